"""Chat formatting with typed content parts, in DataFrame operations only.

A turn is an array of parts (type, text, ref). The visitor goes over the parts in order: text parts give their text,
with control strings escaped; image, audio and document parts give a placeholder of their type and number, record
their reference, and count as many tokens as the type expands to. A conversation is its turns in order:

    <|turn|>role<|body|>parts<|end|>

Escaping puts a backslash after the first character of each control string, and one more where backslashes already
stand there, so undoing it takes exactly one away: it is reversible for every text. Thus a control string in the
output is always the template's own, and the loss mask (bodies of the assistant's turns) can be read back from it.

Null texts and null roles are empty. Turns are in order of turn, then of role and parts as given, so ties have a defined order;
repeated rows are turns of their own. Rows with a null conversation id form one conversation. Other columns are not
read. An empty table gives an empty result. A conversation is one output row, so it has to fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that a part of each type expands to.
TOKENS = {"image": 576, "audio": 750, "document": 1024}
_CONTROL = r"(<|\[)(\\*)(/?s>|/?INST\]|\|[A-Za-z_]+(?::[0-9]+)?\|>)"
_ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\]|\|[A-Za-z_]+(?::[0-9]+)?\|>)"
PART = "array<struct<type:string,text:string,ref:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref")))


def body(parts: Column) -> Column:
    """The parts of a turn flattened: escaped texts and numbered placeholders, in order. Unknown types count as text.

    Neighbouring texts are escaped as one, so no control string can arise where two of them meet."""
    kinds = F.array(*map(F.lit, TOKENS))
    numbered = F.transform(parts, lambda p, i: F.struct(F.coalesce(p["type"], F.lit("text")).alias("type"), F.coalesce(p["text"], F.lit("")).alias("text"), i.cast("string").alias("i")))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))
    placed = lambda s, p: F.concat(s["done"], escape(s["run"]), F.lit("<|"), p["type"], F.lit(":"), p["i"], F.lit("|>"))
    step = lambda s, p: F.when(F.array_contains(kinds, p["type"]), F.struct(placed(s, p).alias("done"), F.lit("").alias("run"))).otherwise(F.struct(s["done"].alias("done"), F.concat(s["run"], p["text"]).alias("run")))
    return F.coalesce(F.aggregate(numbered, start, step, lambda s: F.concat(s["done"], escape(s["run"]))), F.lit(""))


def attachments(parts: Column) -> Column:
    """(type, part, ref, tokens) of the parts that are not text."""
    tokens = F.create_map(*(F.lit(x) for kv in TOKENS.items() for x in kv))
    numbered = F.transform(parts, lambda p, i: F.struct(p["type"].alias("type"), i.alias("part"), p["ref"].alias("ref"), F.try_element_at(tokens, F.coalesce(p["type"], F.lit("text"))).alias("tokens")))
    return F.coalesce(F.filter(numbered, lambda p: p["tokens"].isNotNull()), F.array().cast("array<struct<type:string,part:int,ref:string,tokens:int>>"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """(conv id, formatted, attachments, expanded_tokens): one row per conversation."""
    raw = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.col(parts_col).alias("parts"))
    chats = turns.select(F.col(conv_col), raw.alias("t")).groupBy(conv_col).agg(F.array_sort(F.collect_list("t")).alias("t"))
    chats = chats.withColumn("t", F.transform("t", lambda t: F.struct(escape(t["role"]).alias("role"), body(t["parts"]).alias("body"), attachments(t["parts"]).alias("att"))))
    formatted = F.array_join(F.transform("t", lambda t: F.concat(F.lit("<|turn|>"), t["role"], F.lit("<|body|>"), t["body"], F.lit("<|end|>"))), "")
    found = F.flatten(F.transform("t", lambda t, i: F.transform(t["att"], lambda a: F.struct(i.alias("turn"), a["type"].alias("type"), a["part"].alias("part"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = chats.select(conv_col, formatted.alias("formatted"), found.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation, as array of (role, text, loss), texts unescaped; placeholders stay."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda t: t != "")
    cut = F.transform(turns, lambda t: F.split(F.regexp_replace(t, r"<\|end\|>\z", ""), r"<\|body\|>", -1))
    return F.transform(cut, lambda t: F.struct(unescape(F.get(t, F.lit(0))).alias("role"), unescape(F.get(t, F.lit(1))).alias("text"), (unescape(F.get(t, F.lit(0))) == "assistant").alias("loss")))


def mask(formatted: Column) -> Column:
    """The loss mask: (start, length) in code points of each assistant body in the formatted text."""
    lengths = F.transform(F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda t: t != ""), lambda t: F.struct(F.char_length(t).alias("n"), F.char_length(F.get(F.split(t, r"<\|body\|>", -1), F.lit(0))).alias("role"), t.startswith("assistant<|body|>").alias("loss")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda s, t: F.struct((s["at"] + 8 + t["n"]).alias("at"), F.when(t["loss"], F.array_append(s["spans"], F.struct((s["at"] + 8 + t["role"] + 8).alias("start"), (t["n"] - t["role"] - 15).alias("length")))).otherwise(s["spans"]).alias("spans"))
    return F.aggregate(lengths, empty, step, lambda s: s["spans"])


def masked(formatted: Column) -> Column:
    """All text under the loss mask, unescaped: the assistant texts in order with nothing between."""
    return F.array_join(F.transform(mask(formatted), lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")
