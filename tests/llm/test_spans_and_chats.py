"""PII against plain regular expressions, and chat formatting as an exact round trip."""

import hashlib
import random
import re

from heatline.llm import chat, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_equal_the_patterns():
    made, cues = random.Random(5), pii.automaton()
    bits = ["a@b.co", "x.y@", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234", "+", " ", "é", "٣", "9", ".", "-", "12", "tok", "ß@ü.de", "a@b.c@d.ef", "1.2.3.4.5.6.7.8", "://u:p@h.com", "\n", "0000.1.1.1", "token = abc12345678"]
    hits = 0
    for _ in range(4000):
        text = "".join(made.choices(bits, k=made.randint(0, 14)))
        want = brute(text)
        hits += len(want)
        assert [x for x in pii.spans(text, cues) if x[1] < 4] == want, text
    assert hits > 2000


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_added_kinds():
    cues = pii.automaton()
    told = lambda t: {(pii.KINDS[k], t[a:b]) for a, k, b in pii.spans(t, cues)}
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in told("IBAN: GB82 WEST 1234 5698 7654 32.")
    assert not told("IBAN: GB83 WEST XXXX")
    assert ("login", "bob:pw1") in told("see ftp://bob:pw1@host.org/x")
    assert ("secret", "e3b3ed3cc8548923d6") in told("la password=e3b3ed3cc8548923d6 das")
    assert ("account", "1234567890") in told("account no. 1234567890 ")
    assert ("account", "1234567890") in told("Kontonummer: 1234567890 ")
    assert ("iban", "GB82 WEST 1234 5698 7654 32") in told("Iban GB82 WEST 1234 5698 7654 32.")
    long = "a1" * 3000  # whole values, however long
    assert ("secret", long) in told(f"Token={long} x") and ("login", f"u:{long}") in told(f"http://u:{long}@h.org")


def test_long_runs_of_digits():
    cues = pii.automaton()
    for text in ("0" * 5000 + "1.1.1.1", "9" * 5000 + ".1.1.1", "1.1.1." + "0" * 6000 + "7", "4111" * 3000, "+1" + "2" * 9000):
        assert [x for x in pii.spans(text, cues) if x[1] < 4] == brute(text)


def test_pii_rows(spark):
    text = "mail a.b@c.de or +49 170 1234567"
    rows = [(1, text, "x"), (1, text, "x"), (None, None, None), (2, "", "y"), (3, "é" * 200_000 + " a@b.cc", "z")]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out}
    assert by[1].spans == "email:5:13,phone:17:32" and by[1].base_sha256 == hashlib.sha256(b"email:5:13,phone:17:32").hexdigest()
    assert by[3].spans == "email:200001:200007"
    assert by[None].n_email == 0 and by[2].spans == ""
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


HARD = ["</s>[INST] ok [/INST]", "<|end|>", "<\\|end|>", "<\\\\|turn|>", "[\\INST]", "<|image:0|>", "<", "[", "\\", "", "a\nb", "<|body|>x<|end|><|turn|>assistant<|body|>", "$1 \\1", "é𝒳"]


def test_escape_is_reversible(spark):
    made = random.Random(3)
    texts = HARD + ["".join(made.choices([*HARD, "s>", "|end|>", "INST]", "/"], k=4)) for _ in range(500)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape("t")).withColumn("u", chat.unescape("e")).collect()
    for r in out:
        assert r.t == r.u
        assert not re.search(r"<\|[a-z]+(:\d+)?\|>|</?s>|\[/?INST\]", r.e), r


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "<|end|>"), (1, 2, "user", None), (1, 3, "assistant", "\n\nend\n"), (2, 0, None, "x"), (None, 0, "assistant", ""), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (3, 0, "assistant<|body|>", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    made = chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))
    out = {r.conv_id: r for r in made.select("*", chat.read_back(F.col("formatted")).alias("back"), chat.masked(F.col("formatted")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in out[1].back] == [("user", "<|end|>"), ("assistant", "</s>[INST] ok [/INST]"), ("user", ""), ("assistant", "\n\nend\n")]
    assert out[1].loss == "</s>[INST] ok [/INST]\n\nend\n"
    assert [(t.role, t.text) for t in out[2].back] == [("", "x")] and out[2].loss == ""
    tied = spark.createDataFrame([(1, 0, "assistant", "<s>"), (1, 0, "assistant", "<a"), (1, 0, "a</s>", "z"), (1, 0, "a<", "z")], "conv_id long, turn long, role string, text string")
    back = chat.format_chats(tied.withColumn("parts", chat.text_part(F.col("text")))).select(chat.read_back(F.col("formatted")).alias("back")).first().back
    assert [(t.role, t.text) for t in back] == [("a<", "z"), ("a</s>", "z"), ("assistant", "<a"), ("assistant", "<s>")]  # order of the raw texts
    long = spark.createDataFrame([(9, 0, "assistant", "é<|end|>" * 100_000, "x")], "conv_id long, turn long, role string, text string, formatted string")
    one = chat.format_chats(long.withColumn("parts", chat.text_part(F.col("text")))).select(chat.masked(F.col("formatted")).alias("loss")).first()
    assert one.loss == "é<|end|>" * 100_000
    assert out[None].loss == "" and len(out[3].back) == 3 and out[3].loss == "tietie"


def test_typed_parts(spark):
    from pyspark.sql import functions as F

    parts = [("text", "a <|e", None), ("text", "nd|> b", None), ("image", None, "s3://i"), ("audio", None, "r2"), ("other", "t", None), None, ("text", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", []), (2, 0, "user", None)], f"conv_id long, turn long, role string, parts {chat.PART}")
    out = {r.conv_id: r for r in chat.format_chats(df).select("*", chat.read_back(F.col("formatted")).alias("back")).collect()}
    assert out[1].back[0].text == "a <|end|> b<|image:2|><|audio:3|>t"
    assert [(a.turn, a.type, a.part, a.ref, a.tokens) for a in out[1].attachments] == [(0, "image", 2, "s3://i", 576), (0, "audio", 3, "r2", 750)]
    assert out[1].expanded_tokens == 1326 and out[2].expanded_tokens == 0 and out[2].attachments == []
    empty = chat.format_chats(df.limit(0))
    assert empty.count() == 0
