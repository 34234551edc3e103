"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is its words between ASCII white space. Of lines that are equal only the earliest stays (by document id, then
place); a line of at least `near_words` words also goes if an earlier one lies within one word edit of it (a word put
in, left out or changed), whether that one stays or not. One edit in five words is a similarity of 0.8, so shorter lines
have no near ones. Lines without words always stay.

Two lines are within one edit if and only if one becomes the other by leaving out a word, or both become the same by
leaving out a word at the same place. So each line emits hashed keys of itself and of all its one-word deletions; equal
keys meet, and the earliest line of a key is found by grouped minima: no pairs of a group are formed. The hash of a
sequence is the exclusive or of hash(word, place), so the deletions of a line come from running sums in linear time,
for lines of any length. Each line that is to go is verified word by word against its earlier neighbour.

To keep the neighbourhoods small, only lines that share the first or the last half of their words with another line
emit them: one edit leaves the first or the last half of the shorter line as it is, so no pair is lost.

A document is known by its file and its place in that file; input that isn't read straight from files is written first.
Of the lines that repeat, those with a thousandth of all lines or more each are at most a thousand, so they are
broadcast; a key of the join has less than that.

Null texts stay null, empty ones empty; a document may end up empty, but it stays. Documents with null ids come first
in the order. Repeated rows are documents of their own, so the later one loses its lines. All columns are kept, whatever
their names (the count takes the name that is asked for). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatline.llm.common import SPACES, Scratch

NEAR_WORDS = 5


def single_spaced(line: Column) -> Column:
    """The words of a line with a single space between them."""
    plain = ~(line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c") | line.startswith(" ") | line.endswith(" "))
    return F.when(plain, line).otherwise(F.trim(F.regexp_replace(line, SPACES, " ")))


def _halves(line: Column, n: Column) -> list[Column]:
    """Hashes of the first and last floor(m/2) words for m = n and m = n - 1; the latter null where they'd repeat."""
    h, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    cut = lambda k: F.call_function("substring_index", line, F.lit(" "), k)
    pair = lambda k: [F.xxhash64(F.lit("first"), cut(k)), F.xxhash64(F.lit("last"), cut(-k))]
    return [*pair(h), *(F.when(less < h, x) for x in pair(less))]


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(f, r, id, text, doc): documents with their file's hash and their place in it."""
    at = docs.metadataColumn("_metadata")
    rest = F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != text_col))
    return docs.select(F.xxhash64(at["file_path"]).alias("f"), at["row_index"].alias("r"), docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), rest.alias("doc"))


def _has_places(docs: DataFrame) -> bool:
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
        return True
    except AnalysisException:
        return False


def repeated_lines(placed: DataFrame, scratch: Scratch, near_words: int = NEAR_WORDS) -> DataFrame:
    """placed(f, r, id, text) -> (f, r, pos) of the lines that go."""
    split = placed.select("f", "r", "id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("f", "r", "id", "pos", single_spaced(F.col("line")).alias("line")).filter("line != ''")
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = split.select("f", "r", "id", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit("second"), "line").alias("k2"), n.cast("int").alias("n"), "line")
    halves = [F.when(F.col("n") >= near_words, x).alias(f"h{i}") for i, x in enumerate(_halves(F.col("line"), F.col("n")))]
    lines = scratch.write(lines.select("f", "r", "id", "pos", "k1", "k2", *halves, F.when(F.col("n") >= near_words, F.col("line")).alias("line")), "lines")
    at = F.struct("id", "f", "r", "pos")
    firsts = scratch.write(lines.groupBy("k1", "k2").agg(F.min(at).alias("at"), F.count("*").alias("times"), *(F.any_value(f"h{i}").alias(f"h{i}") for i in range(4))), "firsts")

    half = firsts.select("k1", "k2", F.explode(F.array_compact(F.array(*(f"h{i}" for i in range(4))))).alias("h"))
    shared = half.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    near = half.hint("merge").join(shared, "h", "left_semi").select("k1", "k2").distinct()
    near = near.hint("merge").join(firsts.select("k1", "k2", "at"), ["k1", "k2"])
    place = scratch.write(near.select("k1", "k2", "at", *(F.col("at")[c].alias(c) for c in ("f", "r", "pos"))), "place")
    keys = ["k1", "k2", "f", "r", "pos"]
    near = lines.select(*keys, "line").join(place.hint("shuffle_hash"), keys).select("k1", "k2", "at", F.split("line", " ").alias("w"))
    near = scratch.write(near, "near")
    scratch.drop("place")

    each = near.select("k1", "k2", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    each = each.select("k1", "k2", "n", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("moved"))
    line = "partition by k1, k2"
    upto = f"({line} order by i rows between unbounded preceding and current row)"
    each = each.select("k1", "k2", "n", "i", "here", F.expr(f"bit_xor(here) over {upto}").alias("before"), F.expr(f"bit_xor(moved) over ({line}) ^ bit_xor(moved) over {upto}").alias("after"), F.expr(f"bit_xor(here) over ({line})").alias("whole"))
    one = F.struct(F.col("i").cast("int").alias("i"), F.xxhash64(F.expr("before ^ here ^ after"), F.col("n") - 1).alias("key"))
    self = F.struct(F.lit(-1).alias("i"), F.xxhash64("whole", "n").alias("key"))
    keys = scratch.write(each.select("k1", "k2", F.explode(F.when(F.col("i") == 0, F.array(one, self)).otherwise(F.array(one))).alias("x")).select("k1", "k2", "x.*"), "keys")
    # a key of one line alone links nothing; k1 tells lines apart here, at worst a link of two with equal k1 is lost
    met = keys.groupBy("key").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).filter("a < b").select("key")
    met = scratch.write(keys.hint("merge").join(met, "key", "left_semi").hint("merge").join(near.select("k1", "k2", "at"), ["k1", "k2"]), "met")
    scratch.drop("keys")

    me = F.struct("at", "k1", "k2")
    same = met.groupBy("key", "i").agg(F.min(me).alias("least"))  # lines that are equal but for the word at one place
    by_key = same.groupBy("key").agg(F.min("least").alias("any"), F.min(F.when(F.col("i") == -1, F.col("least"))).alias("whole"))
    other = F.when(F.col("i") == -1, F.col("any")).otherwise(F.least("least", "whole"))
    least = same.hint("merge").join(by_key, "key").select("key", "i", other.alias("other"))
    found = met.hint("merge").join(least, ["key", "i"]).filter(F.col("other.at") < F.col("at")).groupBy("k1", "k2").agg(F.min("other").alias("other"))
    left = found.hint("merge").join(near.select("k1", "k2", F.col("w").alias("a")), ["k1", "k2"]).select("k1", "k2", "a", F.col("other.k1").alias("o1"), F.col("other.k2").alias("o2"))
    right = near.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("w").alias("b"))
    gone = left.hint("merge").join(right, ["o1", "o2"]).filter(_one_edit(F.col("a"), F.col("b"))).select("k1", "k2", F.lit(True).alias("gone"))

    told = firsts.select("k1", "k2", "at", "times").hint("merge").join(gone, ["k1", "k2"], "left").filter("times > 1 or gone")
    told = scratch.write(told.withColumn("gone", F.coalesce("gone", F.lit(False))), "told")
    total = firsts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    scratch.drop("near", "met", "firsts")
    hot = told.filter(F.col("times") * 1000 >= total)
    lines = lines.select("k1", "k2", "f", "r", "pos")
    rest = lines.hint("merge").join(told.filter(F.col("times") * 1000 < total), ["k1", "k2"])
    both = rest.unionByName(lines.join(F.broadcast(hot), ["k1", "k2"]))
    return scratch.write(both.filter((F.col("f") != F.col("at.f")) | (F.col("r") != F.col("at.r")) | (F.col("pos") != F.col("at.pos")) | F.col("gone")).select("f", "r", "pos"), "gone")


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are within one edit: their common start and end leave at most one word of either."""

    def common(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(at == 0, F.size(x)).otherwise(at - 1)

    most = F.greatest(F.size(a), F.size(b))
    return common(a, b) + common(F.reverse(a), F.reverse(b)) >= most - 1


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS, from_files: bool = False, count_col: str | None = "n_dropped") -> DataFrame:
    """docs with the repeated lines taken out of their texts, and the number of those as count_col, if that is named.

    from_files: docs is a plain read of files, which aren't changed meanwhile; else, or if it comes from no file after
    all, it is written first."""
    if count_col in docs.columns:
        raise ValueError(f"docs has a column {count_col}; name another count_col, or None")
    scratch = Scratch(docs.sparkSession, "lines")
    if not from_files or not _has_places(docs):
        docs = scratch.write(docs, "documents")
    placed = _placed(docs, id_col, text_col)
    gone = repeated_lines(placed, scratch, near_words).groupBy("f", "r").agg(F.collect_list("pos").alias("gone"))
    scratch.drop("lines", "told")
    both = placed.join(gone.hint("shuffle_hash"), ["f", "r"], "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    cols = [text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns]
    return both.select(*cols, *([F.coalesce(F.size("gone"), F.lit(0)).alias(count_col)] if count_col else []))
