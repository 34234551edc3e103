"""Which texts hold which surfaces: an inverted-index join in place of every text against every surface.

An ASCII surface matches at word boundaries, in any case, and not before `.digit` (so a later version is no hit). Its
alphanumeric runs are its anchors: the boundaries force each to be a whole run of the text, so the equi-join of
runs and anchors loses no match, and the pattern is verified on what it brings. A surface with other characters matches
as a substring; its anchors are its pairs of characters with such a one, met by the text's pairs. Of several anchors the one
that the fewest texts offer is taken. Surfaces without an anchor (one character, or no alphanumeric) have their first character for one, met by the text's characters. Only keys and
anchors move through that join; the texts meet what it finds. A surface that is one run needs no text: the text says with
each run whether it stands there but before `.digit`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern(surface: Column) -> Column:
    """Java pattern of an ASCII surface."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(surface, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.concat(F.lit(r"(?i)(?<![a-z0-9])"), quoted, F.lit(r"(?!\.\d)(?![a-z0-9])"))


def hit(text: Column, surface: Column) -> Column:
    """The exact test."""
    ascii_ = surface.rlike(r"^[\x00-\x7F]+$")
    return F.when(ascii_, F.regexp_like(text, pattern(surface))).otherwise(F.lower(text).contains(F.lower(surface)))


def anchors_of(surface: Column) -> Column:
    """Distinct anchors that any text with the surface offers: each alphanumeric run of an ASCII surface, as what bounds a
    run inside it bounds it in the text too; each pair of characters with a non-ASCII one of another surface."""
    low = F.lower(surface)
    runs = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1)
    pairs = F.when(F.length(low) >= 2, F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(surface.rlike(r"^[\x00-\x7F]+$"), runs).otherwise(F.filter(pairs, lambda p: ~p.rlike(r"^[\x00-\x7F]+$"))))


def rarest_anchors(surfaces: DataFrame, offered: DataFrame) -> DataFrame:
    """surfaces(..., surface) + anchor: of each surface's anchors the one that the fewest texts offer, so that a frequent word
    in a name doesn't bring every text that has it. offered(anchor): what the texts offer, a row for each text. Surfaces with
    an anchor that no text offers match nothing and go; those without anchors get null."""
    forms = surfaces.filter(F.coalesce(F.trim("surface"), F.lit("")) != "").withColumn("_all", anchors_of(F.col("surface")))
    own = forms.columns[:-1]
    several = forms.filter(F.size("_all") > 1).select(*own, F.explode("_all").alias("anchor"))
    wanted = several.select("anchor").distinct()
    texts = offered.hint("merge").join(wanted, "anchor", "left_semi").groupBy("anchor").agg(F.count("*").alias("_n"))
    met = several.hint("merge").join(texts, "anchor", "left")
    best = met.groupBy(*own).agg(F.min_by("anchor", F.struct(F.coalesce("_n", F.lit(0)), "anchor")).alias("anchor"), F.min(F.coalesce("_n", F.lit(0))).alias("_least")).filter("_least > 0").drop("_least")
    return best.unionByName(forms.filter(F.size("_all") <= 1).select(*own, F.get("_all", F.lit(0)).alias("anchor")))


def text_anchors(text: Column) -> Column:
    """Distinct (anchor, whole) that a text offers: its alphanumeric runs, and its two-character pieces with a non-ASCII one.
    whole: a run that stands somewhere but before `.digit`, so that a surface that is this run is a hit."""
    runs = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda w: F.lower(w)))
    pairs = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=([^\x00-\x7F].|[\x00-\x7F][^\x00-\x7F]))"), 1))
    each = lambda values, whole: F.transform(values, lambda a: F.struct(a.alias("anchor"), F.lit(whole).alias("whole")))
    whole = runs(r"([A-Za-z0-9]++)(?!\.\d)")
    part = F.when(text.rlike(r"[A-Za-z0-9]\.\d"), F.array_except(runs("([A-Za-z0-9]+)"), whole)).otherwise(F.array().cast("array<string>"))
    return F.concat(each(whole, True), each(part, False), each(pairs, False))


def matches(texts: DataFrame, surfaces: DataFrame, key: str, text: str = "text", by: tuple[str, ...] = ("canon",), cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """texts(key, text) and surfaces(by..., surface) -> distinct (key, by...). cut may write a table and read it back: the
    anchors of the texts, which several sides use."""
    rows = texts.select(F.col(key), F.col(text).alias("_text")).filter("_text is not null")
    offered = cut(rows.select(key, F.inline(text_anchors(F.col("_text")))))
    # one run: no text is looked at
    one = F.col("surface").rlike(r"\A[A-Za-z0-9]+\z")
    runs = surfaces.filter(one).select(*by, F.lower("surface").alias("anchor")).distinct()
    sure = offered.filter("whole").select(key, "anchor").hint("merge").join(runs, "anchor").select(key, *by)
    offered = offered.select(key, "anchor")
    forms = rarest_anchors(surfaces.filter(~one).select(*by, "surface").distinct(), offered)
    met = offered.hint("merge").join(forms.filter("anchor is not null"), "anchor").select(key, *by, "surface")
    bare = forms.filter("anchor is null").withColumn("anchor", F.lower(F.substring("surface", 1, 1)))
    if not surfaces.filter(F.size(anchors_of(F.col("surface"))) == 0).isEmpty():
        letters = rows.select(key, F.explode(F.array_distinct(F.split(F.lower("_text"), ""))).alias("anchor"))
        met = met.union(letters.hint("merge").join(bare, "anchor").select(key, *by, "surface"))
    found = met.distinct().hint("merge").join(rows, key)
    return found.filter(hit(F.col("_text"), F.col("surface"))).select(key, *by).union(sure).distinct()


def title_matches(cards: DataFrame, surfaces: DataFrame, key: str = "url", fields: tuple[str, ...] = ("title", "title_zh", "title_en"), by: tuple[str, ...] = ("canon",), cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Distinct (key, by...) where any of the title fields holds a surface."""
    titles = cards.select(key, F.explode(F.array_distinct(F.array_compact(F.array(*fields)))).alias("text"))
    return matches(titles, surfaces, key, by=by, cut=cut)


def term_surfaces(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """terms(canon) -> (canon, surface): the term, its dictionary spellings, and those with other separators."""
    known = terms.hint("merge").join(lexicon.select("canon", "surface"), "canon", "left")
    own = F.array_compact(F.array("canon", "surface"))
    each = known.select("canon", F.explode(own).alias("s"))
    forms = F.when(F.col("s").rlike(r"[^\x00-\x7F]"), F.array("s")).otherwise(F.array("s", F.replace("s", F.lit("-"), F.lit(" ")), F.replace("s", F.lit("-"), F.lit("")), F.replace("s", F.lit(" "), F.lit("-"))))
    return each.select("canon", F.explode(forms).alias("surface")).filter("surface <> ''").distinct()


def model_surfaces(models: DataFrame) -> DataFrame:
    """models(canon, term, full_id) -> (canon, surface): display name, last part of the id, canonical name."""
    return models.select("canon", F.explode(F.array_distinct(F.array_compact(F.array("term", F.element_at(F.split("full_id", "/"), -1), "canon")))).alias("surface")).filter("surface <> ''")


def original_case(keyword: Column, text: Column) -> Column:
    """A keyword as the text writes it, with hyphens and spaces in any mix; itself if the text doesn't have it."""
    parts = F.transform(F.split(keyword, "[- ]"), lambda p: F.concat(F.lit(r"\Q"), p, F.lit(r"\E")))
    near = F.concat(F.lit(r"(?i)(?<![a-z0-9])("), F.array_join(parts, "[- ]"), F.lit(r")(?!\.\d)(?![a-z0-9])"))
    return F.when(keyword.rlike("[A-Za-z]"), F.coalesce(F.nullif(F.call_function("regexp_extract", text, near, F.lit(1)), F.lit("")), keyword)).otherwise(keyword)


def dictionary_keywords(cards: DataFrame, lexicon: DataFrame, stopwords: list[str], key: str = "url", title: str = "title", most: int = 3) -> DataFrame:
    """(key, keywords): dictionary terms in the title, ASCII hits before others, each in dictionary order (lexicon's no);
    stopwords out, as the title writes them."""
    from pyspark.sql import Window

    text = cards.select(F.col(key), F.col(title).alias("_t"))
    class_ = F.when(F.col("is_ascii"), 0).otherwise(1).alias("class")
    met = matches(text, lexicon.select("canon", "surface", class_, "no"), key, "_t", by=("canon", "class", "no"))
    one = met.filter(~F.col("canon").isin(stopwords)).groupBy(key, "canon").agg(F.min(F.struct("class", "no")).alias("at"))
    first = Window.partitionBy(key).orderBy("at", "canon")
    kept = one.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).hint("merge").join(text, key)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", original_case(F.col("canon"), F.col("_t")).alias("k")))), lambda x: x["k"]).alias("keywords"))
