"""Ingest of behaviour logs: the same validation for batch and streaming frames. No shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatline.functions.text import blank_to_null, strip

# Event types that are accepted.
EVENT_TYPES = ("page_view", "click", "search", "word_expand", "word_detail", "view_switch", "lang_switch", "sort_switch", "cat_filter", "link_click", "search_click", "hf_entry_click")
BATCH = 50


def _country(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("Unknown"))


def reason(kind: str, types: tuple[str, ...] = EVENT_TYPES) -> Column:
    """Why a raw row of a log (visits, searches, clicks, events) isn't taken; null if it is."""
    empty = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    if kind == "visits":
        return F.when(F.coalesce(F.col("ip"), F.lit("")) == "", "no ip")
    if kind == "searches":  # braces: templates that a crawler took as they are
        return F.when(empty(F.col("query")), "no query").when(F.contains("query", F.lit("{")) | F.contains("query", F.lit("}")), "template")
    if kind == "clicks":
        return F.when(empty(F.col("query")), "no query")
    return F.when(~F.coalesce(strip(F.col("event_type")).isin(*types), F.lit(False)), "event type")


def shaped(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of a log as they are stored: trimmed, cut to length, with a country."""
    cut = lambda c, n: F.substring(strip(F.coalesce(c, F.lit(""))), 1, n)
    out = rows.withColumn("country", _country(F.col("country")))
    if kind == "searches":
        return out.withColumn("query", cut("query", 80))
    if kind == "clicks":
        return out.withColumns({"query": cut("query", 80), "url": cut("url", 500)})
    if kind == "events":
        return out.withColumns({"event_type": strip("event_type"), "event_data": F.substring("event_data", 1, 2000), "session_id": F.substring(F.coalesce("session_id", F.lit("")), 1, 64), "path": F.substring(F.coalesce("path", F.lit("")), 1, 200)})
    return out


def visits(raw: DataFrame) -> DataFrame:
    """Visits with an ip; the country defaults to Unknown."""
    return shaped(raw.filter(reason("visits").isNull()), "visits")


def searches(raw: DataFrame) -> DataFrame:
    """Searches that aren't empty and hold no braces, cut to 80 characters."""
    return shaped(raw.filter(reason("searches").isNull()), "searches")


def clicks(raw: DataFrame) -> DataFrame:
    return shaped(raw.filter(reason("clicks").isNull()), "clicks")


def events(raw: DataFrame, types: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """Single events (event_type, event_data, session_id, path, ...): allowed types only; payload, session and path cut."""
    return shaped(raw.filter(reason("events", types).isNull()), "events")


def event_batches(raw: DataFrame, types: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """Landed batches with events ARRAY<STRUCT<event_type, event_data>>: the first BATCH of each, one row per event."""
    one = raw.withColumn("e", F.explode(F.slice("events", 1, BATCH)))
    return events(one.withColumns({"event_type": F.col("e.event_type"), "event_data": F.col("e.event_data")}).drop("events", "e"), types)


def judged(lines: DataFrame, kind: str, schema: str) -> DataFrame:
    """Landed lines of JSON (value) -> the stored columns, with status (accepted or rejected), reason, the raw line of what
    was rejected, and date. Every line, and every event of a batch, gives one row: what is no JSON of the schema, what the
    log's rule refuses, and events beyond BATCH are rejected with their reason. schema: fields of a line; for kind batches
    with events, an array of event_type and event_data."""
    raw = lines.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "value").select("r.*", "value")
    late = F.lit(None).cast("string")
    if kind == "batches":
        raw = raw.select("*", F.posexplode_outer("events").alias("_at", "_e"))
        raw = raw.withColumns({"event_type": F.col("_e.event_type"), "event_data": F.col("_e.event_data")})
        late = F.when(F.col("_e").isNull(), "no events").when(F.col("_at") >= BATCH, "over the batch's limit")
        raw, kind = raw.withColumn("_late", late).drop("events", "_at", "_e"), "events"
        late = F.col("_late")
    why = F.when(F.col("_bad").isNotNull() | F.col("value").isNull() | (F.trim("value") == ""), "malformed").otherwise(F.coalesce(late, reason(kind)))
    rows = shaped(raw.withColumn("reason", why), kind)
    return rows.withColumns({"status": F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"), "raw": F.when(F.col("reason").isNotNull(), F.coalesce("value", F.lit(""))), "date": F.to_date("ts")}).drop("value", "_bad", "_late")


def parsed_data(data: Column) -> Column:
    """Event data as a variant; what is no JSON stays as its text."""
    return F.coalesce(F.try_parse_json(data), F.parse_json(F.to_json(F.struct(data.alias("raw")))))
