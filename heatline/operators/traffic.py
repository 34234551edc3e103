"""Traffic reports over visits, searches, clicks, events and slots.

Each aggregate is one partial-and-final aggregation; filters on date reach the scan. Windows without a partition run
over rows that are aggregated already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatline.functions.scores import rounded
from heatline.functions.text import strip
from heatline.sources.scratch import written


def since(as_of: Column, days: int, most: int = 90) -> Column:
    """First day of a look-back; it includes both ends, and days is held within 1 to `most`."""
    return F.date_sub(as_of, max(1, min(days, most)))


def recent(df: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return df.filter(F.col("date") >= since(as_of, days))


def overview(visits: DataFrame, as_of: Column, days: int = 30, exact: bool = True) -> DataFrame:
    """Page views and unique visitors, of the period and of its last day; one row."""
    uniq = F.count_distinct if exact else F.approx_count_distinct
    today = F.col("date") == F.to_date(as_of)
    return recent(visits, as_of, days).agg(F.count("*").alias("total_pv"), uniq("ip").alias("total_uv"), F.count_if(today).alias("today_pv"), uniq(F.when(today, F.col("ip"))).alias("today_uv"))


def regions(visits: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Unique visitors by country and their share of the sum, in percent with one decimal."""
    by = recent(visits, as_of, days).groupBy(F.coalesce("country", F.lit("Unknown")).alias("country")).agg(F.count_distinct("ip").alias("visitors"))
    return by.withColumn("pct", rounded(F.col("visitors") * 100.0 / F.sum("visitors").over(Window.partitionBy()), 1))


def daily(visits: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return recent(visits, as_of, days).groupBy("date").agg(F.count("*").alias("pv"), F.count_distinct("ip").alias("uv"))


def latest(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """The n rows with the highest ids: top-k, no full sort."""
    return df.orderBy(F.desc("id")).limit(n).select("id", *cols)


def search_totals(searches: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return recent(searches, as_of, days).agg(F.count("*").alias("total"), F.count_distinct("query").alias("queries"), F.count_if(F.col("date") == F.to_date(as_of)).alias("today"))


def top_queries(searches: DataFrame, as_of: Column, days: int = 30, n: int = 20) -> DataFrame:
    return recent(searches, as_of, days).groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(n)


def funnel(searches: DataFrame, clicks: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Searches and clicks by query, for queries that were searched. Both sides are counts before they meet."""
    s = recent(searches, as_of, days).filter("query <> ''").groupBy("query").agg(F.count("*").alias("searches"))
    c = recent(clicks, as_of, days).filter("query <> ''").groupBy("query").agg(F.count("*").alias("clicks"))
    both = s.join(c, "query", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)))
    return both.withColumn("rate", rounded(F.col("clicks") * 100.0 / F.col("searches"), 1))


def top_funnel(searches: DataFrame, clicks: DataFrame, as_of: Column, days: int = 30, n: int = 15) -> DataFrame:
    return funnel(searches, clicks, as_of, days).orderBy(F.desc("searches"), "query").limit(n)


def funnel_totals(searches: DataFrame, clicks: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return funnel(searches, clicks, as_of, days).agg(F.coalesce(F.sum("searches"), F.lit(0)).alias("total_searches"), F.coalesce(F.sum("clicks"), F.lit(0)).alias("total_clicks"))


def suggest(searches: DataFrame, prefix: str, as_of: Column, n: int = 8) -> DataFrame:
    """Queries of 30 days that hold the prefix (any case, no wild cards): those that begin with it first, then by count."""
    p, low = prefix.strip().lower(), F.lower("query")
    rows = recent(searches, as_of, 30).filter((F.col("query") != "") & low.contains(p) & F.lit(bool(p)))
    return rows.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc(F.lower("query").startswith(p)), F.desc("n"), "query").limit(n)


def suggestions(searches: DataFrame, as_of: Column, n: int = 8, longest: int = 12) -> DataFrame:
    """(typed, rank, query, n): what suggest() gives, for every text of up to `longest` characters that a query of 30 days
    holds, so that a request reads n rows by key instead of the log.

    Queries are counted first. Each distinct one, 80 characters at most, offers its pieces; of a piece's queries the best n
    are kept, in each task before the shuffle too, so a piece that most queries hold is no hot key."""
    asked = recent(searches, as_of, 30).filter("query <> ''").groupBy("query").agg(F.count("*").alias("n"))
    low, at = F.lower("query"), lambda i, k: F.substring(F.lower("query"), i, k)
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(low) - i + 1)), lambda k: at(i, k))))
    each = asked.select("query", "n", F.explode(F.array_distinct(F.transform(pieces, strip))).alias("typed")).filter("typed <> ''")
    best = Window.partitionBy("typed").orderBy(F.desc(F.lower("query").startswith(F.col("typed"))), F.desc("n"), "query")
    return each.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select("typed", "rank", "query", "n")


def events_by_type(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Counts by type, and their total in the row whose type is null, in one pass."""
    return recent(events, as_of, days).rollup("event_type").agg(F.count("*").alias("n"))


def events_by_day(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return recent(events, as_of, days).groupBy("date").agg(F.count("*").alias("n"))


def active_slots(slots: DataFrame, as_of: Column, region: str | None = None) -> DataFrame:
    """Slots on show: active, of the region or of all, within their dates where they have any; in serving order."""
    today = F.to_date(as_of)
    on = F.col("active") & (F.col("start_date").isNull() | (F.col("start_date") <= today)) & (F.col("end_date").isNull() | (F.col("end_date") >= today))
    if region and region != "all":
        on &= F.col("region").isin(region, "all")
    return slots.filter(on).orderBy("sort_order", "created_at", "slot_id")


def slot_counters(log: DataFrame) -> DataFrame:
    """Impressions and clicks by slot and day from the raw log (slot_id, date, kind)."""
    return log.groupBy("slot_id", "date").agg(F.count_if(F.col("kind") == "impression").alias("impressions"), F.count_if(F.col("kind") == "click").alias("clicks"))


def slot_report(slots: DataFrame, stats: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Sums by slot; slots without any stay, so the date test belongs to the join, not to a filter after it. The fact
    side is summed before it meets the slots."""
    sums = stats.filter(F.col("date") >= since(as_of, days)).groupBy("slot_id").agg(F.sum("impressions").alias("i"), F.sum("clicks").alias("c"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return slots.join(sums, "slot_id", "left").select("slot_id", "name", zero("i").alias("impressions"), zero("c").alias("clicks"))


def apply_slot_changes(slots: DataFrame, changes: DataFrame) -> DataFrame:
    """Slots after a change table (slot_id, ts, op upsert|toggle|delete, columns): upserts and deletes by the latest of
    each slot, toggles after it flip `active` by their number."""
    cols = [c for c in slots.columns if c != "slot_id"]
    last = changes.filter("op <> 'toggle'").groupBy("slot_id").agg(F.max_by(F.struct("op", "ts", *cols), "ts").alias("x"))
    flips = changes.filter("op = 'toggle'").join(last.select("slot_id", F.col("x.ts").alias("since")), "slot_id", "left")
    flips = flips.filter(F.col("since").isNull() | (F.col("ts") > F.col("since"))).groupBy("slot_id").agg((F.count("*") % 2 == 1).alias("flip"))
    met = slots.alias("s").join(last, "slot_id", "full").join(flips, "slot_id", "left").filter(F.coalesce(F.col("x.op"), F.lit("")) != "delete")
    new = {c: F.when(F.col("x").isNotNull(), F.col(f"x.{c}")).otherwise(F.col(f"s.{c}")) for c in cols}
    new["active"] = F.when(F.coalesce("flip", F.lit(False)), ~new["active"]).otherwise(new["active"])
    return met.select("slot_id", *(new[c].alias(c) for c in cols))


def drop_deleted(stats: DataFrame, slots: DataFrame) -> DataFrame:
    """Stats of slots that are still there."""
    return stats.join(slots.select("slot_id"), "slot_id", "left_semi")


def _swept(df: DataFrame, *order: Column) -> DataFrame:
    """df in range partitions of the order, as a written table whose rows know their partition (_part), so that a sweep goes
    through each partition on its own and only one value for each is carried over its border."""
    return written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def first_ranges(ranges: DataFrame) -> DataFrame:
    """ranges(lo, hi, country), overlapping at will -> those that count somewhere; where several hold a place, the one that
    begins first counts, then the first by country. In this order a range counts behind the highest end before it, so what
    is left has rising ends."""
    order = [F.col("lo"), F.col("country"), F.col("hi")]
    dealt = _swept(ranges.filter("lo <= hi").select("lo", "hi", "country"), *order)
    ends = dealt.groupBy("_part").agg(F.max("hi").alias("_top"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = ends.select("_part", F.max("_top").over(before).alias("_carried"))
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.withColumn("_before", F.max("hi").over(own)).join(F.broadcast(carried), "_part")
    return met.filter(F.coalesce(F.col("hi") > F.greatest("_before", "_carried"), F.lit(True))).select("lo", "hi", "country")


def country_of(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows(ip_num, header) + country: the header's code first (XX and T1 say nothing), else that of the range that holds the
    number, else Unknown. Numbers and ends may be of any type with an order: longs, or IPv6 addresses as binary.

    A sweep: the distinct numbers and the ends of first_ranges() lie in one order, dealt out by ranges of it, and a number
    takes the next end at or after it. A partition without an end behind a number takes the first one of the partitions
    after it. Wide ranges cost one row each."""
    kept = first_ranges(ranges)
    own = rows.select(F.col("ip_num").alias("at")).filter("at is not null").distinct().withColumn("range", F.lit(None).cast(kept.select(F.struct("lo", "country")).schema[0].dataType))
    dealt = _swept(own.unionByName(kept.select(F.col("hi").alias("at"), F.struct("lo", "country").alias("range"))), F.col("at"))
    first = dealt.groupBy("_part").agg(F.min_by("range", F.when(F.col("range").isNotNull(), F.col("at"))).alias("_first"))
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carried = first.select("_part", F.last("_first", ignorenulls=True).over(later).alias("_carried"))
    back = Window.partitionBy("_part").orderBy(F.desc("at"), F.col("range").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumn("_next", F.last("range", ignorenulls=True).over(back)).join(F.broadcast(carried), "_part").filter("range is null")
    found = met.select(F.col("at").alias("ip_num"), F.coalesce("_next", "_carried").alias("_r")).filter("_r.lo <= ip_num").select("ip_num", F.col("_r.country").alias("_c"))
    said = F.upper(F.trim("header"))
    return rows.hint("merge").join(found, "ip_num", "left").select(*rows.columns, F.coalesce(F.when(~said.isin("", "XX", "T1"), said), "_c", F.lit("Unknown")).alias("country"))


def page_views(visits: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """One row: page views of the last days, 0 without any."""
    return visits.filter(F.col("date") >= since(as_of, days)).agg(F.count("*").alias("views"))


def page_view_counters(visits: DataFrame) -> DataFrame:
    """Page views by day, the counter that a page adds to."""
    return visits.groupBy("date").agg(F.count("*").alias("views"))


#: Fields of a slot in a file.
SLOT = "slot_id string, name string, region string, active boolean, sort_order int, start_date date, end_date date, created_at date"


def slot_files(spark: SparkSession, path: str) -> DataFrame:
    """Slots of JSON files (one slot a line) as rows of SLOT, and for each line that is none a row with `problem` and the line:
    what isn't JSON, what doesn't fit the fields, and slots without an id."""
    lines = spark.read.text(path).filter("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("file"))
    made = lines.select(F.from_json("value", f"{SLOT}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("s"), "value", "file").select("s.*", "value", "file")
    problem = F.when(F.col("_bad").isNotNull(), "no JSON of a slot").when(F.coalesce(F.trim("slot_id"), F.lit("")) == "", "no id")
    return made.withColumn("problem", problem).withColumn("line", F.when(F.col("problem").isNotNull(), F.col("value"))).drop("_bad", "value")


def fallback_slots(spark: SparkSession, path: str, as_of: Column, region: str) -> DataFrame:
    """The slots of files that may be shown, by the filters and the order of the table; slot_files() reports the others."""
    return active_slots(slot_files(spark, path).filter("problem is null").drop("problem", "line", "file"), as_of, region)


def slots_or(slots: DataFrame, fallback: DataFrame) -> DataFrame:
    """The slot table, or the rows of the slot file where the table has none."""
    return fallback.select(*slots.columns) if slots.isEmpty() else slots


def rate_limit(hits: DataFrame, limit: int, window: int = 60) -> DataFrame:
    """hits(bucket, key, ts) -> + allowed, retry_after. A window begins with a key's first hit and ends `window` seconds
    later; hits beyond the limit in it are refused. Empty keys and limits of 0 pass.

    Where a key pauses for a window or longer a fresh window begins in any case, so its hits are cut into runs there,
    and the runs are shuffled apart. A task goes over its runs in order of time and keeps two numbers, the start of the
    window and the hits in it; a key without pauses is one run, sorted on disk if need be."""
    if limit <= 0:
        return hits.withColumns({"allowed": F.lit(True), "retry_after": F.lit(0)})
    free = F.coalesce(F.col("key"), F.lit("")) == ""
    passed = hits.filter(free).select("bucket", "key", "ts", F.lit(True).alias("allowed"), F.lit(0).alias("retry_after"))
    own = Window.partitionBy("bucket", "key").orderBy("ts")
    rows = hits.filter(~free).select("bucket", "key", "ts", F.unix_micros("ts").alias("at"))
    pause = F.coalesce(F.col("at") - F.lag("at").over(own) >= window * 1_000_000, F.lit(True)).cast("int")
    runs = rows.withColumn("pause", pause).withColumn("run", F.sum("pause").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.repartition("bucket", "key", "run").sortWithinPartitions("bucket", "key", "run", "at").select("bucket", "key", "run", "ts", "at")

    def fold(parts):
        of, start, n = None, 0, 0
        for part in parts:
            allowed, wait = [], []
            for run, at in zip(zip(part["bucket"], part["key"], part["run"]), part["at"]):
                if run != of or at - start >= window * 1_000_000:
                    of, start, n = run, at, 0
                ok = n < limit
                n += ok
                allowed.append(ok)
                wait.append(0 if ok else max(1, int(window - (at - start) / 1_000_000) + 1))
            yield part[["bucket", "key", "ts"]].assign(allowed=allowed, retry_after=wait)

    return passed.unionByName(runs.mapInPandas(fold, "bucket string, key string, ts timestamp, allowed boolean, retry_after int"))


def day_deltas(rows: DataFrame, known: DataFrame | None = None, sign: int = 1) -> tuple[DataFrame, DataFrame]:
    """(deltas, visitors): what rows(date, ip) add to their days' page views and unique visitors, and the (date, ip) that
    known(date, ip) doesn't have yet. sign -1 takes rows back; then known are the visitors that stay after it."""
    views = rows.groupBy("date").agg(F.count("*").alias("pv"))
    each = rows.filter("ip is not null").select("date", "ip").distinct()
    new = each if known is None else each.hint("merge").join(known.select("date", "ip"), ["date", "ip"], "left_anti")
    visitors = new.groupBy("date").agg(F.count("*").alias("uv"))
    return views.hint("merge").join(visitors, "date", "left").select("date", (F.col("pv") * sign).alias("pv"), (F.coalesce("uv", F.lit(0)) * sign).alias("uv")), new
