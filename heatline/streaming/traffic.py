"""Live traffic: counters, unique visitors, limits and session trails over event streams.

Rows later than the watermark are dropped by Spark. State is keyed and bounded: counters by open windows, visitors by day,
limits by a timer that clears a key after its window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_landed(spark, path: str, schema, fmt: str = "parquet", files: int = 1000) -> DataFrame:
    """New files of a landing folder, some at a time."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def daily_views(visits: DataFrame, late: str = "1 day") -> DataFrame:
    """Page views by day, and unique visitors by a sketch."""
    return visits.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("pv"), F.approx_count_distinct("ip").alias("uv_about")).select(F.to_date("w.start").alias("date"), "pv", "uv_about")


def daily_visitors(visits: DataFrame, late: str = "1 day") -> DataFrame:
    """Exact unique visitors by day: first hit of each visitor and day, then a count."""
    first = visits.withColumn("day", F.to_date("ts")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["ip", "day"])
    return first.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("uv")).select(F.to_date("w.start").alias("date"), "uv")


def slot_counters(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Impressions and clicks by slot and day, updated as they come."""
    return log.withWatermark("ts", late).groupBy("slot_id", F.window("ts", "1 day").alias("w")).agg(F.count_if(F.col("kind") == "impression").alias("impressions"), F.count_if(F.col("kind") == "click").alias("clicks")).select("slot_id", F.to_date("w.start").alias("date"), "impressions", "clicks")


def term_activity(mentions: DataFrame, late: str = "2 days") -> DataFrame:
    """mentions(term, ts) -> mentions in the eight days that end with each day."""
    w = F.window("ts", "8 days", "1 day")
    return mentions.withWatermark("ts", late).groupBy("term", w.alias("w")).agg(F.count("*").alias("n")).select("term", F.date_sub(F.to_date("w.end"), 1).alias("day"), "n")


def with_cycle(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """The hour of a row as the cycle key; the session's zone must be fixed."""
    return rows.withColumn("cycle", F.date_format(ts, "yyyy-MM-dd-HH"))


def ingest(lines: DataFrame, kind: str, schema: str, path: str, checkpoint: str):
    """Landed lines of a log into one table by status and day: accepted rows as the batch readers give them, and a quarantine
    of rejected ones with the reason and the raw line. One exactly-once file sink holds both, so after any restart every
    landed row is in it once."""
    from heatline.sources.traffic import judged

    made = judged(lines, kind, schema)
    return made.writeStream.format("parquet").partitionBy("status", "date").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_days(visits: DataFrame, path: str, checkpoint: str, late_s: int = 86_400):
    """Visits (ts, ip) into signed daily counters in a store: each micro-batch adds its page views and new visitors to their
    days. The watermark is the latest time of the batches before, less late_s. A row of a day that had ended by then is late:
    it goes to a side table, from which correct_days() makes corrections, so closed days change only there."""
    from heatline.operators.traffic import day_deltas
    from heatline.sources import store

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        commit = store.Commit(spark, path)
        top = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
        if commit.before.notes.get("batch", -1) >= number or top is None:
            return
        seen = commit.before.notes.get("top")
        day = F.to_date("ts")
        closed = F.lit(False) if seen is None else F.unix_micros(F.date_add(day, 1).cast("timestamp")) <= F.lit(seen - late_s * 1_000_000)
        rows = batch.filter("ts is not null").withColumns({"date": day, "_late": closed})
        _add(spark, commit, path, rows.filter("not _late").drop("_late"), "stream", str(number), day_deltas)
        commit.put("late", rows.filter("_late").drop("_late"), str(number))
        commit.publish(batch=number, top=top if seen is None else max(seen, top))

    return visits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _add(spark, commit, path, rows, kind, part, day_deltas) -> None:
    from heatline.sources import store

    known = store.table(spark, path, commit.before, "visitors")
    deltas, new = day_deltas(rows, known)
    commit.put("deltas", deltas.withColumn("kind", F.lit(kind)), f"{kind}-{part}")
    commit.put("visitors", new, f"{kind}-{part}")


def correct_days(spark, path: str) -> int:
    """Turns the late rows so far into corrections of their days, in one commit, and folds the deltas into one row for each
    day and kind. Returns the number of late batches taken; a run after a crash takes them anew, and none twice."""
    from heatline.operators.traffic import day_deltas
    from heatline.sources import store

    commit = store.Commit(spark, path)
    parts = list(commit.before.tables.get("late", {"parts": {}})["parts"])
    if parts:
        _add(spark, commit, path, store.table(spark, path, commit.before, "late"), "correction", str(commit.next.number), day_deltas)
        commit.drop_parts("late", parts)
        folded = store.table(spark, path, commit.next, "deltas").groupBy("date", "kind").agg(F.sum("pv").alias("pv"), F.sum("uv").alias("uv")).select("date", "pv", "uv", "kind")
        old = list(commit.next.tables["deltas"]["parts"])
        commit.put("deltas", folded, "folded")
        commit.drop_parts("deltas", [p for p in old if p != "folded"])
        commit.publish(**commit.before.notes)
    return len(parts)


def day_counters(spark, path: str) -> DataFrame:
    """(date, pv, uv) as of the newest commit."""
    from heatline.sources import store

    deltas = store.table(spark, path, store.newest(spark, path), "deltas")
    return deltas.groupBy("date").agg(F.sum("pv").alias("pv"), F.sum("uv").alias("uv")).filter("pv <> 0 or uv <> 0")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Trails of a session id, closed by a gap."""
    return events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.count_distinct("path").alias("paths") if not events.isStreaming else F.approx_count_distinct("path").alias("paths")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "paths")


class Limiter(StatefulProcessor):
    """Fixed window per key, begun by its first hit; a timer clears it, so idle keys hold no state."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "start double, n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, n = self.state.get() if self.state.exists() else (None, 0)
        frame = pd.concat(list(rows)).sort_values("ts")
        allowed, wait = [], []
        for ts in frame["ts"]:
            t = ts.timestamp()
            if not key[1] or self.limit <= 0:
                allowed.append(True)
                wait.append(0)
                continue
            if start is None or t - start >= self.window:
                start, n = t, 0
            ok = n < self.limit
            n += ok
            allowed.append(ok)
            wait.append(0 if ok else max(1, int(self.window - (t - start)) + 1))
        if start is not None:
            self.state.update((start, n))
            self.handle.registerTimer(int((start + self.window) * 1000))
        yield pd.DataFrame({"bucket": key[0], "key": key[1], "ts": frame["ts"], "allowed": allowed, "retry_after": wait})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[0] + self.window <= timerValues.getCurrentWatermarkInMs() / 1000:
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def rate_limit(hits: DataFrame, limit: int, window: int = 60, late: str = "1 minute") -> DataFrame:
    """hits(bucket, key, ts) -> + allowed, retry_after; needs the RocksDB state store."""
    return hits.withWatermark("ts", late).groupBy("bucket", "key").transformWithStateInPandas(Limiter(limit, window), "bucket string, key string, ts timestamp, allowed boolean, retry_after int", "append", "EventTime")


def refresh_on_batches(items: DataFrame, path: str, merge, checkpoint: str):
    """Each micro-batch of landed items makes the next version of the table at path: merge(table or None, batch).

    A version carries the number of its batch, so a batch that is replayed after a failure isn't merged again."""
    from heatline.sources.sinks import latest, publish_once

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            publish_once(batch.sparkSession, path, number + 1, lambda: merge(latest(batch.sparkSession, path), batch))

    return items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_cycles(items: DataFrame, path: str, checkpoint: str, models: DataFrame, lexicon: DataFrame, stopwords: list[str], media: list[str], ts: str = "fetched_at", answers=None, glossary: DataFrame | None = None, static: DataFrame | None = None, buckets: int = 256, keep: int = 3):
    """Items with signals as refresh cycles, one for each hour of a micro-batch: cards, term pool, snapshots, word board,
    requests, neutral pool and tops of the dimensions, published by one commit of a store at path.

    An hour's clock is its beginning. Rows of an hour before the newest cycle join the newest one. A batch that is replayed
    after a failure goes on after the last hour that it committed. answers: a function spark -> rows of ANSWER."""

    def step(batch: DataFrame, number: int) -> None:
        from heatline.sources import store

        spark = batch.sparkSession
        rows = with_cycle(batch, ts)
        for hour in sorted(r[0] for r in rows.select("cycle").filter("cycle is not null").distinct().collect()):  # hours of one micro-batch
            last = store.newest(spark, path).notes
            if last.get("batch", -1) < number or (last["batch"] == number and last["hour"] < hour):
                _cycle(spark, path, rows.filter(F.col("cycle") == hour).drop("cycle"), hour, max(hour, last.get("cycle", "")), number, models, lexicon, stopwords, media, answers, glossary, static, buckets)
                store.retire(spark, path, keep)

    return items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _cycle(spark, path, items, hour, cycle, number, models, lexicon, stopwords, media, answers, glossary, static, buckets) -> None:
    from heatline.functions.scores import community
    from heatline.operators import boards as B
    from heatline.operators import cards as C
    from heatline.plans import refresh as R
    from heatline.sources import store

    as_of = F.lit(f"{cycle[:10]} {cycle[11:]}:00:00").cast("timestamp")
    commit = store.Commit(spark, path)
    C.upsert_buckets(commit, C.stored(C.item_cards(items, as_of), as_of), cycle, buckets)
    cards = C.active(store.table(spark, path, commit.next, "cards"), cycle)
    met = cards.filter("active")
    current = met.select("url", community(F.col("hn_points"), F.col("reddit_score"), F.col("reddit_comments")).alias("signal"))
    before = lambda name, shape: spark.createDataFrame([], shape) if (df := store.table(spark, path, commit.before, name)) is None else df
    made = R.refresh_terms(cards, current, models, before("terms", R.schema(R.POOL)), before("snapshots", R.SNAPSHOT), lexicon, as_of, cycle, stopwords, media, glossary, static, before("requests", R.REQUEST), answers(spark) if answers else None)
    commit.put("terms", made.terms)
    commit.put("words", made.words)
    commit.put("requests", made.requests, cycle)
    days = [r[0] for r in made.days.collect()]  # days of the calendar
    commit.drop_parts("snapshots", days)
    commit.put_parts("snapshots", made.snapshots.withColumn("_day", F.substring("cycle", 1, 10)).filter(F.col("_day").isin(days)), "_day")
    pool = C.pool(met, C.history(cards.filter("not active"), as_of, days=30)).drop("title", "summary")
    commit.put_parts("news_pool", pool.withColumn("_d", F.col("dimension")), "_d", keep=False)
    commit.put_parts("tops", B.top_per_dimension(met).withColumn("_d", F.col("dimension")), "_d", keep=False)
    commit.publish(batch=number, hour=hour, cycle=cycle)
    made.clear()
