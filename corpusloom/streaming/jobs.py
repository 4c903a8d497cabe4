"""Streaming forms of line cleaning, deduplication, daily counters and rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions import pii, quality, text
from corpusloom.scratch import drop_table


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines of text files as they arrive."""
    return spark.readStream.format("text").load(folder).select(F.col("value").alias("line"))


def clean(lines: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The line chain of the batch job: clean, redact, score, filter.  Stateless."""
    out = text.bound(lines.where(text.strip(F.col("line")) != ""), line=text.standard(F.col("line"))).where("line != ''")
    out = text.bound(text.bound(out, line=pii.redact(F.col("line"))), score=quality.score(F.col("line")))
    return out.where(F.col("score") >= min_score)


def first_lines(lines: DataFrame, at: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each line once; with an event time, within the watermark, so that state is bounded.

    Without one all hashes are kept, as by a run that never resets; a new checkpoint folder is the reset.
    """
    hashed = lines.withColumn("h", F.sha2("line", 256))
    if at:
        return hashed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["h"]).drop("h")
    return hashed.dropDuplicates(["h"]).drop("h")


def daily(events: DataFrame, at: str = "ts", delay: str = "2 days") -> DataFrame:
    """Counters of each day."""
    return events.withWatermark(at, delay).groupBy(F.window(at, "1 day").alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), "events", "value")


def allowed(times: list[float], window: float, most: int, held: list[int] | None = None) -> tuple[list[bool], list[int]]:
    """Sliding limit over sorted times: a hit is allowed if fewer than ``most`` distinct seconds lie in the window before it; only allowed hits are recorded."""
    held, out = list(held or []), []
    for t in times:
        held = [s for s in held if s > t - window]
        ok = len(held) < most
        if ok and int(t) not in held:
            held.append(int(t))
        out.append(ok)
    return out, held


_LIMITED = "user_id long, event_id long, allowed boolean"


def rate_limit(events: DataFrame, window: float, most: int) -> DataFrame:
    """(user_id, event_id, allowed) in batch; a user's hits form a sequence, so a user is one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "event_id"])
        return part.assign(allowed=allowed(part["t"].tolist(), window, most)[0])[["user_id", "event_id", "allowed"]]

    return events.select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t")).groupBy("user_id").applyInPandas(run, _LIMITED)


def rate_limit_stream(events: DataFrame, window: float, most: int, delay: str = "1 hour") -> DataFrame:
    """The same over a stream whose hits of a user arrive in order, at most ``delay`` late; state is the seconds in the window, and goes when a user is silent for longer by event time."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        part = pd.concat(list(parts)).sort_values(["t", "event_id"])
        ok, held = allowed(part["t"].tolist(), window, most, held)
        state.update((held,))
        # the watermark may have passed that already; then the next batch takes the state away
        state.setTimeoutTimestamp(max(int((part["t"].max() + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield part.assign(allowed=ok)[["user_id", "event_id", "allowed"]]

    keyed = events.withWatermark("ts", delay).select("user_id", "event_id", "ts", F.col("ts").cast("timestamp").cast("double").alias("t"))
    return keyed.groupBy("user_id").applyInPandasWithState(run, _LIMITED, "seconds array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def unseen(urls: DataFrame, at: str = "ts", ttl: str = "1 day") -> DataFrame:
    """URLs not seen within the time to live since they were first seen."""
    return urls.withWatermark(at, ttl).dropDuplicatesWithinWatermark(["url"])


#: Seconds that a seen URL and a cached page live.
SEEN_TTL, PAGE_TTL = 86_400.0, 604_800.0


def marks(rows: DataFrame, ttl: float = SEEN_TTL, key: str = "url", at: str = "ts", order: str = "id") -> DataFrame:
    """Adds fresh: whether the last mark of the key lies ``ttl`` seconds back or more; each mark renews the key."""
    t = F.col(at).cast("timestamp").cast("double")
    before = F.lag(t).over(Window.partitionBy(key).orderBy(at, order))
    return rows.withColumn("fresh", before.isNull() | (t - before >= ttl))


def marks_stream(rows: DataFrame, ttl: float = SEEN_TTL, key: str = "url", at: str = "ts", order: str = "id", delay: str = "1 hour") -> DataFrame:
    """(key, order, fresh) of the same over a stream whose marks of a key arrive in order; a key's state is its last mark, and goes ``ttl`` after it by event time."""
    kind = rows.schema[key].dataType.simpleString()

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        part = pd.concat(list(parts)).sort_values(["_t", order])
        fresh = []
        for t in part["_t"]:
            fresh.append(last is None or t - last >= ttl)
            last = t
        state.update((last,))
        # the watermark may have passed that already; then the next batch takes the state away
        state.setTimeoutTimestamp(max(int((last + ttl) * 1000), state.getCurrentWatermarkMs() + 1))
        yield part.assign(fresh=fresh)[[key, order, "fresh"]]

    keyed = rows.withWatermark(at, delay).select(key, order, at, F.col(at).cast("timestamp").cast("double").alias("_t"))
    return keyed.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {order} long, fresh boolean", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def threshold_batches(folder: str, k: int = 3, by: tuple[str, ...] = ("doc_id",)):
    """A function for ``foreachBatch`` over (..., line_no, line): lines that occur ``k`` times or more keep their first place only.

    One pass cannot know that a line comes again, so a batch writes what it adds and what
    it takes back (``changes``: op +1 or -1), and a state of one row for each line: how
    often, and its places while they are fewer than ``k``.  Both are written by the number
    of the batch, so a batch that runs again replaces its own.  :func:`threshold_kept`
    gives what is left.  Lines of a key must arrive in the order of line_no.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys = [*by, "line"]
        # a batch over a stream is read three times below
        new = batch.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line_no")).alias("all"))
        new = new.select(*keys, "n", F.slice("all", 1, k).alias("places"), "all")
        old = spark.read.parquet(f"{folder}/state/b={number - 1}") if number else spark.createDataFrame([], new.drop("all").schema)
        old = old.select(*keys, F.col("n").alias("_n"), F.col("places").alias("_places"))
        joined = new.join(old, keys, "full_outer").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_n", F.lit(0)).alias("_n"), *(F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("all", "_places")))
        total = F.col("n") + F.col("_n")
        places = F.slice(F.concat("_places", "all"), 1, k)
        state = joined.select(*keys, total.alias("n"), F.when(total < k, places).otherwise(F.slice(places, 1, 1)).alias("places"))
        state.write.mode("overwrite").parquet(f"{folder}/state/b={number}")
        touched = joined.where("n > 0")
        # below the threshold all come; at it the first only, and the others of before go
        added = F.when(total < k, F.col("all")).otherwise(F.when(F.size("_places") == 0, F.slice("all", 1, 1)).otherwise(F.array().cast("array<int>")))
        gone = F.when((total >= k) & (F.col("_n") < k), F.slice("_places", 2, k)).otherwise(F.array().cast("array<int>"))
        change = F.concat(F.transform(added, lambda x: F.struct(x.alias("line_no"), F.lit(1).alias("op"))), F.transform(gone, lambda x: F.struct(x.alias("line_no"), F.lit(-1).alias("op"))))
        touched.select(*keys, F.explode(change).alias("c")).select(*keys, "c.line_no", "c.op").write.mode("overwrite").parquet(f"{folder}/changes/b={number}")
        if number > 1:  # a batch that runs again needs the state before it only
            drop_table(spark, f"{folder}/state/b={number - 2}")

    return run


def threshold_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that are left after all batches."""
    changes = spark.read.parquet(f"{folder}/changes").drop("b")
    keys = [c for c in changes.columns if c != "op"]
    return changes.groupBy(*keys).agg(F.sum("op").alias("op")).where("op > 0").drop("op")
