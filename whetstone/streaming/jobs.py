"""Streams to streams. Each function takes and gives DataFrames that may be streams; `drained` runs one over all that is there.

Rows later than the watermark are dropped where a watermark is set; windows come out once it has passed their ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from whetstone.sources.files import scratch


def drained(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", path: str | None = None) -> DataFrame:
    """The rows that a stream gives for all that is there now, written as Parquet; a second run with the same path goes on from there.

    With `each` or another mode a batch goes to a folder of its own, written over if it is repeated, so a lost batch leaves no
    row twice.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, name)
    out = stream.writeStream.option("checkpointLocation", f"{path}-log").outputMode(mode).trigger(availableNow=True)
    if mode == "append" and not each:
        out.format("parquet").start(path).awaitTermination()
    else:
        put = each or (lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}"))
        out.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", mode != "append" or bool(each)).parquet(path)


#: Groups that share one state, so that a call of Python serves many keys. A stream keeps the number it was started with.
BUCKETS = 1024


def timed(events: DataFrame, late: str, ts: str = "ts") -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _bucketed(events: DataFrame, key: str, buckets: int, *more: str) -> DataFrame:
    """(bucket, key, event_id, ts, more, at): at in seconds."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    return events.select(bucket, key, "event_id", "ts", *more, (F.unix_micros("ts").cast("double") / 1e6).alias("at"))


def rates(events: DataFrame, labels: Sequence[str], length: str = "5 minutes", step: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, labels, n, per_second): counts in sliding windows and over their seconds."""
    seconds = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")).cast("double")
    counts = timed(events, late).groupBy(F.window("ts", length, step).alias("w"), *labels).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), *labels, "n", (F.col("n") / seconds).alias("per_second"))


def latency_counts(events: DataFrame, bounds: Sequence[float], length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, total, b0, b1, ...): per window how many values are at most each bound."""
    counts = timed(events, late).groupBy(F.window("ts", length).alias("w")).agg(F.count("value").alias("total"), *[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return counts.select(F.col("w.start").alias("start"), "total", *[f"b{i}" for i in range(len(bounds))])


def latency_quantiles(counts: DataFrame, bounds: Sequence[float], quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(start, p50, ...): linear within the first bucket that reaches the quantile; beyond the last bound, that bound."""
    def at(q):
        out = F.lit(float(bounds[-1]))
        for i in reversed(range(len(bounds))):
            lo, before = (bounds[i - 1], F.col(f"b{i - 1}")) if i else (0.0, F.lit(0))
            inside = F.lit(lo) + (bounds[i] - lo) * (q * F.col("total") - before) / F.nullif(F.col(f"b{i}") - before, F.lit(0))
            out = F.when(F.col(f"b{i}") >= q * F.col("total"), F.coalesce(inside, F.lit(float(bounds[i])))).otherwise(out)
        return out

    return counts.select("start", *[at(q).alias(f"p{round(100 * q)}") for q in quantiles])


def limited(events: DataFrame, client: str, most: int = 60, seconds: int = 60, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """(client, event_id, allowed, remaining, retry_after): an event passes while fewer than `most` passed in the last `seconds`.

    Rejected events do not count. A client's state holds the times of those that passed, `most` at the most, and goes once
    the watermark is past them. Events of a batch are taken by time, then id.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for who, event, at in zip(rows["client"], rows["event_id"], rows["at"], strict=True):
            passed = [t for t in held.get(who, ()) if t > at - seconds]
            ok = len(passed) < most
            if ok:
                passed.append(at)
            held[who] = passed
            out.append((who, event, ok, most - len(passed), 0.0 if ok else passed[0] + seconds - at))
        now = state.getCurrentWatermarkMs()
        held = {who: list(p) for who, p in held.items() if p and int((max(p) + seconds) * 1000) >= now}
        state.update((list(held), list(held.values())))
        if held:
            state.setTimeoutTimestamp(max(int((max(map(max, held.values())) + seconds) * 1000), now + 1))
        yield pd.DataFrame(out, columns=["client", "event_id", "allowed", "remaining", "retry_after"])

    rows = _bucketed(timed(events, late).withColumn("client", F.col(client).cast("string")), "client", buckets)
    out = rows.groupBy("bucket").applyInPandasWithState(step, "client string, event_id long, allowed boolean, remaining int, retry_after double", "clients array<string>, passed array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("client", F.col("client").cast("long"))


def cached(events: DataFrame, key: str, good: str, seconds: int = 3600, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(key, event_id, hit): whether a good answer to the same key was stored within `seconds` before; a hit stores nothing."""
    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        stored = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        hits = []
        for asked, at, ok in zip(rows["key"], rows["at"], rows["good"], strict=True):
            hit = asked in stored and at - stored[asked] <= seconds
            if ok and not hit:
                stored[asked] = at
            hits.append(hit)
        now = state.getCurrentWatermarkMs()
        stored = {asked: at for asked, at in stored.items() if int((at + seconds) * 1000) >= now}
        state.update((list(stored), list(stored.values())))
        if stored:
            state.setTimeoutTimestamp(max(int((max(stored.values()) + seconds) * 1000) + 1, now + 1))
        yield pd.DataFrame({"key": rows["key"].to_numpy(), "event_id": rows["event_id"].to_numpy(), "hit": hits})

    rows = _bucketed(timed(events, late).withColumns({"key": F.expr(key).cast("string"), "good": F.expr(good)}), "key", buckets, "good")
    return rows.groupBy("bucket").applyInPandasWithState(step, "key string, event_id long, hit boolean", "keys array<string>, stored array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def first_of(events: DataFrame, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """One row a key within the watermark: a log that may send rows again."""
    return timed(events, late).dropDuplicatesWithinWatermark(list(keys))


def elapsed(starts: DataFrame, ends: DataFrame, keys: Sequence[str], within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(keys, start_id, end_id, seconds): ends that follow a start of the same keys within a time."""
    a = timed(starts, late).select(*[F.col(k).alias(f"a_{k}") for k in keys], F.col("event_id").alias("start_id"), F.col("ts").alias("started"))
    b = timed(ends, late).select(*keys, F.col("event_id").alias("end_id"), F.col("ts").alias("ended"))
    on = F.expr(f"ended >= started and ended <= started + interval {within}")
    for k in keys:
        on = on & (F.col(k) == F.col(f"a_{k}"))
    return a.join(b, on).select(*keys, "start_id", "end_id", ((F.unix_micros("ended") - F.unix_micros("started")) / 1e6).alias("seconds"))


def in_flight(events: DataFrame, service: str, up: str, down: str) -> DataFrame:
    """(service, in_flight): how many started and did not end, so far."""
    t = F.col("event_type")
    return events.groupBy(F.col(service).alias("service")).agg(F.sum(F.when(t == up, 1).when(t == down, -1).otherwise(0)).alias("in_flight"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, started, n): runs of events without a longer gap."""
    s = timed(events, late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("started"), "n")
