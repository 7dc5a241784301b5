"""Streaming jobs, run over all of a table, with the batch SQL that they equal once their watermark has passed."""

from __future__ import annotations

from pyspark.sql import functions as F

from whetstone.operators import metadata as M
from whetstone.registry import query
from whetstone.sources.files import scratch
from whetstone.streaming import jobs as J

_BOUNDS = (10.0, 25.0, 50.0, 100.0, 250.0)
_MINUTE = "strftime({0}, '%Y-%m-%d %H:%M')"


def _text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm")


@query("st1_sliding_rates", f"WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(CAST(i AS INT)) FOR i IN range(5)]) AS s FROM events) SELECT {_MINUTE.format('s')} AS start, event_type, count(*) AS n, round(count(*) / 300.0, 6) AS per_second FROM w WHERE s + INTERVAL 5 MINUTES <= (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) - INTERVAL 10 MINUTES FROM events) GROUP BY 1, 2")
def st1(r):
    out = J.drained(J.rates(r.stream("events"), ["event_type"]), "rates")
    return out.select(_text("start").alias("start"), "event_type", "n", F.round("per_second", 6).alias("per_second"))


@query("st2_latency_quantiles", "WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, le, count(*) FILTER (WHERE value <= le) AS cum, count(*) AS total FROM events, (SELECT unnest([10.0, 25.0, 50.0, 100.0, 250.0]) AS le) GROUP BY 1, 2), l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(cum) OVER w, 0) AS bef FROM b WINDOW w AS (PARTITION BY s ORDER BY le)), q AS (SELECT s, " + ", ".join(f"coalesce(arg_min(lo + (le - lo) * ({x} * total - bef) / nullif(cum - bef, 0), le) FILTER (WHERE cum >= {x} * total), 250.0) AS p{n}" for x, n in ((0.5, 50), (0.95, 95), (0.99, 99))) + " FROM l GROUP BY 1) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM q WHERE s + INTERVAL 1 HOUR <= (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) - INTERVAL 1 HOUR FROM events)")
def st2(r):
    counts = J.drained(J.latency_counts(r.stream("events"), _BOUNDS), "latency")
    q = J.latency_quantiles(counts, _BOUNDS)
    return q.select(_text("start").alias("start"), *[F.round(c, 6).alias(c) for c in q.columns[1:]])


@query("st3_rate_limit")
def st3(r):
    """Two events a user in six hours pass."""
    return J.drained(J.limited(r.stream("events"), "user_id", 2, 6 * 3600), "limit")


@query("st4_answer_cache")
def st4(r):
    """Equal questions of a user: a good answer is kept for an hour."""
    return J.drained(J.cached(r.stream("events"), "concat(user_id, ':', event_type)", "event_type <> 'error'"), "cache")


@query("st5_in_flight_now", "SELECT user_id AS service, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) AS BIGINT) AS in_flight FROM events GROUP BY 1")
def st5(r):
    """Each batch gives the gauges that changed, with its number; the last of each counts, also where a batch comes again."""
    path = scratch(r.spark, "gauge")
    gauges = J.in_flight(r.stream("events"), "user_id", "view", "click").withColumn("batch", F.lit(0).cast("long"))
    put = lambda df, i: df.withColumn("batch", F.lit(i).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{i}")
    out = J.drained(gauges, "gauge", each=put, mode="update", path=path)
    return out.groupBy("service").agg(F.max_by("in_flight", "batch").alias("in_flight"))


@query("st6_feedback_applied", "SELECT o_orderkey, f.feedback FROM orders LEFT JOIN (SELECT event_id % 1000 AS k, arg_max(event_type, (ts, event_id)) AS feedback FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1) f ON k = o_orderkey WHERE o_orderkey < 1000 OR f.feedback IS NOT NULL")
def st6(r):
    """The latest feedback on each order, from a stream that joins the orders it names; orders below 1000 without any stay open."""
    orders = r("orders").select("o_orderkey")
    feed = r.stream("events").where(F.col("event_type").isin("purchase", "error")).select((F.col("event_id") % 1000).alias("o_orderkey"), "event_type", "ts", "event_id")
    said = J.drained(feed.join(orders, "o_orderkey"), "feedback")
    last = said.groupBy("o_orderkey").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("feedback"))
    return orders.join(last, "o_orderkey", "left").where("o_orderkey < 1000 or feedback is not null")


@query("st7_promoted_examples", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' OR (event_type = 'error' AND event_id % 2 = 0)")
def st7(r):
    """Liked queries and approved corrections, once each though all are sent twice; a batch that is repeated writes over itself."""
    e = r.stream("events").where("event_type = 'purchase' or (event_type = 'error' and event_id % 2 = 0)").select("event_id", "user_id", "ts")
    path = scratch(r.spark, "examples")
    once = J.first_of(e.unionByName(e), ["event_id"])
    out = J.drained(once, "examples", each=lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}"), path=path)
    return out.select("event_id", "user_id")


@query("st8_idempotent_log", "SELECT event_id, event_type FROM events")
def st8(r):
    """Every row of the log is sent twice and kept once."""
    e = r.stream("events")
    return J.drained(J.first_of(e.unionByName(e), ["event_id"]), "log").select("event_id", "event_type")


@query("st9_session_stream", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS started, count(*) AS n FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) - INTERVAL 1 HOUR FROM events)")
def st9(r):
    return J.drained(J.sessions(r.stream("events"), "user_id"), "sessions").select("user_id", _text("started").alias("started"), "n")


@query("st10_stage_timings", "SELECT a.user_id, a.event_id AS start_id, b.event_id AS end_id, round(epoch_us(b.ts) / 1e6 - epoch_us(a.ts) / 1e6, 3) AS seconds FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def st10(r):
    e = r.stream("events")
    out = J.drained(J.elapsed(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id"]), "timings")
    return out.withColumn("seconds", F.round("seconds", 3))


@query("st11_incremental_chunks", "SELECT doc_id, CAST((pos - 1) // 900 AS BIGINT) AS part, substr(sha256(trim(substr(text, pos, 1000), ' ')), 1, 16) AS hash FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 900)) AS pos FROM documents) WHERE trim(substr(text, pos, 1000), ' ') <> ''")
def st11(r):
    """Documents to chunks, appended; a second run over the same files adds nothing."""
    path = scratch(r.spark, "ingest")
    for _ in range(2):
        out = J.drained(M.chunks(r.stream("documents").select("doc_id", "text"), 1000, 100), "ingest", path=path)
    return out.select("doc_id", "part", "hash")
