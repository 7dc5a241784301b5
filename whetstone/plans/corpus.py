"""The analytical question corpus over the warehouse tables. NOW is the fixed "today" of relative filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from whetstone.operators import analytics as A
from whetstone.registry import query

NOW = "2001-08-01"
NOW_EVENTS = "2024-01-30"
_day = lambda c: F.date_format(c, "yyyy-MM-dd")
_month = lambda c: F.date_format(c, "yyyy-MM")
_r2 = lambda c: F.round(c, 2)
_r6 = lambda c: F.round(c, 6)


def _ts(text):
    return F.lit(text).cast("timestamp_ntz")


@query("k1_top_customers", "SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS spend, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2 ORDER BY sum(o_totalprice) DESC, c_custkey LIMIT 10")
def k1(r):
    spend = r("orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n_orders"))
    top = A.top_k(spend, "s", "o_custkey", 10)  # aggregate and cut before the join
    return top.join(r("customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", _r2("s").alias("spend"), "n_orders")


@query("j1_orders_customer", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def j1(r):
    return r("orders").join(r("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"), _r2(F.sum("o_totalprice")).alias("revenue"))


@query("j2_path_join", "SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def j2(r):
    frames = {t: r(t) for t in ("lineitem", "orders", "customer", "nation", "region")}
    path = [("orders", "l_orderkey", "o_orderkey"), ("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")]
    return A.path_join(frames, path, "lineitem").groupBy("r_name").agg(F.count("*").alias("n"), _r2(F.sum(F.expr("l_extendedprice * (1 - l_discount)"))).alias("revenue"))


@query("j4_active_customers", f"SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate > TIMESTAMP '{NOW}' - INTERVAL 30 DAYS) GROUP BY 1")
def j4(r):
    recent = r("orders").where(F.col("o_orderdate") > F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL 30 DAYS"))
    return r("customer").join(recent, F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("j5_new_customers", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING min(o_orderdate) >= TIMESTAMP '1997-01-01')")
def j5(r):
    new = r("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first")).where(F.col("first") >= _ts("1997-01-01"))
    return r("customer").join(new, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("j6_churned_customers", f"SELECT o_custkey, round(sum(o_totalprice), 2) AS lifetime_value FROM orders o WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 360 DAYS AND p.o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 90 DAYS) AND NOT EXISTS (SELECT 1 FROM orders q WHERE q.o_custkey = o.o_custkey AND q.o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 90 DAYS) GROUP BY 1")
def j6(r):
    o, at = r("orders"), lambda days: F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL {days} DAYS")
    per = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"), F.bool_or(F.col("o_orderdate").between(at(360), at(90)) & (F.col("o_orderdate") < at(90))).alias("was"), F.bool_or(F.col("o_orderdate") >= at(90)).alias("is"))
    return per.where("was and not is").select("o_custkey", _r2("v").alias("lifetime_value"))  # one pass instead of three joins


@query("j6_parts_without_sales", f"SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '{NOW}' - INTERVAL 90 DAYS)")
def j6b(r):
    sold = r("lineitem").where(F.col("l_shipdate") >= F.expr(f"TIMESTAMP_NTZ '{NOW}' - INTERVAL 90 DAYS"))
    return r("part").join(sold, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("j11_market_basket", "SELECT a.l_partkey AS part_a, b.l_partkey AS part_b, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20")
def j11(r):
    return _baskets(r("lineitem"), "l_orderkey", "l_partkey").orderBy(F.desc("n"), "part_a", "part_b").limit(20)


def _baskets(lines, order, part, each=500_000):
    """(part_a, part_b, n): in how many orders two parts are together, part_a < part_b.

    Pairs hardly repeat, so a task's memory follows its pairs, of which compressed bytes tell little: both steps are dealt
    into tasks by the number of lines, `each` a task on average.
    """
    lines = lines.select(F.col(order).alias("o"), F.col(part).alias("p")).dropna()
    tasks = -(-lines.count() // each) or 1
    parts = lines.repartition(tasks, "o").groupBy("o").agg(F.array_sort(F.collect_set("p")).alias("p"))
    pairs = parts.select("p", F.posexplode("p").alias("i", "part_a")).select("part_a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("part_b"))
    return pairs.repartition(tasks, "part_a", "part_b").groupBy("part_a", "part_b").agg(F.count("*").alias("n"))


@query("j12_period_comparison", "SELECT o_orderpriority, round(sum(CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice ELSE 0 END), 2) AS now_rev, round(sum(CASE WHEN year(o_orderdate) = 1999 THEN o_totalprice ELSE 0 END), 2) AS before_rev, round(100 * (sum(CASE WHEN year(o_orderdate) = 2000 THEN o_totalprice ELSE 0 END) - sum(CASE WHEN year(o_orderdate) = 1999 THEN o_totalprice ELSE 0 END)) / nullif(sum(CASE WHEN year(o_orderdate) = 1999 THEN o_totalprice ELSE 0 END), 0), 4) AS pct FROM orders GROUP BY 1")
def j12(r):
    of = lambda y: F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice")).otherwise(0))
    return r("orders").groupBy("o_orderpriority").agg(_r2(of(2000)).alias("now_rev"), _r2(of(1999)).alias("before_rev"), F.round(100 * (of(2000) - of(1999)) / F.nullif(of(1999), F.lit(0.0)), 4).alias("pct"))


@query("j13_within_day", "SELECT count(*) AS signups, count(second) AS completed, round(count(second) / count(*), 6) AS rate FROM (SELECT s.user_id, min(p.ts) AS second FROM (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY 1) s LEFT JOIN events p ON p.user_id = s.user_id AND p.event_type = 'purchase' AND p.ts >= s.t0 AND p.ts <= s.t0 + INTERVAL 24 HOURS GROUP BY 1)")
def j13(r):
    e = r("events")
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0"))
    p = e.where("event_type = 'purchase'").select("user_id", "ts")
    near = first.join(p, (first["user_id"] == p["user_id"]) & (p["ts"] >= first["t0"]) & (p["ts"] <= first["t0"] + F.expr("INTERVAL 24 HOURS")), "left").groupBy(first["user_id"]).agg(F.min("ts").alias("second"))
    return near.agg(F.count("*").alias("signups"), F.count("second").alias("completed"), _r6(F.count("second") / F.count("*")).alias("rate"))


@query("j14_touches_before_purchase", "SELECT user_id, count(*) AS touches, strftime(min(t.ts), '%Y-%m-%d %H:%M:%S') AS first_touch FROM events t JOIN (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (user_id) WHERE t.ts < t0 GROUP BY 1")
def j14(r):
    w = Window.partitionBy("user_id")
    e = r("events").withColumn("t0", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w))
    return e.where("ts < t0").groupBy("user_id").agg(F.count("*").alias("touches"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_touch"))


@query("j15_as_of_join", "SELECT e.event_id, p.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def j15(r):
    e = r("events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_view"))
    return A.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "ts", ["last_view"]).select("event_id", "last_view")


@query("j16_try_cast_join", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'x' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS k, o_totalprice FROM orders) JOIN customer ON TRY_CAST(k AS BIGINT) = c_custkey")
def j16(r):
    o = r("orders").select(F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("x"), F.col("o_custkey"))).otherwise(F.col("o_custkey").cast("string")).alias("k"), "o_totalprice")
    return o.join(r("customer"), F.col("k").try_cast("bigint") == F.col("c_custkey")).agg(F.count("*").alias("n"), _r2(F.sum("o_totalprice")).alias("total"))


@query("j18_line_counts", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n_lines FROM orders")
def j18(r):
    n = r("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return r("orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query("a19_metric_layer", "SELECT o_orderpriority, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def a19(r):
    m = A.metric(r("orders"), {"rev": "sum(o_totalprice)", "customers": "count(DISTINCT o_custkey)"}, ["o_orderpriority"], "o_orderdate", "quarter", ["o_orderstatus <> 'P'"])
    return m.select("o_orderpriority", _day("period").alias("period"), _r2("rev").alias("revenue"), "customers")


@query("a20_conditional_revenue", "SELECT strftime(o_orderdate, '%Y-%m') AS m, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS revenue FROM orders GROUP BY 1")
def a20(r):
    return r("orders").groupBy(_month("o_orderdate").alias("m")).agg(_r2(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0))).alias("revenue"))


@query("a21_conversion_rate", "SELECT CASE user_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'ios' ELSE 'android' END AS platform, round(count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) / nullif(count(DISTINCT user_id), 0), 6) AS rate FROM events GROUP BY 1")
def a21(r):
    platform = F.when(F.col("user_id") % 3 == 0, "web").when(F.col("user_id") % 3 == 1, "ios").otherwise("android")
    per = r("events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("bought"))  # one row a user, so counts need no distinct
    return per.groupBy(platform.alias("platform")).agg(_r6(F.count_if("bought") / F.nullif(F.count("*"), F.lit(0))).alias("rate"))


@query("a22_arpu", "SELECT strftime(o_orderdate, '%Y-%m') AS m, round(sum(o_totalprice) / count(DISTINCT o_custkey), 6) AS arpu FROM orders GROUP BY 1")
def a22(r):
    return r("orders").groupBy(_month("o_orderdate").alias("m")).agg(_r6(F.sum("o_totalprice") / F.count_distinct("o_custkey")).alias("arpu"))


@query("a23_daily_trend", f"SELECT strftime(ts, '%Y-%m-%d') AS d, count(*) AS n, round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 4) AS ok_pct FROM events WHERE ts >= TIMESTAMP '{NOW_EVENTS}' - INTERVAL 14 DAYS GROUP BY 1")
def a23(r):
    e = r("events").where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ '{NOW_EVENTS}' - INTERVAL 14 DAYS"))
    return e.groupBy(_day("ts").alias("d")).agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("event_type") != "error") / F.count("*"), 4).alias("ok_pct"))


@query("a24_orders_over_five_items", "SELECT l_orderkey, count(*) AS items FROM lineitem GROUP BY 1 HAVING count(*) > 5")
def a24(r):
    return r("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items")).where("items > 5")


@query("a24_peak_hours", "SELECT dayofweek(ts) + 1 AS dow, hour(ts) AS hr, count(*) AS n, round(avg(value), 4) AS avg_value FROM events GROUP BY 1, 2")
def a24b(r):
    return r("events").groupBy(F.dayofweek("ts").alias("dow"), F.hour("ts").alias("hr")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))


@query("a25_funnel", "WITH f AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN ts END) AS a, min(CASE WHEN event_type = 'view' THEN ts END) AS b, min(CASE WHEN event_type = 'click' THEN ts END) AS c, min(CASE WHEN event_type = 'purchase' THEN ts END) AS d FROM events GROUP BY 1) SELECT 1 AS step, 'signup' AS stage, count(*) FILTER (WHERE a IS NOT NULL) AS users FROM f UNION ALL SELECT 2, 'view', count(*) FILTER (WHERE b >= a) FROM f UNION ALL SELECT 3, 'click', count(*) FILTER (WHERE b >= a AND c >= b) FROM f UNION ALL SELECT 4, 'purchase', count(*) FILTER (WHERE b >= a AND c >= b AND d >= c) FROM f")
def a25(r):
    return A.funnel(r("events"), "user_id", "ts", "event_type", ["signup", "view", "click", "purchase"])


@query("a26_retention_cohorts", "WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS m FROM orders), f AS (SELECT o_custkey, m, min(m) OVER (PARTITION BY o_custkey) AS c FROM m) SELECT strftime(c, '%Y-%m') AS cohort, CAST(count(*) FILTER (WHERE m = c) AS BIGINT) AS m0, count(*) FILTER (WHERE m = c + INTERVAL 1 MONTH) AS m1, count(*) FILTER (WHERE m = c + INTERVAL 2 MONTH) AS m2, count(*) FILTER (WHERE m = c + INTERVAL 3 MONTH) AS m3 FROM f GROUP BY 1")
def a26(r):
    months = r("orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("m")).distinct()
    first = months.withColumn("c", F.min("m").over(Window.partitionBy("o_custkey")))
    return first.groupBy(_month("c").alias("cohort")).agg(*[F.count_if(F.col("m") == F.add_months("c", k)).alias(f"m{k}") for k in range(4)])


@query("a26_weekly_retention", "WITH w AS (SELECT DISTINCT user_id, date_trunc('week', ts) AS w FROM events), f AS (SELECT user_id, w, min(w) OVER (PARTITION BY user_id) AS c FROM w) SELECT strftime(c, '%Y-%m-%d') AS cohort, CAST(datediff('day', c, w) // 7 AS BIGINT) AS week_no, count(*) AS users FROM f GROUP BY 1, 2")
def a26b(r):
    weeks = r("events").select("user_id", F.trunc("ts", "week").alias("w")).distinct()
    first = weeks.withColumn("c", F.min("w").over(Window.partitionBy("user_id")))
    return first.groupBy(_day("c").alias("cohort"), F.floor(F.datediff("w", "c") / 7).alias("week_no")).agg(F.count("*").alias("users"))


@query("a27_value_buckets", "SELECT CAST(floor(o_totalprice / 50) * 50 AS BIGINT) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def a27(r):
    return r("orders").groupBy((F.floor(F.col("o_totalprice") / 50) * 50).alias("bucket")).agg(F.count("*").alias("n"))


@query("a28_median_p95", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1")
def a28(r):
    return r("orders").groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("median"), F.round(F.percentile("o_totalprice", 0.95), 4).alias("p95"))


@query("a28_approx_percentiles")
def a28b(r):
    return r("events").groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.95, 0.99], 10000).alias("p"))


@query("a29_distinct_visitors", "SELECT event_type, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1")
def a29(r):
    return r("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("visitors"))


@query("a29_approx_visitors")
def a29b(r):
    return r("events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("visitors"), F.expr("approx_top_k(user_id, 5)").alias("top"))


@query("a30_variation_correlation", "SELECT o_orderpriority, round(stddev_samp(o_totalprice) / avg(o_totalprice), 6) AS cv, round(corr(o_totalprice, l.n), 6) AS c FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY 1")
def a30(r):
    n = r("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = r("orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"))
    return o.groupBy("o_orderpriority").agg(_r6(F.stddev_samp("o_totalprice") / F.avg("o_totalprice")).alias("cv"), _r6(F.corr("o_totalprice", F.col("n").cast("double"))).alias("c"))


@query("a31_pivot", "SELECT strftime(o_orderdate, '%Y-%m') AS m, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS \"F\", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS \"O\", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS \"P\" FROM orders GROUP BY 1")
def a31(r):
    return r("orders").groupBy(_month("o_orderdate").alias("m")).pivot("o_orderstatus", ["F", "O", "P"]).agg(_r2(F.sum("o_totalprice")))


@query("a32_duplicates", "SELECT text AS body, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def a32(r):
    return r("documents").groupBy(F.col("text").alias("body")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("a33_score_metric", "SELECT event_type, round(100.0 * (count(*) FILTER (WHERE value >= 90) - count(*) FILTER (WHERE value < 60)) / count(*), 4) AS score FROM events GROUP BY 1")
def a33(r):
    v = F.col("value")
    return r("events").groupBy("event_type").agg(F.round(100.0 * F.try_divide(F.count_if(v >= 90) - F.count_if(v < 60), F.count("*")), 4).alias("score"))


@query("a33_returned_share", "SELECT year(l_shipdate) AS y, quarter(l_shipdate) AS q, round(100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*), 4) AS returned FROM lineitem GROUP BY 1, 2")
def a33b(r):
    return r("lineitem").groupBy(F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("q")).agg(F.round(100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count("*"), 4).alias("returned"))


@query("a34_cast_success", "SELECT round(count(TRY_CAST(CASE WHEN event_id % 10 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE)) / count(*), 6) AS ok FROM events")
def a34(r):
    x = F.when(F.col("event_id") % 10 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return r("events").agg(_r6(F.count(x.try_cast("double")) / F.count("*")).alias("ok"))


@query("a35_new_returning", "WITH m AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate) AS m FROM orders), f AS (SELECT m, m = min(m) OVER (PARTITION BY o_custkey) AS fresh FROM m) SELECT strftime(m, '%Y-%m') AS month, count(*) FILTER (WHERE fresh) AS new_customers, count(*) FILTER (WHERE NOT fresh) AS returning_customers FROM f GROUP BY 1")
def a35(r):
    m = r("orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("m")).distinct()
    f = m.withColumn("fresh", F.col("m") == F.min("m").over(Window.partitionBy("o_custkey")))
    return f.groupBy(_month("m").alias("month")).agg(F.count_if("fresh").alias("new_customers"), F.count_if(~F.col("fresh")).alias("returning_customers"))


@query("a36_net_growth", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS w, CAST(sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS BIGINT) AS net FROM events GROUP BY 1")
def a36(r):
    return r("events").groupBy(_day(F.date_trunc("week", "ts")).alias("w")).agg(F.sum(F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)).alias("net"))


@query("a37_interactions", "SELECT o_custkey AS user_id, l_partkey AS item_id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def a37(r):
    return r("orders").join(r("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id")).agg(F.count("*").alias("n"))


@query("a38_rollup", "SELECT o_orderstatus AS status, o_orderpriority AS priority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (1, 2)")
def a38(r):
    return r("orders").rollup(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(_r2(F.sum("o_totalprice")).alias("total"))


@query("a39_grouping_sets", "SELECT event_type AS stage, user_id % 2 AS model, count(*) AS n, CAST(grouping(event_type, user_id % 2) AS BIGINT) AS g FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 2), ())")
def a39(r):
    e = r("events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 2).alias("model"))
    return e.groupingSets([["stage"], ["model"], []], "stage", "model").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g"))


@query("w1_month_growth", "WITH m AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2) SELECT p, strftime(m, '%Y-%m') AS mon, round(100 * (s - lag(s) OVER w) / lag(s) OVER w, 4) AS growth FROM m WINDOW w AS (PARTITION BY p ORDER BY m)")
def w1(r):
    m = r("orders").groupBy(F.col("o_orderpriority").alias("p"), F.trunc("o_orderdate", "month").alias("m")).agg(F.sum("o_totalprice").alias("s"))
    before = F.lag("s").over(Window.partitionBy("p").orderBy("m"))
    return m.select("p", _month("m").alias("mon"), F.round(100 * (F.col("s") - before) / before, 4).alias("growth"))


@query("w2_rolling_users", "WITH d AS (SELECT date_trunc('day', ts) AS d, count(DISTINCT user_id) AS n FROM events GROUP BY 1) SELECT strftime(d, '%Y-%m-%d') AS day, round(avg(n) OVER (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS avg7 FROM d")
def w2(r):
    d = r("events").groupBy(F.to_date("ts").alias("d")).agg(F.count_distinct("user_id").alias("n"))
    return d.select(_day("d").alias("day"), F.round(F.avg("n").over(Window.orderBy("d").rowsBetween(-6, 0)), 4).alias("avg7"))  # one row a day


@query("w3_latest_order", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def w3(r):
    return r("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("w4_first_second_gap", "WITH x AS (SELECT o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) SELECT count(*) AS customers, round(avg(datediff('day', a.o_orderdate, b.o_orderdate)), 6) AS avg_days FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.n = 1 AND b.n = 2")
def w4(r):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = r("orders").select("o_custkey", "o_orderdate", F.row_number().over(w).alias("n"), F.lead("o_orderdate").over(w).alias("nxt")).where("n = 1 and nxt is not null")
    return x.agg(F.count("*").alias("customers"), _r6(F.avg(F.datediff("nxt", "o_orderdate"))).alias("avg_days"))


@query("w5_ranks", "SELECT c_mktsegment, c_custkey, dense_rank() OVER w AS dr, rank() OVER w AS rk FROM (SELECT c_mktsegment, c_custkey, round(c_acctbal / 100) AS b FROM customer) WINDOW w AS (PARTITION BY c_mktsegment ORDER BY b DESC) QUALIFY dense_rank() OVER w <= 3")
def w5(r):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("b"))
    c = r("customer").select("c_mktsegment", "c_custkey", F.round(F.col("c_acctbal") / 100).alias("b"))
    return c.select("c_mktsegment", "c_custkey", F.dense_rank().over(w).alias("dr"), F.rank().over(w).alias("rk")).where("dr <= 3")


@query("w6_cumulative_revenue", "WITH d AS (SELECT date_trunc('day', o_orderdate) AS d, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1) SELECT strftime(d, '%Y-%m-%d') AS day, CAST(sum(s) OVER (PARTITION BY date_trunc('quarter', d) ORDER BY d) AS DOUBLE) AS running FROM d")
def w6(r):
    d = r("orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"))
    w = Window.partitionBy(F.trunc("d", "quarter")).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return d.select(_day("d").alias("day"), F.sum("s").over(w).cast("double").alias("running"))


_PARETO = "WITH s AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1), c AS (SELECT o_custkey, v, sum(v) OVER (ORDER BY v DESC, o_custkey ROWS UNBOUNDED PRECEDING) AS run, sum(v) OVER () AS tot FROM s) "


def _spend(r):
    return r("orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))


@query("w7_pareto", _PARETO + "SELECT count(*) AS customers, count(*) FILTER (WHERE run <= 0.8 * tot) AS within80, round(100.0 * count(*) FILTER (WHERE run <= 0.8 * tot) / count(*), 4) AS pct FROM c")
def w7(r):
    c = A.cumulative_share(_spend(r), "o_custkey", "v")
    return c.agg(F.count("*").alias("customers"), F.count_if(A.within(80)).alias("within80"), F.round(100.0 * F.count_if(A.within(80)) / F.count("*"), 4).alias("pct"))


@query("w8_abc_classes", _PARETO + "SELECT CASE WHEN run <= 0.8 * tot THEN 'A' WHEN run <= 0.95 * tot THEN 'B' ELSE 'C' END AS class, count(*) AS n, CAST(round(sum(v), 2) AS DOUBLE) AS total FROM c GROUP BY 1")
def w8(r):
    c = A.cumulative_share(_spend(r), "o_custkey", "v")
    return c.groupBy(F.when(A.within(80), "A").when(A.within(95), "B").otherwise("C").alias("class")).agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total"))


@query("w9_z_scores", "WITH d AS (SELECT l_partkey, date_trunc('month', l_shipdate) AS m, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_partkey, strftime(m, '%Y-%m') AS mon, round((q - avg(q) OVER w) / nullif(stddev_samp(q) OVER w, 0), 4) AS z FROM d WINDOW w AS (PARTITION BY l_partkey)")
def w9(r):
    d = r("lineitem").groupBy("l_partkey", F.trunc("l_shipdate", "month").alias("m")).agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_partkey")
    return d.select("l_partkey", _month("m").alias("mon"), F.round((F.col("q") - F.avg("q").over(w)) / F.nullif(F.stddev_samp("q").over(w), F.lit(0.0)), 4).alias("z"))


@query("w10_sequences", "WITH s AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a || '>' || b || '>' || c AS seq, count(*) AS n FROM s WHERE c IS NOT NULL GROUP BY 1 ORDER BY n DESC, seq LIMIT 10")
def w10(r):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = r("events").select(F.concat_ws(">", "event_type", F.lead("event_type").over(w), F.lead("event_type", 2).over(w)).alias("seq"), F.lead("event_type", 2).over(w).alias("c")).where("c is not null")
    return A.top_k(s.groupBy("seq").agg(F.count("*").alias("n")), "n", "seq", 10)


@query("w11_attribution", "WITH p AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'purchase' GROUP BY 1), t AS (SELECT e.*, p.t0 FROM events e JOIN p USING (user_id) WHERE e.ts < t0) SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_touch, arg_max(event_type, (ts, event_id)) AS last_touch FROM t GROUP BY 1")
def w11(r):
    t = r("events").withColumn("t0", F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(Window.partitionBy("user_id"))).where("ts < t0")
    order = F.struct("ts", "event_id")
    return t.groupBy("user_id").agg(F.min_by("event_type", order).alias("first_touch"), F.max_by("event_type", order).alias("last_touch"))


@query("k3_nulls_last_sort", "SELECT p_partkey, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS s FROM part ORDER BY s DESC NULLS LAST, p_partkey")
@query("k3_nulls_last_sort_all")
def k3_all(r):
    return r("part").select("p_partkey", F.when(F.col("p_size") > 40, None).otherwise(F.col("p_size")).alias("s")).orderBy(F.desc_nulls_last("s"), "p_partkey")


@query("k4_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 25")
def k4(r):
    return A.page_after(r("orders"), "o_orderkey", 500, 25).select("o_orderkey", "o_custkey")


@query("k5_capped", "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 10000)")
def k5(r):
    return r("lineitem").limit(10000).agg(F.count("*").alias("n"))


@query("u1_channels", "SELECT 'F' AS channel, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'O', round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'P', round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus = 'P'")
def u1(r):
    return r("orders").where(F.col("o_orderstatus").isin("F", "O", "P")).groupBy(F.col("o_orderstatus").alias("channel")).agg(_r2(F.sum("o_totalprice")).alias("revenue"))  # one scan, not three


@query("u2_intersect", "SELECT o_custkey FROM orders WHERE month(o_orderdate) = 1 INTERSECT SELECT o_custkey FROM orders WHERE month(o_orderdate) = 2")
def u2(r):
    of = lambda m: r("orders").where(F.month("o_orderdate") == m).select("o_custkey")
    return of(1).intersect(of(2))


@query("u3_except", "SELECT o_custkey FROM orders WHERE month(o_orderdate) = 1 EXCEPT SELECT o_custkey FROM orders WHERE month(o_orderdate) = 2")
def u3(r):
    of = lambda m: r("orders").where(F.month("o_orderdate") == m).select("o_custkey")
    return of(1).subtract(of(2))


@query("s1_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49")
def s1(r):
    return r("lineitem").where("l_quantity >= 49").select("l_orderkey", "l_linenumber", "l_quantity")


@query("f12_partition_scan", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-04-01' GROUP BY 1")
def f12(r):
    return A.scan_partitioned(r("orders"), "o_orderdate", "1998-01-01", "1998-04-01").groupBy(_day("o_orderdate").alias("d")).agg(F.count("*").alias("n"))


@query("f18_contains_filter", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_brand), '#1')")
def f18(r):
    has = lambda c, t: F.lower(F.col(c).cast("string")).contains(t)
    return r("part").where(has("p_name", "a") & has("p_brand", "#1")).select("p_partkey")


@query("f19_refinement", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31' AND o_orderstatus = 'F' AND o_totalprice > 1000")
def f19(r):
    rules = [F.col("o_orderdate").between(_ts("1997-01-01"), _ts("1997-12-31")), F.col("o_orderstatus") == "F", F.col("o_totalprice") > 1000]
    out = r("orders")
    for x in rules:
        out = out.where(x)
    return out.select("o_orderkey")


@query("x13_tags", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS tag FROM part) GROUP BY 1")
def x13(r):
    return r("part").select(F.explode(F.split("p_type", " ")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("x14_basket_jaccard", "WITH b AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), n AS (SELECT o, count(*) AS n FROM b GROUP BY 1), p AS (SELECT x.o AS a, y.o AS b, count(*) AS i FROM b x JOIN b y ON x.s = y.s AND x.o < y.o GROUP BY 1, 2) SELECT p.a, p.b, round(i / (na.n + nb.n - i), 6) AS jaccard FROM p JOIN n na ON na.o = p.a JOIN n nb ON nb.o = p.b WHERE 2 * i >= na.n + nb.n - i")
@query("x14_basket_jaccard_all")
def x14_all(r):
    return A.similar_baskets(r("lineitem"), "l_orderkey", "l_suppkey").withColumn("jaccard", _r6("jaccard"))


@query("x15_json_props", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def x15(r):
    return r("events").groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("k")).agg(F.count("*").alias("n"))


@query("x16_nested_search", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def x16(r):
    m = F.from_json("props", "map<string,string>")
    return r("events").where(F.exists(F.map_entries(m), lambda e: (e["key"] == "k") & (e["value"] == "7"))).select("event_id")


@query("l5_time_travel", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1")
def l5(r):
    return A.snapshot(r("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", _ts("1998-01-01"), "o_orderkey").select("o_custkey", "o_orderkey")


@query("l5_changes", "WITH a AS (SELECT o_custkey AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderdate <= TIMESTAMP '1998-02-01' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def l5b(r):
    at = lambda t, v: A.snapshot(r("orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", _ts(t), "o_orderkey").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias(v))
    both = at("1998-01-01", "a").join(at("1998-02-01", "b"), "k", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("k", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))
