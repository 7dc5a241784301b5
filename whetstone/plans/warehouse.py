"""Profiles, SQL-log mining, graphs, entities, retrieval, documents and telemetry over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from whetstone.functions import sqltext as Q
from whetstone.functions import text as X
from whetstone.operators import analytics as A
from whetstone.operators import metadata as M
from whetstone.registry import query

_SQL_LOG, _sql_log = Q.LOG, Q.sql_log


_CALLS = "(SELECT event_type AS stage, CASE WHEN event_id % 2 = 0 THEN 'large' ELSE 'small' END AS model, event_id % 1000 AS input_tokens, event_id % 200 AS output_tokens FROM events)"


_PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("a1_column_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count, round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 2) AS null_pct, CAST(min({c}) AS VARCHAR) AS min, CAST(max({c}) AS VARCHAR) AS max FROM orders" for c in _PROFILED) + " UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), round(100.0 * count(*) FILTER (WHERE o_totalprice IS NULL) / count(*), 2), CAST(CAST(round(min(o_totalprice)) AS BIGINT) AS VARCHAR), CAST(CAST(round(max(o_totalprice)) AS BIGINT) AS VARCHAR) FROM orders UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate), round(100.0 * count(*) FILTER (WHERE o_orderdate IS NULL) / count(*), 2), strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d') FROM orders")
def a1(r):
    """Every column; prices are shown to the whole number and times to the day, as engines print them differently."""
    p = M.profile(r("orders"))
    for c in ("min", "max"):
        shown = F.when(F.col("column") == "o_totalprice", F.round(F.col(c).try_cast("double")).cast("bigint").cast("string")).when(F.col("column") == "o_orderdate", F.substring(c, 1, 10)).otherwise(F.col(c))
        p = p.withColumn(c, shown)
    return p


@query("a1_approx_profile")
def a1b(r):
    return M.profile(r("lineitem"), exact=False)


@query("a2_enumerations", "SELECT 'p_brand' AS \"column\", list(DISTINCT p_brand ORDER BY p_brand) AS values, FALSE AS case_sensitive FROM part UNION ALL SELECT 'p_type', list(DISTINCT p_type ORDER BY p_type), FALSE FROM part")
def a2(r):
    return M.enumerated(r("part"), ["p_brand", "p_type"])


@query("a4_formats", "SELECT bool_and(regexp_full_match(c_name, 'Customer#[0-9]{9}')) AS templated, bool_and(regexp_full_match(c_name, '[^@]+@[^@]+')) AS email FROM customer")
def a4(r):
    return r("customer").agg(F.bool_and(F.col("c_name").rlike("^Customer#[0-9]{9}$")).alias("templated"), F.bool_and(F.col("c_name").rlike("^[^@]+@[^@]+$")).alias("email"))


@query("a5_null_rates", "SELECT 'size_or_null' AS \"column\", round(100.0 * count(*) FILTER (WHERE p_size > 20) / count(*), 2) AS null_pct FROM part HAVING 100.0 * count(*) FILTER (WHERE p_size > 20) / count(*) > 50")
def a5(r):
    p = r("part").select("p_partkey", F.when(F.col("p_size") <= 20, F.col("p_size")).alias("size_or_null"))
    return M.profile(p).where("null_pct > 50").select("column", "null_pct")


@query("a7_join_patterns", f"SELECT g[1] AS right_table, g[2] AS a, g[3] AS a_col, g[4] AS b, g[5] AS b_col, count(*) AS frequency FROM (SELECT regexp_extract(sql_text, '{X.JOIN_ON[4:]}', ['r','a','ac','b','bc'], 'i') AS s FROM {_SQL_LOG}) t, LATERAL (SELECT [s.r, s.a, s.ac, s.b, s.bc] AS g) WHERE g[1] <> '' GROUP BY ALL")
def a7(r):
    got = F.arrays_zip(*[F.regexp_extract_all("sql_text", F.lit(X.JOIN_ON), F.lit(i)).alias(f"g{i}") for i in range(1, 6)])
    j = _sql_log(r).select(F.explode(got).alias("j"))
    return j.groupBy(F.col("j.g1").alias("right_table"), F.col("j.g2").alias("a"), F.col("j.g3").alias("a_col"), F.col("j.g4").alias("b"), F.col("j.g5").alias("b_col")).agg(F.count("*").alias("frequency"))


@query("a8_table_counts", f"SELECT t AS table_name, count(*) AS n FROM (SELECT id, unnest(list_distinct([lower(x) for x in regexp_extract_all(sql_text, '(?i)\\b(?:FROM|JOIN)\\s+([A-Za-z_][\\w.]*)', 1)])) AS t FROM {_SQL_LOG}) GROUP BY 1")
def a8(r):
    return _sql_log(r).select(F.explode(X.referenced_tables(F.col("sql_text"))).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("n"))


@query("a9_degrees", "WITH e AS (SELECT DISTINCT l_partkey AS s, l_suppkey AS d FROM lineitem) SELECT node, count(*) AS degree FROM (SELECT 'p' || s AS node FROM e UNION ALL SELECT 's' || d FROM e) GROUP BY 1 ORDER BY degree DESC, node LIMIT 20")
def a9(r):
    e = r("lineitem").select("l_partkey", "l_suppkey").distinct()
    ends = e.select(F.explode(F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"))).alias("node"))
    return A.top_k(ends.groupBy("node").agg(F.count("*").alias("degree")), "degree", "node", 20)


@query("a12_call_cost", f"SELECT stage, model, count(*) AS calls, round(sum(input_tokens * CASE model WHEN 'large' THEN 0.005 ELSE 0.0004 END + output_tokens * CASE model WHEN 'large' THEN 0.015 ELSE 0.0016 END) / 1000, 6) AS cost FROM {_CALLS} GROUP BY GROUPING SETS ((stage), (model), ())")
def a12(r):
    e = r("events")
    calls = e.select(F.col("event_type").alias("stage"), F.when(e.event_id % 2 == 0, "large").otherwise("small").alias("model"), (e.event_id % 1000).alias("i"), (e.event_id % 200).alias("o"))
    large = F.col("model") == "large"
    cost = (F.col("i") * F.when(large, 0.005).otherwise(0.0004) + F.col("o") * F.when(large, 0.015).otherwise(0.0016)) / 1000
    return calls.withColumn("c", cost).groupingSets([["stage"], ["model"], []], "stage", "model").agg(F.count("*").alias("calls"), F.round(F.sum("c"), 6).alias("cost"))


@query("a13_counters", "SELECT event_type, user_id % 3 AS difficulty, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def a13(r):
    return r("events").groupBy("event_type", (F.col("user_id") % 3).alias("difficulty")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@query("a14_histogram", "SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS cum FROM events, (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]) AS le) GROUP BY 1, 2")
def a14(r):
    return A.bucket_counts(r("events"), "value", _BOUNDS, ["event_type"]).where(F.col("le") < float("inf")).select("event_type", "le", "cum")


@query("a15_bucket_quantile", "WITH b AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS cum, count(*) AS total FROM events, (SELECT unnest([1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]) AS le) GROUP BY 1, 2), l AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(cum) OVER w, 0) AS bef FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)) SELECT event_type, round(arg_min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (0.95 * total - bef) / nullif(cum - bef, 0) END, le), 6) AS p95 FROM l WHERE cum >= 0.95 * total GROUP BY 1")
def a15(r):
    b = A.bucket_counts(r("events"), "value", _BOUNDS, ["event_type"])
    return A.bucket_quantile(b, 0.95, ["event_type"]).select("event_type", F.round("value", 6).alias("p95"))


@query("a16_feedback_rate", "SELECT round(100.0 * count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 0), 1) AS positive_pct FROM events")
def a16(r):
    t = F.col("event_type")
    return r("events").agg(F.round(100.0 * F.count_if(t == "purchase") / F.nullif(F.count_if(t.isin("purchase", "error")), F.lit(0)), 1).alias("positive_pct"))


@query("a18_accuracy", "SELECT source, count(*) AS n, round(avg(quality), 6) AS pass_rate FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)")
def a18(r):
    return r("labels").join(r("documents").select("doc_id", "source"), "doc_id").rollup("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("pass_rate"))


@query("f1_table_names", f"SELECT DISTINCT lower(trim(t)) AS name FROM (SELECT unnest(regexp_extract_all(sql_text, '(?i)\\b(?:FROM|JOIN)\\s+([A-Za-z_][\\w.]*)', 1)) AS t FROM {_SQL_LOG})")
def f1(r):
    return _sql_log(r).select(F.explode(F.regexp_extract_all("sql_text", F.lit(X.TABLE_REF), F.lit(1))).alias("t")).select(X.table_name(F.col("t")).alias("name")).distinct()


@query("f8_valid_sql", f"SELECT id FROM {_SQL_LOG} WHERE trim(sql_text) <> '' AND length(sql_text) <= 50000 AND upper(regexp_extract(sql_text, '^\\s*(\\w+)', 1)) IN ('SELECT', 'WITH')")
def f8(r):
    s = F.col("sql_text")
    return _sql_log(r).where((F.trim(s) != "") & (F.length(s) <= 50000) & F.upper(F.regexp_extract(s, r"^\s*(\w+)", 1)).isin("SELECT", "WITH")).select("id")


@query("f9_read_only", f"SELECT id, coalesce(upper(regexp_extract(sql_text, '^\\s*(\\w+)', 1)) IN ('SELECT', 'WITH'), FALSE) AS ok FROM {_SQL_LOG}")
def f9(r):
    return _sql_log(r).select("id", Q.read_only(F.col("sql_text")).alias("ok"))


@query("f11_clean_sql", f"SELECT id, CASE WHEN contains(upper(sql_text), 'LIMIT') THEN rtrim(sql_text, ';') ELSE rtrim(sql_text, ';') || ' LIMIT 50' END AS clean FROM {_SQL_LOG} WHERE sql_text <> ''")
def f11(r):
    s = F.regexp_replace("sql_text", r";+$", "")
    return _sql_log(r).where("sql_text <> ''").select("id", F.when(F.upper("sql_text").contains("LIMIT"), s).otherwise(F.concat(s, F.lit(" LIMIT 50"))).alias("clean"))


@query("f16_keyword_flag", "SELECT conv_id, turn FROM conversations WHERE regexp_matches(lower(text), '\\b(the|count|total)\\b')")
def f16(r):
    return r("conversations").where(F.lower("text").rlike(X.whole_words("the|count|total"))).select("conv_id", "turn")


@query("f23_urls", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '([0-9]+)', 1) AS first_number FROM pages")
def f23(r):
    return r("pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([0-9]+)", 1).alias("first_number"))


@query("g3_merged_graph", "SELECT s AS src, d AS dst, CASE WHEN n >= 20 THEN 0.95 WHEN n >= 10 THEN 0.85 WHEN n >= 5 THEN 0.7 WHEN n >= 2 THEN 0.5 ELSE 0.3 END AS weight, 'lines' AS source FROM (SELECT 'p' || l_partkey AS s, 's' || l_suppkey AS d, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def g3(r):
    e = r("lineitem").groupBy(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).agg(F.count("*").alias("n"))
    e = e.select("src", "dst", X.frequency_weight(F.col("n")).alias("weight"), F.lit("lines").alias("source"))
    return M.merged_edges(e).drop("join_key")


@query("g4_shortest_paths", "WITH RECURSIVE t AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up FROM orders), w AS (SELECT id AS start, id AS node, CAST(id AS VARCHAR) AS path, 0 AS n FROM t WHERE up IS NULL UNION ALL SELECT start, id, path || '>' || id, n + 1 FROM w JOIN t ON node = up WHERE n < 4) SELECT start, node, path, n FROM w")
def g4(r):
    """From each customer's first order along the later ones, four hops at most."""
    t = r("orders").select(F.col("o_orderkey").alias("dst"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("src"))
    return M.shortest_paths(t.where("src is not null").select("src", "dst"), t.where("src is null").select(F.col("dst").alias("node")), hops=4)


@query("g4_shortest_paths_all")
def g4_all(r):
    """From the three least suppliers to every node that can be reached; a line joins its part and supplier both ways."""
    e = r("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).dropna().distinct()
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    starts = r("lineitem").select("l_suppkey").dropna().distinct().orderBy("l_suppkey").limit(3)
    return M.shortest_paths(e, starts.select(F.concat(F.lit("s"), "l_suppkey").alias("node")), hops=None)


_WORDS = "(SELECT DISTINCT p_name AS value FROM part)"


@query("t2_similar_values", f"WITH v AS (SELECT value, list_distinct([substr(lower(value), i, 3) for i in range(1, length(value) - 1)]) AS g FROM {_WORDS}) SELECT a.value AS a, b.value AS b, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS similarity FROM v a JOIN v b ON a.value < b.value WHERE len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.3")
def t2(r):
    return M.similar_values(r("part").select(F.col("p_name").alias("value")).distinct()).withColumn("similarity", F.round("similarity", 6))


@query("t2_similar_values_lsh")
def t2b(r):
    return M.similar_values_lsh(r("part").select(F.col("p_name").alias("value")).distinct())


@query("t4_chunks", "SELECT doc_id, CAST((pos - 1) // 900 AS BIGINT) AS part, trim(substr(text, pos, 1000), ' ') AS text, substr(sha256(trim(substr(text, pos, 1000), ' ')), 1, 16) AS hash, length(trim(substr(text, pos, 1000), ' ')) AS char_count FROM (SELECT doc_id, text, unnest(range(1, greatest(length(text), 1) + 1, 900)) AS pos FROM documents) WHERE trim(substr(text, pos, 1000), ' ') <> ''")
def t4(r):
    return M.chunks(r("documents"), 1000, 100)


@query("t6_content_dedupe", "SELECT substr(sha256(trim(text, ' ')), 1, 16) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def w14(r):
    return r("documents").groupBy(X.short_hash(F.trim("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"))


_PII = dict(zip(("digits", "emails", "phones", "ips", "uuids"), X.POLICY, strict=True))


@query("t11_pii_counts", "SELECT * FROM (SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {k}" for k, p in _PII.items()) + f" FROM documents) WHERE {' + '.join(_PII)} > 0")
def t11(r):
    """Matches of each of the policy's five patterns in every document that has any."""
    d = r("documents").select("doc_id", *[F.regexp_count("text", F.lit(p)).alias(k) for k, p in _PII.items()])
    return d.where(" + ".join(_PII) + " > 0")


@query("t11_pii_matches")
def t11_all(r):
    """Every match with its place, but for names of columns and values in a safe context."""
    names = sorted({c for t in ("documents", "orders", "customer", "supplier", "part", "lineitem", "events") for c in r(t).columns})
    return X.pii_matches(r("documents"), r.spark.createDataFrame([(n,) for n in names], "name string"))


def _nested_sql(x, pats):
    for p in pats:
        x = f"regexp_replace({x}, '{p}', '[REDACTED]', 'g')"
    return x


@query("t12_redaction", f"SELECT doc_id, md5({_nested_sql('text', X.POLICY)}) AS h FROM documents")
def t12(r):
    return r("documents").select("doc_id", F.md5(X.redacted(F.col("text"))).alias("h"))


@query("t15_numeric_summary", "SELECT 'l_quantity' AS \"column\", min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), round(avg(l_tax), 6) FROM lineitem")
def t15(r):
    cols = ("l_quantity", "l_tax")
    one = r("lineitem").agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi"), F.round(f"mean_{c}", 6).alias("mean")) for c in cols])))


@query("v1_nearest", "WITH n AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM n QUALIFY rank <= 5")
def v1(r):
    e = r("embeddings")
    return M.nearest(e.where("vec_id % 50 = 0"), e, 5).withColumn("similarity", F.round("similarity", 6))


@query("w12_latest_sql", f"SELECT substr(sha256(lower(regexp_replace(trim(sql_text), '\\s+', ' ', 'g'))), 1, 16) AS h, arg_max(id, (updated_at, -id)) AS id FROM {_SQL_LOG} GROUP BY 1")
def w12(r):
    return _sql_log(r).groupBy(X.short_hash(X.normal_key(F.col("sql_text"))).alias("h")).agg(F.max_by("id", F.struct("updated_at", -F.col("id"))).alias("id"))


@query("w13_first_question", "SELECT lower(trim(text)) AS q, min(conv_id) AS conv_id FROM conversations WHERE role = 'user' GROUP BY 1")
def w13(r):
    return r("conversations").where("role = 'user'").groupBy(F.lower(F.trim("text")).alias("q")).agg(F.min("conv_id").alias("conv_id"))


@query("w15_last_turns", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def w15(r):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return r("conversations").select("conv_id", "turn", F.row_number().over(w).alias("n")).where("n <= 3").select("conv_id", "turn")


@query("s18_training_jsonl", "SELECT conv_id, turn, text AS question, nxt AS answer FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nrole = 'assistant'")
def s18(r):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = r("conversations").withColumn("answer", F.lead("text").over(w)).withColumn("nrole", F.lead("role").over(w))
    return c.where("role = 'user' and nrole = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


@query("s19_inventory", "SELECT source, count(*) AS documents, CAST(sum(ceil(length(text) / 4000.0)) AS BIGINT) AS chunks FROM documents GROUP BY 1")
def s19(r):
    return r("documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.ceil(F.length("text") / 4000.0)).alias("chunks"))


@query("l3_overview", "SELECT count(*) AS total, count(DISTINCT user_id) AS users, round(avg(value), 4) AS latency FROM events")
def l3(r):
    return r("events").agg(F.count("*").alias("total"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("latency"))


@query("k8_top_questions", "SELECT lower(text) AS q, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1 ORDER BY n DESC, q LIMIT 10")
def k8(r):
    return A.top_k(r("conversations").where("role = 'user'").groupBy(F.lower("text").alias("q")).agg(F.count("*").alias("n")), "n", "q", 10)


@query("st1_windowed_rates", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS w, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st1(r):
    return r("events").groupBy(F.window("ts", "1 hour").alias("win"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("win.start", "yyyy-MM-dd HH:mm").alias("w"), "event_type", "n")


@query("st9_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, sid")
def st9(r):
    s = r("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


@query("st5_in_flight", "SELECT event_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_flight FROM events")
def st5(r):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return r("events").select("event_id", F.sum(F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)).over(w).alias("in_flight"))


@query("st6_feedback_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS feedback FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1")
def st6(r):
    return r("events").where(F.col("event_type").isin("purchase", "error")).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("feedback"))
