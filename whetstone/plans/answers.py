"""Documents, glossary, retrieval, graphs, training pairs, audits and feedback over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from whetstone.functions import sqltext as Q
from whetstone.functions import text as X
from whetstone.operators import documents as D
from whetstone.operators import feedback as B
from whetstone.operators import metadata as M
from whetstone.operators import terms
from whetstone.plans.catalog import _tables, _TABLES
from whetstone.registry import query
from whetstone.sources import catalog as S
from whetstone.sources import files

_REFS = "list_distinct([lower(x) for x in regexp_extract_all(sql_text, '(?i)\\b(?:FROM|JOIN)\\s+([A-Za-z_][\\w.]*)', 1)])"

# --- documents -------------------------------------------------------------------------------------------------------

_MD = "('# doc ' || doc_id || chr(10) || replace(text, chr(10), chr(10) || '## '))"
_TRIM = "' ' || chr(9) || chr(10) || chr(13)"


def _markdown(r):
    return r("documents").select("doc_id", F.concat(F.lit("# doc "), "doc_id", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("text"))


@query("t5_sections", f"SELECT doc_id, count(*) FILTER (WHERE s LIKE '# %') AS first, count(*) FILTER (WHERE s LIKE '## %') AS second FROM (SELECT doc_id, trim(x, {_TRIM}) AS s FROM (SELECT doc_id, unnest(string_split({_MD}, chr(10))) AS x FROM documents WHERE text IS NOT NULL)) GROUP BY 1")
def t5(r):
    """Each line of a document as a section of its own, under the document's header."""
    s = D.sections(_markdown(r), ["doc_id"])
    return s.groupBy("doc_id").agg(F.count_if((F.col("level") == 1) & (F.col("header") != "")).alias("first"), F.count_if((F.col("level") == 2) & (F.col("header") != "")).alias("second"))


@query("t5_page_sections", "SELECT page_id, len(regexp_extract_all(html, '(?i)<h1')) AS h1, len(regexp_extract_all(html, '(?i)<h2')) AS h2, len(regexp_extract_all(html, '(?i)<h3')) AS h3 FROM pages")
def t5_pages(r):
    """Headers of pages that the Markdown of their text keeps."""
    t = r("pages").select("page_id", D.page_text(F.col("html")).alias("text"))
    s = D.sections(t, ["page_id"]).groupBy("page_id").agg(*[F.count_if(F.col("level") == i).alias(f"h{i}") for i in (1, 2, 3)])
    return r("pages").select("page_id").join(s, "page_id", "left").na.fill(0)


@query("t4_semantic_chunks")
def t4(r):
    """Whole texts in chunks of 4,000 characters at most, 400 of them again, cut at blank lines or sentences."""
    return D.split_long(r("documents").select("doc_id", "text"), ["doc_id"])


@query("t4_short_documents", f"SELECT doc_id, 0 AS part, 1 AS parts, substr(sha256(trim(text, {_TRIM})), 1, 16) AS hash, length(trim(text, {_TRIM})) AS char_count FROM documents WHERE length(text) <= 4000 AND trim(text, {_TRIM}) <> ''")
def t4_short(r):
    """The same where it cuts nothing."""
    return D.split_long(r("documents").select("doc_id", "text"), ["doc_id"]).where("parts = 1 and start = 0").join(r("documents").where(F.length("text") <= 4000).select("doc_id"), "doc_id", "left_semi").select("doc_id", "part", "parts", "hash", "char_count")


@query("w16_numbered_parts")
def w16(r):
    """Sections whose titles number their parts where there are several."""
    return D.section_chunks(_markdown(r), ["doc_id"]).select("doc_id", "section", "title", "part", "hash")


@query("s19_document_status", "SELECT doc_id, CASE WHEN length(text) > 0 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN 'indexed' ELSE 'uploaded' END AS status FROM documents")
def s19(r):
    """A document is indexed if it has a chunk, else uploaded only."""
    chunks = D.split_long(r("documents").select("doc_id", "text"), ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"))
    return r("documents").select("doc_id").join(chunks, "doc_id", "left").select("doc_id", F.when(F.coalesce("n", F.lit(0)) > 0, "indexed").otherwise("uploaded").alias("status"))


_MODEL = "SELECT DISTINCT kind, name, text FROM (SELECT 'table' AS kind, p_brand AS name, p_brand || ': sold as ' || min(p_type) AS text FROM part GROUP BY p_brand UNION ALL SELECT 'table_synonym', lower(p_brand), lower(p_brand) || ' is table ' || p_brand FROM part UNION ALL SELECT 'dimension', p_type, p_brand || '.' || p_type || ' = type ' || p_type FROM part UNION ALL SELECT 'synonym', lower(p_type), lower(p_type) || ' is ' || p_brand || '.' || p_type FROM part UNION ALL SELECT 'metric', p_name, p_brand || '.' || p_name || ' = sum(' || p_name || ')' FROM part UNION ALL SELECT 'relationship', p_brand, p_brand || ' joins ' || s_name || ' on suppkey' FROM (SELECT DISTINCT l_partkey, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) JOIN part ON p_partkey = l_partkey UNION ALL SELECT 'rule', p_brand, 'size ' || p_size || ' of ' || p_brand FROM part UNION ALL SELECT 'verified_query', p_brand, 'SELECT * FROM part WHERE p_type = ' || p_type || ' -- ' || p_brand FROM part)"


@query("t9_glossary_entries", _MODEL)
def t9(r):
    p = r("part")
    none = F.array().cast("array<string>")
    named = lambda c, expr, syn: F.array_distinct(F.collect_list(F.struct(F.col(c).alias("name"), expr.alias("expr"), syn.alias("synonyms"))))
    sold = r("lineitem").select("l_partkey", "l_suppkey").distinct().join(r("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    joins = sold.join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("name")).agg(F.collect_set(F.struct(F.col("s_name").alias("other"), F.lit("suppkey").alias("on"))).alias("relationships"))
    model = p.groupBy(F.col("p_brand").alias("name")).agg(
        F.concat(F.lit("sold as "), F.min("p_type")).alias("description"),
        F.array(F.lower(F.first("p_brand"))).alias("synonyms"),
        named("p_type", F.concat(F.lit("type "), "p_type"), F.array(F.lower("p_type"))).alias("dimensions"),
        F.array_compact(F.array(F.lit(None).cast("struct<name:string,expr:string,synonyms:array<string>>"))).alias("time_dimensions"),
        named("p_name", F.concat(F.lit("sum("), "p_name", F.lit(")")), none).alias("metrics"),
        F.collect_set(F.concat(F.lit("size "), "p_size", F.lit(" of "), "p_brand")).alias("rules"),
        F.collect_set(F.concat(F.lit("SELECT * FROM part WHERE p_type = "), "p_type", F.lit(" -- "), "p_brand")).alias("queries"),
    )
    model = model.join(joins, "name", "left").withColumn("relationships", F.coalesce("relationships", F.array().cast("array<struct<other:string,on:string>>")))
    return D.glossary(model).select("kind", "name", "text")


@query("t10_term_resolution", "WITH a AS (SELECT w AS alias, min(item_id) AS canonical FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark) GROUP BY 1), t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM documents) SELECT canonical, count(DISTINCT doc_id) AS documents, count(*) AS mentions FROM t JOIN a ON w = alias GROUP BY 1")
def t10(r):
    """Words of documents that are aliases of an item; the least item has an alias."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("w")
    alias = r("benchmark").select("item_id", words).groupBy("w").agg(F.min("item_id").alias("canonical"))
    found = r("documents").select("doc_id", words).distinct().join(alias, "w")
    return found.groupBy("canonical").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("mentions"))


@query("t13_evidence", "SELECT 'o_orderstatus' AS \"column\", string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) AS summary FROM orders UNION ALL SELECT 'o_orderpriority', string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) FROM orders UNION ALL SELECT 'o_orderkey', min(o_orderkey) || ' to ' || max(o_orderkey) FROM orders UNION ALL SELECT 'day', count(DISTINCT CAST(o_orderdate AS DATE)) || ' distinct values' FROM orders")
def t13(r):
    return D.evidence(r("orders").select("o_orderstatus", "o_orderpriority", "o_orderkey", F.to_date("o_orderdate").cast("string").alias("day")))


@query("t14_probes", "SELECT 'rows' AS probe, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'from', strftime(min(o_orderdate), '%Y-%m-%d') FROM orders UNION ALL SELECT 'to', strftime(max(o_orderdate), '%Y-%m-%d') FROM orders UNION ALL SELECT 'nulls', CAST(count(*) FILTER (WHERE o_custkey IS NULL) AS VARCHAR) FROM orders UNION ALL SELECT 'values', string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders UNION ALL SELECT 'sample', string_agg(o_orderkey, ',' ORDER BY o_orderkey) FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5)")
def t14(r):
    """One pass for counts, range, nulls and values; a sample is the first five rows by key, which is the probe."""
    o = r("orders")
    day = lambda f: F.date_format(f("o_orderdate"), "yyyy-MM-dd")
    one = o.agg(F.count("*").cast("string").alias("rows"), day(F.min).alias("from"), day(F.max).alias("to"), F.count_if(F.col("o_custkey").isNull()).cast("string").alias("nulls"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("values"))
    sample = o.orderBy("o_orderkey").limit(5).agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("sample"))
    return one.unpivot([], one.columns, "probe", "value").unionByName(sample.unpivot([], ["sample"], "probe", "value"))


# --- errors, guards, scores ------------------------------------------------------------------------------------------

#: Classes of error messages by words, first match first.
RULES = (
    ("syntax", "sql_syntax_error", ("syntax", "unexpected", "mismatched input")),
    ("schema_link", "col_missing", ("does not exist", "cannot be resolved", "column not found")),
    ("filter", "type_mismatch", ("type mismatch", "cannot be cast", "cannot be applied")),
    ("aggregation", "missing_group_by", ("must be an aggregate", "group by", "not in group by")),
    ("join", "ambiguous_column", ("ambiguous", "column reference")),
    ("function", "wrong_arg_type", ("unexpected parameters", "function not found")),
    ("date_time", "wrong_date_format", ("cannot cast", "date", "timestamp", "interval")),
)
_ERRORS = ("line 1: mismatched input", "Column x does not exist", "Type mismatch here", "x must be an aggregate", "Column reference is AMBIGUOUS", "Function not found", "cannot cast to DATE", "broken pipe", "x cannot be resolved by date")
_MESSAGES = "(SELECT event_id, " + f"['{chr(39).join(())}" + "', '".join(_ERRORS) + f"'][CAST(event_id % {len(_ERRORS)} + 1 AS INT)] AS m FROM events)"


@query("j17_error_classes", f"SELECT event_id, CASE event_id % {len(_ERRORS)} WHEN 0 THEN 'syntax' WHEN 1 THEN 'schema_link' WHEN 2 THEN 'filter' WHEN 3 THEN 'aggregation' WHEN 4 THEN 'join' WHEN 5 THEN 'function' WHEN 6 THEN 'date_time' WHEN 7 THEN 'syntax' ELSE 'schema_link' END AS category FROM events")
def j17(r):
    return B.classified(_messages(r), RULES, ("syntax", "sql_syntax_error")).select("event_id", "category")


def _messages(r):
    return r("events").select("event_id", "event_type", F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % len(_ERRORS) + 1).cast("int")).alias("message"))


@query("t16_error_rollup", "SELECT category, subtype, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(m, 'syntax|unexpected|mismatched input') THEN ['syntax', 'sql_syntax_error'] WHEN regexp_matches(m, 'does not exist|cannot be resolved|column not found') THEN ['schema_link', 'col_missing'] WHEN regexp_matches(m, 'type mismatch|cannot be cast') THEN ['filter', 'type_mismatch'] WHEN regexp_matches(m, 'must be an aggregate|group by') THEN ['aggregation', 'missing_group_by'] WHEN regexp_matches(m, 'ambiguous|column reference') THEN ['join', 'ambiguous_column'] WHEN regexp_matches(m, 'function not found') THEN ['function', 'wrong_arg_type'] WHEN regexp_matches(m, 'cannot cast|date') THEN ['date_time', 'wrong_date_format'] ELSE ['syntax', 'sql_syntax_error'] END AS c, c[1] AS category, c[2] AS subtype FROM (SELECT lower(m) AS m FROM " + _MESSAGES + ")) GROUP BY ROLLUP (category, subtype)")
def t16(r):
    return B.classified(_messages(r), RULES, ("syntax", "sql_syntax_error")).rollup("category", "subtype").agg(F.count("*").alias("n"))


_PLANS = "(SELECT event_id, CAST(value AS DECIMAL(18,2)) AS v, 'ScanFilter ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || CASE event_id % 3 WHEN 0 THEN ' TB' WHEN 1 THEN 'GB' ELSE ' mb' END || ' and 1GB; Output: est ' || (event_id * 7) || ' rows' AS plan FROM events)"


def _plans(r):
    unit = F.when(F.col("event_id") % 3 == 0, " TB").when(F.col("event_id") % 3 == 1, "GB").otherwise(" mb")
    return r("events").select("event_id", F.concat(F.lit("ScanFilter "), F.col("value").cast("decimal(18,2)").cast("string"), unit, F.lit(" and 1GB; Output: est "), F.col("event_id") * 7, F.lit(" rows")).alias("plan"))


_GB = "greatest(1.0, CAST(v AS DOUBLE) * CASE event_id % 3 WHEN 0 THEN 1024.0 WHEN 1 THEN 1.0 ELSE 1 / 1024.0 END)"


@query("x25_scan_sizes", f"SELECT event_id, round({_GB}, 4) AS scan_gb, event_id * 7 AS rows FROM {_PLANS}")
def x25(r):
    return B.guarded(_plans(r)).select("event_id", F.round("scan_gb", 4).alias("scan_gb"), "rows")


@query("x26_guard_verdicts", f"SELECT allowed, kind, count(*) AS n FROM (SELECT {_GB} <= 500 AND event_id * 7 <= 10000 AS allowed, CASE WHEN {_GB} > 500 THEN 'scan ' ELSE '' END || CASE WHEN event_id * 7 > 10000 THEN 'rows ' ELSE '' END AS kind FROM {_PLANS}) GROUP BY 1, 2")
def x26(r):
    g = B.guarded(_plans(r))
    kind = F.concat(F.when(F.col("reason").contains(" GB is over 500"), "scan ").otherwise(""), F.when(F.col("reason").contains("rows are over 10000"), "rows ").otherwise(""))
    return g.groupBy("allowed", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("x22_confidence", "SELECT event_id, s / 10.0 AS score, CASE WHEN s >= 7 THEN 'HIGH' WHEN s >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM (SELECT event_id, CASE WHEN event_id % 4 >= 3 THEN 2 WHEN event_id % 4 = 2 THEN 1 ELSE 0 END + CASE WHEN event_type <> 'error' THEN 2 ELSE 0 END + CASE WHEN value < 100 THEN 1 ELSE 0 END + CASE WHEN user_id % 2 >= 1 THEN 1 ELSE 0 END + CASE WHEN user_id % 3 >= 1 THEN 1 ELSE 0 END + CASE WHEN event_id % 10 / 10.0 >= 0.7 THEN 2 WHEN event_id % 10 / 10.0 >= 0.5 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 >= 1 THEN 1 ELSE 0 END AS s FROM events)")
def x22(r):
    e = F.col("event_id")
    c = B.confidence(e % 4, F.col("event_type") == "error", F.col("value") < 100, F.col("user_id") % 2, F.col("user_id") % 3, e % 10 / 10, e % 5)
    return r("events").select("event_id", c.alias("c")).select("event_id", "c.score", "c.level")


@query("a17_tournament", "WITH m AS (SELECT user_id AS round, event_id % 3 AS a, 3 + event_id % 2 AS b, CASE event_type WHEN 'click' THEN event_id % 3 WHEN 'view' THEN 3 + event_id % 2 END AS w FROM events), p AS (SELECT round, candidate, sum(points) AS points FROM (SELECT round, a AS candidate, CASE WHEN w IS NULL THEN 0.5 WHEN w = a THEN 1.0 ELSE 0.0 END AS points FROM m UNION ALL SELECT round, b, CASE WHEN w IS NULL THEN 0.5 WHEN w = b THEN 1.0 ELSE 0.0 END FROM m) GROUP BY 1, 2) SELECT round, candidate, CAST(points AS DOUBLE) AS points, row_number() OVER (PARTITION BY round ORDER BY points DESC, candidate) = 1 AS won FROM p")
def a17(r):
    e = F.col("event_id")
    m = r("events").select(F.col("user_id").alias("round"), (e % 3).alias("a"), (3 + e % 2).alias("b"), F.when(F.col("event_type") == "click", e % 3).when(F.col("event_type") == "view", 3 + e % 2).alias("winner"))
    return B.tournament(m)


@query("a11_test_set_checks", "SELECT count(*) AS n, max(item_id) - min(item_id) + 1 = count(DISTINCT item_id) AS sequential, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS without_text, (SELECT count(*) FROM (SELECT item_id % 7 FROM benchmark GROUP BY 1 HAVING count(*) < 10)) AS small_categories, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z_]+[.][A-Za-z_]+')) AS with_table FROM benchmark")
def a11(r):
    b = r("benchmark")
    small = b.groupBy(F.col("item_id") % 7).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") < 10).alias("small_categories"))
    one = b.agg(F.count("*").alias("n"), (F.max("item_id") - F.min("item_id") + 1 == F.count_distinct("item_id")).alias("sequential"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("without_text"), F.count_if(F.col("text").rlike("[A-Za-z_]+[.][A-Za-z_]+")).alias("with_table"))
    return one.crossJoin(small)  # one row each


@query("a16_cache_rates", "WITH h AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ts - before <= INTERVAL 1 HOUR) AS hits, round(100.0 * count(*) FILTER (WHERE ts - before <= INTERVAL 1 HOUR) / count(*), 1) AS hit_pct FROM h GROUP BY 1")
def a16(r):
    """How often the same question came within an hour before."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    hit = r("events").select("event_type", (F.col("ts") <= F.lag("ts").over(w) + F.expr("interval 1 hour")).alias("hit"))
    return hit.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(100.0 * F.count_if("hit") / F.count("*"), 1).alias("hit_pct"))


@query("a18_accuracy_summary", "WITH x AS (SELECT source, quality, 1 - toxic AS ran, CASE WHEN doc_id % 3 = 0 THEN 'SIMPLE' ELSE 'COMPLEX' END AS difficulty, list_distinct([doc_id % 4, doc_id % 5]) AS got, list_distinct([doc_id % 4, doc_id % 3]) AS want, n_chars FROM labels JOIN documents USING (doc_id)) SELECT difficulty, source, count(*) AS n, round(avg(quality), 6) AS pass_rate, round(avg(ran), 6) AS execution, round(avg(len(list_intersect(got, want)) / len(want)), 6) AS recall, round(avg(len(list_intersect(got, want)) / len(got)), 6) AS precision, round(quantile_cont(n_chars, 0.95), 4) AS p95 FROM x GROUP BY ROLLUP (difficulty, source)")
def a18(r):
    d = F.col("doc_id")
    x = r("labels").join(r("documents").select("doc_id", "source", "n_chars"), "doc_id").withColumns({"difficulty": F.when(d % 3 == 0, "SIMPLE").otherwise("COMPLEX"), "got": F.array_distinct(F.array(d % 4, d % 5)), "want": F.array_distinct(F.array(d % 4, d % 3))})
    both = F.size(F.array_intersect("got", "want"))
    return x.rollup("difficulty", "source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("pass_rate"), F.round(F.avg(1 - F.col("toxic")), 6).alias("execution"), F.round(F.avg(both / F.size("want")), 6).alias("recall"), F.round(F.avg(both / F.size("got")), 6).alias("precision"), F.round(F.percentile("n_chars", F.lit(0.95)), 4).alias("p95"))


@query("a36_runway", "WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS burn FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT count(*) AS months, round(avg(burn), 2) AS burn, round((SELECT sum(c_acctbal) FROM customer) / avg(burn), 4) AS runway FROM m")
def a36(r):
    m = r("orders").where("o_orderstatus = 'F'").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum("o_totalprice").alias("burn"))
    one = m.agg(F.count("*").alias("months"), F.avg("burn").alias("burn")).crossJoin(r("customer").agg(F.sum("c_acctbal").alias("left")))  # one row each
    return one.select("months", F.round("burn", 2).alias("burn"), F.round(F.col("left") / F.nullif(F.col("burn"), F.lit(0)), 4).alias("runway"))


@query("x2_date_arithmetic", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS later, strftime(o_orderdate - INTERVAL 2 MONTH, '%Y-%m-%d') AS earlier, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') AS soon FROM orders")
def x2(r):
    t = F.col("o_orderdate")
    return r("orders").select("o_orderkey", F.date_format(F.date_add(t, 45), "yyyy-MM-dd").alias("later"), F.date_format(F.add_months(t, -2), "yyyy-MM-dd").alias("earlier"), F.date_format(t + F.expr("interval 90 minutes"), "yyyy-MM-dd HH:mm").alias("soon"))


@query("x15_containment", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7' OR CAST(json_extract_string(props, '$.k') AS INT) IN (1, 2)")
def x15(r):
    """JSON objects that contain {"k": 7}, or whose k is in a list."""
    k = F.from_json("props", "map<string,int>")["k"]
    return r("events").where((k == 7) | F.arrays_overlap(F.array(k), F.array(F.lit(1), F.lit(2)))).select("event_id")


@query("u2_union_distinct", "SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' UNION SELECT user_id FROM events")
def u2(r):
    return r("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")).union(r("events").select("user_id")).distinct()


# --- questions, training pairs ---------------------------------------------------------------------------------------

_LOG = "(SELECT conv_id, turn, text AS question, nxt AS sql, CASE conv_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' END AS confidence, CASE (conv_id + turn) % 4 WHEN 0 THEN 'thumbs_up' WHEN 2 THEN 'corrected' END AS feedback, conv_id * 1000 + turn AS created_at FROM (SELECT *, lead(text) OVER w AS nxt, lead(role) OVER w AS nrole FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nrole = 'assistant')"


def _log(r):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c, k = F.col("conv_id"), (F.col("conv_id") + F.col("turn")) % 4
    rows = r("conversations").withColumn("sql", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w)).where("role = 'user' and next_role = 'assistant'")
    return rows.select("conv_id", "turn", F.col("text").alias("question"), "sql", F.when(c % 3 == 0, "HIGH").when(c % 3 == 1, "MEDIUM").alias("confidence"), F.when(k == 0, "thumbs_up").when(k == 2, "corrected").alias("feedback"), (c * 1000 + F.col("turn")).alias("created_at"))


@query("f15_confident", f"SELECT conv_id, turn FROM {_LOG} WHERE confidence IN ('HIGH', 'MEDIUM')")
def f15(r):
    return B.confident(_log(r), "MEDIUM").select("conv_id", "turn")


@query("f22_feedback_pairs", f"SELECT conv_id, turn, 'liked' AS how FROM {_LOG} WHERE feedback = 'thumbs_up' UNION ALL SELECT conv_id, turn, 'corrected' FROM {_LOG} WHERE feedback = 'corrected' AND trim(sql) <> ''")
def f22(r):
    p = _log(r)
    liked = p.where("feedback = 'thumbs_up'").select("conv_id", "turn", F.lit("liked").alias("how"))
    return liked.unionByName(p.where("feedback = 'corrected' and trim(sql) <> ''").select("conv_id", "turn", F.lit("corrected").alias("how")))


_PAIRS = f"(SELECT question, sql, confidence, created_at, 'query_log' AS source, 0 AS priority FROM {_LOG} WHERE feedback = 'thumbs_up' UNION ALL SELECT question, sql || '!', confidence, created_at, 'corrections', 1 FROM {_LOG} WHERE feedback = 'corrected' UNION ALL SELECT text, 'SELECT ' || item_id, 'HIGH', item_id, 'verified', 2 FROM benchmark UNION ALL SELECT 'order ' || id, sql_text, NULL, id, 'saved', 3 FROM {Q.LOG})"
_GOOD = f"(SELECT * FROM {_PAIRS} WHERE trim(question) <> '' AND trim(sql) <> '')"


def _pairs(r):
    p = _log(r)
    verified = r("benchmark").select(F.col("text").alias("question"), F.concat(F.lit("SELECT "), "item_id").alias("sql"), F.lit("HIGH").alias("confidence"), F.col("item_id").alias("created_at"))
    saved = Q.sql_log(r).select(F.concat(F.lit("order "), "id").alias("question"), F.col("sql_text").alias("sql"), F.lit(None).cast("string").alias("confidence"), F.col("id").alias("created_at"))
    fixed = p.where("feedback = 'corrected'").withColumn("sql", F.concat("sql", F.lit("!")))
    return B.training_pairs(("query_log", p.where("feedback = 'thumbs_up'")), ("corrections", fixed), ("verified", verified), ("saved", saved))


@query("u5_training_union", f"SELECT source, priority, count(*) AS n, count(DISTINCT question) AS questions FROM {_GOOD} GROUP BY 1, 2")
def u5(r):
    return _pairs(r).groupBy("source", "priority").agg(F.count("*").alias("n"), F.count_distinct("question").alias("questions"))


_FIRST = f"(SELECT * FROM {_GOOD} QUALIFY row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY priority, created_at DESC, sql, question) = 1)"


@query("w13_first_by_priority", f"SELECT lower(trim(question)) AS q, source, created_at FROM {_FIRST}")
def w13(r):
    return B.first_of_questions(_pairs(r)).select(F.lower(F.trim("question")).alias("q"), "source", "created_at")


@query("l2_training_corpus", f"SELECT shape, source, count(*) AS n, sum(length(question)) AS chars, sum(length(sql)) AS sql_chars FROM (SELECT * FROM {_GOOD} WHERE confidence IN ('HIGH', 'MEDIUM') QUALIFY row_number() OVER (PARTITION BY lower(trim(question)) ORDER BY priority, created_at DESC, sql, question) = 1), (SELECT unnest(['preference', 'raw']) AS shape) GROUP BY 1, 2")
def l2(r):
    """Confident pairs, one a question, written as JSON lines in two shapes that carry their source, and counted from there."""
    pairs = B.first_of_questions(B.confident(_pairs(r), "MEDIUM"))
    spark, out = pairs.sparkSession, None
    for shape, (source, question, sql) in {"preference": ("$.metadata.source", "$.prompt", "$.chosen"), "raw": ("$.source", "$.question", "$.sql")}.items():
        path = files.scratch(spark, "pairs")
        B.shaped(pairs, shape).write.text(path)
        read = lambda p: F.get_json_object("value", p)
        one = spark.read.text(path).groupBy(read(source).alias("source")).agg(F.count("*").alias("n"), F.sum(F.length(read(question))).alias("chars"), F.sum(F.length(read(sql))).alias("sql_chars")).withColumn("shape", F.lit(shape))
        out = one if out is None else out.unionByName(one)
    return out


@query("s18_chat_lines", f"SELECT question, sql AS answer, count(*) AS n FROM {_LOG} GROUP BY 1, 2")
def s18(r):
    """Chat messages written as JSON lines, read again."""
    p = _log(r)
    path = files.scratch(p.sparkSession, "chat")
    B.shaped(p, "chat").write.text(path)
    m = p.sparkSession.read.text(path).select(F.from_json("value", "messages array<struct<role:string,content:string>>")["messages"].alias("m"))
    said = lambda role: F.filter("m", lambda x: x["role"] == role)[0]["content"]
    return m.groupBy(said("user").alias("question"), said("assistant").alias("answer")).agg(F.count("*").alias("n"))


@query("k6_pending_corrections", f"SELECT conv_id, turn FROM {_LOG} WHERE feedback = 'corrected' ORDER BY created_at DESC, conv_id, turn LIMIT 50")
def k6(r):
    """The fifty newest; fifty is the feature."""
    return _log(r).where("feedback = 'corrected'").orderBy(F.desc_nulls_last("created_at"), "conv_id", "turn").limit(50).select("conv_id", "turn")


@query("k8_recent_failures", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 20")
def k8(r):
    """The twenty latest; twenty is the feature."""
    return r("events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(20).select("event_id", "user_id")


@query("k4_page_with_total", "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' AND o_orderkey > 100 ORDER BY o_orderkey LIMIT 25")
def k4(r):
    """A page of twenty-five by key, and how many rows there are."""
    o = r("orders").where("o_orderstatus = 'O'")
    page = o.where("o_orderkey > 100").orderBy("o_orderkey").limit(25).select("o_orderkey")
    return page.crossJoin(o.agg(F.count("*").alias("total")))  # one row on the right


@query("w15_history", "SELECT conv_id, string_agg(turn || ':' || role, ' ' ORDER BY turn) AS history FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10) GROUP BY 1")
def w15(r):
    """The last ten turns of each conversation, oldest first."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = r("conversations").withColumn("n", F.row_number().over(w)).where("n <= 10")
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["turn"], F.lit(":"), x["role"])), " ").alias("history"))


@query("f16_data_words", f"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '(?i)\\b({X.DATA_WORDS})\\b')")
def f16(r):
    return r("conversations").where(X.has_data_words(F.col("text"))).select("conv_id", "turn")


_SHORT = "(SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'What about ' || text WHEN 1 THEN 'Show me more' WHEN 2 THEN 'only two' ELSE text END AS q FROM conversations WHERE role = 'user')"
_SIGNS = " OR ".join(f"contains(q, '{s}')" for s in X.FOLLOW_UPS)


@query("f17_follow_ups", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, trim(lower(q)) AS q FROM {_SHORT}) WHERE {_SIGNS} OR (len(regexp_extract_all(q, '\\S+')) <= 4 AND NOT regexp_matches(q, '^(how many|what is|show me|list)'))")
def f17(r):
    k = (F.col("conv_id") + F.col("turn")) % 5
    q = F.when(k == 0, F.concat(F.lit("What about "), "text")).when(k == 1, "Show me more").when(k == 2, "only two").otherwise(F.col("text"))
    return r("conversations").where("role = 'user'").select("conv_id", "turn", q.alias("q")).where(X.is_follow_up(F.col("q"))).select("conv_id", "turn")


_PAGE = "CASE page_id % 5 WHEN 0 THEN 'see https://bi.example.org/dashboard/' || page_id || ' for sales' WHEN 1 THEN 'https://bi.example.org/question/' || page_id WHEN 2 THEN 'x https://bi.example.org/question#' || page_id WHEN 3 THEN 'http://bi.example.org/collection/' || page_id || ' what is this page?' ELSE 'What is this dashboard? ' || url END"


def _page_questions(r):
    k, p = F.col("page_id") % 5, F.col("page_id").cast("string")
    q = F.when(k == 0, F.concat(F.lit("see https://bi.example.org/dashboard/"), p, F.lit(" for sales"))).when(k == 1, F.concat(F.lit("https://bi.example.org/question/"), p)).when(k == 2, F.concat(F.lit("x https://bi.example.org/question#"), p)).when(k == 3, F.concat(F.lit("http://bi.example.org/collection/"), p, F.lit(" what is this page?"))).otherwise(F.concat(F.lit("What is this dashboard? "), "url"))
    return r("pages").select("page_id", q.alias("q"))


@query("f23_url_classes", f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'dashboard' WHEN 3 THEN 'collection' ELSE 'question' END AS kind, CASE page_id % 5 WHEN 3 THEN 'http' ELSE 'https' END || '://bi.example.org' AS base, page_id AS id, CASE page_id % 5 WHEN 0 THEN 'see  for sales' WHEN 1 THEN '' WHEN 2 THEN 'x' ELSE 'what is this page?' END AS rest FROM pages WHERE page_id % 5 < 4")
def f23(r):
    p = r"(https?://[^/\s]+)/(dashboard|question|collection)[/#](\d+)"
    q = _page_questions(r).where(F.col("q").rlike(p))
    return q.select("page_id", F.regexp_extract("q", p, 2).alias("kind"), F.regexp_extract("q", p, 1).alias("base"), F.regexp_extract("q", p, 3).cast("long").alias("id"), F.trim(F.regexp_replace("q", p, "")).alias("rest"))


@query("f24_clean_questions", f"SELECT page_id, trim(regexp_replace({_PAGE}, 'https?://\\S+', '', 'g')) AS question, page_id % 5 IN (1, 3, 4) AS about_page FROM pages")
def f24(r):
    return _page_questions(r).select("page_id", X.without_urls(F.col("q")).alias("question"), X.is_about_page(F.col("q")).alias("about_page"))


@query("t20_scopes", "SELECT o_custkey AS scope, string_agg(DISTINCT t, ',' ORDER BY t) AS tables, max(note) AS note FROM (SELECT o_custkey, 'base' AS t, NULL AS note FROM orders UNION ALL SELECT o_custkey, 'p' || o_orderpriority, NULL FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 'base', arg_max('n' || o_orderkey, (o_orderdate, 'n' || o_orderkey)) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) GROUP BY 1")
def t20(r):
    """Accepted suggestions, one an order: those with status F add a table, those with O set a note."""
    o = r("orders")
    scopes = o.select(F.col("o_custkey").alias("scope")).distinct().select("scope", F.array(F.lit("base")).alias("tables"), F.create_map().cast("map<string,string>").alias("notes"))
    s = F.col("o_orderstatus")
    sug = o.select(F.col("o_custkey").alias("scope"), F.when(s == "F", "table").otherwise("note").alias("kind"), F.when(s == "F", F.concat(F.lit("p"), "o_orderpriority")).otherwise("n").alias("name"), F.concat(F.lit("n"), "o_orderkey").alias("note"), F.col("o_orderdate").alias("at"), (s != "P").alias("accepted"))
    return B.applied(scopes, sug).select("scope", F.array_join(F.array_sort("tables"), ",").alias("tables"), F.col("notes")["n"].alias("note"))


# --- retrieval -------------------------------------------------------------------------------------------------------

_COS = "list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def _near(r, k, floor=-1.0, where="true"):
    e = r("embeddings")
    return M.nearest(e.where("vec_id % 50 = 0"), e.where(where), k, floor)


@query("f14_floor", f"SELECT q.vec_id AS query_id, c.vec_id FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 AND {_COS} >= 0.4")
def f14(r):
    """All neighbours of the queries from the floor of 0.4 on."""
    return _near(r, None, 0.4).select("query_id", "vec_id")


@query("k7_shortlist", f"SELECT q.vec_id AS query_id, c.vec_id FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, c.vec_id) <= 200")
def k7(r):
    """The two hundred nearest of each query."""
    return _near(r, 200).select("query_id", "vec_id")


@query("x23_metric_boost", f"SELECT query_id, vec_id, round(s, 6) AS similarity FROM (SELECT q.vec_id AS query_id, c.vec_id, least(1.0, {_COS} + CASE WHEN c.label = q.label THEN 0.1 ELSE 0 END) AS s FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 5")
def x23(r):
    """The five nearest after those of the query's own label gain 0.1, up to 1: five of each label by that sum suffice, in one pass."""
    e = r("embeddings")
    near = M.nearest(e.where("vec_id % 50 = 0"), e, 5, by="label", bonus=0.1)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


_BUNDLE = f"(SELECT q.vec_id AS query_id, CASE WHEN c.label < 4 THEN 'examples' WHEN c.label < 7 THEN 'glossary' ELSE 'docs' END AS kind, c.vec_id, {_COS} AS s FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)"


@query("t18_retrieval_bundle", f"SELECT query_id, max(ids) FILTER (WHERE kind = 'examples') AS examples, max(ids) FILTER (WHERE kind = 'glossary') AS glossary, max(ids) FILTER (WHERE kind = 'docs') AS docs FROM (SELECT query_id, kind, string_agg(vec_id, ',' ORDER BY i) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY s DESC, vec_id) AS i FROM {_BUNDLE}) WHERE i <= CASE kind WHEN 'glossary' THEN 5 ELSE 3 END GROUP BY 1, 2) GROUP BY 1")
def t18(r):
    """For each question its three examples, five glossary entries and three documents, in one pass over all of them."""
    e = r("embeddings").withColumn("kind", F.when(F.col("label") < 4, "examples").when(F.col("label") < 7, "glossary").otherwise("docs"))
    near = M.nearest(e.where("vec_id % 50 = 0"), e, 5, by="kind").where("kind = 'glossary' or rank <= 3")
    ids = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "vec_id")))), lambda x: x["vec_id"].cast("string")), ",")
    some = near.groupBy("query_id").agg(*[F.when(F.count_if(F.col("kind") == kind) > 0, ids(kind)).alias(kind) for kind in ("examples", "glossary", "docs")])
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")).join(some, "query_id", "left")


@query("t17_did_you_mean", f"WITH n AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, {_COS} AS s FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0), a AS (SELECT query_id, 0 AS p, vec_id, s FROM n WHERE label < 5 AND s >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 3 UNION ALL SELECT query_id, 1, vec_id, s FROM n WHERE label >= 5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 5) SELECT query_id, vec_id, p AS priority FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p, s DESC, vec_id) <= 5")
def t17(r):
    """Up to three similar questions, then glossary terms, five in all, in one pass."""
    e = r("embeddings").withColumn("priority", (F.col("label") >= 5).cast("int"))
    both = M.nearest(e.where("vec_id % 50 = 0"), e, 5, by="priority").where("priority = 1 or (rank <= 3 and similarity >= 0.2)")
    w = Window.partitionBy("query_id").orderBy("priority", F.desc("similarity"), "vec_id")
    return both.withColumn("i", F.row_number().over(w)).where("i <= 5").select("query_id", "vec_id", "priority")


@query("v3_approximate_nearest")
def v3(r):
    """The five nearest by cells, from as many cells as a stated sample of queries needs; recall is measured in the tests."""
    e = r("embeddings")
    return M.nearest_in_cells(e.where("vec_id % 50 = 0"), e, 5)


@query("e1_hashed_embeddings")
def e1(r):
    """Every text's embedding by the default function, hashed character 3-grams."""
    return M.embedded(r("documents").select("doc_id", "text")).select("doc_id", "embedding")


def _words(r):
    """Every distinct word of all documents, in lower case: runs of letters, digits and marks of any script."""
    return r("documents").select(F.explode(terms.words(F.col("text"))).alias("value")).distinct()


@query("t2_similar_words")
def t2_words(r):
    """Similar pairs among the distinct words of all documents, of any length and script, exactly: from 0.75 on, as words of few letters have very many pairs from 0.3 on."""
    return M.similar_values(_words(r), 0.75)


# --- graphs ----------------------------------------------------------------------------------------------------------

_LOGEDGES = f"(SELECT lower(g.b) AS src, lower(g.a) AS dst, count(*) AS n FROM (SELECT regexp_extract(sql_text, '(?i)\\bJOIN\\s+([\\w.]+)(?:\\s+AS)?(?:\\s+\\w+)?\\s+ON\\s+([\\w.]+)\\.(\\w+)\\s*=\\s*([\\w.]+)\\.(\\w+)', ['a', 'b', 'bc', 'c', 'cc']) AS g FROM {Q.LOG}) WHERE g.a <> '' AND lower(g.a) <> lower(g.b) GROUP BY 1, 2)"


def _log_edges(r):
    """Edges of the SQL log's joins, weighted by how often they occur."""
    got = F.arrays_zip(*[F.regexp_extract_all("sql_text", F.lit(X.JOIN_ON), F.lit(i)).alias(f"g{i}") for i in range(1, 6)])
    j = Q.sql_log(r).select(F.explode(got).alias("j"))
    key = F.concat_ws(" = ", F.col("j.g3"), F.col("j.g5"))
    e = j.groupBy(X.table_name(F.col("j.g2")).alias("src"), X.table_name(F.col("j.g1")).alias("dst")).agg(F.count("*").alias("n"), F.min(key).alias("join_key"))
    return e.where("src <> dst").select("src", "dst", "n", X.frequency_weight(F.col("n")).alias("weight"), F.lit("log").alias("source"), "join_key")


@query("g1_log_edges", f"SELECT src, dst, n, CASE WHEN n >= 20 THEN 0.95 WHEN n >= 10 THEN 0.85 WHEN n >= 5 THEN 0.7 WHEN n >= 2 THEN 0.5 ELSE 0.3 END AS weight FROM {_LOGEDGES}")
def g1(r):
    return _log_edges(r).select("src", "dst", "n", "weight")


_REL = "(SELECT DISTINCT 's' || l_suppkey AS src, 'n' || s_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def _relations(r):
    """Relationships of the model at a fixed weight."""
    s = r("lineitem").select("l_suppkey").distinct().join(r("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return s.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), F.lit(0.9).alias("weight"), F.lit("model").alias("source"), F.lit("nationkey").alias("join_key"))


@query("g2_relationship_edges", f"SELECT src, dst, 0.9 AS weight FROM {_REL}")
def g2(r):
    return _relations(r).select("src", "dst", "weight")


_LINES = "(SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, count(*) AS n FROM lineitem GROUP BY 1, 2)"
_ORDERS = "(SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)"


def _three(r):
    """Lines by frequency, returned lines at 0.4, and the model's relationships."""
    ends = (F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    lines = r("lineitem").groupBy(*ends).agg(F.count("*").alias("n")).select("src", "dst", X.frequency_weight(F.col("n")).alias("weight"), F.lit("lines").alias("source"), F.lit(None).cast("string").alias("join_key"))
    back = r("lineitem").where("l_returnflag = 'R'").select(*ends).distinct().select("src", "dst", F.lit(0.4).alias("weight"), F.lit("returns").alias("source"), F.lit("partkey").alias("join_key"))
    return M.merged_edges(lines, back, _relations(r))


_MERGED = f"(SELECT src, dst, max(weight) AS weight, string_agg(DISTINCT source, '+' ORDER BY source) AS source, arg_max(join_key, i) FILTER (WHERE join_key IS NOT NULL) AS join_key FROM (SELECT src, dst, CASE WHEN n >= 20 THEN 0.95 WHEN n >= 10 THEN 0.85 WHEN n >= 5 THEN 0.7 WHEN n >= 2 THEN 0.5 ELSE 0.3 END AS weight, 'lines' AS source, NULL AS join_key, 0 AS i FROM {_LINES} UNION ALL SELECT src, dst, 0.4, 'returns', 'partkey', 1 FROM {_ORDERS} UNION ALL SELECT src, dst, 0.9, 'model', 'nationkey', 2 FROM {_REL}) GROUP BY 1, 2)"


@query("u4_three_edge_sets", f"SELECT src, dst, weight, source, coalesce(join_key, '') AS join_key FROM {_MERGED}")
def u4(r):
    return _three(r).withColumn("join_key", F.coalesce("join_key", F.lit("")))


@query("a9_graph_summary", f"SELECT s AS source, count(*) AS edges, count(DISTINCT src) AS sources FROM (SELECT src, unnest(string_split(source, '+')) AS s FROM {_MERGED}) GROUP BY 1")
def a9(r):
    return _three(r).select("src", F.explode(F.split("source", r"\+")).alias("source")).groupBy("source").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))


@query("g3_layers", f"SELECT CASE WHEN regexp_matches(t, 'gold|mart|dim_|fact_|agg_') THEN 'gold' WHEN regexp_matches(t, 'silver|cleaned|enriched') THEN 'silver' WHEN regexp_matches(t, 'bronze|raw|staging|stg_') THEN 'bronze' ELSE 'unknown' END AS layer, count(DISTINCT id) AS nodes, count(up) AS edges FROM (SELECT id, up, lower(table_schema || '.' || table_name) AS t FROM {_TABLES}) GROUP BY 1")
def g3(r):
    """Nodes and lineage edges by layer."""
    t = _tables(r).withColumn("layer", S.layer(F.concat_ws(".", "table_schema", "table_name")))
    return t.groupBy("layer").agg(F.count_distinct("id").alias("nodes"), F.count("up").alias("edges"))


def _bridges(r):
    """Paths of at most two hops from each part over its suppliers to their nations, and the edges they take."""
    return _three(r).select("src", "dst", "join_key")


_TWO = f"(SELECT a.src AS start, b.dst AS node, min(a.src || '>' || a.dst || '>' || b.dst) AS path FROM {_MERGED} a JOIN {_MERGED} b ON a.dst = b.src GROUP BY 1, 2)"


@query("g5_bridge_tables", f"SELECT start, node, split_part(path, '>', 2) AS bridge FROM {_TWO}")
def g5(r):
    """Between each part and each nation it comes from: the tables on the shortest path that are neither end."""
    e = _bridges(r)
    paths = M.shortest_paths(e.select("src", "dst"), r("part").select(F.concat(F.lit("p"), "p_partkey").alias("node")), hops=2)
    return M.bridges(paths.where("n >= 2"))


@query("g6_join_keys", f"SELECT p.start, p.node, p.hop, coalesce(m.join_key, p.src || '.id') AS join_key FROM (SELECT start, node, 1 AS hop, split_part(path, '>', 1) AS src, split_part(path, '>', 2) AS dst FROM {_TWO} UNION ALL SELECT start, node, 2, split_part(path, '>', 2), split_part(path, '>', 3) FROM {_TWO}) p JOIN {_MERGED} m ON m.src = p.src AND m.dst = p.dst")
def g6(r):
    """The key of each hop; an edge without one joins on its source's id."""
    e = _bridges(r)
    paths = M.shortest_paths(e.select("src", "dst"), r("part").select(F.concat(F.lit("p"), "p_partkey").alias("node")), hops=2)
    return M.hop_keys(paths.where("n >= 2"), e)


@query("l1_query_state", "SELECT user_id, event_id AS last_query, event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def l1(r):
    """The state of each user's last query."""
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return r("events").groupBy("user_id").agg(last.alias("x")).select("user_id", F.col("x.event_id").alias("last_query"), F.col("x.event_type").alias("state"))


@query("l3_admin_overview", "SELECT count(*) AS total, count(DISTINCT user_id) AS users, round(avg(value), 4) AS latency, round(avg(event_id % 200 * 0.001), 6) AS cost, round(100.0 * count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type IN ('purchase', 'error')), 0), 1) AS liked_pct, round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 1) AS passed_pct FROM events")
def l3(r):
    t = F.col("event_type")
    return r("events").agg(F.count("*").alias("total"), F.count_distinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("latency"), F.round(F.avg(F.col("event_id") % 200 * 0.001), 6).alias("cost"), F.round(100.0 * F.count_if(t == "purchase") / F.nullif(F.count_if(t.isin("purchase", "error")), F.lit(0)), 1).alias("liked_pct"), F.round(100.0 * F.count_if(t != "error") / F.count("*"), 1).alias("passed_pct"))


@query("t1_minhash_signatures")
def t1(r):
    """A signature of 128 least hashes for every distinct word of the documents, of any length and script; tests bound the error of its estimates."""
    return _words(r).select("value", X.minhash(X.grams(F.col("value")), 128).alias("signature"))


@query("t3_entity_values", "SELECT DISTINCT * FROM (SELECT 'part' AS tab, 'p_name' AS col, p_name AS value FROM part UNION ALL SELECT 'part', 'p_brand', p_brand FROM part UNION ALL SELECT 'part', 'p_type', p_type FROM part UNION ALL SELECT 'customer', 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'orders', 'o_orderpriority', o_orderpriority FROM orders) WHERE length(trim(value)) >= 2")
def t3(r):
    """Distinct values of string columns, all columns of a table in one pass."""
    out = None
    for table, columns in {"part": ("p_name", "p_brand", "p_type"), "customer": ("c_mktsegment",), "orders": ("o_orderpriority",)}.items():
        one = r(table).select(F.lit(table).alias("tab"), F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("value")) for c in columns])))
        out = one if out is None else out.unionByName(one)
    return out.where(F.length(F.trim("value")) >= 2).distinct()


@query("a10_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def a10(r):
    return r("documents").groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"))


@query("j3_lookup", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j3(r):
    """Every document with its label, or defaults where it has none."""
    return r("documents").select("doc_id").join(r("labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
