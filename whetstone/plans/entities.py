"""Stored entity values, metrics over several tables, the error taxonomy, terms of several words and the merged feedback feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from whetstone.operators import entities as E
from whetstone.operators import metadata as M
from whetstone.operators import semantic as S
from whetstone.operators import taxonomy as T
from whetstone.operators import terms
from whetstone.operators import vectors as V
from whetstone.registry import query
from whetstone.sources.files import scratch
from whetstone.streaming.merge import KeyedTable

# --- keywords against a stored index ---------------------------------------------------------------------------------

#: String columns whose values are indexed.
COLUMNS = {
    "part": ("p_name", "p_brand", "p_type"),
    "supplier": ("s_name",),
    "customer": ("c_name", "c_mktsegment"),
    "orders": ("o_orderpriority",),
    "events": ("event_type",),
    "documents": ("source", "lang"),
    "pages": ("url",),
}
_VALUES = " UNION ".join(f"SELECT '{t}' AS tab, '{c}' AS col, trim({c}) AS value FROM {t} WHERE length(trim({c})) >= 2" for t, cs in COLUMNS.items() for c in cs)
_KEYWORDS = (
    "SELECT DISTINCT keyword FROM (SELECT substr(p_name, 1, 1) || substr(p_name, 3) AS keyword FROM part WHERE p_partkey % 50 = 0"
    " UNION ALL SELECT replace(lower(c_name), '#', ' ') FROM customer WHERE c_custkey % 50 = 0"
    " UNION ALL SELECT replace(url, '/', '-') FROM pages WHERE page_id % 50 = 0)"
)
_GRAMS = "CASE WHEN length({0}) < 3 THEN [lower({0})] ELSE list_distinct([substr(lower({0}), i, 3) FOR i IN range(1, length({0}) - 1)]) END"


def _keywords(r):
    """Misspelt names of every fiftieth part, customer and page."""
    part = r("part").where("p_partkey % 50 = 0").select(F.concat(F.substring("p_name", 1, 1), F.expr("substr(p_name, 3)")).alias("keyword"))
    customer = r("customer").where("c_custkey % 50 = 0").select(F.replace(F.lower("c_name"), F.lit("#"), F.lit(" ")))
    page = r("pages").where("page_id % 50 = 0").select(F.replace("url", F.lit("/"), F.lit("-")))
    return part.union(customer).union(page)


@query(
    "t2_keyword_match",
    f"""WITH v AS (SELECT tab, col, value, {_GRAMS.format("value")} AS g FROM ({_VALUES})),
    k AS (SELECT keyword, {_GRAMS.format("trim(keyword)")} AS g FROM ({_KEYWORDS}) WHERE keyword <> ''),
    p AS (SELECT keyword, tab, col, value, len(list_intersect(k.g, v.g)) AS n, len(k.g) + len(v.g) AS m FROM k, v),
    s AS (SELECT keyword, tab, col, value, n / (m - n) AS s FROM p WHERE n / (m - n) >= 0.3)
    SELECT keyword, tab, col, value, round(s, 6) AS similarity, row_number() OVER (PARTITION BY keyword ORDER BY s DESC, tab, col, value) AS rank FROM s
    QUALIFY rank <= 5""",
)
def t2_match(r):
    """The five most similar values of each keyword, from an index that two tables start, all tables add to, and one probe reads."""
    path, tables = scratch(r.spark, "entities"), {t: r(t) for t in COLUMNS}
    for some in (("part", "pages"), tuple(COLUMNS)):
        E.add_values(E.column_values(tables, {t: COLUMNS[t] for t in some}), path)
    return E.match_keywords(_keywords(r), path).withColumn("similarity", F.round("similarity", 6))


# --- metrics over several tables -------------------------------------------------------------------------------------

MODEL = S.Model(
    tables={
        "lineitem": S.Table(
            dimensions={"returned": "l_returnflag"},
            measures={"revenue": S.Measure("sum", "l_extendedprice * (1 - l_discount)"), "lines": S.Measure("count"), "parts": S.Measure("count_distinct", "l_partkey"), "largest": S.Measure("max", "l_quantity")},
            time="l_shipdate",
        ),
        "orders": S.Table(
            dimensions={"priority": "o_orderpriority"},
            measures={"value": S.Measure("sum", "o_totalprice"), "n": S.Measure("count"), "finished": S.Measure("count", "1", "o_orderstatus = 'F'"), "buyers": S.Measure("count_distinct", "o_custkey"), "mean": S.Measure("avg", "o_totalprice")},
            time="o_orderdate",
        ),
        "events": S.Table(measures={"n": S.Measure("count"), "purchases": S.Measure("count", "1", "event_type = 'purchase'")}, time="ts", rules=("event_type <> 'error'",)),
        "customer": S.Table(dimensions={"segment": "c_mktsegment"}, measures={"n": S.Measure("count"), "balance": S.Measure("sum", "c_acctbal")}),
        "nation": S.Table(dimensions={"name": "n_name"}),
        "region": S.Table(dimensions={"name": "r_name"}),
    },
    relationships=(
        S.Relationship("lineitem", "orders", "l_orderkey", "o_orderkey"),
        S.Relationship("orders", "customer", "o_custkey", "c_custkey"),
        S.Relationship("events", "customer", "user_id", "c_custkey"),
        S.Relationship("customer", "nation", "c_nationkey", "n_nationkey"),
        S.Relationship("nation", "region", "n_regionkey", "r_regionkey"),
    ),
    metrics={
        "revenue_per_order": "{lineitem.revenue} / nullif({orders.n}, 0)",
        "finished_share": "{orders.finished} / nullif({orders.n}, 0)",
        "finished_revenue": "{revenue_per_order} * {finished_share}",
        "purchases_per_customer": "{events.purchases} / nullif({customer.n}, 0)",
    },
)
_TO_REGION = "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _settled(c: str):
    """Rounded a little above: means of cents often end in a five, where the order of a sum would decide."""
    return F.round(F.col(c) + 1e-7, 4)


@query(
    "a19_cross_table_metrics",
    f"""WITH l AS (SELECT r_name, c_mktsegment, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(DISTINCT l_partkey) AS parts, max(l_quantity) AS largest
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
    o AS (SELECT r_name, c_mktsegment, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, avg(o_totalprice) AS mean
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
    e AS (SELECT r_name, c_mktsegment, count(*) FILTER (WHERE event_type = 'purchase') AS purchases
      FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE event_type <> 'error' GROUP BY 1, 2),
    c AS (SELECT r_name, c_mktsegment, count(*) AS n FROM customer {_TO_REGION} GROUP BY 1, 2),
    k AS (SELECT r_name, c_mktsegment FROM l UNION SELECT r_name, c_mktsegment FROM o UNION SELECT r_name, c_mktsegment FROM e UNION SELECT r_name, c_mktsegment FROM c)
    SELECT k.r_name AS region__name, k.c_mktsegment AS customer__segment, round(revenue / nullif(o.n, 0) + 1e-7, 4) AS revenue_per_order, round(finished / nullif(o.n, 0), 6) AS finished_share,
      round(revenue / nullif(o.n, 0) * (finished / nullif(o.n, 0)) + 1e-7, 4) AS finished_revenue, round(purchases / nullif(c.n, 0), 6) AS purchases_per_customer, parts AS lineitem__parts, largest AS lineitem__largest, round(mean + 1e-7, 4) AS orders__mean
    FROM k LEFT JOIN l ON l.r_name IS NOT DISTINCT FROM k.r_name AND l.c_mktsegment IS NOT DISTINCT FROM k.c_mktsegment LEFT JOIN o ON o.r_name IS NOT DISTINCT FROM k.r_name AND o.c_mktsegment IS NOT DISTINCT FROM k.c_mktsegment
    LEFT JOIN e ON e.r_name IS NOT DISTINCT FROM k.r_name AND e.c_mktsegment IS NOT DISTINCT FROM k.c_mktsegment LEFT JOIN c ON c.r_name IS NOT DISTINCT FROM k.r_name AND c.c_mktsegment IS NOT DISTINCT FROM k.c_mktsegment""",
)
def a19_cross(r):
    """Four facts by region and segment: ratios between facts, a metric of metrics, and no row counted twice."""
    frames = {t: r(t) for t in MODEL.tables}
    m = S.metrics(MODEL, frames, ["revenue_per_order", "finished_share", "finished_revenue", "purchases_per_customer", "lineitem.parts", "lineitem.largest", "orders.mean"], ["region.name", "customer.segment"])
    shares = {c: F.round(c, 6) for c in ("finished_share", "purchases_per_customer")}
    return m.withColumns(shares | {c: _settled(c) for c in ("revenue_per_order", "finished_revenue", "orders__mean")})


@query(
    "a19_metrics_by_quarter",
    """WITH l AS (SELECT date_trunc('quarter', l_shipdate) AS p, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS lines FROM lineitem GROUP BY 1),
    o AS (SELECT date_trunc('quarter', o_orderdate) AS p, sum(o_totalprice) AS value, count(*) AS n, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1)
    SELECT strftime(coalesce(l.p, o.p), '%Y-%m-%d') AS period, round(revenue / nullif(n, 0) + 1e-7, 4) AS revenue_per_order, lines AS lineitem__lines, round(value, 2) AS orders__value, buyers AS orders__buyers FROM l FULL JOIN o ON l.p = o.p""",
)
def a19_quarter(r):
    """Lines by the day they ship and orders by their own day, side by side."""
    m = S.metrics(MODEL, {t: r(t) for t in MODEL.tables}, ["revenue_per_order", "lineitem.lines", "orders.value", "orders.buyers"], grain="quarter")
    return m.withColumns({"period": F.date_format("period", "yyyy-MM-dd"), "revenue_per_order": _settled("revenue_per_order"), "orders__value": F.round("orders__value", 2)})


# --- error taxonomy --------------------------------------------------------------------------------------------------

#: Starts of messages, to which every document adds its text: as an engine quotes the statement that failed.
STARTS = ("line 1:8: mismatched input", "Column cannot be resolved", "Unused alias", "cannot cast value", "Timeout", "must be an aggregate:", "Function not found", "INTERSECT", "Missing WHERE", "Literal")
_MESSAGE = "['" + "', '".join(STARTS) + f"'][CAST(doc_id % {len(STARTS)} + 1 AS INT)]"
_RULES = ", ".join(f"({i}, '{c}', '{s}', '{w}')" for i, (c, s, d) in enumerate(T.TAXONOMY) for w in dict.fromkeys(d.lower().split()) if len(w) >= T.LEAST)
_PHRASES = ", ".join(f"({len(T.TAXONOMY) + i}, '{c}', '{s}', '{w}')" for i, (c, s, ws) in enumerate(T.PHRASES) for w in ws)
# where the text says that as often as not, only the start and the first line that has no such word decide
_CLASSES = f"""(WITH words(rank, category, subtype, word) AS (VALUES {_RULES}), phrases(rank, category, subtype, word) AS (VALUES {_PHRASES}),
    m AS (SELECT doc_id, lower({_MESSAGE} || ' ' || replace(coalesce(text, ''), 'th', 'Th')) AS message FROM documents),
    w AS (SELECT doc_id, min(rank) AS rank FROM m JOIN words ON contains(message, word) GROUP BY 1),
    p AS (SELECT doc_id, min(rank) AS rank FROM m JOIN phrases ON contains(message, word) GROUP BY 1),
    r AS (SELECT DISTINCT rank, category, subtype FROM words UNION SELECT DISTINCT rank, category, subtype FROM phrases)
    SELECT doc_id, coalesce(category, 'syntax') AS category, coalesce(subtype, 'sql_syntax_error') AS subtype FROM m LEFT JOIN w USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN r ON r.rank = coalesce(w.rank, p.rank))"""


def _classes(r):
    start = F.element_at(F.array(*map(F.lit, STARTS)), (F.col("doc_id") % len(STARTS) + 1).cast("int"))
    messages = r("documents").select("doc_id", F.concat(start, F.lit(" "), F.coalesce("text", F.lit(""))).alias("message"))
    return T.classified(messages, T.rules(r.spark), ["doc_id"])


@query("j17_taxonomy", f"SELECT doc_id, category, subtype FROM {_CLASSES}")
def j17_taxonomy(r):
    """Each document as an error message: the first of 43 rules that one of its words meets."""
    return _classes(r).select("doc_id", "category", "subtype")


@query("t16_taxonomy_rollup", f"SELECT category, subtype, count(*) AS n FROM {_CLASSES} GROUP BY ROLLUP (category, subtype)")
def t16_taxonomy(r):
    return _classes(r).rollup("category", "subtype").agg(F.count("*").alias("n"))


# --- terms of several words ------------------------------------------------------------------------------------------

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')"
_RUN = "array_to_string(w[p:p + n - 1], ' ')"
_ALIASES = f"""(SELECT {_RUN} AS words, n, min(item_id) AS canonical FROM (SELECT *, 1 + (item_id + p) % 4 AS n FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)) WHERE p % 3 = 0)
    WHERE p + n - 1 <= len(w) AND (n > 1 OR length(w[p]) > 5) GROUP BY 1, 2)"""


def _aliases(r):
    """Runs of one to four words of benchmark texts as names of their items."""
    w = r("benchmark").select("item_id", terms.words(F.col("text")).alias("w")).select("item_id", "w", F.posexplode("w").alias("i", "first"))
    n = (1 + (F.col("item_id") + F.col("i") + 1) % 4).cast("int")
    run = w.where("(i + 1) % 3 = 0").withColumn("n", n).where("i + n <= size(w) and (n > 1 or length(first) > 5)")
    return run.select(F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("alias"), F.col("item_id").alias("canonical"))


@query(
    "t10_terms_in_texts",
    f"""WITH a AS {_ALIASES}, d AS (SELECT doc_id, {_WORDS} AS w FROM documents), places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
    h AS (SELECT doc_id, p, max(n) AS n, arg_max(canonical, n) AS canonical FROM (SELECT doc_id, p, x.n, canonical FROM (SELECT doc_id, w, p, unnest([1, 2, 3, 4]) AS n FROM places) x JOIN a ON a.words = array_to_string(w[p:p + x.n - 1], ' ') AND a.n = x.n) GROUP BY 1, 2),
    f AS (SELECT doc_id, list_reduce(list([p, n]::BIGINT[] ORDER BY p), lambda acc, x: CASE WHEN x[1] >= acc[1] THEN list_concat([x[1] + x[2]], list_append(acc[2:], x[1])) ELSE acc END, [0]::BIGINT[]) AS kept FROM h GROUP BY 1)
    SELECT doc_id, canonical, count(*) AS mentions, sum(n)::BIGINT AS words, sum(p - 1)::BIGINT AS places FROM (SELECT doc_id, unnest(kept[2:]) AS p FROM f) JOIN h USING (doc_id, p) GROUP BY 1, 2""",
)
def t10_terms(r):
    """Mentions of items in documents by names of one to four words; places are summed, so that each counts."""
    found = terms.found_terms(r("documents"), _aliases(r))
    return found.groupBy("doc_id", "canonical").agg(F.count("*").alias("mentions"), F.sum("n").alias("words"), F.sum("place").alias("places"))


# --- feedback merged into a keyed table ------------------------------------------------------------------------------

_SAID = "SELECT 2 * event_id AS o_orderkey, event_type AS feedback, ts, event_id FROM events WHERE event_type IN ('purchase', 'error')"


def _merged(r) -> KeyedTable:
    """Feedback on orders by every other number, from a stream."""
    table = KeyedTable(r.spark, scratch(r.spark, "feedback"), "o_orderkey", "feedback", ["ts", "event_id"])
    said = r.stream("events").where(F.col("event_type").isin("purchase", "error"))
    table.follow(said.select((2 * F.col("event_id")).alias("o_orderkey"), F.col("event_type").alias("feedback"), "ts", "event_id"), r("orders").select("o_orderkey"))
    return table


@query("st6_feedback_merged", f"SELECT o.o_orderkey, f.feedback FROM orders o LEFT JOIN (SELECT o_orderkey, arg_max(feedback, (ts, event_id)) AS feedback FROM ({_SAID}) GROUP BY 1) f USING (o_orderkey)")
def st6_merged(r):
    """Every order with the latest feedback on it, merged by key batch by batch."""
    return r("orders").select("o_orderkey").join(_merged(r).read().select("o_orderkey", "feedback"), "o_orderkey", "left")


@query("st6_unknown_feedback", f"SELECT o_orderkey, event_id FROM ({_SAID}) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def st6_unknown(r):
    """Feedback on orders that do not exist, reported and not lost."""
    return _merged(r).unknown().select("o_orderkey", "event_id")


# --- vectors, and everything about a question ------------------------------------------------------------------------


@query("v3_quantised_nearest")
def v3_quantised(r):
    """The five nearest by a stored index of two-level cells and product-quantised residuals; recall is measured in the tests."""
    e, path = r("embeddings"), scratch(r.spark, "vectors")
    V.build(e, path)
    return V.search(e.where("vec_id % 50 = 0"), path, 5).withColumn("similarity", F.round("similarity", 6))


_COS = "list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_PROFILES = " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS col, count(DISTINCT {c}) AS n, min({c}) AS lo, max({c}) AS hi FROM {t}" for t, cs in COLUMNS.items() for c in cs)


@query(
    "t18_question_bundle",
    f"""WITH q AS (SELECT vec_id AS query_id, embedding, substr(p_name, 1, 1) || substr(p_name, 3) AS keyword FROM embeddings JOIN part ON p_partkey = vec_id WHERE vec_id % 50 = 0),
    near AS (SELECT q.query_id, CASE WHEN c.label < 4 THEN 'examples' WHEN c.label < 7 THEN 'glossary' ELSE 'docs' END AS kind, CAST(c.vec_id AS VARCHAR) AS item, c.vec_id, {_COS} AS s FROM q JOIN embeddings c ON q.query_id <> c.vec_id),
    top AS (SELECT query_id, kind, item, row_number() OVER (PARTITION BY query_id, kind ORDER BY s DESC, vec_id) AS rank FROM near QUALIFY rank <= CASE kind WHEN 'glossary' THEN 5 ELSE 3 END),
    v AS (SELECT tab, col, value, {_GRAMS.format("value")} AS g FROM ({_VALUES})), k AS (SELECT DISTINCT keyword, {_GRAMS.format("trim(keyword)")} AS g FROM q),
    m AS (SELECT keyword, tab, col, value, row_number() OVER (PARTITION BY keyword ORDER BY s DESC, tab, col, value) AS rank FROM (SELECT keyword, tab, col, value, len(list_intersect(k.g, v.g)) / (len(k.g) + len(v.g) - len(list_intersect(k.g, v.g))) AS s FROM k, v) WHERE s >= 0.3 QUALIFY rank <= 5),
    e AS (SELECT query_id, tab, col, value, rank FROM q JOIN m USING (keyword)),
    p AS (SELECT DISTINCT query_id, tab || '.' || col || ' has ' || n || ' values, ' || lo || ' to ' || hi AS item FROM e JOIN ({_PROFILES}) USING (tab, col)),
    every AS (SELECT query_id, kind, item, rank FROM top UNION ALL SELECT query_id, 'entities', tab || '.' || col || ' = ' || value, rank FROM e UNION ALL SELECT query_id, 'profiles', item, row_number() OVER (PARTITION BY query_id ORDER BY item) FROM p)
    SELECT query_id, {", ".join(f"string_agg(item, '; ' ORDER BY rank) FILTER (WHERE kind = '{k}') AS {k}" for k in ("entities", "examples", "glossary", "docs", "profiles"))} FROM every GROUP BY 1""",
)
def t18_bundle(r):
    """Of each question its entities, examples, glossary entries, documents and profiles: every index is asked once for all questions, and one grouping brings the answers together."""
    e = r("embeddings")
    part = r("part").select(F.col("p_partkey").alias("query_id"), F.concat(F.substring("p_name", 1, 1), F.expr("substr(p_name, 3)")).alias("keyword"))
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding").join(part, "query_id")
    kinds = e.withColumn("kind", F.when(F.col("label") < 4, "examples").when(F.col("label") < 7, "glossary").otherwise("docs"))
    near = M.nearest(asked.select(F.col("query_id").alias("vec_id"), "embedding"), kinds, 5, by="kind").where("kind = 'glossary' or rank <= 3")
    path = scratch(r.spark, "entities")
    E.add_values(E.column_values({t: r(t) for t in COLUMNS}, COLUMNS), path)
    matched = asked.select("query_id", "keyword").join(E.match_keywords(asked.select("keyword"), path), "keyword")
    seen = None
    for table, columns in COLUMNS.items():
        one = M.profile(r(table).select(*columns)).select(F.lit(table).alias("tab"), F.col("column").alias("col"), F.concat(F.lit(f"{table}."), "column", F.lit(" has "), "distinct_count", F.lit(" values, "), "min", F.lit(" to "), "max").alias("item"))
        seen = one if seen is None else seen.unionByName(one)
    profiles = matched.join(F.broadcast(seen), ["tab", "col"]).select("query_id", F.lit("profiles").alias("kind"), "item", F.lit(0).alias("rank")).distinct()  # a row for each column of the model
    every = near.select("query_id", "kind", F.col("vec_id").cast("string").alias("item"), "rank")
    every = every.unionByName(matched.select("query_id", F.lit("entities").alias("kind"), F.concat("tab", F.lit("."), "col", F.lit(" = "), "value").alias("item"), "rank")).unionByName(profiles)
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "item"))))
    listed = lambda kind: F.when(F.size(of(kind)) > 0, F.array_join(F.transform(of(kind), lambda x: x["item"]), "; "))
    return every.groupBy("query_id").agg(*[listed(k).alias(k) for k in ("entities", "examples", "glossary", "docs", "profiles")])
