"""Sources, catalogs, saved questions and sinks over catalogs derived from orders and their lines: as large as these tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from whetstone.functions import sqltext as Q
from whetstone.functions import text as X
from whetstone.operators import metadata as M
from whetstone.registry import query
from whetstone.sources import catalog as S
from whetstone.sources import files

#: Each order is a table, each of its lines a column.
NAMES = ("order_id", "status", "Email", "ds", "amount", "paid", "region")
_SCHEMA = "CASE o_orderstatus WHEN 'F' THEN 'gold_mart' WHEN 'O' THEN 'silver' ELSE 'raw_zone' END"
_TABLE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'fact_' WHEN '2' THEN 'cleaned_' WHEN '3' THEN 'stg_' WHEN '4' THEN 'agg_' ELSE 't_' END || CAST(o_orderkey AS VARCHAR)"
_COLS = f"(SELECT o_orderkey AS id, o_custkey % 3 AS cat, {_SCHEMA} AS table_schema, {_TABLE} AS table_name, [{', '.join(repr(n) for n in NAMES)}][l_linenumber] AS column_name, CASE l_returnflag WHEN 'A' THEN 'varchar' WHEN 'N' THEN 'bigint' ELSE 'date' END AS data_type, l_linenumber AS ordinal, CASE WHEN l_linestatus = 'O' THEN '' ELSE 'about ' || l_partkey END AS description FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_TABLES = f"(SELECT o_orderkey AS id, {_SCHEMA} AS table_schema, {_TABLE} AS table_name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'table ' || o_orderkey END AS description, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS up, o_orderdate AS updated_at FROM orders)"


#: Lines that one task takes on average where rows are dealt by their number.
LINES = 500_000


def _named(o):
    p = F.substring("o_orderpriority", 1, 1)
    schema = F.when(F.col("o_orderstatus") == "F", "gold_mart").when(F.col("o_orderstatus") == "O", "silver").otherwise("raw_zone")
    table = F.concat(F.when(p == "1", "fact_").when(p == "2", "cleaned_").when(p == "3", "stg_").when(p == "4", "agg_").otherwise("t_"), "o_orderkey")
    return o.withColumns({"id": F.col("o_orderkey"), "table_schema": schema, "table_name": table})


def _columns(r):
    o = _named(r("orders")).select("id", "o_custkey", "table_schema", "table_name")
    flag = F.col("l_returnflag")
    named = r("lineitem").join(o, F.col("l_orderkey") == F.col("id"))
    return named.select("id", (F.col("o_custkey") % 3).alias("cat"), "table_schema", "table_name", F.get(F.array(*map(F.lit, NAMES)), F.col("l_linenumber") - 1).alias("column_name"), F.when(flag == "A", "varchar").when(flag == "N", "bigint").otherwise("date").alias("data_type"), F.col("l_linenumber").alias("ordinal"), F.when(F.col("l_linestatus") == "O", "").otherwise(F.concat(F.lit("about "), "l_partkey")).alias("description"))


def _tables(r):
    up = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    text = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("table "), "o_orderkey"))
    return _named(r("orders")).select("id", "table_schema", "table_name", text.alias("description"), up.alias("up"), F.col("o_orderdate").alias("updated_at"))


def _listed(columns):
    return F.array_join(F.transform(columns, lambda c: F.concat_ws(" ", c["column_name"], c["data_type"])), ", ")


_GROUPED = f"SELECT table_schema, table_name, string_agg(column_name || ' ' || data_type, ', ' ORDER BY ordinal, column_name, data_type, description) AS columns FROM {_COLS} GROUP BY 1, 2"


@query("s2_catalog_scan", _GROUPED)
def s2(r):
    return S.grouped(_columns(r)).withColumn("columns", _listed(F.col("columns")))


def _manifest(r):
    """One JSON text for each table, as a manifest of one node."""
    columns = S.grouped(_columns(r).withColumn("column_name", F.concat_ws("_", "column_name", "ordinal"))).withColumn("columns", F.map_from_entries(F.transform(F.array_distinct("columns"), lambda c: F.struct(F.concat_ws("-", c["column_name"], c["data_type"], c["description"]), F.struct(c["column_name"].alias("name"), c["data_type"].alias("data_type"), c["description"].alias("description"), c["ordinal"].alias("ordinal"))))))
    t = _tables(r).join(columns, ["table_schema", "table_name"], "left")
    node = F.struct(F.col("table_name").alias("name"), F.col("table_schema").alias("schema"), "description", F.lit("table").alias("materialized"), "columns", F.array_compact(F.array(F.concat(F.lit("model."), "up"))).alias("depends_on"))
    return t.select(F.to_json(F.create_map(F.concat(F.lit("model."), "id"), node)).alias("text"))


@query("s3_manifest_nodes", f"SELECT t.table_schema AS schema, t.table_name AS name, t.description, coalesce(n, 0) AS n_columns, CASE WHEN up IS NULL THEN 0 ELSE 1 END AS n_depends FROM {_TABLES} t LEFT JOIN (SELECT id, count(DISTINCT (column_name, ordinal, data_type, description)) AS n FROM {_COLS} GROUP BY 1) c ON t.id = c.id")
def s3(r):
    return S.manifest_rows(_manifest(r)).select("schema", "name", "description", F.coalesce(F.greatest(F.size("columns"), F.lit(0)), F.lit(0)).alias("n_columns"), F.size("depends_on").alias("n_depends"))


@query("s4_lineage_edges", f"SELECT u.table_schema || '.' || u.table_name AS upstream, d.table_schema || '.' || d.table_name AS downstream FROM {_TABLES} d JOIN {_TABLES} u ON d.up = u.id")
def s4(r):
    return S.lineage(S.manifest_rows(_manifest(r)))


_CARDS = "(SELECT event_id AS card_id, ts AS created_at, user_id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 4 = 0 THEN 'query' ELSE 'native' END AS query_type, event_id % 10 = 3 AS archived FROM events)"


@query("s5_saved_questions", f"SELECT card_id, k, created_at FROM {_CARDS} WHERE query_type = 'native' AND NOT archived AND k IS NOT NULL")
def s5(r):
    """Native, not archived, newest first."""
    e = r("events").select(F.col("event_id").alias("card_id"), F.get_json_object("props", "$.k").alias("k"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 4 == 0, "query").otherwise("native").alias("query_type"), (F.col("event_id") % 10 == 3).alias("archived"))
    return e.where("query_type = 'native' and not archived and k is not null").select("card_id", "k", "created_at").orderBy(F.desc("created_at"), "card_id")


@query("s6_question_csv", f"SELECT id, sql_text AS query FROM {Q.LOG} WHERE trim(sql_text) <> ''")
def s6(r):
    """Written as a CSV export, with one row in six without SQL, and read again."""
    log = Q.sql_log(r)
    path = files.scratch(log.sparkSession, "questions")
    files.write_csv(log.select("id", F.concat(F.lit('He said "q'), "id", F.lit('",\nthen left')).alias("name"), F.col("sql_text").alias("query")), path)
    return files.read_questions(log.sparkSession, path).select(F.col("id").cast("long").alias("id"), "query")


@query("s7_export_questions", "SELECT e.event_id AS card_id, n.n_name AS collection, c.c_name AS creator, coalesce(x.n, 0) AS cards_of_creator FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1) x ON x.user_id = e.user_id WHERE e.event_type <> 'error'")
def s7(r):
    cards = r("events").where("event_type <> 'error'").select(F.col("event_id").alias("card_id"), "user_id")
    n = cards.groupBy("user_id").agg(F.count("*").alias("cards_of_creator"))
    who = r("customer").join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("creator"), F.col("n_name").alias("collection"))
    return cards.join(who, "user_id", "left").join(n, "user_id", "left").select("card_id", "collection", "creator", F.coalesce("cards_of_creator", F.lit(0)).alias("cards_of_creator"))


@query("s8_quick_stats", "SELECT 'cards' AS metric, count(*) AS n FROM events UNION ALL SELECT 'active', count(*) FILTER (WHERE event_type <> 'error') FROM events UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'open_orders', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders")
def s8(r):
    """One scan for each table, its counts as rows."""
    e = r("events").agg(F.count("*").alias("cards"), F.count_if(F.col("event_type") != "error").alias("active"), F.count_distinct("user_id").alias("users"))
    o = r("orders").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"))
    return e.unpivot([], e.columns, "metric", "n").unionByName(o.unpivot([], o.columns, "metric", "n"))


def _dashboards(r):
    """JSON texts: the orders of a customer as the cards of a dashboard."""
    log = Q.sql_log(r, "o_custkey")
    card = F.struct(F.col("id").alias("id"), F.when(F.col("id") % 4 == 0, "query").otherwise("native").alias("type"), F.col("sql_text").alias("sql"))
    return log.groupBy(F.col("o_custkey").alias("dashboard")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(card)).alias("dashcards"))).alias("text"))


_DASH = f"(SELECT o_custkey AS dashboard, id, t AS table_name, sql_text FROM (SELECT l.*, unnest(list_distinct([lower(x) for x in regexp_extract_all(sql_text, '(?i)\\b(?:FROM|JOIN)\\s+([A-Za-z_][\\w.]*)', 1)])) AS t, o_custkey FROM {Q.LOG} l JOIN orders ON o_orderkey = id) WHERE id % 4 <> 0)"


@query("s9_dashboard_cards", f"SELECT dashboard, id AS card, string_agg(table_name, ',' ORDER BY table_name) AS tables FROM {_DASH} GROUP BY 1, 2")
def s9(r):
    cards = Q.dashboard_cards(_dashboards(r))
    return cards.where(F.size("tables") > 0).select("dashboard", "card", F.array_join(F.array_sort("tables"), ",").alias("tables"))


@query("t19_dashboard_scope", f"SELECT dashboard, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS tables, count(DISTINCT id) AS n_cards FROM {_DASH} GROUP BY 1")
def t19(r):
    cards = Q.dashboard_cards(_dashboards(r)).select("dashboard", "card", F.explode("tables").alias("t"))
    return cards.groupBy("dashboard").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tables"), F.count_distinct("card").alias("n_cards"))


@query("s10_document_files", "SELECT lang AS kind, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY 1 UNION ALL SELECT 'html', count(*), sum(length(html)) FROM pages")
def s10(r):
    """Documents and pages written in folders by kind and read back from there by file name."""
    d = r("documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("kind")).unionByName(r("pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), F.lit("html").alias("kind")))
    path = files.scratch(d.sparkSession, "documents")
    files.write_documents(d, path, "kind")
    return files.read_documents(d.sparkSession, path).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_ENTITY = "table_schema || '.' || table_name || CASE WHEN description <> '' THEN chr(10) || description ELSE '' END"


@query("s11_metadata_export", f"SELECT t.id, {_ENTITY.replace('table_', 't.table_').replace('description', 't.description')} || coalesce(chr(10) || 'Columns: ' || columns, '') AS text FROM {_TABLES} t LEFT JOIN (SELECT id, string_agg(column_name || ' ' || data_type, ', ' ORDER BY ordinal, column_name, data_type, description) AS columns FROM {_COLS} GROUP BY 1) c ON c.id = t.id")
def s11(r):
    """Entities with columns in JSON to texts."""
    one = F.struct("ordinal", "column_name", "data_type", "description")
    # dealt by the number of lines: a task's memory follows the rows it sorts, of which compressed bytes tell little
    tasks = -(-r("lineitem").count() // LINES) or 1
    keys = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
    columns = _columns(lambda t: r(t).repartition(tasks, keys[t])).groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("columns"))
    export = _tables(r).repartition(tasks, "id").join(columns, "id", "left").select(F.to_json(F.struct("id", F.concat_ws(".", "table_schema", "table_name").alias("name"), "description", "columns")).alias("json"))
    e = export.select(F.from_json("json", "id long, name string, description string, columns array<struct<column_name:string,data_type:string>>").alias("e")).select("e.*")
    return e.select("id", F.concat_ws("\n", "name", F.when(F.col("description") != "", F.col("description")), F.concat(F.lit("Columns: "), _listed(F.col("columns")))).alias("text"))


@query("s12_annotations", "SELECT s_suppkey, s_name || chr(10) || CASE WHEN s_acctbal < 0 THEN 'Warning: in debt' || chr(10) ELSE '' END || 'Tips: ' || tips AS text, s_acctbal < 0 AS has_warning FROM supplier JOIN (SELECT l_suppkey, string_agg(DISTINCT l_returnflag || l_linestatus, '; ' ORDER BY l_returnflag || l_linestatus) AS tips FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def s12(r):
    tips = r("lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), "; ").alias("tips"))
    s = r("supplier").join(tips, F.col("s_suppkey") == F.col("l_suppkey"))
    debt = F.col("s_acctbal") < 0
    return s.select("s_suppkey", F.concat_ws("\n", "s_name", F.when(debt, "Warning: in debt"), F.concat(F.lit("Tips: "), "tips")).alias("text"), debt.alias("has_warning"))


def _embedding_rows(r):
    d = r("documents").select("doc_id", "source", F.col("text"), F.lit("{}").alias("metadata"))
    return files.clipped(d, {"text": 2000})


@query("s13_reload", "SELECT source, count(*) AS n, sum(length(substr(text, 1, 2000))) AS chars FROM documents GROUP BY 1")
def s13(r):
    """The clipped table written over what was there."""
    d = _embedding_rows(r)
    path = files.scratch(d.sparkSession, "reload")
    d.limit(0).write.partitionBy("source").parquet(path)
    d.write.mode("overwrite").partitionBy("source").parquet(path)
    return d.sparkSession.read.schema(d.schema).parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s14_append", "SELECT label, count(*) AS n, max(vec_id) AS newest FROM embeddings GROUP BY 1")
def s14(r):
    e = r("embeddings")
    path = files.scratch(e.sparkSession, "append")
    for part in (F.col("vec_id") % 2 == 0, F.col("vec_id") % 2 == 1):
        e.where(part).write.mode("append").parquet(path)
    return e.sparkSession.read.schema(e.schema).parquet(path).groupBy("label").agg(F.count("*").alias("n"), F.max("vec_id").alias("newest"))


@query("s15_delete_source", "SELECT source, count(*) AS n, max(length(text)) AS longest FROM (SELECT source, CASE WHEN source = 'src1' THEN substr(text, 1, 2000) || '!' ELSE substr(text, 1, 2000) END AS text FROM documents WHERE source IS NULL OR source <> 'src0') GROUP BY 1")
def s15(r):
    """One source deleted, another replaced in place by its new rows."""
    d = _embedding_rows(r)
    spark = d.sparkSession
    first, second = files.scratch(spark, "sources"), files.scratch(spark, "sources")
    d.write.partitionBy("source").parquet(first)
    files.delete_source(spark, first, second, "source", "src0")
    files.replace_source(d.where("source = 'src1'").withColumn("text", F.concat("text", F.lit("!"))), second, "source")
    return spark.read.schema(d.schema).parquet(second).groupBy("source").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))


@query("s16_artifacts", f"SELECT table_name, n FROM (SELECT t AS table_name, count(*) AS n FROM (SELECT unnest(list_distinct([lower(x) for x in regexp_extract_all(sql_text, '(?i)\\b(?:FROM|JOIN)\\s+([A-Za-z_][\\w.]*)', 1)])) AS t FROM {Q.LOG}) GROUP BY 1)")
def s16(r):
    """Table counts saved as JSON lines and read again."""
    counts = Q.sql_log(r).select(F.explode(X.referenced_tables(F.col("sql_text"))).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("n"))
    return files.reread(counts, files.scratch(counts.sparkSession, "counts"), "json")


@query("s17_result_csv", "SELECT part_text AS value, count(*) AS n FROM (SELECT 'p_partkey,\"note\",size' AS part_text FROM part UNION ALL SELECT p_partkey || ',\"' || p_name || ' \"\"' || p_brand || '\"\"\",' || CASE WHEN p_size > 20 THEN '' ELSE CAST(p_size AS VARCHAR) END FROM part) GROUP BY 1 HAVING count(*) = 1")
def s17(r):
    """The lines of the export but for the header: nulls empty, quotes doubled, plain values bare."""
    p = r("part").select("p_partkey", F.concat("p_name", F.lit(' "'), "p_brand", F.lit('"')).alias("note"), F.when(F.col("p_size") <= 20, F.col("p_size")).alias("size"))
    path = files.scratch(p.sparkSession, "export")
    files.write_csv(p, path)
    return p.sparkSession.read.text(path).where("value <> 'p_partkey,note,size'").groupBy("value").agg(F.count("*").alias("n"))


@query("f2_layers", f"SELECT layer, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(t, 'gold|mart|dim_|fact_|agg_') THEN 'gold' WHEN regexp_matches(t, 'silver|cleaned|enriched') THEN 'silver' WHEN regexp_matches(t, 'bronze|raw|staging|stg_') THEN 'bronze' ELSE 'unknown' END AS layer FROM (SELECT lower(table_name) AS t FROM {_TABLES})) GROUP BY 1")
def f2(r):
    return _tables(r).groupBy(S.layer(F.col("table_name")).alias("layer")).agg(F.count("*").alias("n"))


@query("f3_tiers", f"SELECT table_schema, CASE WHEN contains(f, 'gold') OR contains(lower(table_schema), 'mview') THEN 'gold' WHEN contains(f, 'silver') THEN 'silver' WHEN contains(f, 'bronze') OR contains(f, 'raw') THEN 'bronze' ELSE 'other' END AS tier, count(*) AS n FROM (SELECT *, lower(table_schema || '.' || table_name) AS f FROM {_TABLES}) GROUP BY 1, 2")
def f3(r):
    return _tables(r).groupBy("table_schema", S.tier(F.col("table_schema"), F.col("table_name")).alias("tier")).agg(F.count("*").alias("n"))


@query("f4_refined", f"SELECT id, table_name FROM {_TABLES} WHERE NOT regexp_matches(lower(table_schema), 'bronze|raw')")
def f4(r):
    return _tables(r).where(S.refined(F.col("table_schema"))).select("id", "table_name")


@query("f5_listable_columns", f"SELECT id, column_name, ordinal FROM {_COLS} WHERE upper(data_type) IN ('VARCHAR', 'STRING', 'TEXT', 'CHAR', '') AND NOT regexp_matches(lower(column_name), '{'|'.join(S.MANY_VALUES)}') AND NOT regexp_matches(lower(table_schema), 'bronze|raw')")
def f5(r):
    return _columns(r).where(S.refined(F.col("table_schema")) & S.listable(F.col("column_name"), F.col("data_type"))).select("id", "column_name", "ordinal")


@query("f6_partition_columns", f"SELECT id, column_name, CASE WHEN data_type = 'date' AND ordinal = 1 THEN 'declared' ELSE 'by_name' END AS how FROM {_COLS} WHERE (data_type = 'date' AND ordinal = 1) OR lower(column_name) IN ('ds', 'dt', 'date', 'partition_date', 'event_date')")
def f6(r):
    how = S.partitions(F.col("column_name"), (F.col("data_type") == "date") & (F.col("ordinal") == 1))
    return _columns(r).select("id", "column_name", how.alias("how")).where("how is not null")


@query("f7_needs_description", f"SELECT t.id FROM {_TABLES} t LEFT JOIN (SELECT id, count(*) AS n, count(*) FILTER (WHERE trim(description) = '') AS e FROM {_COLS} GROUP BY 1) c ON c.id = t.id WHERE trim(t.description) = '' OR (n > 0 AND 2 * e > n)")
def f7(r):
    columns = S.grouped(_columns(r))
    both = _tables(r).join(columns, ["table_schema", "table_name"], "left").withColumn("columns", F.coalesce("columns", F.array().cast(columns.schema["columns"].dataType)))
    return both.where(S.needs_description(F.col("description"), F.col("columns"))).select("id")


@query("j7_enriched_catalog", f"WITH t AS (SELECT id, 'c' || (id % 3) AS catalog, table_schema, table_name, id % 5 = 0 AS has FROM {_TABLES}), l AS (SELECT 'c' || cat AS catalog, table_schema, table_name, count(*) AS n FROM {_COLS} GROUP BY 1, 2, 3), a AS (SELECT table_schema, table_name, min(catalog) AS catalog, arg_min(n, catalog) AS n FROM l GROUP BY 1, 2) SELECT t.table_name, CASE WHEN has THEN 1 ELSE coalesce(l.n, a.n, 0) END AS n_columns, CASE WHEN has THEN 'own' WHEN l.n IS NOT NULL THEN 'exact' WHEN a.n IS NOT NULL THEN 'like ' || a.catalog ELSE 'none' END AS how FROM t LEFT JOIN l ON l.catalog = t.catalog AND l.table_schema = t.table_schema AND l.table_name = t.table_name LEFT JOIN a ON a.table_schema = t.table_schema AND a.table_name = t.table_name")
def j7(r):
    one = F.array(F.struct(F.lit(1).alias("ordinal"), F.lit("x").alias("column_name"), F.lit("int").alias("data_type")))
    t = _tables(r).select(F.concat(F.lit("c"), F.col("id") % 3).alias("catalog"), "table_schema", "table_name", F.when(F.col("id") % 5 == 0, one).otherwise(F.array().cast("array<struct<ordinal:int,column_name:string,data_type:string>>")).alias("columns"))
    listing = _columns(r).select(F.concat(F.lit("c"), "cat").alias("catalog"), "table_schema", "table_name", "ordinal", "column_name", "data_type")
    return S.enriched(t, listing).select("table_name", F.greatest(F.coalesce(F.size("columns"), F.lit(0)), F.lit(0)).alias("n_columns"), "how")


@query("j8_described", f"SELECT table_schema, count(*) AS n, count(*) FILTER (WHERE description = '' AND id % 2 = 0) AS changed, count(*) FILTER (WHERE description <> '' OR id % 2 = 0) AS with_text FROM {_TABLES} GROUP BY 1")
def j8(r):
    t = _tables(r)
    new = t.where("id % 2 = 0").select("table_name", F.concat(F.lit("new "), "id").alias("new"))
    return S.described(t, new).groupBy("table_schema").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"), F.count_if(F.col("description") != "").alias("with_text"))


@query("j20_missing_tables", f"SELECT t AS table_name, count(*) AS n FROM (SELECT unnest(list_distinct([lower(x) for x in regexp_extract_all(sql_text, '(?i)\\b(?:FROM|JOIN)\\s+([A-Za-z_][\\w.]*)', 1)])) AS t FROM {Q.LOG}) WHERE t NOT IN ('customer', 'orders', 'nation', 'region', 'part') GROUP BY 1")
def j20(r):
    log = Q.sql_log(r)
    known = log.sparkSession.createDataFrame([(x,) for x in ("customer", "orders", "nation", "region", "part")], "table_name string")
    used = log.select(F.explode(X.referenced_tables(F.col("sql_text"))).alias("table_name"))
    return used.join(F.broadcast(known), "table_name", "left_anti").groupBy("table_name").agg(F.count("*").alias("n"))  # five rows are broadcast


@query("j19_out_of_scope", f"SELECT o_custkey AS scope, t AS table_name FROM (SELECT DISTINCT o_custkey, unnest(list_distinct([lower(x) for x in regexp_extract_all(sql_text, '(?i)\\b(?:FROM|JOIN)\\s+([A-Za-z_][\\w.]*)', 1)])) AS t FROM {Q.LOG} JOIN orders ON o_orderkey = id) WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = t.o_custkey AND o.o_orderstatus = 'F' AND ['orders', 'part', 'nation'][CAST(o.o_orderkey % 3 + 1 AS INT)] = t)".replace("t.o_custkey", "q.o_custkey").replace(" JOIN orders ON o_orderkey = id) WHERE", " JOIN orders ON o_orderkey = id) q WHERE"))
def j19(r):
    """Tables that the questions of a scope use and its list does not hold."""
    used = Q.sql_log(r, "o_custkey").select(F.col("o_custkey").alias("scope"), F.explode(X.referenced_tables(F.col("sql_text"))).alias("table_name")).distinct()
    listed = r("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("scope"), F.get(F.array(*map(F.lit, ("orders", "part", "nation"))), (F.col("o_orderkey") % 3).cast("int")).alias("table_name"))
    return used.join(listed, ["scope", "table_name"], "left_anti")


@query("a3_min_max", "SELECT * FROM (SELECT 'l_quantity' AS \"column\", CAST(min(l_quantity) AS VARCHAR) AS min, CAST(max(l_quantity) AS VARCHAR) AS max, 'numeric' AS format FROM lineitem UNION ALL SELECT 'l_linenumber', CAST(min(l_linenumber) AS VARCHAR), CAST(max(l_linenumber) AS VARCHAR), 'numeric' FROM lineitem UNION ALL SELECT 'l_shipdate', strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S'), strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S'), 'YYYY-MM-DD HH:MM:SS' FROM lineitem)")
def a3(r):
    return M.extremes(r("lineitem").select("l_quantity", "l_linenumber", "l_shipdate", "l_returnflag"))


_FORMATS = "CASE WHEN {0} THEN '6-digit zero-padded string' WHEN {1} THEN '4-digit code' WHEN {2} THEN 'email' WHEN {3} THEN 'UUID' END"


@query("a4_format_patterns", "WITH v AS (SELECT 'code6' AS \"column\", lpad(CAST(p_partkey % 1000000 AS VARCHAR), 6, '0') AS v FROM part UNION ALL SELECT 'year', CAST(1000 + p_partkey % 9000 AS VARCHAR) FROM part UNION ALL SELECT 'mail', p_partkey || '@example.org' FROM part UNION ALL SELECT 'uuid', substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) FROM (SELECT md5(CAST(p_partkey AS VARCHAR)) AS m FROM part) UNION ALL SELECT 'brand', p_brand FROM part) SELECT \"column\", " + _FORMATS.format("bool_and(regexp_full_match(v, '[0-9]{6}'))", "bool_and(regexp_full_match(v, '[0-9]{4}'))", "bool_and(contains(v, '@'))", "bool_and(regexp_full_match(lower(v), '[0-9a-f-]{36}'))") + " AS format FROM v GROUP BY 1")
def a4(r):
    p = r("part")
    m = F.md5(F.col("p_partkey").cast("string"))
    uuid = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12))
    return M.formats(p.select(F.lpad((F.col("p_partkey") % 1000000).cast("string"), 6, "0").alias("code6"), (1000 + F.col("p_partkey") % 9000).cast("string").alias("year"), F.concat("p_partkey", F.lit("@example.org")).alias("mail"), uuid.alias("uuid"), F.col("p_brand").alias("brand")))


@query("a6_coverage", f"SELECT layer, count(*) AS tables, count(*) FILTER (WHERE trim(description) = '') AS empty_tables, coalesce(sum(n), 0) AS columns, coalesce(sum(e), 0) AS empty_columns, round(100.0 * coalesce(sum(e), 0) / nullif(sum(n), 0), 1) AS empty_pct FROM (SELECT t.id, t.description, CASE WHEN regexp_matches(t.table_schema, 'gold|mart') THEN 'gold' WHEN regexp_matches(t.table_schema, 'silver') THEN 'silver' ELSE 'bronze' END AS layer, n, e FROM {_TABLES} t LEFT JOIN (SELECT id, count(*) AS n, count(*) FILTER (WHERE trim(description) = '') AS e FROM {_COLS} GROUP BY 1) c ON c.id = t.id) GROUP BY ROLLUP (layer)")
def a6(r):
    c = _columns(r).groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.trim("description") == "").alias("e"))
    t = _tables(r).join(c, "id", "left").withColumn("layer", S.layer(F.col("table_schema")))
    return t.rollup("layer").agg(F.count("*").alias("tables"), F.count_if(F.trim("description") == "").alias("empty_tables"), F.coalesce(F.sum("n"), F.lit(0)).alias("columns"), F.coalesce(F.sum("e"), F.lit(0)).alias("empty_columns"), F.round(100.0 * F.coalesce(F.sum("e"), F.lit(0)) / F.nullif(F.sum("n"), F.lit(0)), 1).alias("empty_pct"))


@query("t7_catalog_texts", f"SELECT t.id, t.table_name || CASE WHEN trim(t.description) <> '' THEN ': ' || t.description ELSE '' END || '. Columns: ' || coalesce(x, '') AS text FROM {_TABLES} t JOIN (SELECT id, string_agg(column_name || ' (' || data_type || ')' || CASE WHEN trim(description) <> '' THEN ' - ' || description ELSE '' END, ', ' ORDER BY ordinal, column_name, data_type, description) AS x FROM {_COLS} GROUP BY 1) c ON c.id = t.id")
def t7(r):
    t = _tables(r).join(S.grouped(_columns(r)), ["table_schema", "table_name"])
    return t.select("id", S.catalog_text(F.col("table_name"), F.col("description"), F.col("columns")).alias("text"))


@query("t8_question_texts", f"SELECT id, 'Order ' || id || ' of ' || strftime(updated_at, '%Y-%m-%d') AS text, sql_text AS sql FROM {Q.LOG} WHERE trim(sql_text) <> ''")
def t8(r):
    return Q.question_texts(Q.sql_log(r).withColumn("question", F.concat(F.lit("Order "), "id", F.lit(" of "), F.date_format("updated_at", "yyyy-MM-dd")))).select("id", "text", F.col("metadata")["sql"].alias("sql"))


@query("f20_schema_search", f"WITH t AS (SELECT id, table_name FROM {_TABLES} WHERE contains(table_name, 'fact_') OR contains(table_name, 'agg_')), e AS (SELECT d.id AS dst, d.up AS src FROM {_TABLES} d WHERE up IS NOT NULL) SELECT src, dst FROM e WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)")
def f20(r):
    """Edges whose both ends are tables that the term is in."""
    t = _tables(r)
    found = t.where("table_name like '%fact\\_%' or table_name like '%agg\\_%'").select("id")
    e = t.where("up is not null").select(F.col("up").alias("src"), F.col("id").alias("dst"))
    return e.join(found, e.src == found.id, "left_semi").join(found, e.dst == found.id, "left_semi")


@query("x24_difficulty", f"SELECT id, CASE WHEN len(regexp_extract_all(upper(sql_text), 'JOIN')) < 2 THEN 'SIMPLE' ELSE 'COMPLEX' END AS difficulty FROM {Q.LOG}")
def x24(r):
    return Q.sql_log(r).select("id", Q.difficulty(F.col("sql_text")).alias("difficulty"))


@query("f10_suspicious_sql", f"SELECT id, concat_ws(',', CASE WHEN regexp_matches(sql_text, ';\\s*(DROP|DELETE|INSERT|UPDATE|ALTER|CREATE)', 'i') THEN 'stacked' END, CASE WHEN regexp_matches(sql_text, '--') THEN 'line_comment' END, CASE WHEN regexp_matches(sql_text, '/\\*.*?\\*/', 's') THEN 'block_comment' END, CASE WHEN regexp_matches(sql_text, 'xp_cmdshell', 'i') THEN 'shell' END, CASE WHEN regexp_matches(sql_text, 'UNION\\s+ALL\\s+SELECT\\s+NULL', 'i') THEN 'union_null' END) AS why FROM {Q.ODD}")
def f10(r):
    return Q.odd_log(r).select("id", F.array_join(Q.suspicious(F.col("sql_text")), ",").alias("why"))


@query("f9_read_only_audit", "SELECT o_orderkey AS id, o_orderkey % 12 IN (0, 2, 6, 8, 10, 11) AS ok FROM orders")
def f9(r):
    """SQL texts of which it is known by construction whether they only read."""
    return Q.odd_log(r).select("id", Q.read_only(F.col("sql_text")).alias("ok"))


@query("f13_preferred_tables", f"SELECT id, string_agg(coalesce(p, t), ',' ORDER BY coalesce(p, t)) AS tables, count(p) AS replaced FROM (SELECT id, t, CASE t WHEN 'orders' THEN 'gold_orders' WHEN 'nation' THEN 'dim_nation' END AS p FROM (SELECT id, unnest(list_distinct([lower(x) for x in regexp_extract_all(sql_text, '(?i)\\b(?:FROM|JOIN)\\s+([A-Za-z_][\\w.]*)', 1)])) AS t FROM {Q.LOG})) GROUP BY 1")
def f13(r):
    log = Q.sql_log(r)
    better = F.create_map(*[F.lit(x) for x in ("orders", "gold_orders", "nation", "dim_nation")])
    used = log.select("id", F.explode(X.referenced_tables(F.col("sql_text"))).alias("t")).withColumn("p", F.try_element_at(better, F.col("t")))
    return used.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("p", "t"))), ",").alias("tables"), F.count("p").alias("replaced"))


@query("f21_onboarding", "SELECT o_orderkey AS id, o_orderpriority AS title FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate, o_orderkey LIMIT 8")
def f21(r):
    """The first eight verified queries that are flagged for it; eight is the feature."""
    o = r("orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return o.orderBy("o_orderdate", "o_orderkey").limit(8).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))


@query("v2_examples_by_table", f"SELECT id FROM {Q.LOG} WHERE list_has_any(list_distinct([lower(x) for x in regexp_extract_all(sql_text, '(?i)\\b(?:FROM|JOIN)\\s+([A-Za-z_][\\w.]*)', 1)]), ['lineitem', 'region']) ORDER BY updated_at DESC, id LIMIT 20")
def v2(r):
    """The latest twenty examples that use one of the tables; no vector is compared."""
    log = Q.sql_log(r).where(F.arrays_overlap(X.referenced_tables(F.col("sql_text")), F.array(F.lit("lineitem"), F.lit("region"))))
    return log.orderBy(F.desc("updated_at"), "id").limit(20).select("id")
