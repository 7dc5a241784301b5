"""Document files by extension, chunks as a table function, paths between pairs, calls that may fail, and what probes found."""

from __future__ import annotations

from pyspark.sql import functions as F

from whetstone.functions import udtf
from whetstone.operators import calls, paths
from whetstone.operators import documents as D
from whetstone.registry import query
from whetstone.sources import documents as files_by_kind
from whetstone.sources import files
from whetstone.streaming import jobs as J

# --- document files --------------------------------------------------------------------------------------------------

#: Rows of a table that one file holds.
EACH = 50
_NL = "chr(10)"
_FILES = f"""(SELECT 'md' AS kind, 'd' || doc_id // {EACH} || '.md' AS name, string_agg('# doc ' || doc_id || {_NL} || replace(text, {_NL}, {_NL} || '## '), {_NL} ORDER BY doc_id) AS content FROM documents GROUP BY doc_id // {EACH}
    UNION ALL SELECT 'txt', 'd' || doc_id // {EACH} || '.txt', string_agg(doc_id || '. Document in ' || lang || {_NL} || text, {_NL} ORDER BY doc_id) FROM documents GROUP BY doc_id // {EACH}
    UNION ALL SELECT 'html', 'p' || page_id // {EACH} || '.html', string_agg(html, {_NL} ORDER BY page_id) FROM pages GROUP BY page_id // {EACH})"""
_HEADERS = f"""SELECT kind, name, len(regexp_extract_all(content, '(?m)^#{{1,2}}\\s')) AS sections FROM {_FILES} WHERE kind = 'md'
    UNION ALL SELECT kind, name, len(regexp_extract_all(content, '(?m)^\\d+\\.\\s')) FROM {_FILES} WHERE kind = 'txt'
    UNION ALL SELECT kind, name, len(regexp_extract_all(content, '(?i)<h[123]')) FROM {_FILES} WHERE kind = 'html'
    UNION ALL SELECT 'json', 's' || s_nationkey || '.json', count(*) FROM supplier GROUP BY s_nationkey"""


def _files(r):
    """(name, content): documents as Markdown and as numbered text, pages, and suppliers as entities, some rows a file."""
    gathered = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", part.alias("part")))), lambda x: x["part"]), "\n")
    d = r("documents").select(F.col("doc_id").alias("id"), "text", "lang", F.expr(f"doc_id div {EACH}").alias("g"))
    md = gathered(F.concat(F.lit("# doc "), "id", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## "))))
    txt = gathered(F.concat("id", F.lit(". Document in "), "lang", F.lit("\n"), "text"))
    out = d.groupBy("g").agg(md.alias("md"), txt.alias("txt")).select(F.inline(F.array(*[F.struct(F.concat(F.lit("d"), "g", F.lit(f".{k}")).alias("name"), F.col(k).alias("content")) for k in ("md", "txt")])))
    p = r("pages").select(F.col("page_id").alias("id"), "html", F.expr(f"page_id div {EACH}").alias("g"))
    out = out.unionByName(p.groupBy("g").agg(gathered(F.col("html")).alias("content")).select(F.concat(F.lit("p"), "g", F.lit(".html")).alias("name"), "content"))
    entity = F.struct(F.col("s_name").alias("name"), F.concat(F.lit("balance "), "s_acctbal").alias("description"), F.array(F.struct(F.lit("s_suppkey").alias("name"), F.lit("bigint").alias("dataType"))).alias("columns"))
    s = r("supplier").groupBy("s_nationkey").agg(F.to_json(F.array_sort(F.collect_list(entity))).alias("content"))
    return out.unionByName(s.select(F.concat(F.lit("s"), "s_nationkey", F.lit(".json")).alias("name"), "content"))


def _written(r) -> str:
    path = files.scratch(r.spark, "files")
    files_by_kind.write_files(_files(r), path)
    return path


@query("s10_files_by_extension", _HEADERS)
def s10_kinds(r):
    """Files of four kinds written from the tables and read back, each cut in its own way; sections with a header are counted."""
    s = files_by_kind.file_sections(files_by_kind.read_files(r.spark, _written(r)))
    # a section starts with its mark; what stands before the first one has none
    marked = F.when(F.col("kind") == "txt", F.col("text").rlike(r"^\d+\.\s")).when(F.col("kind") == "json", True).when(F.col("kind") == "md", F.col("text").rlike(r"^#{1,2}(\s|$)")).otherwise(F.col("text").rlike(r"^#{1,3}(\s|$)"))
    return s.groupBy("kind", files_by_kind.short_name(F.col("path")).alias("name")).agg(F.count_if(marked).alias("sections"))


@query("t5_file_chunks")
def t5_chunks(r):
    """All chunks of those files, one of each hash, read as a stream: a second run over the folder adds nothing."""
    path, out = _written(r), files.scratch(r.spark, "chunks")
    for _ in range(2):
        chunks = files_by_kind.file_chunks(files_by_kind.read_files(r.spark, path, stream=True))
        held = J.drained(chunks, "chunks", path=out)
    held = held.select("path", "kind", "section", "title", "part", "hash")  # no texts through the shuffle
    return files_by_kind.distinct_chunks(held).select(files_by_kind.short_name(F.col("path")).alias("name"), "kind", "section", "title", "part", "hash")


# --- chunks from SQL text --------------------------------------------------------------------------------------------


@query("t4_chunks_in_sql")
def t4_sql(r):
    """Every document's chunks by a LATERAL call, and by a call over the table in partitions of its languages."""
    udtf.register(r.spark)
    docs = r("documents").select("doc_id", "lang", "text")
    beside = r.spark.sql("SELECT 'lateral' AS how, doc_id, c.part, c.parts, c.start, c.hash, c.char_count FROM {docs} d, LATERAL split_text(d.text) c", docs=docs)
    docs.createOrReplaceTempView("documents_to_split")
    over = r.spark.sql("SELECT 'table' AS how, doc_id, part, parts, start, hash, char_count FROM split_rows(TABLE(documents_to_split) PARTITION BY doc_id)")
    return beside.unionByName(over)


@query("t4_chunk_calls_agree", "SELECT count(*) AS documents, 0 AS differing FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def t4_agree(r):
    """How many documents have chunks, and for how many the three ways of cutting them differ."""
    columns = ["part", "parts", "start", "hash", "char_count"]
    listed = lambda df: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("c"))
    both = t4_sql(r)
    a = listed(D.split_long(r("documents").select("doc_id", "text"), ["doc_id"]))
    b, c = (listed(both.where(F.col("how") == how)).withColumnRenamed("c", how) for how in ("lateral", "table"))
    every = a.join(b, "doc_id", "full").join(c, "doc_id", "full")
    return every.agg(F.count("*").alias("documents"), F.count_if(~(F.col("c").eqNullSafe(F.col("lateral")) & F.col("c").eqNullSafe(F.col("table")))).alias("differing"))


# --- paths between pairs ---------------------------------------------------------------------------------------------


def _graph(r):
    """Parts to their suppliers, these to their nations, these to their regions."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    bought = r("lineitem").select("l_partkey", "l_suppkey").distinct().select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst"), F.lit("suppkey").alias("join_key"))
    based = r("supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), F.lit("nationkey").alias("join_key"))
    return bought.unionByName(based).unionByName(r("nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.lit(None).cast("string").alias("join_key")))


def _asked(r):
    """Of every fiftieth order each part with the region of its customer."""
    o = r("orders").where("o_orderkey % 50 = 0").join(r("customer"), F.col("o_custkey") == F.col("c_custkey")).join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.join(r("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("set"), F.concat(F.lit("p"), "l_partkey").alias("start"), F.concat(F.lit("r"), "n_regionkey").alias("node"))


_PAIR_PATHS = """(SELECT start, node, min(start || '>s' || l_suppkey || '>n' || s_nationkey || '>' || node) AS path FROM
    (SELECT DISTINCT l_partkey AS part, 'p' || l_partkey AS start, 'r' || n_regionkey AS node FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 50 = 0) a
    JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) b ON b.l_partkey = a.part JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey AND 'r' || n_regionkey = node GROUP BY 1, 2)"""


@query("g4_paths_between_pairs", f"SELECT start, node, path, 3 AS n FROM {_PAIR_PATHS}")
def g4_pairs(r):
    """From parts to regions: fronts of thousands of pairs that meet at a supplier or a nation."""
    return paths.paths_between(_graph(r), _asked(r), 4)


@query("g6_pair_hop_keys", f"SELECT start, node, hop, src, dst, CASE hop WHEN 1 THEN 'suppkey' WHEN 2 THEN 'nationkey' ELSE src || '.id' END AS join_key FROM (SELECT start, node, hop, split_part(path, '>', hop) AS src, split_part(path, '>', hop + 1) AS dst FROM {_PAIR_PATHS}, (SELECT unnest([1, 2, 3]) AS hop))")
def g6_pairs(r):
    g = _graph(r)
    return paths.pair_hop_keys(paths.paths_between(g, _asked(r), 4), g)


@query("g5_connecting_tables", f"""WITH a AS (SELECT DISTINCT o_orderkey AS "set", 'p' || l_partkey AS start, 'r' || n_regionkey AS node FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 50 = 0),
    m AS (SELECT "set", start AS node FROM a UNION SELECT "set", node FROM a), p AS (SELECT DISTINCT "set", unnest(string_split(path, '>')) AS node FROM a JOIN {_PAIR_PATHS} USING (start, node))
    SELECT "set", node, node NOT IN (SELECT m2.node FROM m m2 WHERE m2."set" = u."set") AS is_bridge FROM (SELECT * FROM m UNION SELECT * FROM p) u""")
def g5_sets(r):
    """What lies on the ways between each order's parts and its customer's region, beside these themselves."""
    asked = _asked(r).distinct()
    found = paths.paths_between(_graph(r), asked.select("start", "node"), 4)
    on = asked.join(found, ["start", "node"]).select("set", F.explode(F.split("path", ">")).alias("node"), F.lit(True).alias("is_bridge"))
    members = asked.select("set", F.explode(F.array("start", "node")).alias("node"), F.lit(False).alias("is_bridge"))
    return members.unionByName(on).groupBy("set", "node").agg(F.min("is_bridge").alias("is_bridge"))


# --- calls that may fail ---------------------------------------------------------------------------------------------


def _lengths(texts: list[str]) -> list[int]:
    """A stand-in for a service: it takes no batch with an empty text and none over a million characters."""
    if not all(texts):
        raise ValueError("empty text")
    if sum(map(len, texts)) > 1_000_000:
        raise ValueError("batch too large")
    return [len(t) for t in texts]


@query("e1_called_in_batches", "SELECT doc_id, CASE WHEN text <> '' THEN length(text) END AS result, CASE WHEN text <> '' THEN NULL ELSE 'ValueError: empty text' END AS error FROM documents")
def e1_calls(r):
    """A batch function over all texts, in waves that a failed run would not repeat; rows it refuses get their error."""
    from pyspark.sql import types as T

    docs = r("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = calls.called_in_waves(docs, files.scratch(r.spark, "calls"), F.col("doc_id"), 2, lambda df: calls.called(df, _lengths, T.LongType(), wait=0.0))
    return out.select("doc_id", "result", "error")


@query("e1_native_embeddings")
def e1_native(r):
    """Hashed 3-gram counts of every text at unit length, without Python workers."""
    return calls.hashed_embeddings(r("documents").select("doc_id", "text")).select("doc_id", "embedding")


# --- limits by table, rates over an hour, columns that probes found ---------------------------------------------------

_LIMITS = {"documents": ("doc_id", "text", 50_000), "conversations": ("conv_id", "text", 2_000), "pages": ("page_id", "html", 8_000)}


@query("s13_limits_by_table", " UNION ALL ".join(f"SELECT '{t}' AS tab, count(*) AS n, sum(length(substr({c}, 1, {n}))) AS chars, count(*) FILTER (WHERE length({c}) > {n}) AS clipped FROM {t}" for t, (_, c, n) in _LIMITS.items()))
def s13_limits(r):
    """Documents, questions and descriptions written over their tables, each with texts up to its own length."""
    out = None
    for table, (key, column, most) in _LIMITS.items():
        rows = r(table).select(F.col(key).alias("id"), F.col(column).alias("text"), (F.length(column) > most).alias("cut"))
        held = files.reread(files.clipped(rows, {"text": most}), files.scratch(r.spark, table))
        one = held.agg(F.lit(table).alias("tab"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if("cut").alias("clipped"))
        out = one if out is None else out.unionByName(one)
    return out


_MINUTE = "strftime({0}, '%Y-%m-%d %H:%M')"


@query("st1_hourly_feedback_rate", f"WITH w AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(CAST(i AS INT)) FOR i IN range(60)]) AS s FROM events WHERE event_type IN ('purchase', 'error')) SELECT {_MINUTE.format('s')} AS start, event_type, count(*) AS n, round(count(*) / 3600.0, 6) AS per_second FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT time_bucket(INTERVAL 1 MILLISECOND, max(ts)) - INTERVAL 10 MINUTES FROM events WHERE event_type IN ('purchase', 'error')) GROUP BY 1, 2")
def st1_hourly(r):
    """Feedback a second over the last hour, minute by minute."""
    said = r.stream("events").where(F.col("event_type").isin("purchase", "error"))
    out = J.drained(J.rates(said, ["event_type"], "1 hour", "1 minute"), "rates")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("per_second", 6).alias("per_second"))


@query("j19_columns_not_noted", "SELECT DISTINCT user_id AS scope, event_type || '.' || json_extract_string(props, '$.k') AS \"column\" FROM events e WHERE event_type <> 'view' AND NOT EXISTS (SELECT 1 FROM events n WHERE n.event_type = 'view' AND n.user_id = e.user_id AND json_extract_string(n.props, '$.k') = json_extract_string(e.props, '$.k'))")
def j19_columns(r):
    """Columns that a scope's probes saw and its notes do not name."""
    k = F.get_json_object("props", "$.k")
    seen = r("events").where("event_type <> 'view'").select(F.col("user_id").alias("scope"), k.alias("k"), F.concat("event_type", F.lit("."), k).alias("column")).distinct()
    noted = r("events").where("event_type = 'view'").select(F.col("user_id").alias("scope"), k.alias("k"))
    return seen.join(noted, ["scope", "k"], "left_anti").select("scope", "column")
