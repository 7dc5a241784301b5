"""Audits of SQL texts that hold the text of every document as a literal, so that patterns meet what people write."""

from __future__ import annotations

from pyspark.sql import functions as F

from whetstone.functions import sqltext as Q
from whetstone.functions import text as X
from whetstone.registry import query

STARTS = ("SELECT", "select", "  WITH x AS (SELECT 1) SELECT", "-- c\nSELECT", "/* a\n b */ EXPLAIN SELECT", "INSERT INTO t SELECT", "with y as (delete from z returning *) select", "SHOW TABLES --", "VALUES", "(SELECT", "")
ENDS = ("", ";", "; drop table t", " -- end", " /* x\n y */", " UNION  ALL SELECT NULL", ";;\n", " ; exec XP_cmdshell", " JOIN Cat.S.Dim d ON d.id = a.id")


def _listed(texts: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in texts) + "]"


_TEXTS = f"""(SELECT doc_id, {_listed(STARTS)}[CAST(doc_id % {len(STARTS)} + 1 AS INT)] || ' ''' || replace(coalesce(text, ''), '''', '''''') || ''' AS a FROM ' || lang || '.' || source || ' a' || {_listed(ENDS)}[CAST(doc_id // 7 % {len(ENDS)} + 1 AS INT)] AS sql_text FROM documents)"""


def _texts(r):
    of = lambda texts, at: F.element_at(F.array(*map(F.lit, texts)), (at % len(texts) + 1).cast("int"))
    literal = F.replace(F.coalesce("text", F.lit("")), F.lit("'"), F.lit("''"))
    sql = F.concat(of(STARTS, F.col("doc_id")), F.lit(" '"), literal, F.lit("' AS a FROM "), "lang", F.lit("."), "source", F.lit(" a"), of(ENDS, F.expr("doc_id div 7")))
    return r("documents").select("doc_id", sql.alias("sql_text"))


_BODY = r"regexp_replace(trim(regexp_replace(regexp_replace(sql_text, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g')), '[;\s]+$', '')"


@query("f9_read_only_texts", f"SELECT doc_id, coalesce(word IN ({', '.join(repr(x) for x in Q.READERS)}) AND NOT contains(body, ';') AND NOT (word = 'WITH' AND regexp_matches(body, '{Q.CHANGES}')), false) AS ok FROM (SELECT doc_id, body, upper(regexp_extract(body, '^\\s*(\\w+)', 1)) AS word FROM (SELECT doc_id, {_BODY} AS body FROM {_TEXTS}))")
def f9_texts(r):
    """Which statements only read: one statement, a reader's start, no change inside WITH, comments aside."""
    return _texts(r).select("doc_id", Q.read_only(F.col("sql_text")).alias("ok"))


_WHY = ", ".join(f"CASE WHEN regexp_matches(sql_text, '{p}') THEN '{k}' END" for k, p in Q.SUSPICIOUS.items())


@query("f10_suspicious_texts", f"SELECT doc_id, concat_ws(',', {_WHY}) AS why FROM {_TEXTS}")
def f10_texts(r):
    return _texts(r).select("doc_id", F.array_join(Q.suspicious(F.col("sql_text")), ",").alias("why"))


@query("a8_tables_of_texts", f"SELECT t AS table_name, count(*) AS n FROM (SELECT unnest(list_distinct([lower(x) for x in regexp_extract_all(sql_text, '{X.TABLE_REF}', 1)])) AS t FROM {_TEXTS}) GROUP BY 1")
def a8_texts(r):
    """How many statements read each table, wherever the words FROM and JOIN stand in them."""
    return _texts(r).select(F.explode(X.referenced_tables(F.col("sql_text"))).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("n"))
