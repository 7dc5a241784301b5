"""The SQL log that queries read, one text for each order, and functions over SQL texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whetstone.functions import text as X

TEMPLATES = ("SELECT c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT * FROM lineitem JOIN orders ON lineitem.l_orderkey = orders.o_orderkey", "WITH x AS (SELECT * FROM part) SELECT * FROM x", "DELETE FROM orders", "", "SELECT n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey;")
#: Texts that audits tell apart: comments, two statements, changes inside WITH, odd starts.
ODD_TEMPLATES = (
    "SELECT 1 -- all",
    "SELECT 1; DROP TABLE orders",
    "  with x AS (SELECT 1) SELECT * FROM x",
    "WITH x AS (DELETE FROM orders RETURNING *) SELECT * FROM x",
    "   ",
    "REVOKE ALL ON orders FROM ann",
    "VALUES (1), (2);",
    "INSERT INTO t SELECT 1",
    "/* first */ SELECT 2",
    "GRANT ALL ON t TO bob",
    "EXPLAIN SELECT 1",
    "-- note\nSELECT a UNION ALL SELECT NULL",
)


def _case(templates) -> str:
    return f"CASE o_orderkey % {len(templates)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(templates)) + " END"


#: The logs in DuckDB's SQL.
LOG = f"(SELECT o_orderkey AS id, o_orderdate AS updated_at, {_case(TEMPLATES)} AS sql_text FROM orders)"
ODD = f"(SELECT o_orderkey AS id, {_case(ODD_TEMPLATES)} AS sql_text FROM orders)"


def _of(templates) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in templates]), (F.col("o_orderkey") % len(templates) + 1).cast("int"))


def sql_log(r, *more: str) -> DataFrame:
    return r("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated_at"), _of(TEMPLATES).alias("sql_text"), *more)


def odd_log(r) -> DataFrame:
    return r("orders").select(F.col("o_orderkey").alias("id"), _of(ODD_TEMPLATES).alias("sql_text"))


#: How a text may start, what may not occur within WITH, and patterns of suspicious texts.
READERS = ("SELECT", "WITH", "EXPLAIN", "DESCRIBE", "SHOW", "VALUES")
CHANGE_WORDS = "INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|MERGE"
CHANGES = rf"(?i)\b({CHANGE_WORDS})\b"
SUSPICIOUS = {"stacked": r"(?i);\s*(DROP|DELETE|INSERT|UPDATE|ALTER|CREATE)", "line_comment": "--", "block_comment": r"(?s)/\*.*?\*/", "shell": r"(?i)xp_cmdshell", "union_null": r"(?i)UNION\s+ALL\s+SELECT\s+NULL"}


def read_only(sql: Column) -> Column:
    """One statement that starts as a reader does, comments aside, and changes nothing within WITH; blank texts are none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(sql, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "))
    body = F.regexp_replace(bare, r"[;\s]+$", "")
    first = F.upper(F.regexp_extract(body, r"^\s*(\w+)", 1))
    return F.coalesce(first.isin(*READERS) & ~F.contains(body, F.lit(";")) & ~((first == "WITH") & body.rlike(X.whole_words(CHANGE_WORDS))), F.lit(False))


def suspicious(sql: Column) -> Column:
    """The names of the patterns that a text has."""
    return F.array_compact(F.array(*[F.when(sql.rlike(p), F.lit(k)) for k, p in SUSPICIOUS.items()]))


def difficulty(sql: Column) -> Column:
    return F.when(F.regexp_count(F.upper(sql), F.lit("JOIN")) < 2, "SIMPLE").otherwise("COMPLEX")


def dashboard_cards(dashboards: DataFrame) -> DataFrame:
    """(dashboard, card, sql, tables) of the native cards of dashboards in JSON."""
    of = F.from_json("text", "dashcards array<struct<id:long,type:string,sql:string>>")
    cards = dashboards.select("dashboard", F.explode(of["dashcards"]).alias("c")).where("c.type = 'native'")
    return cards.select("dashboard", F.col("c.id").alias("card"), F.col("c.sql").alias("sql"), X.referenced_tables(F.col("c.sql")).alias("tables"))


def question_texts(questions: DataFrame) -> DataFrame:
    """(id, text, metadata): a question's text to embed, its SQL beside it; blank questions and blank SQL go."""
    some = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return questions.where(some("question") & some("sql_text")).select("id", F.trim("question").alias("text"), F.create_map(F.lit("sql"), F.col("sql_text")).alias("metadata"))
