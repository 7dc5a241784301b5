"""Error messages to categories by a table of rules: words of the rules' descriptions first, then phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories, subtypes and descriptions of errors, in the order in which they count.
TAXONOMY = (
    ("syntax", "sql_syntax_error", "SQL syntax error"),
    ("syntax", "invalid_alias", "Invalid alias reference"),
    ("schema_link", "table_missing", "Referenced table does not exist"),
    ("schema_link", "col_missing", "Referenced column does not exist"),
    ("schema_link", "ambiguous_col", "Ambiguous column reference"),
    ("schema_link", "incorrect_foreign_key", "Incorrect column used as foreign key"),
    ("join", "join_missing", "Missing JOIN condition"),
    ("join", "join_wrong_type", "Incorrect join type"),
    ("join", "extra_table", "Unused table in FROM/JOIN"),
    ("join", "incorrect_col", "Using incorrect column name to perform join"),
    ("filter", "where_missing", "Missing WHERE for filter in question"),
    ("filter", "condition_wrong_col", "Condition uses wrong column"),
    ("filter", "condition_type_mismatch", "Type mismatch in WHERE condition"),
    ("aggregation", "agg_no_groupby", "Aggregation without GROUP BY"),
    ("aggregation", "groupby_missing_col", "Missing column in GROUP BY"),
    ("aggregation", "having_without_groupby", "HAVING used without GROUP BY"),
    ("aggregation", "having_incorrect", "Incorrect placement of HAVING"),
    ("aggregation", "having_vs_where", "Usage of HAVING confused with usage of WHERE"),
    ("value", "hardcoded_value", "Hardcoded literal instead of column"),
    ("value", "value_format_wrong", "Value format incompatible"),
    ("subquery", "unused_subquery", "Subquery not used"),
    ("subquery", "subquery_missing", "Needed subquery missing"),
    ("subquery", "subquery_correlation_error", "Correlation error in subquery"),
    ("set_op", "union_missing", "UNION query without UNION operator"),
    ("set_op", "intersect_missing", "INTERSECT missing"),
    ("set_op", "except_missing", "EXCEPT missing"),
    ("others", "order_by_missing", "ORDER BY needed but missing"),
    ("others", "limit_missing", "LIMIT needed but missing"),
    ("others", "duplicate_select", "Duplicate columns in SELECT"),
    ("others", "unsupported_function", "Function not supported"),
    ("others", "incorrect_foreign_key_relationship", "Used incorrect foreign key relationship"),
    ("select", "incorrect_extra_values", "Columns or values selected are incorrect or extra"),
    ("select", "incorrect_order", "Values selected are in the wrong order"),
    ("trino_specific", "missing_partition_filter", "Partition column (ds/dt/date) not in WHERE — will cause full table scan"),
    ("trino_specific", "cast_instead_of_try_cast", "Using CAST instead of TRY_CAST — will fail on bad data"),
    ("trino_specific", "non_trino_function", "Using function not available in Trino (e.g., IFNULL, DATEADD without quotes, ISNULL)"),
)
#: Phrases for messages that no word of the taxonomy hits, in order, and the class of all others.
PHRASES = (
    ("syntax", "sql_syntax_error", ("syntax", "unexpected", "mismatched input")),
    ("schema_link", "col_missing", ("does not exist", "cannot be resolved", "column not found")),
    ("filter", "type_mismatch", ("type mismatch", "cannot be cast", "cannot be applied")),
    ("aggregation", "missing_group_by", ("must be an aggregate", "group by", "not in group by")),
    ("join", "ambiguous_column", ("ambiguous", "column reference")),
    ("function", "wrong_arg_type", ("unexpected parameters", "function not found")),
    ("date_time", "wrong_date_format", ("cannot cast", "date", "timestamp", "interval")),
)
DEFAULT = ("syntax", "sql_syntax_error")
#: Words of a description with fewer characters say nothing.
LEAST = 4


def rules(spark: SparkSession, taxonomy=TAXONOMY, phrases=PHRASES) -> DataFrame:
    """(rank, category, subtype, word, is_phrase): a row for each word of each description and for each phrase; earlier rules have lower ranks."""
    rows = [(i, c, s, w, False) for i, (c, s, d) in enumerate(taxonomy) for w in dict.fromkeys(d.lower().split()) if len(w) >= LEAST]
    rows += [(len(taxonomy) + i, c, s, w, True) for i, (c, s, ws) in enumerate(phrases) for w in ws]
    return spark.createDataFrame(rows, "rank int, category string, subtype string, word string, is_phrase boolean")


def classified(messages: DataFrame, table: DataFrame, keys: list[str], message: str = "message", default: tuple[str, str] = DEFAULT) -> DataFrame:
    """messages with category and subtype of the lowest rule one of whose words lies anywhere in the message; case does not count.

    Words are looked for in the order of their ranks, up to the first that a message has, so a message is read at most once a
    word and nothing is shuffled; phrases count only where no word does. `keys` are the columns that come first. Null and
    empty messages get the default, as do those that nothing hits.
    """
    listed = sorted((r["rank"], r["word"], r["is_phrase"]) for r in table.collect())  # some hundred rows

    def lowest(text: Column, phrase: bool) -> Column:
        kept: list[tuple[int, str]] = []
        for rank, word, p in listed:
            if p == phrase and not any(w in word for _, w in kept):  # else an earlier word lies in this one
                kept.append((rank, word))
        return F.coalesce(*[F.when(text.contains(w), F.lit(i)) for i, w in kept], F.lit(None).cast("int"))

    named = table.groupBy("rank").agg(F.first("category").alias("category"), F.first("subtype").alias("subtype"))
    lower = messages.select(*keys, *[c for c in messages.columns if c not in keys], F.lower(F.col(message)).alias("__lower"))
    ranked = lower.withColumn("rank", F.coalesce(lowest(F.col("__lower"), False), lowest(F.col("__lower"), True))).drop("__lower")
    out = ranked.join(F.broadcast(named), "rank", "left").drop("rank")  # a row for each rule
    return out.withColumns({"category": F.coalesce("category", F.lit(default[0])), "subtype": F.coalesce("subtype", F.lit(default[1]))})
