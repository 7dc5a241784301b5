"""Catalogs of tables: from column listings, from manifests in JSON, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is read of a manifest's node.
NODE = "struct<name:string,schema:string,description:string,materialized:string,columns:map<string,struct<name:string,data_type:string,description:string,ordinal:int>>,depends_on:array<string>>"
#: Column names that mark a partition column.
PARTITION_NAMES = ("ds", "dt", "date", "partition_date", "event_date")
#: Parts of column names that say the values are too many to list.
MANY_VALUES = ("id", "uuid", "guid", "hash", "token", "key", "password", "email", "phone", "ip", "url", "path", "timestamp", "created_at", "updated_at", "deleted_at")
#: Data types of text columns; a type that is not known may be one.
TEXT_TYPES = ("VARCHAR", "STRING", "TEXT", "CHAR", "")


def grouped(columns: DataFrame) -> DataFrame:
    """(table_schema, table_name, columns): the columns of each table in order of their ordinals."""
    one = F.struct("ordinal", "column_name", "data_type", "description")
    return columns.groupBy("table_schema", "table_name").agg(F.array_sort(F.collect_list(one)).alias("columns"))


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """(key, name, schema, description, materialized, columns, depends_on) of each node in a manifest: `text` maps keys to nodes."""
    nodes = manifest.select(F.explode(F.from_json("text", f"map<string,{NODE}>")).alias("key", "node"))
    columns = F.array_sort(F.transform(F.map_values("node.columns"), lambda c: F.struct(c["ordinal"].alias("ordinal"), c["name"].alias("column_name"), c["data_type"].alias("data_type"), F.coalesce(c["description"], F.lit("")).alias("description"))))
    return nodes.select("key", "node.name", "node.schema", F.coalesce("node.description", F.lit("")).alias("description"), "node.materialized", columns.alias("columns"), "node.depends_on")


def lineage(nodes: DataFrame) -> DataFrame:
    """(upstream, downstream) by full names; a dependency that the manifest does not hold keeps its key."""
    full = F.concat_ws(".", "schema", "name")
    edges = nodes.select(full.alias("downstream"), F.explode("depends_on").alias("key"))
    return edges.join(nodes.select("key", full.alias("name")), "key", "left").select(F.coalesce("name", "key").alias("upstream"), "downstream")


def layer(name: Column) -> Column:
    """gold, silver, bronze or unknown, by the first rule that a name meets."""
    t = F.lower(name)
    return F.when(t.rlike("gold|mart|dim_|fact_|agg_"), "gold").when(t.rlike("silver|cleaned|enriched"), "silver").when(t.rlike("bronze|raw|staging|stg_"), "bronze").otherwise("unknown")


def tier(schema: Column, name: Column) -> Column:
    """gold, silver, bronze or other, by schema and name; a schema of materialised views is gold."""
    t = F.lower(F.concat_ws(".", schema, name))
    return F.when(t.contains("gold") | F.lower(schema).contains("mview"), "gold").when(t.contains("silver"), "silver").when(t.rlike("bronze|raw"), "bronze").otherwise("other")


def refined(schema: Column) -> Column:
    """Whether a schema is no raw one."""
    return ~F.lower(schema).rlike("bronze|raw")


def listable(column: Column, data_type: Column) -> Column:
    """Whether a column's values can be listed: text, and no part of its name says that they are too many."""
    return F.upper(data_type).isin(*TEXT_TYPES) & ~F.lower(column).rlike("|".join(MANY_VALUES))


def partitions(column: Column, declared: Column) -> Column:
    """declared, by_name, or null where a column is no partition column."""
    return F.when(declared, "declared").when(F.lower(column).isin(*PARTITION_NAMES), "by_name")


def needs_description(text: Column, columns: Column) -> Column:
    """No text, or more than half of the columns without one."""
    empty = F.size(F.filter(columns, lambda c: F.trim(F.coalesce(c["description"], F.lit(""))) == ""))
    return (F.trim(F.coalesce(text, F.lit(""))) == "") | ((F.size(columns) > 0) & (2 * empty > F.size(columns)))


def enriched(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """tables (catalog, table_schema, table_name, columns) whose empty columns are filled from the listing.

    Of the same catalog first, else of the least catalog that has the same schema and table.
    """
    listed = columns.groupBy("catalog", "table_schema", "table_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type"))).alias("listed"))
    least = Window.partitionBy("table_schema", "table_name").orderBy("catalog")
    other = listed.withColumn("i", F.row_number().over(least)).where("i = 1").select("table_schema", "table_name", F.col("listed").alias("other"), F.col("catalog").alias("from_catalog"))
    both = tables.join(listed, ["catalog", "table_schema", "table_name"], "left").join(other, ["table_schema", "table_name"], "left")
    empty = F.size("columns") == 0
    how = F.when(~empty, "own").when(F.col("listed").isNotNull(), "exact").when(F.col("other").isNotNull(), F.concat(F.lit("like "), "from_catalog")).otherwise("none")
    return both.select("catalog", "table_schema", "table_name", F.when(empty, F.coalesce("listed", "other")).otherwise(F.col("columns")).alias("columns"), how.alias("how"))


def described(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """tables with empty descriptions filled from texts (table_name, new), and whether that changed them."""
    empty = F.trim(F.coalesce("description", F.lit(""))) == ""
    changed = empty & (F.trim(F.coalesce("new", F.lit(""))) != "")
    return tables.join(texts, "table_name", "left").withColumns({"changed": changed, "description": F.when(changed, F.col("new")).otherwise(F.coalesce("description", F.lit("")))}).drop("new")


def catalog_text(name: Column, text: Column, columns: Column) -> Column:
    """'table: text. Columns: name (type) - description, ...'"""
    one = F.transform(columns, lambda c: F.concat(c["column_name"], F.lit(" ("), c["data_type"], F.lit(")"), F.when(F.trim(c["description"]) != "", F.concat(F.lit(" - "), c["description"])).otherwise("")))
    return F.concat(name, F.when(F.trim(text) != "", F.concat(F.lit(": "), text)).otherwise(""), F.lit(". Columns: "), F.array_join(one, ", "))
