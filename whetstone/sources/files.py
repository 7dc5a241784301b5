"""File sources and sinks. All of them go through Spark's readers and writers, so files are read and written by the executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; only a local session may go without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_csv(rows: DataFrame, path: str) -> None:
    """A result as CSV: a header, nulls as empty, quotes only where needed and doubled within."""
    rows.write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Saved questions of a CSV export, without those that lack a name or SQL text ('nan' counts as none)."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=10_000_000)
    some = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    return rows.where(some("name") & some("query") & (F.lower(F.trim("query")) != "nan"))


def write_documents(docs: DataFrame, path: str, kind: str) -> None:
    """(id, text) as one JSON object a line, in folders by `kind`."""
    docs.select(F.col(kind), F.to_json(F.struct("id", "text")).alias("value")).write.partitionBy(kind).text(path)


def read_documents(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(id, text, kind) of all files below `path` whose names match."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    at = F.from_json("value", "id long, text string")
    return lines.select(at.alias("x"), F.regexp_extract(F.input_file_name(), r"kind=([^/]+)/", 1).alias("kind")).select("x.*", "kind")


def replace_source(rows: DataFrame, path: str, source: str) -> None:
    """Overwrites the partitions of `source` that `rows` hold and leaves all others (delete by source, then load)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)


def delete_source(spark: SparkSession, path: str, to: str, source: str, value: str) -> None:
    """A copy of a table without the rows of one source; a null source stays."""
    spark.read.parquet(path).where(~F.col(source).eqNullSafe(F.lit(value))).write.partitionBy(source).parquet(to)


def clipped(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """rows with texts cut to so many characters, as the embedding tables hold them."""
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in limits.items()})


def reread(rows: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = ()) -> DataFrame:
    """rows, written and read again."""
    rows.write.format(form).partitionBy(*by).save(path)
    return rows.sparkSession.read.format(form).schema(rows.schema).load(path)
