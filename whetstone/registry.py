"""Registered queries and the SQL each one equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Reader:
    """The tables of a folder, as they are or as streams."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def stream(self, table: str) -> DataFrame:
        # a pattern, as a streaming source takes a plain path for a folder
        return self.spark.readStream.schema(self(table).schema).parquet(f"{self.sf_dir}/[{table[0]}]{table[1:]}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a function Reader -> DataFrame under a name."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Reader(spark, sf_dir))

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def load() -> None:
    """Imports every module that registers queries."""
    import importlib
    import pkgutil

    from whetstone import plans

    for m in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"whetstone.plans.{m.name}")


load()
