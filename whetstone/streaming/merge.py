"""A keyed table that streams are merged into, safe when a batch comes again.

The table is split into buckets of keys. A batch rewrites the buckets it touches as versions of its own, named by its
number, and notes them once they are written; readers take each bucket's last noted version. A repeated batch
starts from the versions before its own and writes over what it left, so it changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new table: a batch rewrites those that it touches.
BUCKETS = 64


class KeyedTable:
    """Rows (key, value, at) with the latest `at` of each key, in folders below a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, key: str, value: str, order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.value, self.order, self.buckets = spark, path.rstrip("/"), key, value, order, buckets

    def _there(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _versions(self, before: int | None = None) -> dict[int, int]:
        """{bucket: the last batch that wrote it}: a row a bucket reaches the driver."""
        if not self._there("notes"):
            return {}
        notes = self.spark.read.parquet(f"{self.path}/notes")
        if before is not None:
            notes = notes.where(F.col("batch") < before)
        return {r["bucket"]: r["last"] for r in notes.groupBy("bucket").agg(F.max("batch").alias("last")).collect()}

    def _rows(self, versions: dict[int, int]) -> DataFrame | None:
        if not versions:
            return None
        by_batch: dict[int, list[int]] = {}
        for bucket, batch in versions.items():
            by_batch.setdefault(batch, []).append(bucket)
        # partition filters, so no other version is read
        parts = [(F.col("batch") == batch) & F.col("bucket").isin(some) for batch, some in by_batch.items()]
        return self.spark.read.parquet(f"{self.path}/rows").where(reduce(lambda a, b: a | b, parts)).drop("batch", "bucket")

    def read(self) -> DataFrame | None:
        """The table as of the last noted batch; None before the first."""
        return self._rows(self._versions())

    def unknown(self) -> DataFrame | None:
        """Rows whose keys were not known, once for each batch that had them."""
        return self.spark.read.parquet(f"{self.path}/unknown").drop("batch") if self._there("unknown") else None

    def merge(self, batch: DataFrame, number: int, known: DataFrame) -> None:
        """Merges a batch: keys of `known` into the table, the latest value of each; other rows to `unknown`. For foreachBatch.

        Null keys are unknown. Of equal `order` the greatest value counts.
        """
        columns = [self.key, self.value, *self.order]
        some = known.select(F.col(self.key).alias("__known")).distinct()
        said = batch.select(*columns).join(some, F.col(self.key) == F.col("__known"), "left").persist()
        try:
            said.where("__known is null").select(*columns).write.mode("overwrite").parquet(f"{self.path}/unknown/batch={number}")
            latest = lambda df: df.groupBy(self.key).agg(F.max_by(F.struct(*columns), F.struct(*self.order, self.value)).alias("__r")).select("__r.*")
            bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
            new = latest(said.where("__known is not null").select(*columns))
            touched = [r["bucket"] for r in new.select(bucket.alias("bucket")).distinct().collect()]  # `buckets` rows at most
            if not touched:
                return
            old = self._rows({b: v for b, v in self._versions(number).items() if b in set(touched)})
            merged = new if old is None else latest(old.select(*columns).unionByName(new))
            target = f"{self.path}/rows/batch={number}"
            merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
            self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/notes/batch={number}")
        finally:
            said.unpersist()

    def follow(self, stream: DataFrame, known: DataFrame) -> None:
        """Merges all that a stream has now; a second call goes on from there."""
        log = f"{self.path}-log"
        stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).foreachBatch(lambda df, i: self.merge(df, i, known)).start().awaitTermination()
