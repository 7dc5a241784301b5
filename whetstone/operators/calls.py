"""Batch calls of a function that may fail: retries with growing waits, halves down to the bad rows, and waves that are not done twice."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Calls of a batch, and seconds before the second one, doubled each time.
ATTEMPTS, WAIT = 3, 1.0


class Retry(Exception):
    """Raised by a function whose call may succeed later: only then is the same batch sent again."""


def settled(call: Callable[[list[str]], Sequence], texts: list[str], attempts: int = ATTEMPTS, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> list[tuple]:
    """(result, error) for each text: one of the two is None.

    A batch that raises Retry is sent again, up to `attempts` times; one that still fails, or raises anything else, is
    halved until the rows that fail are alone. Results of another number than the texts count as a failure.
    """
    error = None
    for attempt in range(attempts):
        try:
            got = list(call(texts))
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} results for {len(texts)} texts")
            return [(x, None) for x in got]
        except Retry as e:
            error = e
            if attempt + 1 < attempts:
                sleep(wait * 2**attempt)
        except Exception as e:  # noqa: BLE001
            error = e
            break
    if len(texts) <= 1:
        return [(None, f"{type(error).__name__}: {error}") for _ in texts]
    half = len(texts) // 2
    return settled(call, texts[:half], attempts, wait, sleep) + settled(call, texts[half:], attempts, wait, sleep)


def called(texts: DataFrame, call: Callable[[list[str]], Sequence], kind: T.DataType, batch: int = 2048, text_col: str = "text", attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """texts with `result` and `error`: `call` over batches of texts (null counts as empty) in each task."""
    schema = T.StructType([*texts.schema.fields, T.StructField("result", kind), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = settled(call, [t or "" for t in part[text_col].to_pylist()], attempts, wait)
                columns = [*part.columns, pa.array([None if x is None else list(x) if isinstance(kind, T.ArrayType) else x for x, _ in got], to_arrow_type(kind)), pa.array([e for _, e in got], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts.mapInArrow(run, schema)


def called_in_waves(texts: DataFrame, path: str, key: Column, waves: int, how: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`how(texts)`, wave by wave of keys, each written below `path`; a later call over the same texts does the missing waves only.

    A wave counts as done once Spark has committed it, so what a failed run had finished is kept and nothing is called twice for it. Each
    wave reads the input once.
    """
    spark = texts.sparkSession
    for w in range(waves):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/wave={w}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            how(texts.where(F.pmod(F.xxhash64(key), F.lit(waves)) == w)).write.mode("overwrite").parquet(f"{path}/wave={w}")
    return spark.read.parquet(path).drop("wave")


def hashed_embeddings(texts: DataFrame, dim: int = 256, text_col: str = "text") -> DataFrame:
    """texts with `embedding`: counts of hashed character 3-grams at unit length, all in the JVM. Shorter and null texts are zero."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    steps = PipelineModel([
        RegexTokenizer(inputCol="__text", outputCol="__chars", pattern="(?s).", gaps=False, toLowercase=True),
        NGram(n=3, inputCol="__chars", outputCol="__grams"),
        HashingTF(numFeatures=dim, inputCol="__grams", outputCol="__counts"),
        Normalizer(p=2.0, inputCol="__counts", outputCol="__unit"),
    ])
    made = steps.transform(texts.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))))
    return made.withColumn("embedding", vector_to_array("__unit", "float32")).drop("__text", "__chars", "__grams", "__counts", "__unit")
