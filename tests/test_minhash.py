"""MinHash signatures against brute force, and how often a value's grams are made for one."""

import re

from pyspark.sql import functions as F

from whetstone import registry
from whetstone.functions import text as X


def test_minhash_makes_grams_once(spark):
    words = [("abcdef",), ("ab",), ("",), ("aaaaaaa",), (None,), ("größer als",)]
    df = spark.createDataFrame(words, "value string").repartition(2)
    signed = df.select("value", X.minhash(X.grams(F.col("value")), 9).alias("m"))
    flat = df.select("value", F.explode(X.grams(F.col("value"))).alias("g")).crossJoin(spark.range(1, 10).select(F.col("id").cast("int").alias("s")))
    least = flat.groupBy("value", "s").agg(F.min(F.xxhash64("g", "s")).alias("h"))
    want = {r.value: [x.h for x in sorted(r.x, key=lambda x: x.s)] for r in least.groupBy("value").agg(F.collect_list(F.struct("s", "h")).alias("x")).collect()}
    got = {r.value: r.m for r in signed.collect()}
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}
    plan = signed._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" in plan
    assert "array_distinct" not in plan[plan.index("array_min") : plan.index("xxhash64")]  # not inside the function over the hashes


TEXTS = ["Größer ALS x, 42_b; größer", "東京 \n a1 été", "", None, "d377c9aa056ab85cf58c4e299cff1736db855bb1 abcdef"]


def test_every_word_is_signed(spark, tmp_path):
    """Words of any length and script have a signature, not only those of six ASCII letters or more."""
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [x.value for x in registry.queries()["t1_minhash_signatures"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted({w for t in TEXTS if t for w in re.findall(r"\w+", t.lower())})
