"""Sharding by longest processing time: groups of equal texts, largest first, each to the least loaded shard.

The driver's heap takes a bounded list: the largest groups one by one, and all others in bundles, dealt by hash, of
which each is a small part of a shard. Where a table has no more groups than there are bundles, most bundles are single groups.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from whetstone.llm.common import durable

#: Bundles for each shard, and the groups that are placed by themselves, at most.
BUNDLES_PER_SHARD, LARGE = 400, 5_000
#: Parts of a shard that are numbered independently.
SLOT_PARTS = 256


def longest_first(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """{item: shard} for (item, size): the largest first, to the least loaded shard; ties by number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[item] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row; law is `bytes`, so grown_shard is null.

    A null text counts as empty and stays with empty texts. Null ids and repeated rows are rows like others; ties in size go by
    number. Texts of any length count whole. No rows give none; other columns are ignored and may have any names. Slots run
    from 0 without gaps in each shard: counts of hashed parts, summed, precede ranks within a part.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = durable(docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("g")))
    groups = durable(rows.groupBy("g").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    cut = total / (shards * 100)
    large = groups.where(F.col("bytes") >= cut).orderBy(F.desc("bytes"), "g").limit(LARGE)  # fewer than 100 * shards exist
    n = shards * BUNDLES_PER_SHARD
    bundle = F.pmod(F.col("g"), F.lit(n)).cast("long")
    small = groups.where(F.col("bytes") < cut).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    big = [(r["g"], r["bytes"]) for r in large.collect()]
    items = [(i, b) for i, (_, b) in enumerate(big)] + [(len(big) + r["bundle"], r["bytes"]) for r in small.collect()]
    placed = longest_first(items, shards)
    of_big = spark.createDataFrame([(g, placed[i]) for i, (g, _) in enumerate(big)], "g long, big_shard int")  # at most LARGE rows
    of_bundle = F.array(*[F.lit(0)]) if not items else F.lit("".join(chr(48 + placed.get(len(big) + b, 0)) for b in range(n)))
    at = (F.ascii(F.substring(of_bundle, F.pmod(F.col("g"), F.lit(n)).cast("int") + 1, F.lit(1))) - 48) if items else F.lit(0)
    named = rows.join(F.broadcast(of_big), "g", "left").withColumn("shard", F.coalesce("big_shard", at).cast("int")).withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_PARTS)))
    counts = named.groupBy("shard", "part").agg(F.count("*").alias("n"))
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1
    # at most shards * SLOT_PARTS rows
    return named.withColumn("rank", rank).join(F.broadcast(ahead), ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
