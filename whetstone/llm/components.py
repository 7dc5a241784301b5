"""Connected components by alternating large-star and small-star steps, all of it joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whetstone.llm.common import durable, join_hot, lean


def _forest(batches):
    """Spanning edges of the edges of one task: shrinks dense groups before any shuffle."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        if not len(a):
            continue
        names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = np.arange(len(names))
        x, y = at[: len(a)], at[len(a) :]
        while True:  # minimum labels with pointer jumping
            low = np.minimum(root[x], root[y])
            nxt = root.copy()
            np.minimum.at(nxt, root[x], low)
            np.minimum.at(nxt, root[y], low)
            nxt = nxt[nxt]
            if (nxt == root).all():
                break
            root = nxt
        away = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[away], pa.int64()), pa.array(names[root[away]], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge. Nulls and loops are left out.

    Each round halves the depth of every tree at least; rounds end when a whole round changes no edge.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    pairs = durable(pairs.mapInArrow(lean(_forest), "u long, v long").distinct())
    before = None
    while True:
        state = pairs.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
        if state == before or state["n"] == 0:
            break
        before = state
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = F.count_if(F.col("v") > F.col("u")).alias("n")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        # a hub has many rows: its minimum is broadcast; the plan computes `low` once
        large = join_hot(both.where("v > u"), low, ["u"], total=state["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        # a node has as many smaller neighbours as tasks held it at most: each task gave it one root
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        stars = small.join(least, "u")
        pairs = durable(stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    roots = pairs.select(F.col("v").alias("u")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
