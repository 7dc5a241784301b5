"""Groups of candidates: stars first, then the members that are still apart, in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whetstone.llm.common import durable, join_hot

#: Members in a block, and about how many rows a task takes.
BLOCK, TASK_ROWS = 512, 20_000
#: Members that one row holds.
PIECE = 1024


def still_apart(lists: DataFrame, classes: DataFrame) -> tuple[DataFrame, int]:
    """Rows of tasks for the members of groups that are not all in one component, and how many parts to deal them to.

    lists: (g, doc) and more; classes: (node, component). Adds comp, task, side and inside (as `task_pairs` reads them).
    The members of a group's largest component are compared with the others only, not among themselves.
    """
    named = durable(lists.join(classes.select(F.col("node").alias("doc"), F.col("component").alias("comp")), "doc", "left").withColumn("comp", F.coalesce("comp", "doc")))
    per = named.groupBy("g", "comp").agg(F.count("*").alias("n"))
    mixed = per.groupBy("g").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("main")).where("comps > 1")
    mixed = durable(mixed.select("g", "n", F.col("main.comp").alias("main"), F.ceil(F.col("main.n") / BLOCK).alias("most"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("rest")))
    open_ = join_hot(named, mixed, ["g"])
    own = F.col("comp") == F.col("main")
    spread = F.pmod(F.xxhash64("doc", F.lit(5)), F.when(own, F.col("most")).otherwise(F.col("rest")))
    block = F.when(own, F.col("rest") + spread).otherwise(spread)  # blocks of the others come first
    others = F.sequence(F.lit(0).cast("long"), F.when(own, F.col("rest")).otherwise(F.col("rest") + F.col("most")) - 1)
    dealt = open_.withColumn("block", block).withColumn("other", F.explode(others))
    dealt = dealt.withColumns({"task": F.xxhash64("g", F.least("block", "other"), F.greatest("block", "other")), "side": (F.col("block") > F.col("other")).cast("int"), "inside": F.col("block") == F.col("other")})
    rows = mixed.agg(F.sum(F.col("n") * F.col("rest") + F.col("n") * F.col("most"))).first()[0] or 0
    return dealt.drop("main", "most", "rest", "block", "other"), max(16, rows // TASK_ROWS)


def join_lists(found: DataFrame, *more: str) -> DataFrame:
    """(g, doc, choice, ...) from rows of g, members and further lists beside the members; choice is the least bucket of equal lists."""
    zipped = F.explode(F.arrays_zip("members", *more)).alias("x")
    lists = found.where("kind = 1").groupBy("g", "members", *more).agg(F.min("bucket").alias("choice"))
    return lists.select("g", "choice", zipped).select("g", "choice", F.col("x.members").alias("doc"), *(F.col(f"x.{c}").alias(c) for c in more))
