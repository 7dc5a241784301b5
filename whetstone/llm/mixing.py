"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source should be copied target / size times: a whole part that all get and a fractional rest. The
rests are rounded in pairs: mass (copy probability times size) moves at random from one document to the other until one
of the two is integral, so that each expectation and the source's total stay as they are. A node of the reduction tree
folds a bounded number of documents this way and passes its one fractional residual to the next level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whetstone.llm.common import WORD, durable

#: Documents or residuals that one node of the tree folds.
FAN_IN = 128
#: Below this a probability counts as 0, above one less this as 1.
EPS = 1e-12


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n, source_size, target): sources by code point, null last, weigh `weights` in turn.

    They share `share` times all sizes by weight; a target over `most` times its source's size is cut to that and the
    excess shared anew. In closed form: sorted by the level at which each source is cut, the common level is the first
    that is no higher than the next cut. One row a source, so the windows hold the list of sources only.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("sized"))
    every = Window.partitionBy(F.lit(0))
    ranked = per.withColumn("i", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("i") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    by_cut = every.orderBy(F.col("cap") / F.col("w"), "i")
    upto = by_cut.rowsBetween(Window.unboundedPreceding, -1)
    total = share * F.sum("source_size").over(every)
    left = F.greatest(F.lit(0.0), total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    rest = F.sum("w").over(by_cut.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", left / rest)
    fits = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "i", "level"))).over(every)["level"]
    return level.withColumn("target", F.least("cap", F.coalesce(fits * F.col("w"), F.col("cap")))).select("source", "n", "sized", "source_size", "target")


def _unit(*what: Column) -> Column:
    """A number from 0 to 1 that follows from its arguments: reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(*what), 11) / F.lit(float(1 << 53))


def _fold(items: Column, level: int, seed: int) -> Column:
    """Pairs the residual so far with each item in turn. Items: w, id, p, largest first, so that residuals get small. Gives (left: the residual, done: ids with 0 or 1)."""

    def step(acc, x):
        a, b = acc["left"], x
        move_a = F.least((1 - a["p"]) * a["w"], b["p"] * b["w"])  # mass that can go to a
        move_b = F.least(a["p"] * a["w"], (1 - b["p"]) * b["w"])
        to_a = _unit(F.lit(seed), F.lit(level), a["id"], b["id"]) * (move_a + move_b) < move_b
        pa = F.when(to_a, a["p"] + move_a / a["w"]).otherwise(a["p"] - move_b / a["w"])
        pb = F.when(to_a, b["p"] - move_a / b["w"]).otherwise(b["p"] + move_b / b["w"])
        whole = lambda p: F.when(p < EPS, F.lit(0.0)).when(p > 1 - EPS, F.lit(1.0)).otherwise(p)
        at = lambda y, p: F.struct(y["w"].alias("w"), y["id"].alias("id"), whole(p).alias("p"))
        moved = F.struct(at(a, pa).alias("a"), at(b, pb).alias("b"))

        def settle(m):
            stays = (m["a"]["p"] > 0) & (m["a"]["p"] < 1)
            return F.struct(F.when(stays, m["a"]).otherwise(m["b"]).alias("left"), F.concat(acc["done"], F.array(F.when(stays, m["b"]).otherwise(m["a"]))).alias("done"))

        return F.transform(F.array(moved), settle)[0]

    one = "struct<w:double,id:bigint,p:double>"
    return F.aggregate(F.slice(items, 2, FAN_IN), F.struct(items[0].cast(one).alias("left"), F.array().cast(f"array<{one}>").alias("done")), step)


def round_copies(docs: DataFrame, levels: int, seed: int = 20240229) -> DataFrame:
    """(source, id, extra): extra is 0 or 1. docs: source, id, p strictly between 0 and 1, w > 0. Null sources are one source."""
    live, settled = docs.select("source", F.col("id").cast("long"), F.col("p").cast("double"), F.col("w").cast("double")), None
    for level in range(levels):
        count = live.groupBy(F.col("source").alias("of")).agg(F.ceil(F.count("*") / (0.75 * FAN_IN)).alias("nodes"))
        # one node at the last level; else so many that each holds a bounded number
        node = F.lit(0) if level == levels - 1 else F.pmod(F.xxhash64(F.lit(seed + level), "id"), F.col("nodes"))
        placed = live.join(count, F.col("source").eqNullSafe(F.col("of"))).select("source", "id", "p", "w", node.alias("node"))
        # a node that chance fills beyond FAN_IN is cut into parts by rank; each part has a residual of its own
        rank = F.row_number().over(Window.partitionBy("source", "node").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
        parts = placed.withColumn("part", F.floor((rank - 1) / FAN_IN)).groupBy("source", "node", "part").agg(F.sort_array(F.collect_list(F.struct("w", "id", "p")), asc=False).alias("items"))
        folded = durable(parts.select("source", _fold(F.col("items"), level, seed).alias("x")))
        done = folded.select("source", F.explode("x.done").alias("y")).select("source", "y.id", F.col("y.p").cast("int").alias("extra"))
        live = folded.select("source", "x.left.*")
        whole = live.where("p <= 0 or p >= 1").select("source", "id", F.col("p").cast("int").alias("extra"))
        live = live.where("p > 0 and p < 1")
        done = done.unionByName(whole)
        settled = done if settled is None else settled.unionByName(done)
    last = live.select("source", "id", (F.col("p") >= 0.5).cast("int").alias("extra"))  # one a source: rounded to the nearer
    return last if settled is None else settled.unionByName(last)


def _numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, row): `row` is a hash of id, source, text and of the rank among rows equal in these.

    With `whole`, column `held` has the row as it was; rows equal in these are ranked by the rest of it.
    """
    size = F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    held = [F.struct(*(docs[c] for c in docs.columns)).alias("held")] if whole else []
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), size.alias("size"), F.xxhash64(docs[text_col]).alias("h"), *held)
    again = F.row_number().over(Window.partitionBy("doc_id", "source", "h").orderBy(F.xxhash64("held") if whole else "size"))
    return rows.withColumn("again", again).withColumn("row", F.xxhash64("doc_id", "source", "h", "again")).drop("h", "again")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken, row): how often the mix takes each row of documents.

    Null and empty texts have size 0 and take nothing; null is a source like others. Repeated rows are rows of their
    own: `row`, a hash of the row's columns and of its rank among equal ones, tells them apart. No rows, no result. Texts of any
    length are counted whole; other columns are ignored and may have any names.
    """
    sizes = durable(_numbered(docs, id_col, text_col, source_col).select("doc_id", "source", "size", "row"))
    targets = durable(source_targets(sizes, weights, share, most))
    most_docs = targets.agg(F.max("sized")).first()[0] or 0
    levels, nodes = 1, most_docs
    while nodes > FAN_IN // 2:
        nodes, levels = nodes // 48 + 1, levels + 1
    rated = sizes.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "row", "source", "size", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = rated.withColumn("whole", F.floor(rate + EPS)).withColumn("p", rate - F.col("whole"))
    open_ = rated.where((F.col("size") > 0) & (F.col("p") > EPS)).select("source", F.col("row").alias("id"), "p", F.col("size").cast("double").alias("w"))
    extra = durable(round_copies(open_, levels)).groupBy("id").agg(F.max("extra").alias("extra"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0)).cast("long")
    out = rated.join(extra.withColumnRenamed("id", "row"), "row", "left").withColumn("copies", copies)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "row")


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows of documents, each as often as the mix takes it, with all their columns, whatever their names.

    Repeated rows, rows without an id and texts that share an id are rows of their own. No rows give none.
    """
    counts = mix(docs).where("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
    rows = _numbered(docs, "doc_id", "text", "source", whole=True).select("row", "held")
    taken = rows.join(counts, "row").select("held", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("again"))
    return taken.select("held.*")
