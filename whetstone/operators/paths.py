"""Shortest paths between many pairs of nodes at once, from both ends, and the tables that connect sets of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whetstone.sources.files import reread, scratch


def paths_between(edges: DataFrame, pairs: DataFrame, hops: int = 6) -> DataFrame:
    """(start, node, path, n): for each pair (start, node) the least text among its shortest directed paths of at most `hops` edges.

    A front grows from each distinct start and from each distinct node, however many pairs have it, one join with the edges a step, on the side
    where the fronts are smaller. A pair is met at the first step that brings its fronts together; ends without an open pair grow no
    further. A node that a front has visited is not visited again; of equally
    short ways to it the least text stays. A pair of a node with itself has the path of that node alone. Pairs without a path, with nulls or
    repeated come out not at all or once. Every front is written to the shared folder, so plans do not grow with the steps.
    """
    spark = edges.sparkSession
    e = reread(edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).dropna().where("src <> dst").distinct(), scratch(spark, "edges"))
    asked = pairs.select(F.col("start").cast("string").alias("start"), F.col("node").cast("string").alias("node")).dropna().distinct()
    found = asked.where("start = node").select("start", "node", F.col("start").alias("path"), F.lit(0).alias("n"))
    open_ = reread(asked.where("start <> node"), scratch(spark, "pairs"))
    pair, name = ["start", "node"], {"ahead": "start", "back": "node"}
    ends = lambda side: open_.select(F.col(name[side]).alias("end")).distinct()
    # at: where the front stands; path: the text from the start to it, or from it to the node
    front = {side: reread(ends(side).select("end", F.col("end").alias("at"), F.col("end").alias("path")), scratch(spark, "front")) for side in name}
    seen = dict(front)
    size = {side: front[side].count() for side in name}
    many = dict(size)
    for n in range(1, hops + 1):
        side, other = ("ahead", "back") if size["ahead"] <= size["back"] else ("back", "ahead")
        if not size[side]:
            break
        here, there, text = ("src", "dst", F.concat_ws(">", "path", "to")) if side == "ahead" else ("dst", "src", F.concat_ws(">", "to", "path"))
        step = front[side].join(e.select(F.col(here).alias("at"), F.col(there).alias("to")), "at").select("end", F.col("to").alias("at"), text.alias("path"))
        new = step.groupBy("end", "at").agg(F.min("path").alias("path")).join(seen[side].select("end", "at"), ["end", "at"], "left_anti")
        front[side] = new = reread(new, scratch(spark, "front"))
        seen[side] = seen[side].unionByName(new)
        size[side] = new.count()
        # the other front's last nodes are met first at their own distance, so the sum is the length of a shortest path
        of = {s: front[s].select(F.col("end").alias(name[s]), "at", F.col("path").alias(s)) for s in name}
        whole = F.concat("ahead", F.substr("back", F.length("at") + 1))
        # pairs take up the fronts that are smaller by end, and only these are multiplied by the pairs
        few, rest = ("ahead", "back") if size["ahead"] * many["back"] <= size["back"] * many["ahead"] else ("back", "ahead")
        met = open_.join(of[few], name[few]).join(of[rest], [name[rest], "at"])
        met = reread(met.groupBy(*pair).agg(F.min(whole).alias("path")).withColumn("n", F.lit(n)), scratch(spark, "met"))
        found = found.unionByName(met)
        open_ = reread(open_.join(met.select(*pair), pair, "left_anti"), scratch(spark, "pairs"))
        if open_.isEmpty():
            break
        front = {s: front[s].join(ends(s), "end", "left_semi") for s in name}
    return found


def set_pairs(sets: DataFrame) -> DataFrame:
    """(set, start, node): the pairs start < node of the distinct members of each set. Sets are those of one question: some tables each."""
    m = sets.dropna().distinct()
    return m.select("set", F.col("member").alias("start")).join(m.select("set", F.col("member").alias("node")), "set").where("start < node")


def connected(edges: DataFrame, sets: DataFrame, hops: int = 6) -> DataFrame:
    """(set, node, is_bridge): the members of each set and every node on a shortest path between two of them, in either direction of the edges.

    Each distinct pair is searched once, however many sets have it.
    """
    two_way = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    pairs = set_pairs(sets)
    paths = paths_between(two_way, pairs.select("start", "node"), hops)
    on = pairs.join(paths, ["start", "node"]).select("set", F.explode(F.split("path", ">")).alias("node"))
    members = sets.dropna().distinct().select("set", F.col("member").alias("node"), F.lit(False).alias("is_bridge"))
    every = members.unionByName(on.select("set", "node", F.lit(True).alias("is_bridge")))
    return every.groupBy("set", "node").agg(F.min("is_bridge").alias("is_bridge"))


def pair_hop_keys(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node, hop, src, dst, join_key) of each hop from 1; an edge without a key joins on '<src>.id'."""
    nodes = F.split("path", ">")
    hop = F.transform(F.sequence(F.lit(1), F.size(nodes) - 1), lambda i: F.struct(i.alias("hop"), F.element_at(nodes, i).alias("src"), F.element_at(nodes, i + 1).alias("dst")))
    flat = paths.where("n > 0").select("start", "node", F.inline(hop))
    return flat.join(edges.select("src", "dst", "join_key"), ["src", "dst"], "left").select("start", "node", "hop", "src", "dst", F.coalesce("join_key", F.concat("src", F.lit(".id"))).alias("join_key"))
