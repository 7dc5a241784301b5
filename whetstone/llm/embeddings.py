"""Embedding near-dedup by projections on random lines and collisions on them.

The method as named, windows around every query on every sorted line and a count for each pair, has no selective window: on one line
two vectors at cosine 0.95 are found with probability 0.98 only by a window that holds 40 % of all rows (README). So no line is
sorted and no window is looked up for candidates; a line speaks for the vectors that lie farthest out on it.

Vectors are projected on LINES fixed random lines. A window around a query is selective where the sorted line is thin, so each vector queries the lines on which it lies farthest out only,
`outer` of them: there its window, REACH deviations of two vectors at the least similarity, holds few others. A pair's
count is the number of lines on which both lie in each other's window. Pairs that count `least` lines or more meet in a
key made of `least` of their lines, so counting is an equi-join on such keys and nothing is compared by itself.
`outer` and `least` are calibrated by simulated pairs at the least similarity for the wanted recall, and `least` grows
with the number of vectors so that pairs which meet by chance stay few for each vector. The lines do not follow the data,
so the recall holds for any; vectors that crowd in few directions only make larger groups.

A pair that shares more lines than `least` is taken under its first ones only, hence once. Members of a key are compared
in blocks of bounded size, in double precision; tasks return counts and spanning links, never all pairs.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whetstone.llm import common as C
from whetstone.llm.components import components

#: Lines, the recall wanted at the least similarity itself, and chance meetings a vector may have.
LINES, RECALL, CHANCE = 1024, 0.985, 4
#: Half a window, in deviations of the difference of two vectors at the least similarity.
REACH = 4.0
#: Vectors in a block, and about how many rows a task takes.
BLOCK, TASK_ROWS = 2048, 40_000


@cache
def _lines(dim: int) -> np.ndarray:
    return np.random.default_rng(7919 + dim).standard_normal((dim, LINES))


def _outermost(z: np.ndarray, outer: int) -> np.ndarray:
    """For each row the signed numbers of the lines on which it lies farthest out, in order."""
    far = np.argpartition(-np.abs(z), outer - 1, axis=1)[:, :outer]
    side = np.take_along_axis(z, far, 1) > 0
    return np.sort(2 * far + side, axis=1).astype(np.uint16)


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which entries of x's rows are in y's rows."""
    return (x[:, :, None] == y[:, None, :]).any(2)


@cache
def calibrated(n: int, dim: int, similarity: float) -> tuple[int, int, int]:
    """(lines, outer, least) for n vectors: the least count whose chance meetings are few, with the fewest outer lines that
    give the recall. Short vectors have few directions, so where no such count exists fewer lines are drawn."""
    r = np.random.default_rng(13)
    a = r.standard_normal((4000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e = r.standard_normal((4000, dim))
    e -= (e * a).sum(1, keepdims=True) * a
    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
    p, q = a @ _lines(dim), (similarity * a + sqrt(max(0.0, 1 - similarity**2)) * e) @ _lines(dim)
    near = np.abs(p - q) <= _reach(similarity)
    for lines in (LINES, 256, 64, 16, 4, 1):
        found = None
        for least in range(2 if lines > 16 else 1, 7):
            for outer in range(least, min(16, lines) + 1):
                x = _outermost(p[:, :lines], outer)
                hit = _shared(x, _outermost(q[:, :lines], outer)) & np.take_along_axis(near, (x // 2).astype(np.int64), 1)
                if (hit.sum(1) >= least).mean() >= RECALL:
                    break
            else:
                break
            found = lines, outer, least
            if n * comb(outer, least) ** 2 <= CHANCE * comb(lines, least) * 2**least:
                break
        if found:
            return found
    return 1, 1, 1


def _reach(similarity: float) -> float:
    return REACH * sqrt(max(0.0, 2 - 2 * similarity))


def _key(lines: np.ndarray) -> np.ndarray:
    """The key of each row of line numbers, in their order."""
    h = np.full(len(lines), lines.shape[1], np.uint64)
    for c in range(lines.shape[1]):
        h = C.mixed(h * np.uint64(0x9E3779B97F4A7C15) + lines[:, c].astype(np.uint64) + np.uint64(1))
    return h.view(np.int64)


def _valid(batches):
    """Vectors as bytes of doubles; those that are null, zero or have null or non-finite components have none."""
    for batch in batches:
        ids, out, dims = batch["vec_id"], [], []
        for v in batch["embedding"]:
            x = np.array(v.as_py(), np.float64) if v.is_valid and None not in v.as_py() else np.zeros(0)
            good = len(x) and np.isfinite(x).all() and x.any()
            out.append(x.tobytes() if good else None)
            dims.append(len(x) if good else 0)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "vector"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _of_dim(batch: pa.RecordBatch):
    """The rows of each length of vectors: their places and unit vectors."""
    dim = batch["dim"].to_numpy(zero_copy_only=False)
    for d in np.unique(dim).tolist():
        at = np.flatnonzero(dim == d)
        yield d, at, _unit(np.frombuffer(b"".join(batch["vector"][i].as_py() for i in at.tolist()), np.float64).reshape(-1, d))


def _keys(scale):
    def run(batches):
        for batch in batches:
            for d, at, x in _of_dim(batch):
                lines, outer, least = scale[d]
                top = _outermost(x @ _lines(d)[:, :lines], outer)
                chosen = list(combinations(range(outer), least))
                key = np.stack([_key(top[:, list(c)]) for c in chosen], 1).ravel()
                tops = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * outer), len(at), [None, pa.py_buffer(np.ascontiguousarray(top).tobytes())]).cast(pa.binary())
                each = pa.array(np.repeat(np.arange(len(at)), len(chosen)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), d), pa.int32()), pa.array(key), batch["rid"].take(pa.array(at)).take(each), tops.take(each)], names=["dim", "key", "rid", "top"])

    return run


def _stars(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        nxt = root.copy()
        np.minimum.at(nxt, root[x], low)
        np.minimum.at(nxt, root[y], low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            at = np.flatnonzero(root != np.arange(n))
            return at, root[at]
        root = nxt


def _compare(similarity, scale):
    def one(table: pa.Table, d: int) -> pa.Table:
        _, outer, least = scale[d]
        key, rid, copies, side, inside = (table[c].to_numpy() for c in ("key", "rid", "copies", "side", "inside"))
        task = table["task"].to_numpy()
        order = np.argsort(task, kind="stable")
        key, rid, copies, side, inside, task = (v[order] for v in (key, rid, copies, side, inside, task))
        unit = _unit(np.frombuffer(b"".join(table["vector"].to_pylist()), np.float64).reshape(-1, d))[order]
        top = np.frombuffer(b"".join(table["top"].to_pylist()), np.uint16).reshape(-1, outer)[order]
        place = np.empty(top.shape)  # of each row on its own lines
        for i in range(0, len(top), 4096):
            place[i : i + 4096] = np.take_along_axis(unit[i : i + 4096] @ _lines(d), (top[i : i + 4096] // 2).astype(np.int64), 1)
        names, at = np.unique(rid, return_inverse=True)
        links, xs, ys = np.zeros(len(names), np.int64), [], []
        for x, y in C.task_pairs(task, side, inside):
            for begin in range(0, len(x), 1 << 15):
                a, b = x[begin : begin + (1 << 15)], y[begin : begin + (1 << 15)]
                good = (key[a] == key[b]) & (np.einsum("ij,ij->i", unit[a], unit[b]) >= similarity)
                a, b = a[good], b[good]
                # lines on which both lie in the other's window; the pair belongs to the key of the first of them
                hit = ((top[a][:, :, None] == top[b][:, None, :]) & (np.abs(place[a][:, :, None] - place[b][:, None, :]) <= _reach(similarity))).any(2)
                enough = hit.sum(1) >= least
                a, b, hit = a[enough], b[enough], hit[enough]
                first = top[a][hit & (np.cumsum(hit, axis=1) <= least)].reshape(-1, least)
                own = _key(first) == key[a]
                xs.append(at[a[own]])
                ys.append(at[b[own]])
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
        many = np.zeros(len(names), np.int64)
        many[at] = copies
        np.add.at(links, x, many[y])
        np.add.at(links, y, many[x])
        a, b = _stars(x, y, len(names))
        some = np.flatnonzero(links)
        return pa.table({"a": pa.array(np.concatenate((names[a], names[some])), pa.int64()), "b": pa.array(np.concatenate((names[b], names[some])), pa.int64()), "links": pa.array(np.concatenate((np.zeros(len(a), np.int64), links[some])), pa.int64())})

    return lambda table: one(table, table["dim"][0].as_py())


def near_vectors(vectors: DataFrame, similarity: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each vector, by cosine similarity in double precision.

    Vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different lengths
    do not link. Rows without an id are left out; a row repeated whole counts once. Different vectors of one id are rows
    of their own, each with its own links; no rows give none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("embedding")).where("vec_id is not null")
    rows = C.durable(rows.mapInArrow(_valid, "vec_id long, dim int, vector binary").distinct())
    reps = C.durable(rows.where("dim > 0").groupBy("dim", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")).withColumn("rid", F.monotonically_increasing_id()))
    # a row for each length of vectors
    scale = {r["dim"]: calibrated(1 << max(20, (r["n"] - 1).bit_length()), r["dim"], similarity) for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect()}

    keys = C.durable(reps.mapInArrow(_keys(scale), "dim int, key long, rid long, top binary"))
    # members of a key come in blocks, and two blocks at a time to a task
    met = C.durable(keys.groupBy("dim", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK)))
    live = C.join_hot(keys, met, ["dim", "key"]).withColumn("block", F.pmod(F.xxhash64("rid", F.lit(3)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = live.select("*", other.alias("other")).select("dim", "key", "rid", "top", (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("inside"), F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task"))
    n_dealt = met.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    parts = max(16, n_dealt // TASK_ROWS)
    full = C.durable(dealt).join(reps.select("rid", "vector", "copies"), "rid")
    out = C.durable(full.groupBy("dim", F.pmod("task", F.lit(parts)).alias("part")).applyInArrow(_compare(similarity, scale), "a long, b long, links long"))

    counts = out.where("links > 0").groupBy(F.col("a").alias("rid")).agg(F.sum("links").alias("links"))
    classes = components(out.where("links = 0").select("a", "b")).withColumnRenamed("node", "rid")
    named = C.durable(reps.select("rid", "dim", "vector", "first", "copies").join(counts, "rid", "left").join(classes, "rid", "left").withColumn("component", F.coalesce("component", "rid")))
    least = C.durable(named.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n")))
    info = C.durable(C.join_hot(named, least, ["component"]).select("dim", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.col("copies").alias("n")))
    sound = C.join_hot(rows.where("dim > 0"), info, ["dim", "vector"]).select("vec_id", "n_links", "component_id")
    every = sound.unionByName(rows.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return every.withColumn("kept", F.col("component_id") == F.col("vec_id"))
