"""A stored index for approximate nearest neighbours: two-level cells, product-quantised residuals, and exact re-ranking.

Vectors are scaled to length one. A cell is a pair of a centre and of a correction that all centres share, so K + K codewords name
K * K cells and the codebooks stay small while the number of cells follows the corpus. What remains of a vector is
kept as a byte for each part of its numbers. A search reads the codes of the cells nearest to a query, keeps a short list by
approximate cosines, and takes the order from the full vectors of that list only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whetstone.sources.files import reread, scratch

#: Rows that codebooks are fitted on, queries that the number of probed cells is measured on, rows of a cell that one task takes.
FIT_ROWS, CALIBRATION_ROWS, BLOCK = 40_000, 200, 20_000
#: Vectors that a cell should hold, codewords of a part, and numbers in a part.
PER_CELL, WORDS, PART = 64, 256, 4
#: Centres whose corrections are tried for a row.
BEAM = 8
#: Folders of codes.
FOLDERS = 64


@dataclass(frozen=True)
class Codebooks:
    coarse: np.ndarray  # K x d
    fine: np.ndarray  # K x d
    parts: np.ndarray  # m x words x PART, of the numbers filled up with zeros to m * PART
    probes: int

    @property
    def dim(self) -> int:
        return self.coarse.shape[1]

    def split(self, x: np.ndarray) -> np.ndarray:
        """n x m x PART: the parts of each row."""
        m = len(self.parts)
        return np.pad(x, ((0, 0), (0, m * PART - x.shape[1]))).reshape(len(x), m, PART)

    def cells(self, x: np.ndarray, most: int) -> np.ndarray:
        """Of each row the `most` cells nearest to it, the nearest first: coarse * K + fine."""
        norm = (self.coarse**2).sum(1)[:, None] + (self.fine**2).sum(1) + 2 * self.coarse @ self.fine.T
        most = min(most, norm.size)
        out = np.empty((len(x), most), np.int64)
        each = max(1, 4_000_000 // norm.size)
        for first in range(0, len(x), each):
            some = x[first : first + each]
            far = norm[None] - 2 * ((some @ self.coarse.T)[:, :, None] + (some @ self.fine.T)[:, None, :])
            far = far.reshape(len(some), -1)
            near = np.argpartition(far, most - 1, axis=1)[:, :most]
            order = np.lexsort((near, np.take_along_axis(far, near, 1)))
            out[first : first + each] = np.take_along_axis(near, order, 1)
        return out

    def own(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: the best correction of its nearest centres."""
        beam = min(BEAM, len(self.coarse))
        out, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        if not len(x):
            return out
        far = (self.coarse**2).sum(1) - 2 * x @ self.coarse.T
        tops = np.argpartition(far, beam - 1, axis=1)[:, :beam]
        tops.sort(axis=1)
        for t in tops.T:
            rest = x - self.coarse[t]
            to = (rest**2).sum(1)[:, None] + (self.fine**2).sum(1) - 2 * rest @ self.fine.T
            fine = to.argmin(1)
            d = to[np.arange(len(x)), fine]
            nearer = d < best
            out[nearer], best[nearer] = (t * len(self.fine) + fine)[nearer], d[nearer]
        return out

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.fine)] + self.fine[cell % len(self.fine)]

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """n x m bytes: the nearest codeword of each part of what the cell leaves."""
        rest = self.split(x - self.centre(cell))
        out = np.empty(rest.shape[:2], np.uint8)
        for j, words in enumerate(self.parts):
            out[:, j] = ((words**2).sum(1) - 2 * rest[:, j] @ words.T).argmin(1)
        return out


def _unit(df: DataFrame) -> DataFrame:
    e = df.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.withColumn("n", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))).where("n > 0 and n < double('inf')").select("vec_id", F.transform("e", lambda x: x / F.col("n")).alias("e"))


def _means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means from rows at even steps; a centre without rows stays."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def fitted(sample: np.ndarray, rows: int, recall: float, k: int) -> Codebooks:
    """Codebooks for a corpus of `rows` from a sample of unit vectors. More cells for more rows, up to what the sample can fit.

    probes: the least number of cells in which `recall` of the k nearest others of some sample rows lie; no row counts
    as its own neighbour.
    """
    n, d = sample.shape
    side = max(1, min(math.ceil(math.sqrt(rows / PER_CELL)), n // 16 or 1))
    coarse = _means(sample, side)
    near = ((coarse**2).sum(1) - 2 * sample @ coarse.T).argmin(1)
    fine = _means(sample - coarse[near], side)
    m = -(-d // PART)
    books = Codebooks(coarse, fine, np.zeros((m, 1, PART)), 1)
    cell = books.own(sample)
    rest = books.split(sample - books.centre(cell))
    words = max(1, min(WORDS, n // 4))
    books = Codebooks(coarse, fine, np.stack([_means(rest[:, j], words) for j in range(m)]), 1)
    asked = np.linspace(0, n - 1, min(n, CALIBRATION_ROWS)).astype(int)
    s = sample[asked] @ sample.T
    s[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-s, axis=1, kind="stable")[:, : min(k, n - 1)]
    order = books.cells(sample[asked], side * side)
    place = np.argsort(order, axis=1)  # of each cell in a query's order
    deep = np.take_along_axis(place, cell[true], 1) if true.size else np.zeros((1, 1), int)
    return Codebooks(coarse, fine, books.parts, int(np.quantile(deep, recall, method="higher")) + 1)


def build(corpus: DataFrame, path: str, recall: float = 0.95, k: int = 10) -> None:
    """Writes the index of (vec_id, embedding) rows below `path`: codebooks, codes by cell, full vectors. Null, zero and infinite vectors are left out.

    Codebooks are fitted on FIT_ROWS rows at most, chosen by the hash of their ids; every row is coded and indexed. All vectors must
    have one length.
    """
    spark = corpus.sparkSession
    unit = reread(_unit(corpus), f"{path}/vectors")
    rows = unit.count()
    sample = unit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).collect()  # bounded: FIT_ROWS
    d = len(sample[0]["e"]) if sample else 1
    books = fitted(np.array([r["e"] for r in sample]).reshape(-1, d), rows, recall, k) if sample else Codebooks(np.zeros((1, d)), np.zeros((1, d)), np.zeros((1, 1, PART)), 1)
    held = [("coarse", i, 0, v.tolist()) for i, v in enumerate(books.coarse)] + [("fine", i, 0, v.tolist()) for i, v in enumerate(books.fine)]
    held += [("part", j, i, v.tolist()) for j, words in enumerate(books.parts) for i, v in enumerate(words)] + [("probes", books.probes, 0, [])]
    spark.createDataFrame(held, "kind string, i int, j int, v array<double>").coalesce(1).write.parquet(f"{path}/codebooks")

    def run(batches):
        for b in batches:
            x = b["e"].flatten().to_numpy(zero_copy_only=False).reshape(-1, books.dim)
            cell = books.own(x)
            codes = books.codes(x, cell)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array(cell, pa.int64()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "cell", "code"])

    coded = unit.mapInArrow(run, "vec_id long, cell long, code binary").withColumn("folder", F.pmod(F.xxhash64("cell"), F.lit(FOLDERS)).cast("int"))
    coded.repartition("folder", F.pmod(F.xxhash64("vec_id"), F.lit(4))).sortWithinPartitions("folder", "cell").write.partitionBy("folder").parquet(f"{path}/codes")


def _codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id long, cell long, code binary, folder int").parquet(f"{path}/codes")


def codebooks(spark: SparkSession, path: str) -> Codebooks:
    """The stored codebooks, whose size does not follow the corpus beyond that of the fit."""
    rows = spark.read.parquet(f"{path}/codebooks").collect()
    of = lambda kind: [r for r in sorted(rows, key=lambda r: (r["i"], r["j"])) if r["kind"] == kind]
    parts = of("part")
    m = parts[-1]["i"] + 1
    return Codebooks(np.array([r["v"] for r in of("coarse")]), np.array([r["v"] for r in of("fine")]), np.array([r["v"] for r in parts]).reshape(m, -1, PART), of("probes")[0]["i"])


def search(queries: DataFrame, path: str, k: int, shortlist: int = 20, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest found, by exact cosine; a row is no neighbour of itself.

    A query reads `probes` cells (calibrated where none is given) and takes `shortlist * k` rows from them to their full vectors. A cell of
    more than BLOCK rows is dealt to several tasks.
    """
    spark = queries.sparkSession
    books = codebooks(spark, path)
    probes = min(probes or books.probes, len(books.coarse) * len(books.fine))
    take = shortlist * k

    def run(batches):
        for b in batches:
            near = books.cells(b["e"].flatten().to_numpy(zero_copy_only=False).reshape(-1, books.dim), probes)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["e"], pa.array(list(near), pa.list_(pa.int64()))], names=["query_id", "q", "cells"])

    asked = reread(_unit(queries).mapInArrow(run, "query_id long, q array<double>, cells array<long>"), scratch(spark, "asked"))
    codes = _codes(spark, path)
    sizes = reread(codes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), scratch(spark, "sizes"))
    wanted = asked.select("query_id", "q", F.explode("cells").alias("cell")).join(sizes, "cell")
    left = wanted.select("query_id", "q", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = wanted.select("cell", "blocks").distinct()
    folders = [r["f"] for r in cells.select(F.pmod(F.xxhash64("cell"), F.lit(FOLDERS)).cast("int").alias("f")).distinct().collect()]  # FOLDERS at most
    right = codes.where(F.col("folder").isin(folders)).join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).select("vec_id", "code", "cell", "block")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            q = left["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(left), -1)
            ids, asks = right["vec_id"].to_numpy(), left["query_id"].to_numpy()
            code = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            base = q @ books.centre(np.array([left["cell"][0].as_py()]))[0]
            tables = np.einsum("njp,jwp->njw", books.split(q), books.parts)  # what each codeword of each part adds to the cosine
            for i, at in enumerate(asks.tolist()):
                s = base[i] + tables[i][np.arange(code.shape[1]), code].sum(1)
                s[ids == at] = -np.inf
                some = np.argpartition(-s, take - 1)[:take] if len(s) > take else np.arange(len(s))
                some = some[s[some] > -np.inf]
                out.append((np.full(len(some), at), ids[some], s[some]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "about"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    about = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(scan, "query_id long, vec_id long, about double")
    w = Window.partitionBy("query_id").orderBy(F.desc("about"), "vec_id")
    short = about.withColumn("r", F.row_number().over(w)).where(F.col("r") <= take).select("query_id", "vec_id")
    full = short.join(spark.read.parquet(f"{path}/vectors"), "vec_id").join(asked.select("query_id", "q"), "query_id")
    cosine = F.aggregate(F.zip_with("e", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return full.select("query_id", "vec_id", cosine.alias("similarity")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def read_bytes(spark: SparkSession, path: str, probes: int | None = None) -> float:
    """Bytes of codes and ids that a query reads on average, where all cells are as likely: what `search` takes from the index before its short list."""
    books = codebooks(spark, path)
    rows = _codes(spark, path).count()
    cells = len(books.coarse) * len(books.fine)
    return rows * min(1.0, (probes or books.probes) / cells) * (8 + len(books.parts))
