"""Shared helpers: durable intermediate tables, text buffers as numpy arrays, rolling hashes and packed shuffles."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are hashed in slices of about this many bytes; a longer document is a slice of its own.
SLICE_BYTES = 800_000
#: Rows that a map task gathers before it writes packed blobs.
FLUSH_ROWS = 1_200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without one: it gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.conf.get("spark.whetstone.scratch", None)
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set("spark.whetstone.scratch", named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/whetstone-{uuid.uuid4().hex}"
    held = _SCOPE.get()
    if held is not None:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The paths written inside the innermost `intermediates` of this thread or task.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("intermediates", default=None)


@contextlib.contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what `durable` wrote inside it, and nothing that was written outside or by other threads.

    Results that are still lazy must be written before the end.
    """
    held: list[str] = []
    outer = _SCOPE.set(held)
    try:
        yield held
    finally:
        _SCOPE.reset(outer)
        for name in held:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_hot(rows: DataFrame, per: DataFrame, keys: list[str], n: str = "n", total: int | None = None, hot: int = 200) -> DataFrame:
    """rows joined with the one row that `per` has for each key and that counts in `n` how many rows have the key.

    Keys with one of `hot` parts of all rows or more are `hot` at most, so theirs are broadcast and no task gets such a
    key whole; all others are shuffled. Both sides are read twice, so they should be durable.
    """
    total = per.agg(F.sum(n)).first()[0] or 0 if total is None else total
    heavy = F.broadcast(per.where(F.col(n) * hot >= total))  # at most `hot` rows
    light = rows.join(heavy.select(*keys), keys, "left_anti").join(per.where(F.col(n) * hot < total), keys)
    return rows.join(heavy, keys).drop(n).unionByName(light.drop(n))


def keyed(docs: DataFrame, id_col: str, text_col: str, rows: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) of the rows with an id, where ids stand for one text each, and the (doc_id, named) of such ids, if new.

    Where an id has different texts, new ids number the distinct pairs of id and text in their order; equal rows share one.
    With `rows`, column `row` holds the row as it was.
    """
    held = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if rows else []
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"), *held).where("doc_id is not null")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # reads no text
        return docs, None
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    if hashed.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").isEmpty():
        return docs, None
    # partitions of a sorted table are in order, and so are these numbers
    ids = durable(hashed.distinct().orderBy("doc_id", "h").withColumnRenamed("doc_id", "named").withColumn("doc_id", F.monotonically_increasing_id()))
    both = docs.withColumnRenamed("doc_id", "named").withColumn("h", F.xxhash64("text")).join(ids, ["named", "h"])
    return durable(both.select("doc_id", "text", *(["row"] if rows else []))), ids.select("doc_id", "named")


def renamed(rows: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """rows with the ids that `keyed` gave in `columns` as they were."""
    for c in columns if names is not None else ():
        rows = rows.join(names.withColumnRenamed("doc_id", c), c).drop(c).withColumnRenamed("named", c)
    return rows


def numbered(rows: DataFrame, order: list, within: str | None = None, name: str = "i") -> DataFrame:
    """rows with their place from 0 in `order`, within equal values of `within` (nulls are one value) if given.

    A global sort by ranges; each partition's count then precedes the places of the next, so no task ranks more rows than it
    sorts. Rows equal in `order` are told apart by where they were read.
    """
    first = [F.col(within).asc_nulls_first()] if within else []
    held = rows.withColumn("__tie", F.monotonically_increasing_id()).orderBy(*first, *order, "__tie").drop("__tie")
    held = durable(held.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    key = [F.col(within).alias("__of")] if within else [F.lit(None).cast("string").alias("__of")]
    per = held.groupBy("__part", *key).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))  # a row for each partition and value
    before = Window.partitionBy("__of").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per.withColumn("__ahead", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumnRenamed("__part", "__in")
    same = (F.col("__part") == F.col("__in")) & (F.col(within).eqNullSafe(F.col("__of")) if within else F.lit(True))
    place = (F.col("__ahead") + F.col("__at") - F.col("__first")).cast("long")
    return held.join(ahead, same).withColumn(name, place).drop("__part", "__at", "__of", "__in", "__first", "__n", "__ahead")


def buckets(spark: SparkSession, each: int = 4) -> int:
    """How many key ranges a packed shuffle deals to: a multiple of the shuffle partitions, so that it follows the cluster."""
    return max(16, each * int(spark.conf.get("spark.sql.shuffle.partitions")))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_BASE = 0x5851F42D4C957F2D
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(max(n, SLICE_BYTES + 1024), base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Rolling:
    """64-bit polynomial hashes of any spans of one byte buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.prefix[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[end] - self.prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as its bytes and offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str, each: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts hold about `each` bytes: rows, bytes, offsets."""
    data, at = raw(batch.column(text))
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + each, "right")) - 1)
        yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def whole(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A string array of its own for what `slices` gives: some Arrow kernels misread arrays that are slices of others."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_LOWER = _FOLD.copy()
_LOWER[65:91] += 32


class Words:
    """The words of several texts: bytes with every white-space run made one space, and each word's span and text number."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = True):
        folded = (_LOWER if lower else _FOLD)[data]
        n, texts = len(folded), len(at) - 1
        begins = np.zeros(n + 1, bool)
        begins[at] = True
        solid = folded != 0x20
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
        new = solid & (~before | begins[:n])
        number = np.cumsum(new) - 1  # of the word that each solid byte belongs to
        words = int(number[-1]) + 1 if n else 0
        kept = np.flatnonzero(solid)
        owner = number[kept]
        self.data = np.full(len(kept) + words, 0x20, np.uint8)
        place = np.arange(len(kept)) + owner
        self.data[place] = folded[kept]
        lengths = np.bincount(owner, minlength=words) if words else np.zeros(0, np.int64)
        self.end = np.cumsum(lengths + 1) - 1
        self.start = self.end - lengths
        self.first = np.searchsorted(np.flatnonzero(new), at)  # index of each text's first word
        self.text = np.repeat(np.arange(texts), np.diff(self.first))


def shingles(data: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text and their offsets by text; a shorter text is one shingle, no words none."""
    w = Words(data, at)
    count = np.diff(w.first)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), n)
    begin = w.first[:-1][text] + (np.arange(len(text)) - (np.cumsum(n) - n)[text])
    last = np.minimum(begin + k, w.first[1:][text]) - 1
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    h = Rolling(w.data).spans(w.start[begin], w.end[last])
    edge = np.cumsum(n).tolist()
    for a, b in zip([0, *edge], edge, strict=False):  # a direct sort of each text's hashes is far faster than one indirect sort
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(at)))


def task_pairs(task: np.ndarray, side: np.ndarray, inside: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of rows of one task, in pieces, from rows sorted by task: all of a block with itself (inside), else of either side."""
    edge = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
    size = np.diff(np.concatenate((edge, [len(task)])))
    few = np.repeat(size <= 16, size)
    for off in range(1, min(16, int(size.max(initial=1)))):  # small tasks all at once
        x = np.flatnonzero((task[off:] == task[:-off]) & few[off:])
        x = x[inside[x] | (side[x] != side[x + off])]
        yield x, x + off
    for e, s in zip(edge[size > 16].tolist(), size[size > 16].tolist(), strict=True):
        rows = np.arange(e, e + s)
        left, right = (rows, rows) if inside[e] else (rows[side[rows] == 0], rows[side[rows] == 1])
        for begin in range(0, len(left), 16):
            x, y = np.repeat(left[begin : begin + 16], len(right)), np.tile(right, len(left[begin : begin + 16]))
            ok = x < y if inside[e] else slice(None)
            yield x[ok], y[ok]


def packed(bucket: np.ndarray, rows: np.ndarray, into: dict[int, list[bytes]] | None = None) -> Iterator[tuple[int, bytes]]:
    """Rows of a structured array as one blob for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for b, part in zip(bucket[np.concatenate(([0], cuts))] if len(bucket) else [], np.split(rows, cuts), strict=False):
        yield int(b), part.tobytes()


def unpacked(blobs: pa.ChunkedArray | pa.Array, kind: np.dtype) -> np.ndarray:
    """The rows of all blobs of a column."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def lean(run):
    """A function of batches after whose last one Arrow's pool gives back what it keeps: idle workers stay beside later stages with all they hold."""

    def out(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return out


def text_column(df: DataFrame, name: str):
    return F.coalesce(df[name].cast("string"), F.lit(""))
