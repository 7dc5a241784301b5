"""Fuzzy line dedup: lines that say nearly the same anywhere in the corpus stay once.

Lines are normalised (ASCII letters in lower case, digits as 0, white space as one space); equal ones share a 128-bit
hash. A line's signature is BLOCKS bytes, each from the word whose hash is least in an order of the block's own: a minimum
hash cut to a byte. It stands where the method asks for a SimHash and a pigeonhole join, which cannot find these lines
at a bearable cost (README): with equal weights near lines differ in 6 of 64 bits in the median and in 9 at the ninth decile, so blocks that a pair is
certain to share would be 6 bits long. Near lines have most bytes in common: they are joined on choices of bytes, the same
choices whatever the number of lines, so that two lines meet or not by themselves, and so many that the wanted share of pairs
meets. That share is a probability and no certainty. Pairs with enough equal bytes
are verified by edit similarity. Groups are linked as stars first; members that are still apart are then compared
in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whetstone.llm import common as C
from whetstone.llm.components import components
from whetstone.llm.groups import join_lists, still_apart
from whetstone.llm.jaccard import _FOUND, _distinct, _found

#: Edit similarity in hundredths.
PERCENT = 90
#: Blocks of a signature, and how many of them near lines have in common at least. On sf0.01 no near pair has fewer than 17.
BLOCKS, EQUAL = 24, 12
#: Blocks of a key. Unlike lines agree in one block of 80, so keys stay selective up to some 80^5 = 3 * 10^9 lines.
EACH = 6
#: Share of pairs that are to meet in some key among those with the share ALIKE of equal blocks.
MEET, ALIKE = 0.99, 0.8
#: Counters of pairs of neighbours that a line has.
GRAMS = 512
#: Pairs, and bytes of their texts, that a worker codes and compares at once, and documents that it cuts at once, whatever the batches hold.
PIECE_PAIRS, PIECE_BYTES, PIECE_DOCS = 2048, 1_000_000, 256
_TIMES = C.mixed(np.arange(1, BLOCKS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_DIGITS = np.arange(256, dtype=np.uint8)
_DIGITS[48:58] = 48
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _normal(data: np.ndarray, at: np.ndarray):
    """Of a slice of texts: the line starts, the words of the lines, and per line its text, place in it, and bytes' span."""
    breaks = np.flatnonzero(data == 0x0A) + 1
    texts = np.arange(len(at) - 1)
    begins = np.concatenate((at[:-1], breaks))
    owner = np.concatenate((texts, np.searchsorted(at, breaks - 1, "right") - 1))
    order = np.lexsort((np.concatenate((np.zeros(len(texts), int), np.ones(len(breaks), int))), begins, owner))
    begins, owner = begins[order], owner[order]
    w = C.Words(_DIGITS[data], np.concatenate((begins, [len(data)])))
    number = np.arange(len(owner)) - np.searchsorted(owner, owner)
    some = np.diff(w.first) > 0
    start = np.zeros(len(owner), np.int64)
    end = np.zeros(len(owner), np.int64)
    if len(w.start):
        start[some], end[some] = w.start[w.first[:-1][some]], w.end[w.first[1:][some] - 1]
    return w, owner, number, start, end


def _signature(word: np.ndarray, first: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """BLOCKS bytes of each of the lines, which have words: of each block a byte of its least word. A word's rank in a block is its hash times an odd number."""
    some = np.flatnonzero(np.diff(first) > 0)
    at = np.searchsorted(some, lines)
    out = np.zeros((len(lines), BLOCKS), np.uint8)
    half = (word >> np.uint64(32)).astype(np.uint32)  # half the bits order the words as well, at half the cost
    for k in range(BLOCKS if len(lines) else 0):
        least = np.minimum.reduceat(half * np.uint32(_TIMES[k] & np.uint64(0xFFFFFFFF)), first[:-1][some])[at]
        out[:, k] = (C.mixed(least.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
    return out


#: The columns of a signature, eight blocks each.
SIGS = tuple(f"s{i}" for i in range(BLOCKS // 8))


def _equal(x: str, y: str):
    """How many blocks two signatures have in common: the bytes that are 0 in their difference."""
    low = F.lit(0x007F7F7F7F7F7F7F)

    def apart(c):
        d = F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))
        # in each of the lower bytes, adding 127 to its lower bits carries into its top bit if one is set; no carry leaves a byte
        lower = F.bit_count((d.bitwiseAND(low) + low).bitwiseOR(d).bitwiseAND(F.lit(0x0080808080808080)))
        return lower + (F.shiftrightunsigned(d, 56) != 0).cast("int")

    return BLOCKS - sum((apart(c) for c in SIGS), F.lit(0))


def _hashed(batches):
    for batch in batches:
        for rows, data, at in C.slices(batch, "text"):
            w, owner, number, start, end = _normal(data, at)
            good = np.flatnonzero(end > start)
            roll = C.Rolling(w.data)
            word = roll.spans(w.start, w.end)
            line = roll.spans(start[good], end[good])
            sums = np.concatenate(([np.uint64(0)], np.cumsum(C.mixed(word ^ np.uint64(0x1234567))))) if len(word) else np.zeros(1, np.uint64)
            second = C.mixed(sums[w.first[1:][good]] - sums[w.first[:-1][good]])
            sig = _signature(word, w.first, good).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(owner[good])), pa.array(number[good], pa.int64()), *(pa.array(x.view(np.int64), pa.int64()) for x in (line, second)), *(pa.array(np.ascontiguousarray(sig[:, i])) for i in range(BLOCKS // 8))], names=["doc_id", "line", "h1", "h2", *SIGS])


def choices() -> list[np.ndarray]:
    """Which blocks make up each key: so many keys that MEET holds, the same for every input."""
    many = math.ceil(math.log(1 - MEET) / math.log1p(-(ALIKE**EACH)))
    r = np.random.default_rng(7)
    rounds = np.concatenate([r.permutation(BLOCKS)[: BLOCKS // EACH * EACH] for _ in range(many)])  # within a round no block serves twice
    return list(np.sort(rounds.reshape(-1, EACH)[:many], axis=1))


_ROW = np.dtype([("key", "<u4"), ("choice", "u1"), ("line", "<i8")])


def _pack(keys, nb):
    def run(batches):
        for batch in batches:
            line = batch["h1"].to_numpy(zero_copy_only=False)
            sig = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in SIGS], 1).view(np.uint8).astype(np.uint64)
            held = []
            for t, chosen in enumerate(keys):
                key = np.full(len(sig), t + 1, np.uint64)
                for c in chosen:
                    key = C.mixed(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, c])
                rows = np.empty(len(sig), _ROW)
                rows["key"], rows["choice"], rows["line"] = key & np.uint64(0xFFFFFFFF), t, line
                held.append((((key >> np.uint64(32)) % np.uint64(nb)).astype(np.int64), rows))
            out = list(C.packed(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "rows"])

    return run


def _groups(nb):
    def run(table: pa.Table) -> pa.Table:
        rows = C.unpacked([x for c in table["rows"].chunks for x in c], _ROW)
        rows = rows[np.lexsort((C.mixed(np.ascontiguousarray(rows["line"]).view(np.uint64)), rows["key"]))]
        key, line = np.ascontiguousarray(rows["key"]), np.ascontiguousarray(rows["line"])
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((edge, [len(key)])))
        x, y = np.repeat(edge, size), np.arange(len(key))
        three = edge[size == 3]
        x, y = np.concatenate((x, three + 1)), np.concatenate((y, three + 2))
        some = x != y
        pairs = np.unique(np.sort(np.stack((line[x[some]], line[y[some]]), 1), axis=1), axis=0)
        lists = {}
        for e, s in zip(edge[size > 3], size[size > 3], strict=True):
            d = np.sort(line[e : e + s])
            t = int(rows["choice"][e])
            lists[d.tobytes()] = (d, None, min(t, lists.get(d.tobytes(), (0, 0, t))[2]))
        return _found(pairs, list(lists.values()), nb)

    return run


_NORMAL = bytes(_DIGITS[_LOWER])


def _texts(batches):
    """The normalised text of asked lines."""
    for batch in (b.slice(i, PIECE_DOCS) for b in batches for i in range(0, b.num_rows, PIECE_DOCS)):
        ids, out = [], []
        for text, asks in zip(batch["text"], batch["asks"].to_pylist(), strict=True):
            parts = text.as_buffer().to_pybytes().split(b"\n")
            for a in asks:
                if a["line"] < len(parts):
                    ids.append(a["id"])
                    out.append(b" ".join(parts[a["line"]].translate(_NORMAL).split()).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "norm"])


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The characters of all texts, as many as fit packed into a number from each place on, offsets by text, how often each
    hash of two neighbours occurs in a text, and the bits of a character."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate(([0], np.cumsum(n)))
    text = np.repeat(np.arange(len(n)), n)
    pair = np.flatnonzero(text[1:] == text[:-1])
    h = (data[pair] * np.uint32(2654435761) + data[pair + 1] * np.uint32(40503)) >> np.uint32(7)
    grams = np.bincount(text[pair] * GRAMS + (h % np.uint32(GRAMS)), minlength=GRAMS * len(n)).reshape(-1, GRAMS)
    seen = np.zeros(0x110000, bool)  # the characters at hand are numbered, so that few bits hold one
    seen[data] = True
    number = (np.cumsum(seen) - 1).astype(np.uint64)[data]
    bits = 8 if seen.sum() <= 256 else 16 if seen.sum() <= 1 << 16 else 32
    number = np.concatenate((number, np.zeros(8, np.uint64)))
    packed = np.zeros(len(data) + 1, np.uint64)
    for j in range(64 // bits):
        packed |= number[j : j + len(packed)] << np.uint64(bits * j)
    return packed, at, np.minimum(grams, 30_000).astype(np.int16), bits


def near_pairs(packed: np.ndarray, at: np.ndarray, grams: np.ndarray, bits: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs of texts x, y have an edit similarity, 1 less the edit distance by the longer length, of PERCENT or more."""
    nx, ny = np.diff(at)[x], np.diff(at)[y]
    most = (100 - PERCENT) * np.maximum(nx, ny) // 100
    out = np.zeros(len(x), bool)
    some = np.flatnonzero(np.abs(ny - nx) <= most)
    for part in np.array_split(some, len(some) // 4096 + 1):
        # an edit changes at most two pairs of neighbours on either side
        apart = np.abs(grams[x[part]] - grams[y[part]]).sum(1, dtype=np.int64)
        part = part[apart <= 4 * most[part]]
        part = part[np.argsort(most[part], kind="stable")]
        size = np.cumsum(2 * most[part] + 1)
        for few in np.split(part, np.searchsorted(size, np.arange(100_000, int(size[-1]) if len(part) else 0, 100_000))):
            out[few] = _within(packed, bits, at[x[few]], at[y[few]], nx[few], ny[few], most[few])
    return out


def _ahead(packed, bits, i, j, most):
    """How many characters from places i and j on are equal, up to `most`: packed numbers at a time."""
    per = 64 // bits
    run = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        apart = packed[i[live] + run[live]] ^ packed[j[live] + run[live]]
        low = apart & (~apart + np.uint64(1))  # its lowest bit, a power of two
        step = np.where(apart == 0, per, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // bits)
        run[live] += step
        live = live[(apart == 0) & (run[live] < most[live])]
    return np.minimum(run, most)


def _within(packed, bits, x, y, nx, ny, most) -> np.ndarray:
    """Whether `most` edits make one text of the other, for many pairs at once: by edits, the furthest place on each diagonal."""
    out = np.zeros(len(x), bool)
    if not len(x):
        return out
    w = int(most.max())
    live = np.arange(len(x))
    far = np.full((len(x), 2 * w + 3), -2, np.int64)  # place in x; column d + w + 1 is diagonal d, place in y less place in x
    far[:, w + 1] = _ahead(packed, bits, x, y, np.minimum(nx, ny))
    for e in range(w + 1):
        end = far[np.arange(len(live)), (ny - nx)[live] + w + 1] >= nx[live]
        out[live[end]] = True
        keep = ~end & (most[live] > e)
        live, far = live[keep], far[keep]
        if not len(live):
            break
        d = np.arange(-e - 1, e + 2)
        c = slice(w - e, w + e + 3)
        before = np.concatenate((np.full((len(live), 1), -2), far[:, c], np.full((len(live), 1), -2)), axis=1)
        # a change steps on along the diagonal, a deletion comes from the one above, an insertion from the one below
        i = np.maximum(np.maximum(before[:, 1:-1] + 1, before[:, 2:] + 1), before[:, :-2])
        i = np.minimum(np.minimum(i, nx[live][:, None]), ny[live][:, None] - d)
        # a diagonal from which the last one cannot be reached with the edits left is of no use
        ok = (i >= 0) & (i + d >= 0) & (np.abs(d - (ny - nx)[live][:, None]) <= (most[live] - e - 1)[:, None])
        r, k = np.nonzero(ok)
        at = i[r, k]
        rest = np.minimum(nx[live[r]] - at, ny[live[r]] - at - d[k])
        i[r, k] = at + _ahead(packed, bits, x[live[r]] + at, y[live[r]] + at + d[k], rest)
        far[:, c] = np.where(ok, i, -2)
    return out


def _pieces(size: np.ndarray):
    """Runs of pairs, given the bytes of their texts: PIECE_PAIRS pairs and PIECE_BYTES bytes at most; a longer pair is a run of its own."""
    total = np.concatenate(([0], np.cumsum(size)))
    first = 0
    while first < len(size):
        last = int(np.searchsorted(total, total[first] + PIECE_BYTES, "right")) - 1
        last = max(first + 1, min(first + PIECE_PAIRS, last))
        yield first, last
        first = last


def _verify(batches):
    """Pairs of lines that are near. A line of several pairs of a piece is coded once."""
    for batch in batches:
        a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
        size = sum(pc.binary_length(batch[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("na", "nb"))
        for i, j in _pieces(size):
            n = j - i
            _, at, place = np.unique(np.concatenate((a[i:j], b[i:j])), return_index=True, return_inverse=True)
            texts = pa.chunked_array([batch["na"].slice(i, n), batch["nb"].slice(i, n)])
            known = _codes(texts.take(pa.array(at)).to_pylist())
            good = near_pairs(*known, place[:n], place[n:])
            yield pa.RecordBatch.from_arrays([pa.array(a[i:j][good], pa.int64()), pa.array(b[i:j][good], pa.int64())], names=["a", "b"])


def _gathered(pieces, each=100_000):
    """Pieces of pairs put together to `each` pairs or more, as small ones cost as much as large ones."""
    xs, ys, n = [], [], 0
    for x, y in pieces:
        xs.append(x)
        ys.append(y)
        n += len(x)
        if n >= each:
            yield np.concatenate(xs), np.concatenate(ys)
            xs, ys, n = [], [], 0
    if xs:
        yield np.concatenate(xs), np.concatenate(ys)


def _across(keys):
    """Of tasks: links between lines of different components, as few as unite what the task can.

    Two lines that share several keys are compared in the group of the first of them only.
    """

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table["doc"].to_numpy(), table["task"].to_numpy()))
        doc, comp, task, side, inside, choice = (table[c].to_numpy()[order] for c in ("doc", "comp", "task", "side", "inside", "choice"))
        sig = np.stack([table[c].to_numpy() for c in SIGS], 1)[order].view(np.uint8)
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in _gathered(C.task_pairs(task, side, inside)):
            some = comp[x] != comp[y]
            x, y = x[some], y[some]
            same = sig[x] == sig[y]
            some = same.sum(1) >= EQUAL
            x, y, same = x[some], y[some], same[some]
            first = np.full(len(x), -1)
            for t in reversed(range(len(keys))):
                first[same[:, keys[t]].all(1)] = t
            some = first == choice[x]
            xs.append(x[some])
            ys.append(y[some])
        x, y = np.concatenate(xs), np.concatenate(ys)
        name, root = np.unique(comp, return_inverse=True)
        out = [np.zeros((0, 2), np.int64)]
        size = pc.binary_length(table["norm"]).to_numpy().astype(np.int64)[order]
        for i, j in _pieces(size[x] + size[y]):
            a, b = x[i:j], y[i:j]
            some = root[a] != root[b]  # others are united by now
            a, b = a[some], b[some]
            ids, at = np.unique(doc[np.concatenate((a, b))], return_index=True)
            known = _codes([table["norm"][int(order[i])].as_py() for i in np.concatenate((a, b))[at]])
            good = near_pairs(*known, np.searchsorted(ids, doc[a]), np.searchsorted(ids, doc[b]))
            for u, v in zip(a[good].tolist(), b[good].tolist(), strict=True):
                if root[u] != root[v]:
                    root = np.where(root == root[v], root[u], root)
                    out.append(np.array([[doc[u], doc[v]]]))
        p = np.concatenate(out)
        return pa.table({"a": pa.array(p[:, 0], pa.int64()), "b": pa.array(p[:, 1], pa.int64())})

    return run


def _without(digests, rows=False):
    import hashlib

    def run(batches):
        for batch in (b.slice(i, PIECE_DOCS) for b in batches for i in range(0, b.num_rows, PIECE_DOCS)):
            total, gone, kept = [], [], []
            for text, drop in zip(batch["text"].to_pylist(), batch["drop"].to_pylist(), strict=True):
                lines, drop = text.split("\n"), set(drop or ())
                rest = "\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text
                total.append(len(lines))
                gone.append(len(drop))
                kept.append(hashlib.sha256(rest.encode("utf-8", "surrogatepass")).hexdigest() if digests else rest)
            gone, kept = pa.array(gone, pa.int64()), pa.array(kept, pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([gone, kept, batch["row"]], names=["n_removed", "kept", "row"])
            else:
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(total, pa.int64()), gone, kept], names=["doc_id", "n_lines", "n_removed", "kept"])

    return run


def line_verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, line, keep_doc, keep_line): lines that occur again or have a near copy, and the occurrence of their group that stays."""
    spark = docs.sparkSession
    sigs = ", ".join(f"{c} long" for c in SIGS)
    lines = C.durable(docs.mapInArrow(C.lean(_hashed), f"doc_id long, line long, h1 long, h2 long, {sigs}"))
    place = F.struct(F.col("doc_id").alias("keep_doc"), F.col("line").alias("keep_line"))
    distinct = C.durable(lines.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in SIGS)))
    nb = C.buckets(spark)
    keys = choices()
    found = C.durable(distinct.select("h1", *SIGS).mapInArrow(C.lean(_pack(keys, nb)), "bucket int, rows binary").groupBy("bucket").applyInArrow(_groups(nb), _FOUND))
    ids = distinct.select(F.col("h1").alias("id"), "at", *SIGS)
    side = lambda c, what: ids.select(F.col("id").alias(c), *(F.col(s).alias(f"{c}{s}") for s in what))
    pairs = found.where("kind = 0").groupBy("bucket").applyInArrow(_distinct, "a long, b long")
    pairs = C.durable(pairs.join(side("a", SIGS), "a").join(side("b", SIGS), "b").where(_equal("a", "b") >= EQUAL).select("a", "b").distinct())

    # the texts of all lines that may be compared
    lists = C.durable(join_lists(found))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).union(lists.select("doc")).distinct()
    asks = ids.join(wanted, "id", "left_semi").groupBy(F.col("at.keep_doc").alias("doc_id")).agg(F.collect_list(F.struct(F.col("at.keep_line").alias("line"), "id")).alias("asks"))
    texts = C.durable(docs.join(C.durable(asks).hint("merge"), "doc_id").select("text", "asks").mapInArrow(C.lean(_texts), "id long, norm string").groupBy("id").agg(F.min("norm").alias("norm")))
    text = lambda c: texts.select(F.col("id").alias(c), F.col("norm").alias(f"n{c}"))
    classes = C.durable(components(pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "na", "nb").mapInArrow(C.lean(_verify), "a long, b long")))

    open_, parts = still_apart(lists, classes)
    open_ = C.durable(open_.select("doc", "comp", "task", "side", "inside", "choice"))
    if not open_.isEmpty():
        full = open_.join(ids.select(F.col("id").alias("doc"), *SIGS), "doc").join(texts.withColumnRenamed("id", "doc"), "doc")
        more = C.durable(full.groupBy(F.pmod("task", F.lit(parts)).alias("part")).applyInArrow(_across(keys), "a long, b long").distinct())
        if not more.isEmpty():
            classes = C.durable(components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))

    own = distinct.select("h1", "h2", "at", F.col("n").alias("occurs"))
    named = C.durable(own.join(classes.withColumnRenamed("node", "h1"), "h1"))
    first = C.durable(named.groupBy("component").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    shared = C.join_hot(named, first, ["component"]).select("h1", "h2", F.col("first").alias("at"), F.col("occurs").alias("n"))
    again = own.where("occurs > 1").join(classes.withColumnRenamed("node", "h1"), "h1", "left_anti").select("h1", "h2", "at", F.col("occurs").alias("n"))
    return C.join_hot(lines.select("doc_id", "line", "h1", "h2"), C.durable(shared.unionByName(again)), ["h1", "h2"]).select("doc_id", "line", "at.keep_doc", "at.keep_line")


def _dropped(docs: DataFrame) -> DataFrame:
    """docs with `drop`, the numbers of the lines that go."""
    drop = line_verdicts(docs.select("doc_id", "text")).where("doc_id <> keep_doc or line <> keep_line").groupBy("doc_id").agg(F.collect_set("line").alias("drop"))
    return docs.join(drop.hint("merge"), "doc_id", "left")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept): each text without the lines whose group has an earlier occurrence.

    kept is the rest, lines joined by line feeds, or its SHA-256 (digests). Earlier: smaller doc_id, then smaller line
    number. Blank lines always stay. Null texts count as empty. Rows without an id have no place in the order and are left
    out; rows that repeat an id and its text share its verdicts, and different texts of one id are texts of their own. No
    rows give none; other columns are ignored.
    """
    docs, names = C.keyed(docs, id_col, text_col)
    out = _dropped(docs).select("doc_id", "text", "drop").mapInArrow(C.lean(_without(digests)), "doc_id long, n_lines long, n_removed long, kept string")
    return C.renamed(out, names, "doc_id")


def apply_line_dedup(docs: DataFrame) -> DataFrame:
    """documents with texts that lost their repeated lines, and n_chars to match where there is one.

    A row whose text loses all of its content goes, as do rows without an id; repeated rows stay as many as they are. Any
    further columns stay as they are, whatever their names.
    """
    rows, _ = C.keyed(docs, "doc_id", "text", rows=True)
    kept = _dropped(rows).select("doc_id", "text", "drop", "row").mapInArrow(C.lean(_without(False, True)), T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), rows.schema["row"]]))
    kept = kept.where("n_removed = 0 or kept rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    of = lambda c: F.when(F.col("n_removed") > 0, new[c]).otherwise(F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row")[c].alias(c)
    return kept.select(*(of(c) for c in docs.columns))
