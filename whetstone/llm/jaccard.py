"""N-gram Jaccard join by partitioning the universe of shingles.

Sizes fall in windows [2^k, 8/3 * 2^k). In a window every shingle hash belongs to one of m segments. If two documents
link, the smaller one (s shingles) differs from the other in at most s/3 shingles (for the threshold of 0.75), so of
any s/3 + 1 of its segments one is equal in both: the larger document looks up all its segments, the smaller one is
indexed under so many only, leaving out those made of frequent shingles. Windows of small sets use half the segments
with all one-deletion neighbours (such a segment counts twice), or single shingles. Which of these a window uses is
chosen by cost from counts over all documents, among the layouts that suffice for every one of its documents.
Candidates are verified on the texts. Groups of candidates are linked as stars first; then members that ended up in
different components are compared, so no link between different texts is lost and no group is expanded into pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whetstone.llm import common as C
from whetstone.llm.components import components
from whetstone.llm.groups import PIECE, join_lists, still_apart

#: Layouts of a window: name and segments per 2^k shingles.
LAYOUTS = (("exact", 0.8), ("exact", 1.2), ("delete", 0.5), ("token", 0))
#: Frequent shingles: seen so often by one task's flush, and at most so many in all (only the cost depends on them).
HOT_LOCAL, HOT_MOST = 3, 400_000
#: Bits of a set's parity sketch: two sets differ in at least as many shingles as their sketches in bits.
SKETCH = 2048
_DOC = "doc_id long, kind int, n long, h1 long, h2 long, k int, slack array<int>, cost array<int>, sketch array<long>"


def _most_apart(n):
    """The largest symmetric difference between a set of n and any larger set that links with it (0.75)."""
    return n // 3


def _segment(h, m):
    return (((h >> np.uint64(9)) & np.uint64(0xFFFFFFFF)) * m.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def _measure(k):
    def run(batches):
        gathered, size = [], 0

        def hot():
            if not gathered:
                return []
            v, c = np.unique(np.concatenate(gathered), return_counts=True)
            v, c = v[c >= HOT_LOCAL], c[c >= HOT_LOCAL]
            top = np.argsort(-c, kind="stable")[:50_000]
            return [_rows(None, len(top), kind=1, h1=v[top].view(np.int64), n=c[top])]

        for batch in batches:
            for rows, data, at in C.slices(batch, "text"):
                h, off = C.shingles(data, at, k)
                n = np.diff(off)
                text = np.repeat(np.arange(len(n)), n)
                high = np.bincount(text, (h >> np.uint64(32)).astype(float), len(n)).astype(np.uint64)
                low = np.bincount(text, (h & np.uint64(0xFFFFFFFF)).astype(float), len(n)).astype(np.uint64)
                w = np.maximum(np.frexp(n.astype(float))[1] - 1, 0)
                slack, cost = [], []
                for kind, per in LAYOUTS[:-1]:
                    m = np.maximum(1, np.ceil(per * 2.0**w)).astype(np.int64)
                    base = np.cumsum(m) - m
                    counts = np.bincount(base[text] + _segment(h, m[text]), minlength=int(m.sum()))
                    full = np.add.reduceat(counts > 0, base) if len(base) else base
                    weight = np.add.reduceat(np.minimum(counts, 2), base) if kind == "delete" and len(base) else full
                    slack.append(weight - _most_apart(n) - 1)
                    cost.append(full + n if kind == "delete" else full)
                slack.append(n - _most_apart(n) - 1)
                cost.append(2 * n)
                bits = np.bincount(text * SKETCH + (h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH * len(n)).reshape(-1, SKETCH) & 1
                sketch = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
                yield _rows(rows.column("doc_id"), len(n), kind=0, n=n, h1=C.mixed(high).view(np.int64), h2=C.mixed(low ^ (high << np.uint64(40))).view(np.int64), k=w, slack=np.array(slack).T, cost=np.array(cost).T, sketch=sketch)
                gathered.append(h)
                size += len(h)
                if size >= C.FLUSH_ROWS:
                    yield from hot()
                    gathered, size = [], 0
        yield from hot()

    return run


def _rows(ids, count, kind, n, h1, h2=None, k=None, slack=None, cost=None, sketch=None):
    def lists(x, of):
        if x is None:
            return pa.nulls(count, pa.list_(of))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), of))

    one = lambda x, of: pa.nulls(count, of) if x is None else pa.array(x, of)
    return pa.RecordBatch.from_arrays(
        [ids.cast(pa.int64()) if ids is not None else pa.nulls(count, pa.int64()), pa.array(np.full(count, kind), pa.int32()), one(n, pa.int64()), one(h1, pa.int64()), one(h2, pa.int64()), one(k, pa.int32()), lists(slack, pa.int32()), lists(cost, pa.int32()), lists(sketch, pa.int64())],
        names=["doc_id", "kind", "n", "h1", "h2", "k", "slack", "cost", "sketch"],
    )


_ROW = np.dtype([("low", "<u4"), ("high", "<u2"), ("doc", "<i8")])
_SHORT = np.dtype([("low", "<u4"), ("high", "<u2"), ("doc", "<u4")])


def _emit(k, layout, hot, nb):
    """Map side: keys of segments, packed by key range. The top bit of a key marks a document's own index entries."""

    def keys(h, text, n, window, own):
        for choice in np.unique(layout[window]):
            if choice < 0:
                continue
            kind, per = LAYOUTS[choice]
            use = layout[window] == choice
            mine = use[text]
            hh, tt = h[mine], text[mine]
            m = np.where(use, np.maximum(1, np.ceil(per * 2.0**window)), 0).astype(np.int64)
            if kind == "token":
                at, seg, count = np.arange(len(hh)), np.zeros(len(hh), np.int64), np.ones(len(hh), np.int64)
                owner, low, high = tt, (hh & np.uint64(0xFFFFFFFF)), hh >> np.uint64(32)
                frequent = hot(hh)
            else:
                base = np.cumsum(m) - m
                seg = _segment(hh, np.maximum(m[tt], 1))
                at = base[tt] + seg
                total = int(m.sum())
                count = np.bincount(at, minlength=total)
                low = np.bincount(at, (hh & np.uint64(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
                high = np.bincount(at, (hh >> np.uint64(32)).astype(float), total).astype(np.uint64)
                frequent = (np.bincount(at, hot(hh), total) == count) & (count > 0)
                owner = np.repeat(np.arange(len(m)), m)
                seg = np.arange(total) - base[owner]
            salt = lambda w, s: C.mixed((w.astype(np.uint64) << np.uint64(40)) + s.astype(np.uint64) + np.uint64(choice << 56))
            full = count > 0
            weight = np.minimum(count, 2) if kind == "delete" else full.astype(np.int64)
            # index the cheapest segments whose weights reach the bound: those that are not frequent come first
            def ahead(of):  # the weight of such segments before each one, in its text
                run = np.cumsum(np.where(of, weight, 0))
                first = np.concatenate(([0], run))[np.searchsorted(owner, np.arange(len(m) + 1))]
                return run - np.where(of, weight, 0) - first[:-1][owner], np.diff(first)

            rare, total_rare = ahead(full & ~frequent)
            rank = np.where(frequent, ahead(full & frequent)[0] + total_rare[owner], rare)
            index = full & (rank <= _most_apart(n)[owner]) & own[owner]
            where = np.flatnonzero(full)
            key = C.mixed(C.mixed(low[where]) + high[where] * np.uint64(0x9E3779B97F4A7C15) ^ salt(window[owner[where]], seg[where]))
            yield key, index[where], owner[where]
            if kind == "delete":
                some = count[at] > 1
                a, x = at[some], hh[some]
                key = C.mixed(C.mixed(low[a] - (x & np.uint64(0xFFFFFFFF))) + (high[a] - (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) ^ salt(window[owner[a]], seg[a]))
                yield key, index[a], owner[a]

    def run(batches):
        held, size, seen = [], 0, set()

        def flush():
            rows = np.concatenate([x[1] for x in held])
            bucket = np.concatenate([x[0] for x in held])
            low = rows["doc"].min() if len(rows) else 0
            short = len(rows) and int(rows["doc"].max()) - int(low) < 1 << 32
            if short:
                less = np.empty(len(rows), _SHORT)
                less["low"], less["high"], less["doc"] = rows["low"], rows["high"], rows["doc"] - low
                rows = less
            out = list(C.packed(bucket, rows))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array(np.full(len(out), low), pa.int64()), pa.array(np.full(len(out), bool(short))), pa.array([x for _, x in out], pa.binary())], names=["bucket", "low", "short", "rows"])

        for batch in batches:
            for rows, data, at in C.slices(batch, "text"):
                h, off = C.shingles(data, at, k)
                n = np.diff(off)
                ids = rows.column("doc_id").cast(pa.int64())
                valid = ~np.asarray(ids.is_null())
                doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(len(n)), n)
                # of equal sets that one task holds, the first stands for all: they are linked by their hash already
                low = np.bincount(text, (h & np.uint64(0xFFFFFFFF)).astype(float), len(n)).astype(np.uint64)
                high = np.bincount(text, (h >> np.uint64(32)).astype(float), len(n)).astype(np.uint64)
                for i, pair in enumerate(zip(low.tolist(), high.tolist(), n.tolist(), strict=True)):
                    if pair in seen:
                        valid[i] = False
                    elif valid[i]:
                        seen.add(pair)
                n = np.where(valid, n, 0)
                mine = valid[text]
                h, text = h[mine], text[mine]
                window = np.maximum(np.frexp(n.astype(float))[1] - 1, 0)
                for w, own, take in ((window, n > 0, n > 0), (window - 1, np.zeros(len(n), bool), (window > 0) & (3 * n < 2.0 ** (window + 2)))):
                    part = take[text]
                    for key, index, owner in keys(h[part], text[part], n, np.where(take, w, len(layout) - 1), own):
                        out = np.empty(len(key), _ROW)
                        out["low"] = key & np.uint64(0xFFFFFFFF)
                        out["high"] = ((key >> np.uint64(32)) & np.uint64(0x7FFF)) | (index.astype(np.uint64) << np.uint64(15))
                        out["doc"] = doc[owner]
                        held.append((((key >> np.uint64(48)) % np.uint64(nb)).astype(np.int32), out))
                        size += len(out)
                if size >= C.FLUSH_ROWS:
                    yield flush()
                    held, size, seen = [], 0, set()
        if size:
            yield flush()

    return run


def _groups(nb):
    """Reduce side: of each key with an index entry, star pairs; of more than three members, also the list of members."""

    def run(table: pa.Table) -> pa.Table:
        parts = []
        for low, short, blob in zip(table["low"].to_pylist(), table["short"].to_pylist(), (x for c in table["rows"].chunks for x in c), strict=True):
            got = np.frombuffer(blob.as_buffer(), _SHORT if short else _ROW)
            one = np.empty(len(got), [("key", "<u8"), ("doc", "<i8")])
            one["key"] = got["low"].astype(np.uint64) | ((got["high"] & np.uint16(0x7FFF)).astype(np.uint64) << np.uint64(32)) | ((got["high"] >> np.uint16(15)).astype(np.uint64) << np.uint64(63))
            one["doc"] = got["doc"].astype(np.int64) + (low if short else 0)
            parts.append(one)
        rows = np.concatenate(parts)
        key, flag, doc = rows["key"] & np.uint64((1 << 63) - 1), (rows["key"] >> np.uint64(63)).astype(bool), rows["doc"]
        order = np.argsort(key, kind="stable")
        key, flag, doc = key[order], flag[order], doc[order]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((edge, [len(key)])))
        some = np.logical_or.reduceat(flag, edge) & (size > 1)
        keep = np.repeat(some, size)
        key, flag, doc = key[keep], flag[keep], doc[keep]
        if not len(key):
            return _found(np.zeros((0, 2), np.int64), [], nb)
        order = np.lexsort((C.mixed(doc.astype(np.uint64)), ~flag, key))  # the hub: an indexed one, the same in most groups
        key, flag, doc = key[order], flag[order], doc[order]
        again = np.concatenate(([False], (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])))
        key, flag, doc = key[~again], flag[~again], doc[~again]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((edge, [len(key)])))
        hub = np.repeat(doc[edge], size)
        pairs = np.stack((hub, doc), 1)
        three = edge[(size == 3)]
        three = three[flag[three + 1]]
        pairs = np.concatenate((pairs, np.stack((doc[three + 1], doc[three + 2]), 1)))
        pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
        lists = {}
        for e, s in zip(edge[size > 3], size[size > 3], strict=True):
            d = doc[e : e + s]
            order = np.argsort(d, kind="stable")
            lists[d[order].tobytes() + np.packbits(flag[e : e + s][order]).tobytes()] = (d[order], flag[e : e + s][order], None)
        return _found(pairs, list(lists.values()), nb)

    return run


_FOUND = "kind int, bucket int, pairs binary, g long, members array<long>, own array<boolean>"


def _found(pairs, lists, nb):
    """Pairs as blobs by bucket; lists as rows of PIECE members at most, under a number of the whole list, with their choice as bucket."""
    nb = max(8, nb // 16)  # pairs are few: so many buckets keep the blobs of all tasks few, too
    b = (C.mixed(pairs[:, 0].astype(np.uint64) * np.uint64(31) + pairs[:, 1].astype(np.uint64)) % np.uint64(nb)).astype(np.int64)
    out = list(C.packed(b, np.ascontiguousarray(pairs).view("<i8,<i8").ravel())) if len(pairs) else []
    pieces = []
    for members, own, choice in lists:
        raw = members.tobytes() + (b"" if own is None else np.packbits(own).tobytes())
        g = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
        pieces += [(g, members[i : i + PIECE], None if own is None else own[i : i + PIECE], choice) for i in range(0, len(members), PIECE)]
    none = [None] * len(out)
    return pa.table({
        "kind": pa.array([0] * len(out) + [1] * len(pieces), pa.int32()),
        "bucket": pa.array([x for x, _ in out] + [c for _, _, _, c in pieces], pa.int32()),
        "pairs": pa.array([x for _, x in out] + [None] * len(pieces), pa.binary()),
        "g": pa.array(none + [g for g, _, _, _ in pieces], pa.int64()),
        "members": pa.array(none + [x for _, x, _, _ in pieces], pa.list_(pa.int64())),
        "own": pa.array(none + [x for _, _, x, _ in pieces], pa.list_(pa.bool_())),
    })


def _distinct(table: pa.Table) -> pa.Table:
    p = np.concatenate([np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 2) for c in table["pairs"].chunks for x in c])
    p = np.unique(p, axis=0)
    return pa.table({"a": pa.array(p[:, 0], pa.int64()), "b": pa.array(p[:, 1], pa.int64())})


def _verify(k, percent):
    def run(batches):
        for batch in batches:
            for rows, data, at in C.slices(batch, "ta"):
                h1, o1 = C.shingles(data, at, k)
                h2, o2 = C.shingles(*C.raw(rows.column("tb")), k)
                n1, n2 = np.diff(o1), np.diff(o2)
                both = np.zeros(len(n1), np.int64)
                for i in range(len(n1)):
                    h = np.concatenate((h1[o1[i] : o1[i + 1]], h2[o2[i] : o2[i + 1]]))
                    h.sort()
                    both[i] = np.count_nonzero(h[1:] == h[:-1])
                good = (both > 0) & (100 * both >= percent * (n1 + n2 - both))
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(good)), rows.column(1).filter(pa.array(good))], names=["a", "b"])

    return run


def _across(percent):
    """Of tasks: pairs of an indexed and any member from different components that sizes and sketches allow."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["task"].to_numpy(), kind="stable")
        doc, comp, n, task, side, inside, own = (table[c].to_numpy()[order] for c in ("doc", "comp", "size", "task", "side", "inside", "own"))
        sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH // 64)[order]
        out = [np.zeros((0, 2), np.int64)]
        for x, y in C.task_pairs(task, side, inside):
            some = (comp[x] != comp[y]) & (own[x] | own[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[some], y[some]
            near = 7 * np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= n[x] + n[y]
            out.append(np.stack((doc[x[near]], doc[y[near]]), 1))
        p = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pa.table({"a": pa.array(p[:, 0], pa.int64()), "b": pa.array(p[:, 1], pa.int64())})

    return run


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row with an id, by word-shingle Jaccard similarity of 0.75 or more.

    Null and empty texts, and texts without a word, have no shingle and link with nothing. Rows without an id are left
    out; repeated rows each return a row, and different texts of one id are documents of their own. Other columns are ignored. An empty table gives an empty result.
    """
    docs, names = C.keyed(docs, id_col, text_col)
    return C.renamed(_classes(docs, shingle_words), names, "doc_id", "component_id").select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows whose ids stand for one text each."""
    spark = docs.sparkSession
    measured = C.durable(docs.mapInArrow(C.lean(_measure(shingle_words)), _DOC))
    sets = measured.where("kind = 0").select("doc_id", "n", "h1", "h2", "k", "slack", "cost", "sketch")

    best = {}
    stats = sets.where("n > 0").select("k", F.posexplode(F.arrays_zip("slack", "cost")).alias("i", "x")).groupBy("k", "i").agg(F.min("x.slack").alias("slack"), F.sum("x.cost").alias("cost")).collect()  # a row for each window and layout
    for r in stats:
        if r["slack"] >= 0 and (r["k"] not in best or (r["cost"], r["i"]) < best[r["k"]]):
            best[r["k"]] = (r["cost"], r["i"])
    layout = np.full(66, -1)
    for w, (_, i) in best.items():
        layout[w] = i
    frequent = measured.where("kind = 1").groupBy("h1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h1").limit(HOT_MOST).select("h1").toPandas()["h1"].to_numpy(np.int64).view(np.uint64)
    frequent = np.sort(frequent)
    known = spark.sparkContext.broadcast(frequent)  # at most HOT_MOST values

    def hot(h):
        v = known.value
        out = np.zeros(len(h), bool)
        if len(v):
            marks = np.zeros(1 << 20, bool)
            marks[v >> np.uint64(44)] = True
            at = np.flatnonzero(marks[h >> np.uint64(44)])
            out[at] = v[np.minimum(np.searchsorted(v, h[at]), len(v) - 1)] == h[at]
        return out

    nb = C.buckets(spark)
    keyed = docs.mapInArrow(C.lean(_emit(shingle_words, layout, hot, nb)), "bucket int, low long, short boolean, rows binary")
    found = C.durable(keyed.groupBy("bucket").applyInArrow(_groups(nb), _FOUND))

    info = sets.where("n > 0").groupBy("doc_id").agg(F.max_by(F.struct("n", "sketch", "h1", "h2"), "n").alias("x")).select("doc_id", "x.*")

    def links(pairs: DataFrame, large: bool) -> DataFrame:
        x, y = (info.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")
        apart = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH // 64)), F.lit(0))
        near = C.durable(pairs.join(x, "a").join(y, "b").where((100 * F.least("na", "nb") >= 75 * F.greatest("na", "nb")) & (7 * apart <= F.col("na") + F.col("nb"))).select("a", "b"))
        # the pairs have no bound, so they are not to be broadcast; both joins read one exchange of the texts
        ta, tb = (docs.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
        near = near.hint("merge") if large else near
        both = near.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
        return C.durable(both.mapInArrow(C.lean(_verify(shingle_words, 75)), "a long, b long").distinct())

    filled = C.durable(sets.where("n > 0").select("doc_id", F.col("n").alias("size"), "h1", "h2"))
    twins = C.durable(filled.groupBy("size", "h1", "h2").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1"))
    equal = C.durable(C.join_hot(filled, twins, ["size", "h1", "h2"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct())
    pairs = C.durable(found.where("kind = 0").groupBy("bucket").applyInArrow(_distinct, "a long, b long"))
    edges = equal.unionByName(links(pairs, True))
    classes = C.durable(components(edges))

    open_, parts = still_apart(join_lists(found, "own"), classes)
    open_ = open_.join(info.select(F.col("doc_id").alias("doc"), F.col("n").alias("size"), "sketch"), "doc")
    rest = C.durable(open_.groupBy(F.pmod("task", F.lit(parts)).alias("part")).applyInArrow(_across(75), "a long, b long").distinct())
    if not rest.isEmpty():
        more = links(rest, False)
        if not more.isEmpty():
            classes = C.durable(components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    return sets.join(classes.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of documents that are the first of their class of near copies, each as it is.

    Of repeated rows one stays, of rows that share id and text any one that a hash of the row picks. Rows without an id go;
    rows without a word are in no class and stay. Columns may have any names.
    """
    rows, _ = C.keyed(docs, "doc_id", "text", rows=True)
    keep = _classes(rows.select("doc_id", "text")).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    held = rows.select("doc_id", "row").join(C.durable(keep).hint("merge"), "doc_id")
    again = held.where("n > 1").groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return held.where("n = 1").select("row").unionByName(again.select("row")).select("row.*")
