"""Removing repeated passages by suffix sorting.

A byte goes if a 100-byte string that also starts earlier covers it. Every such string holds an anchor: the k-gram with
the least hash in it, the leftmost of equals. Equal strings have equal anchors, so strings need comparing among the
surroundings (fragments) of equal anchors only. Equal fragments are collapsed to their earliest before they are shuffled
as bytes; what is left is suffix-sorted, in parts by anchor, in two stages: only suffixes smaller than their successors
are sorted directly, all others are induced from them in one scan over the buckets of first bytes. Adjacent common
prefixes of 100 bytes or more then form classes, of which the earliest start stays. An anchor with very many different
fragments is not sorted in one task: its strings go by 128 bits of their own, the earliest kept by each map task first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whetstone.llm import common as C

#: Bytes of an anchor; anchors are the least of LENGTH - GRAM + 1 neighbours.
GRAM = 40
#: Bytes that one suffix sort takes, beyond the fragments of a single anchor.
SORT_BYTES = 200_000
#: Windows of a long text that are read at a time, and fragments of an anchor beyond which it is split by window.
SEGMENT, HOT = 1 << 22, 20_000
#: Symbols in a 63-bit word of nine-bit symbols.
SYMBOLS = 7


def _words(text: np.ndarray) -> np.ndarray:
    """At each place the next SYMBOLS symbols as one number; zeros beyond the end."""
    long = np.concatenate((text.astype(np.uint64), np.zeros(SYMBOLS, np.uint64)))
    out = np.zeros(len(text), np.uint64)
    for j in range(SYMBOLS):
        out = (out << np.uint64(9)) | long[j : j + len(text)]
    return out


def two_stage(text: np.ndarray, depth: int = 105) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of `text` (small integers, 0 a separator) in order of their first `depth` symbols at least, and
    how many symbols, up to `depth`, each has in common with the one before it."""
    n = len(text)
    t = text.astype(np.int64)
    words = np.concatenate((_words(text), np.zeros(depth + SYMBOLS, np.uint64)))
    step = np.sign(np.diff(t, append=-1))  # the last suffix is greater than the empty one
    nxt = np.where(step != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    smaller = step[np.minimum(nxt, n - 1)] > 0  # than its successor
    smaller[n - 1] = True  # nothing induces it

    # first stage: sort directly, only ties going on to the next word; words are compared by their ranks, so that a tie's
    # group and word fit one number
    order = np.argsort(words[:n])
    rank = np.zeros(n + depth + SYMBOLS, np.uint64)
    ordered = words[order]
    rank[order] = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1]))).astype(np.uint64)
    direct = np.flatnonzero(smaller)
    key = rank[direct]
    order = np.argsort(key)
    direct, key = direct[order], key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    at = np.arange(len(direct))
    for j in range(SYMBOLS, depth, SYMBOLS):
        h = head[at]
        at = at[~(h & np.concatenate((h[1:], [True])))]
        if not len(at):
            break
        key = (np.cumsum(head[at]).astype(np.uint64) << np.uint64(32)) | rank[direct[at] + j]
        order = np.argsort(key)
        direct[at] = direct[at[order]]
        key = key[order]
        head[at] = np.concatenate(([True], key[1:] != key[:-1]))

    # second stage: one scan over the buckets induces the rest
    symbols = int(t.max()) + 1
    all_of = np.bincount(t, minlength=symbols)
    end = np.cumsum(all_of)
    start = end - all_of
    sorted_ = np.full(n, -1)
    of = t[direct]
    count = np.bincount(of, minlength=symbols)
    sorted_[(end - count)[of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]] = direct
    fill = start.copy()

    def push(places):
        before = places[places > 0] - 1
        before = before[~smaller[before]]
        s = t[before]
        order = np.argsort(s, kind="stable")
        before, s = before[order], s[order]
        each = np.bincount(s, minlength=symbols)
        sorted_[fill[s] + np.arange(len(s)) - (np.cumsum(each) - each)[s]] = before
        np.add(fill, each, out=fill)

    for c in np.flatnonzero(all_of):
        done = start[c]
        while done < fill[c]:  # runs of one symbol come in rounds
            upto = fill[c]
            push(sorted_[done:upto])
            done = upto
        push(sorted_[end[c] - count[c] : end[c]])

    # adjacent common prefixes by halves: 8, 4, 2 and 1 words (longer stretches as hashes of their halves), then symbols
    sizes = [words]
    while SYMBOLS << len(sizes) < depth:
        x = sizes[-1]
        width = SYMBOLS << (len(sizes) - 1)
        sizes.append(C.mixed(x + np.concatenate((x[width:], np.zeros(width, np.uint64))) * np.uint64(0x9E3779B97F4A7C15)))
    a, b = sorted_[1:].copy(), sorted_[:-1].copy()
    for i in reversed(range(len(sizes))):
        step = np.where(sizes[i][a] == sizes[i][b], SYMBOLS << i, 0)
        a += step
        b += step
    apart = words[np.minimum(a, len(words) - 1)] ^ words[np.minimum(b, len(words) - 1)]
    same = np.zeros(n - 1, np.int64)
    for j in range(1, SYMBOLS):
        same += (apart >> np.uint64(9 * (SYMBOLS - j))) == 0
    common = np.concatenate(([0], np.minimum(a - sorted_[1:] + same, depth)))
    return sorted_, common


_ROW = np.dtype([("key", "<u8"), ("frag", "<u8"), ("doc", "<i8"), ("pos", "<i8"), ("a", "u1"), ("b", "u1"), ("left", "u1"), ("right", "u1")])
_THIN = np.dtype([("k0", "<u4"), ("k1", "<u2"), ("frag", "<u8"), ("doc", "<u4"), ("pos", "<u4"), ("a", "u1"), ("b", "u1"), ("left", "u1"), ("right", "u1")])
_M48 = np.uint64((1 << 48) - 1)


def _anchors(data: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """A row for each anchor of each text: its hash, its fragment's hash, place, and the range of windows that have it."""
    n, reach = len(data), length - GRAM
    if n < length:
        return np.zeros(0, _ROW)
    roll = C.Rolling(data)
    i = np.arange(n - GRAM + 1)
    h = roll.spans(i, i + GRAM)
    least = (h & np.uint64(~((1 << 28) - 1) & (1 << 64) - 1)) | i.astype(np.uint64)
    width = 1
    while width * 2 <= reach + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width <= reach:
        least = np.minimum(least[: len(least) - (reach + 1 - width)], least[reach + 1 - width :])
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    fits = np.arange(len(least)) + length <= at[1:][owner]
    j = np.flatnonzero(fits)
    if not len(j):
        return np.zeros(0, _ROW)
    p = (least[j] & np.uint64((1 << 28) - 1)).astype(np.int64)
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (owner[j[1:]] != owner[j[:-1]])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(j)])) - 1
    own, p = owner[j[first]], p[first]
    f0, f1 = np.maximum(at[:-1][own], p - reach), np.minimum(at[1:][own], p + length)
    rows = np.empty(len(p), _ROW)
    rows["key"], rows["frag"] = h[p] & _M48, C.mixed(roll.spans(f0, f1) + (p - f0).astype(np.uint64))
    rows["doc"], rows["pos"] = doc[own], p - at[:-1][own]
    rows["a"], rows["b"], rows["left"], rows["right"] = p - j[first], p - j[last], p - f0, f1 - p
    return rows


def _collapse(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of equal fragments; spans (doc, start, end) of the others."""
    rows = rows[np.lexsort((rows["pos"], rows["doc"], rows["frag"], rows["key"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["frag"][1:] != rows["frag"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    later = (rows["doc"] != rows["doc"][head]) | (rows["pos"] != rows["pos"][head])  # a repeated row is not later
    out = rows[later]
    return rows[new], _merged(out["doc"], out["pos"] - out["a"], out["pos"] - out["b"] + length)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans as the least number of disjoint runs, by doc and start."""
    if not len(doc):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    rank = np.concatenate(([0], np.cumsum(doc[1:] != doc[:-1])))
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * far) - rank * far
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(doc)])) - 1
    return np.stack((doc[first], start[first], reach[last]), 1)


_OUT = "kind int, bucket int, low long, thin boolean, rows binary"


def _table(kinds, buckets, lows, thins, rows):
    return dict(kind=pa.array(kinds, pa.int32()), bucket=pa.array(buckets, pa.int32()), low=pa.array(lows, pa.int64()), thin=pa.array(thins, pa.bool_()), rows=pa.array(rows, pa.binary()))


def _by_doc(kind: int, rows: np.ndarray, doc: np.ndarray, nd: int) -> dict:
    """Rows about documents as a blob for each of nd parts of all ids."""
    out = list(C.packed((C.mixed(np.ascontiguousarray(doc).view(np.uint64)) % np.uint64(nd)).astype(np.int64), rows))
    n = len(out)
    return _table([kind] * n, [b for b, _ in out], [None] * n, [None] * n, [x for _, x in out])


_SPAN = np.dtype([("doc", "<i8"), ("start", "<i8"), ("end", "<i8")])


def _spans(kind: int, spans: np.ndarray, nd: int) -> dict:
    return _by_doc(kind, np.ascontiguousarray(spans, np.int64).view(_SPAN).ravel() if len(spans) else np.zeros(0, _SPAN), spans[:, 0], nd)


def _each_doc(kind: np.dtype, merge: bool):
    """From blobs by part of all ids to one blob for each document, without its id."""

    def run(table: pa.Table) -> pa.Table:
        rows = C.unpacked([x for c in table["rows"].chunks for x in c], kind)
        if merge:
            rows = np.ascontiguousarray(_merged(rows["doc"], rows["start"], rows["end"])).view(_SPAN).ravel()
        rows = rows[np.argsort(rows["doc"], kind="stable")]
        cuts = np.flatnonzero(np.diff(rows["doc"])) + 1
        parts = np.split(rows, cuts)
        return pa.table({"doc_id": pa.array([int(x["doc"][0]) for x in parts], pa.int64()), "rows": pa.array([x.tobytes() for x in parts], pa.binary())})

    return run


def _thin(rows: np.ndarray) -> tuple[int, bool, np.ndarray]:
    low = int(rows["doc"].min()) if len(rows) else 0
    if not len(rows) or int(rows["doc"].max()) - low >= 1 << 32 or int(rows["pos"].max()) >= 1 << 32:
        return low, False, rows
    out = np.empty(len(rows), _THIN)
    out["k0"], out["k1"] = rows["key"] & np.uint64(0xFFFFFFFF), rows["key"] >> np.uint64(32)
    out["frag"] = rows["frag"]
    out["doc"], out["pos"] = rows["doc"] - low, rows["pos"]
    for c in ("a", "b", "left", "right"):
        out[c] = rows[c]
    return low, True, out


def _wide(low: int, thin: bool, blob) -> np.ndarray:
    if not thin:
        return np.frombuffer(blob.as_buffer(), _ROW)
    x = np.frombuffer(blob.as_buffer(), _THIN)
    out = np.empty(len(x), _ROW)
    out["key"] = x["k0"].astype(np.uint64) | (x["k1"].astype(np.uint64) << np.uint64(32))
    out["frag"] = x["frag"]
    out["doc"], out["pos"] = x["doc"].astype(np.int64) + low, x["pos"]
    for c in ("a", "b", "left", "right"):
        out[c] = x[c]
    return out


def _map(length, nb, nd):
    def run(batches):
        held, size = [], 0

        def flush():
            rows, spans = _collapse(np.concatenate(held), length)
            low, thin, less = _thin(rows)
            out = list(C.packed((C.mixed(rows["key"]) % np.uint64(nb)).astype(np.int64), less))
            n = len(out)
            yield pa.RecordBatch.from_pydict(_table([0] * n, [b for b, _ in out], [low] * n, [thin] * n, [x for _, x in out]))
            yield pa.RecordBatch.from_pydict(_spans(1, spans, nd))

        for batch in batches:
            for rows, data, at in C.slices(batch, "text"):
                doc = rows.column("doc_id").to_numpy(zero_copy_only=False)
                for s in range(0, max(len(data), 1), SEGMENT if len(at) == 2 else max(len(data), 1)):  # a long text is a slice of its own
                    part = data[s : s + SEGMENT + length - 1] if len(at) == 2 else data
                    held.append(_anchors(part, np.array([0, len(part)]) if len(at) == 2 else at, doc, length))
                    held[-1]["pos"] += s
                size = sum(map(len, held))
                if 2 * size >= C.FLUSH_ROWS:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()

    return run


_ASK = np.dtype([("doc", "<i8"), ("key", "<u8"), ("start", "<i8"), ("n", "<i8"), ("hot", "u1")])


def _reduce(length, nd):
    """Kind 1: spans of a document; kind 2: the fragments that suffix sorting needs, by document."""

    def run(table: pa.Table) -> pa.Table:
        if table["kind"][0].as_py() == 1:
            spans = C.unpacked([x for c in table["rows"].chunks for x in c], _SPAN)
            return pa.table(_spans(1, _merged(spans["doc"], spans["start"], spans["end"]), nd))
        rows = np.concatenate([_wide(*x) for x in zip(table["low"].to_pylist(), table["thin"].to_pylist(), (x for c in table["rows"].chunks for x in c), strict=True)])
        rows, spans = _collapse(rows, length)
        new = np.concatenate(([True], rows["key"][1:] != rows["key"][:-1]))
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group]
        rows, many = rows[many > 1], many[many > 1]
        ask = np.empty(len(rows), _ASK)
        ask["hot"] = many > HOT
        ask["doc"], ask["key"], ask["start"], ask["n"] = rows["doc"], rows["key"], rows["pos"] - rows["left"], rows["left"].astype(np.int64) + rows["right"]
        return pa.concat_tables([pa.table(_spans(1, spans, nd)), pa.table(_by_doc(2, ask, ask["doc"], nd))])

    return run


_WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("start", "<i8")])


def _windows(raw: np.ndarray, asks: np.ndarray, doc: int, length: int) -> np.ndarray:
    """Of hot fragments each window of a text once, by 128 bits of its bytes."""
    at = np.unique(np.concatenate([np.arange(s, s + n - length + 1) for s, n in zip(asks["start"].tolist(), asks["n"].tolist(), strict=True)]))
    out = np.empty(len(at), _WINDOW)
    out["doc"], out["start"] = doc, at
    for name, data in (("h1", raw), ("h2", _OTHER[raw])):
        out[name] = C.Rolling(data).spans(at, at + length)
    # the second is of other bytes, each with its neighbour, so that no pair of texts has both alike by one cause
    out["h2"] = C.mixed(out["h2"] + C.Rolling(raw[::-1].copy()).spans(len(raw) - at - length, len(raw) - at) * np.uint64(0x9E3779B97F4A7C15))
    return out


_OTHER = np.random.default_rng(5).permutation(256).astype(np.uint8)


def _earliest(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of equal windows, and all others."""
    rows = rows[np.lexsort((rows["start"], rows["doc"], rows["h2"], rows["h1"]))]
    new = np.concatenate(([True], (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1]))) if len(rows) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)) if len(rows) else np.zeros(0, int)
    later = (rows["doc"] != rows["doc"][head]) | (rows["start"] != rows["start"][head])
    return rows[new], rows[later]


def _fragments(nb, nd, length):
    """Kind 0: the asked fragments of each document, packed by anchor; kind 3: the windows of hot ones, by hash, of equal ones the earliest; kind 1: spans of the others."""

    def run(batches):
        hot = []

        def flush():
            first, later = _earliest(np.concatenate(hot))
            out = list(C.packed((C.mixed(first["h1"]) % np.uint64(nb)).astype(np.int64), first))
            yield rows_of(3, [b for b, _ in out], [None] * len(out), [x for _, x in out])
            spans = _spans(1, _merged(later["doc"], later["start"], later["start"] + length), nd)
            yield rows_of(1, spans["bucket"].to_pylist(), [None] * len(spans["bucket"]), spans["rows"].to_pylist())

        def rows_of(kind, buckets, heads, blobs):
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(buckets), pa.int32()), pa.array(buckets, pa.int32()), pa.array(heads, pa.binary()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "head", "bytes"])

        for batch in batches:
            held: dict[int, list[tuple[int, int, int, bytes]]] = {}
            for doc, text, asks in zip(batch["doc_id"].to_pylist(), batch["text"], batch["asks"].to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                a = np.frombuffer(asks, _ASK)
                some = a[(a["hot"] > 0) & (a["n"] >= length)]
                if len(some):
                    hot.append(_windows(np.frombuffer(raw, np.uint8), some, doc, length))
                a = a[a["hot"] == 0]
                for b, key, s, n in zip((C.mixed(a["key"]) % np.uint64(nb)).tolist(), a["key"].tolist(), a["start"].tolist(), a["n"].tolist(), strict=True):
                    held.setdefault(b, []).append((key, doc, s, raw[s : s + n]))
            ks = list(held)
            yield rows_of(0, ks, [np.array([x[:3] + (len(x[3]),) for x in held[k]], np.int64).tobytes() for k in ks], [b"".join(x[3] for x in held[k]) for k in ks])
            if sum(map(len, hot)) > C.FLUSH_ROWS:
                yield from flush()
                hot = []
        if hot:
            yield from flush()

    return run


def _sort(length, nd):
    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"][0].as_py()
        if kind == 1:
            spans = C.unpacked([x for c in table["bytes"].chunks for x in c], _SPAN)
            return pa.table(_spans(1, _merged(spans["doc"], spans["start"], spans["end"]), nd))
        if kind == 3:
            _, later = _earliest(C.unpacked([x for c in table["bytes"].chunks for x in c], _WINDOW))
            return pa.table(_spans(1, _merged(later["doc"], later["start"], later["start"] + length), nd))
        head = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 4) for x in table["head"].to_pylist()])
        data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        at = np.cumsum(head[:, 3]) - head[:, 3]
        order = np.argsort(head[:, 0], kind="stable")
        head, at = head[order], at[order]
        same = np.concatenate((np.flatnonzero(np.diff(head[:, 0])) + 1, [len(head)]))
        sizes = np.cumsum(head[:, 3] + 1)
        out, first = [], 0
        while first < len(head):
            base = sizes[first - 1] if first else 0
            k = np.searchsorted(sizes[same - 1], base + SORT_BYTES, "right")
            last = int(same[max(k - 1, np.searchsorted(same, first, "right"))]) if len(same) else len(head)
            out.append(_classes(head[first:last], at[first:last], data, length))
            first = last
        return pa.table(_spans(1, _merged(*np.concatenate(out).T), nd))

    return run


def _classes(head: np.ndarray, at: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Spans of the 100-byte strings that start later than an equal one in these fragments."""
    n = head[:, 3]
    place = np.cumsum(n + 1) - n - 1
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
    text = np.zeros(int((n + 1).sum()), np.int16)
    text[place[owner] + within] = data[at[owner] + within].astype(np.int16) + 1
    suffixes, common = two_stage(text, max(105, length + 5))
    frag = np.searchsorted(place, suffixes, "right") - 1
    offset = suffixes - place[frag]
    long = n[frag] - offset >= length
    # a suffix with fewer bytes left than length parts classes: its neighbours on both sides cannot be equal across it
    new = ~(long & np.concatenate(([False], long[:-1])) & (common >= length))
    cls = np.cumsum(new)
    keep = long
    cls, doc, start = cls[keep], head[frag[keep], 1], head[frag[keep], 2] + offset[keep]
    if not len(cls):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((start, doc, cls))
    cls, doc, start = cls[order], doc[order], start[order]
    first = np.maximum.accumulate(np.where(np.concatenate(([True], cls[1:] != cls[:-1])), np.arange(len(cls)), 0))
    later = (doc != doc[first]) | (start != start[first])
    return _merged(doc[later], start[later], start[later] + length)


def _cut(digests):
    def run(batches):
        for batch in batches:
            n, gone, spans, kept = [], [], [], []
            for text, blob in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                runs = np.frombuffer(blob or b"", _SPAN)
                ends = [0, *runs["end"].tolist()]
                rest = b"".join([raw[a:b] for a, b in zip(ends, [*runs["start"].tolist(), len(raw)], strict=True)])
                n.append(len(raw))
                gone.append(len(raw) - len(rest))
                spans.append(len(runs))
                kept.append(hashlib.sha256(rest).hexdigest() if digests else rest)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string() if digests else pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, digests: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes of each text that no earlier string of `length` bytes repeats.

    kept is the rest in bytes (cuts may split a character), or its SHA-256 (digests). Null texts count as empty. Rows
    without an id have no place in the order and are left out; rows that repeat an id and its text share its spans, different
    texts of one id are texts of their own. No rows give none; other columns are ignored. Texts of any length are read in
    segments.
    """
    spark = docs.sparkSession
    nb = C.buckets(spark)
    docs, names = C.keyed(docs, id_col, text_col)
    nd = max(8, nb // 8)
    mapped = docs.mapInArrow(_map(length, nb, nd), _OUT)
    # kind 0 is grouped by the anchors' buckets, kind 1 by the documents'
    reduced = C.durable(mapped.groupBy("kind", "bucket").applyInArrow(_reduce(length, nd), _OUT))
    asks = C.durable(reduced.where("kind = 2").groupBy("bucket").applyInArrow(_each_doc(_ASK, False), "doc_id long, rows binary"))
    fragments = docs.join(asks, "doc_id").select("doc_id", "text", F.col("rows").alias("asks")).mapInArrow(_fragments(nb, nd, length), "kind int, bucket int, head binary, bytes binary")
    sorted_ = C.durable(fragments.groupBy("kind", "bucket").applyInArrow(_sort(length, nd), _OUT))
    parts = [x.where("kind = 1").select("bucket", "rows") for x in (reduced, sorted_)]
    spans = C.durable(parts[0].unionByName(parts[1]).groupBy("bucket").applyInArrow(_each_doc(_SPAN, True), "doc_id long, rows binary"))
    both = docs.join(spans.withColumnRenamed("rows", "spans"), "doc_id", "left").select("doc_id", "text", "spans")
    out = both.mapInArrow(_cut(digests), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digests else 'binary'}")
    return C.renamed(out, names, "doc_id").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
