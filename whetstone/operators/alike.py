"""Values whose sets of 3-grams are alike, by parts of the sets that must be equal.

Two sets of a and b grams whose Jaccard similarity reaches `least` differ in few grams, at most `slack` by a + b. Grams are dealt by their hash into
parts; so many of them that however the differing grams lie, some parts are equal in both. A value is sent once for each choice of that many
parts, and values that meet are compared where they meet: first by a word of bits, then by their grams. Nothing is left to chance.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Grams of a set at most; values whose keys, and pairs that are compared, are held at once; what fills rows of grams up.
MOST, VALUES, PAIRS, NONE = 24, 40_000, 100_000, np.iinfo(np.int64).max
#: Of a value and a choice of parts; `lower` only where it differs from the value. Rows go in compressed blocks, one for each task, as a row by itself costs the shuffle far more than what it holds.
ROW = pa.schema({"key": pa.uint32(), "choice": pa.int16(), "value": pa.string(), "lower": pa.string()})
SCHEMA = "task int, rows binary"


@cache
def slack(least: float) -> np.ndarray:
    """By a and b, up to MOST each: how many grams in all may be in one of the sets only; -1 where no two such sets are alike."""
    out = np.full((MOST + 1, MOST + 1), -1)
    for a in range(1, MOST + 1):
        for b in range(1, MOST + 1):
            shared = [o for o in range(1, min(a, b) + 1) if o / (a + b - o) >= least]
            out[a, b] = a + b - 2 * shared[0] if shared else -1
    return out


@cache
def layouts(least: float) -> tuple[np.ndarray, dict[int, tuple[int, list[tuple[int, ...]]]]]:
    """By a and b the layout that such sets meet in, -1 for none; of each layout its parts and the choices of them.

    A layout is the most grams that sets of its sizes may differ in, or fewer, taken over all smaller sizes, so that a value is in few layouts.
    """
    d = slack(least)
    up_to = np.zeros(2 * MOST + 1, int)
    for s in range(1, 2 * MOST + 1):
        up_to[s] = max([up_to[s - 1], 1, *(int(d[a, s - a]) for a in range(max(1, s - MOST), min(MOST, s - 1) + 1))])
    sums = np.add.outer(np.arange(MOST + 1), np.arange(MOST + 1))
    of = np.where(d >= 0, up_to[sums], -1)
    parts = {}
    for x in sorted({*of[of >= 0].tolist()}):
        n = x + EQUAL.get(x, 2)
        parts[x] = (n, list(combinations(range(n), n - x)))
    return of, parts


#: Parts of a layout that must be equal, two but for these.
EQUAL = {1: 3, 2: 3, 3: 3, 4: 3}


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well spread bits of each number."""
    x = x.astype(np.uint64)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): the distinct 3-grams of each text, in order, as numbers of 21 bits a character; a shorter text is its own gram. Those of text i end at ends[i + 1]."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(size)])
    points = np.concatenate([np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1, np.zeros(3, np.int64)])
    count = np.maximum(size - 2, 1)
    row = np.repeat(np.arange(len(texts)), count)
    i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + at[row]
    there = lambda k: np.where(i + k < at[row + 1], points[i + k], 0)
    code = (there(0) << 42) + (there(1) << 21) + there(2)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return code[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(texts)))])


def keys(least: float, tasks: int):
    """Of batches (value, lower) a row for each choice of parts of each value of up to MOST grams, in blocks by task."""
    of, parts = layouts(least)
    within = {x: (of == x).any(1) for x in parts}

    def keyed(b: pa.Table) -> tuple[np.ndarray, pa.Table]:
        """The task of each row, in order, and the rows."""
        code, ends = grams(b["lower"].to_pylist())
        n = np.diff(ends)
        keep = np.flatnonzero(n <= MOST)
        hashes = _mixed(code)
        row, key, choice = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int16)]
        for x, (p, choices) in parts.items():
            rows = keep[within[x][n[keep]]]
            part = (hashes >> np.uint64(20)) % np.uint64(p)
            sums = [_mixed(np.add.reduceat(np.where(part == j, hashes, np.uint64(0)), ends[:-1])[rows] + np.uint64(j + 1)) for j in range(p)]
            for c, chosen in enumerate(choices):
                row.append(rows)
                key.append(_mixed(sum((sums[j] for j in chosen), np.zeros(len(rows), np.uint64)) + np.uint64(x * 1000 + c)))
                choice.append(np.full(len(rows), x * 1000 + c, np.int16))
        row, key, choice = np.concatenate(row), np.concatenate(key), np.concatenate(choice)
        task = ((key >> np.uint64(3)) % np.uint64(tasks)).astype(np.int32)
        order = np.argsort(task, kind="stable")
        row, key, choice = row[order], (key[order] >> np.uint64(32)).astype(np.uint32), choice[order]
        b = b.take(pa.array(row)).combine_chunks()
        other = pc.if_else(pc.equal(b["value"], b["lower"]), pa.scalar(None, pa.string()), b["lower"])
        return task[order], pa.table([pa.array(key), pa.array(choice), b["value"], other], schema=ROW)

    def run(batches):
        for table in gathered(batches):
            task, rows = keyed(table)
            first = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])[: len(task)])
            blocks = [_packed(rows.slice(x, y - x)) for x, y in zip(first.tolist(), [*first[1:].tolist(), len(task)], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(task[first], pa.int32()), pa.array(blocks, pa.binary())], names=["task", "rows"])

    def gathered(batches):
        held = []
        for b in batches:
            held += [b] if b.num_rows else []
            if sum(x.num_rows for x in held) >= VALUES:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    return run


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, ROW, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    return out.getvalue().to_pybytes()


def unpacked(blocks) -> pa.Table:
    return pa.concat_tables([ROW.empty_table(), *(pa.ipc.open_stream(x.as_buffer()).read_all() for x in blocks)])


def met(least: float):
    """Of a task's blocks the alike pairs (a, b, similarity), each under the first choice that it meets by."""
    d, (of, parts) = slack(least), layouts(least)

    def alike(value, lower, choice, i, j):
        """Of candidate rows i and j."""
        rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        code, ends = grams([lower[x] for x in rows.tolist()])
        n = np.diff(ends)
        sets = np.full((len(rows), MOST), NONE)
        sets[np.repeat(np.arange(len(rows)), n), np.arange(len(code)) - np.repeat(ends[:-1], n)] = code
        a, b = at[: len(i)], at[len(i) :]
        both = np.sort(np.concatenate([sets[a], sets[b]], axis=1), axis=1)
        shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != NONE)).sum(1)
        similarity = shared / (n[a] + n[b] - shared)
        good = np.flatnonzero((similarity >= least) & (both[:, 0] != NONE))
        i, j, a, b, similarity = i[good], j[good], a[good], b[good], similarity[good]
        first = np.ones(len(i), bool)  # a pair may meet by several choices
        for x, (p, choices) in parts.items():
            here = np.flatnonzero(choice[i] // 1000 == x)
            if not len(here):
                continue
            own, two = np.unique(np.concatenate([a[here], b[here]]), return_inverse=True)
            hashes = _mixed(sets[own])
            part = np.where(sets[own] == NONE, p, (hashes >> np.uint64(20)) % np.uint64(p))
            same = np.stack([(s := np.where(part == q, hashes, np.uint64(0)).sum(1))[two[: len(here)]] == s[two[len(here) :]] for q in range(p)], axis=1)
            earliest = np.full(len(here), len(choices))
            for c in range(len(choices) - 1, -1, -1):
                earliest[same[:, choices[c]].all(1)] = c
            first[here] = earliest == choice[i[here]] % 1000
        i, j, similarity = i[first], j[first], similarity[first]
        pairs = [(min(v), max(v)) for v in zip((value[x] for x in i.tolist()), (value[x] for x in j.tolist()), strict=True)]
        return pa.table({"a": pa.array([v[0] for v in pairs], pa.string()), "b": pa.array([v[1] for v in pairs], pa.string()), "similarity": pa.array(similarity, pa.float64())})

    def run(blocks: pa.Table) -> pa.Table:
        table = unpacked(x for c in blocks["rows"].chunks for x in c)
        key = table["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        twin = np.zeros(len(key), bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:]
        order, key = order[twin], key[twin]
        some = table.take(pa.array(order))
        choice = some["choice"].to_numpy().astype(int)
        value, lower = some["value"].to_pylist(), pc.coalesce(some["lower"], some["value"]).to_pylist()
        n, bits = np.zeros(len(key), int), np.zeros(len(key), np.uint64)
        for x in range(0, len(key), PAIRS):
            code, ends = grams(lower[x : x + PAIRS])
            n[x : x + PAIRS] = np.diff(ends)
            bits[x : x + PAIRS] = np.bitwise_or.reduceat(np.uint64(1) << (_mixed(code) >> np.uint64(58)), ends[:-1])
        out, held, lag, i = [], [], 1, np.arange(len(key))
        while True:
            i = i[: np.searchsorted(i, len(key) - lag)]
            i = i[key[i] == key[i + lag]]  # equal keys are side by side
            if len(i):
                na, nb = n[i], n[i + lag]
                near = i[(of[na, nb] == choice[i] // 1000) & (choice[i] == choice[i + lag]) & (np.bitwise_count(bits[i] ^ bits[i + lag]) <= d[na, nb])]
                held.append((near, near + lag))
            if held and (not len(i) or sum(len(x) for x, _ in held) >= PAIRS):
                left, right = (np.concatenate(x) for x in zip(*held, strict=True))
                out += [alike(value, lower, choice, left[x : x + PAIRS], right[x : x + PAIRS]) for x in range(0, len(left), PAIRS)]
                held = []
            if not len(i):
                return pa.concat_tables(out) if out else pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
            lag += 1

    return run
