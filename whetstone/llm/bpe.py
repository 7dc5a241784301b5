"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Bytes map to Latin-1 characters, so that an Aho-Corasick automaton finds the tokens at every place of a piece. A piece is
encoded by taking the longest token at each place and backtracking where it may not follow the token before it: two
adjacent tokens are compatible if merging them again, in order of rank, gives the same two (memoised for each pair). That
reproduces the merges exactly in linear time. Frequent pieces are looked up.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from whetstone.llm import common as C

#: Pieces that a worker remembers, twice as many pairs of tokens, and the longest such piece in bytes. Idle workers keep them beside later stages.
MEMO, MEMO_BYTES = 150_000, 64
#: Bytes of a piece from which it is encoded in flat arrays.
LONG = 4096
_LOADED: dict[tuple[str, str], Codec] = {}


class Codec:
    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern).findall
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {i: t for t, i in self.rank.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.token}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for t, i in sorted(self.rank.items(), key=lambda x: x[1]):
            parts = self._merge(t, i) if len(t) > 1 else [i]
            if len(parts) == 2:
                self.halves[i] = (parts[0], parts[1])
                self.merged[parts[0], parts[1]] = i
            elif len(parts) == 1:
                self.halves[i] = (i, i)
        self.found = ahocorasick.Automaton()
        for t, i in self.rank.items():
            if i in self.halves:
                self.found.add_word(t.decode("latin-1"), (len(t), i))
        self.found.make_automaton()
        self.memo: dict[str, bytes] = {}
        self.joins: dict[tuple[int, int], bool] = {}

    def _merge(self, t: bytes, below: int) -> list[int]:
        """The merges of ranks under `below`, lowest first: what a token is made of."""
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], below))
            if self.rank.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.rank[p] for p in parts]

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b before both are complete: undoes their merges, latest first."""
        known = self.joins.get((a, b))
        if known is not None:
            return known
        x, y, limit, good = a, b, 1 << 62, True
        while True:
            across = self.merged.get((x, y))
            if across is not None and across < limit:
                good = False
                break
            if x > y:  # x was made later: its right half stood at the border before
                limit, half = x, self.halves[x][1]
                if half == x:
                    limit, half = y + 1, self.halves[y][0]
                    if half == y:
                        break
                    y = half
                else:
                    x = half
            else:
                limit, half = y + 1, self.halves[y][0]
                if half == y:
                    limit, half = x, self.halves[x][1]
                    if half == x:
                        break
                    x = half
                else:
                    y = half
        if len(self.joins) > 2 * MEMO:
            self.joins.clear()
        self.joins[a, b] = good
        return good

    def piece(self, raw: bytes) -> list[int]:
        if raw in self.rank:
            return [self.rank[raw]]
        if len(raw) > LONG:
            return self._long_piece(raw)
        at: list[list[tuple[int, int]]] = [[] for _ in raw]  # tokens from each place, shortest first
        for end, (n, i) in self.found.iter(raw.decode("latin-1")):
            at[end - n + 1].append((n, i))
        for x in at:
            x.sort()
        open_, out, pos, size = [True] * (len(raw) + 1), [], 0, len(raw)
        choice = [len(x) - 1 for x in at]
        while pos < size:
            k = choice[pos]
            while k >= 0:
                n, i = at[pos][k]
                if open_[pos + n] and (not out or self._compatible(out[-1][1], i)):
                    break
                k -= 1
            if k >= 0:
                choice[pos] = k
                out.append((n, i))
                pos += n
                if pos < size:
                    choice[pos] = len(at[pos]) - 1
            else:
                open_[pos] = False
                n, _ = out.pop()
                pos -= n
                choice[pos] -= 1
        return [i for _, i in out]

    def _long_piece(self, raw: bytes) -> array:
        """The same in flat arrays, some 25 bytes for each token that the automaton finds."""
        size, seen = len(raw), array("i")
        for end, (n, i) in self.found.iter(raw.decode("latin-1")):
            seen.extend((end - n + 1, n, i))
        m = np.frombuffer(seen, np.int32).reshape(-1, 3)
        m = m[np.lexsort((m[:, 1], m[:, 0]))]  # by place, shortest first
        first = array("i", np.searchsorted(m[:, 0], np.arange(size + 1)).astype(np.int32).tobytes())
        length, token = array("i", m[:, 1].tobytes()), array("i", m[:, 2].tobytes())
        del seen, m
        open_, choice, taken = bytearray(b"\x01") * (size + 1), array("i", bytes(4 * size)), array("i")
        pos, choice[0] = 0, first[1] - 1
        while pos < size:
            k = choice[pos]
            while k >= first[pos]:
                if open_[pos + length[k]] and (not taken or self._compatible(token[taken[-1]], token[k])):
                    break
                k -= 1
            if k >= first[pos]:
                choice[pos] = k
                taken.append(k)
                pos += length[k]
                if pos < size:
                    choice[pos] = first[pos + 1] - 1
            else:
                open_[pos] = 0
                pos -= length[taken.pop()]
                choice[pos] -= 1
        return array("i", [token[k] for k in taken])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo, out = self.memo, []
        for p in self.pieces(text):
            got = memo.get(p)
            if got is None:
                raw = p.encode("utf-8", "surrogatepass")
                got = b"".join([self.packed[i] for i in self.piece(raw)])
                if len(raw) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[p] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process and vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Codec(path, pattern)
    return _LOADED[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None, digests: bool = False) -> DataFrame:
    """Of each row: doc_id, n_tokens, ids (little-endian 32-bit) and the decoded bytes; or the SHA-256 of both (digests).

    Null texts count as empty and have no tokens. Null ids and repeated rows are rows like others; ties do not arise. Texts of any
    length are encoded whole, each in one task. No rows give none; other columns are ignored and may have any names. The vocabulary is
    (path of a rank file, pattern of pieces); the path must exist on every worker.
    """
    path, pattern = vocabulary or default_vocabulary()

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            texts = batch.column("text")
            for first in range(0, batch.num_rows, 256):
                part = texts.slice(first, 256)
                ids, n, one, two = batch.column("doc_id").slice(first, 256), [], [], []
                for t in part:
                    x = c.encode(t.as_py() or "")
                    y = c.decode(x)
                    n.append(len(x) // 4)
                    one.append(hashlib.sha256(x).hexdigest() if digests else x)
                    two.append(hashlib.sha256(y).hexdigest() if digests else y)
                kind = pa.string() if digests else pa.binary()
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(one, kind), pa.array(two, kind)], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    kind = "string" if digests else "binary"
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), C.text_column(docs, text_col).alias("text"))
    return rows.mapInArrow(C.lean(run), f"{names[0]} long, {names[1]} long, {names[2]} {kind}, {names[3]} {kind}")
