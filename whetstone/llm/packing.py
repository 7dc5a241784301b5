"""Sum-of-squares online packing of tokenised documents into windows of a fixed length.

Each task tokenises the documents of its partition and packs them as they come, without a shuffle. It tracks how many
open windows stand at each fill level; a document goes into the level (or a new window) after which the sum of squared
counts over the levels is least, which keeps every level rare and so lets windows fill up exactly. Full windows leave at
once. What is still open at the end, or beyond a bound, is poured together by cutting documents.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whetstone.llm import common as C

#: Tokens in a window, and the id that ends a document.
LENGTH, EOS = 2048, 1
#: Open windows at which a task pours them together before it goes on: bounds its memory to some 32 MB of ids.
OPEN = 4096
#: Words and ids that a worker remembers.
MEMO_WORDS, MEMO_IDS = 800_000, 8_000_000
#: Rows in a batch of results.
BATCH_ROWS = 8192
#: Marks that end words, a word of basic Latin and Latin-1 letters (one piece to the tokenizer), and the bytes of texts in a slice.
_MARKS, _LETTERS, _SLICE = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+"), 4_000_000
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_LOADED: dict[str, WordTokens] = {}


class WordTokens:
    """Ids of whole texts by a tokenizer that drops white space: each distinct run of other characters is encoded once and looked up after."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.count, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.ids = np.zeros(1 << 18, np.int32)

    def _put(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.number), len(self.number) + len(words)
        while last > len(self.start):
            self.start, self.count = np.concatenate((self.start, self.start)), np.concatenate((self.count, self.count))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, self.ids))
        self.count[first:last] = sizes
        self.start[first:last] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.number.update(zip(words, range(first, last), strict=True))

    def _numbers(self, column: pa.Array) -> np.ndarray:
        """The number of each word of a column, once it is encoded."""
        coded = column.dictionary_encode()
        words = coded.dictionary.to_pylist()
        if new := [w for w in words if w not in self.number]:
            one = [bool(_LETTERS.fullmatch(w)) for w in new]
            plain, rest = list(itertools.compress(new, one)), [w for w, x in zip(new, one, strict=True) if not x]
            for first in range(0, len(plain), 256):  # words that are one piece each, as one text
                got = self.tokenizer.encode_batch([" ".join(plain[first : first + 256])], add_special_tokens=False)[0]
                self._put(plain[first : first + 256], np.array(got.ids, np.int32), np.bincount(np.array(got.word_ids, np.int64)))
            found = [x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._put(rest, np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum())), sizes)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]

    def _halves(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words without the marks at their end, and the marks, where a letter or digit of ASCII stands before them: these are pieces of their own.

        Heads of ASCII are in lower case, as the tokenizer will make them; other words stay whole.
        """
        data, at = C.raw(words)
        head, until = C.raw(pc.ascii_rtrim(words, characters=_MARKS))
        size = np.diff(until)
        last = head[np.maximum(until[1:], 1) - 1] if len(head) else np.zeros(len(size), np.uint8)
        size = np.where((size > 0) & _ALNUM[last], size, np.diff(at))
        tail_size = np.diff(at) - size
        ends = np.concatenate(([0], np.cumsum(size))), np.concatenate(([0], np.cumsum(tail_size)))
        inside = np.repeat(at[1:] - tail_size, np.diff(at)) > np.arange(len(data))
        high = np.concatenate(([0], np.cumsum(data >= 0x80)))
        ascii_ = np.repeat(high[at[1:]] == high[at[:-1]], np.diff(at))
        folded = np.where(ascii_ & (data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        parts = ((folded[inside], ends[0]), (data[~inside], ends[1]))
        return tuple(pa.LargeStringArray.from_buffers(len(e) - 1, pa.py_buffer(e.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(d))) for d, e in parts)

    def __call__(self, texts: pa.Array, eos: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each ended by eos, and their offsets by text."""
        if len(self.number) > MEMO_WORDS or self.used > MEMO_IDS:
            self.forget()
        lists = pc.split_pattern_regex(texts, r"[\x20\x09-\x0D]+")
        of_text = np.diff(np.asarray(lists.offsets))
        coded = lists.flatten().dictionary_encode()
        both = [self._numbers(x) for x in self._halves(coded.dictionary)]
        # each word is two runs of ids, its head and its marks; each text has one more for its eos
        word = coded.indices.to_numpy(zero_copy_only=False)
        slots = 2 * len(word) + len(of_text)
        begin, size = np.full(slots, -1, np.int64), np.ones(slots, np.int64)
        place = 2 * np.arange(len(word)) + np.repeat(np.arange(len(of_text)), of_text)
        for side, number in enumerate(both):
            begin[place + side], size[place + side] = self.start[number][word], self.count[number][word]
        end = np.cumsum(size)
        own = np.flatnonzero(begin < 0)
        begin[own] = 0
        ids = self.ids[np.repeat(begin - (end - size), size) + np.arange(int(end[-1]) if slots else 0)]
        ids[end[own] - 1] = eos
        return ids, np.concatenate(([0], end[own]))


def word_tokens(path: str) -> WordTokens:
    """One for each worker process and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Piece:
    """A run of a document's ids."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> Piece:
        """The last n ids as a piece of their own; this one keeps the rest."""
        keep = len(self.ids) - n
        tail = Piece(self.doc, self.start + keep, self.ids[keep:], self.total)
        self.ids = self.ids[:keep]
        return tail


class Packer:
    """The level array of one task. `full` gets the pieces of each window that is done.

    Levels that are powers of two count nothing, as a window of that length needs no padding; neither do empty and full ones.
    """

    def __init__(self, length: int, full: Callable[[list[Piece]], None]):
        self.length, self.full = length, full
        self.free = np.array([h & (h - 1) == 0 or h == length for h in range(length + 1)])
        self._empty()

    def _empty(self) -> None:
        self.at: list[list[list[Piece]]] = [[] for _ in range(self.length + 1)]
        self.open = 0
        # change of the sum of squares when a window comes to a level, and when it leaves one; a new window leaves level 0
        self.come = np.where(self.free, 0, 1).astype(np.int64)
        self.leave = np.full(self.length + 1, 1 << 60, np.int64)
        self.leave[0] = 0

    def _counted(self, h: int) -> None:
        n = len(self.at[h])
        self.come[h] = 0 if self.free[h] else 2 * n + 1
        self.leave[h] = 0 if h == 0 else 1 << 60 if n == 0 else 0 if self.free[h] else 1 - 2 * n

    def level(self, size: int) -> int:
        """The level to place a document of `size` on; of equal ones the fullest."""
        change = self.come[size:] + self.leave[: self.length - size + 1]
        return self.length - size - int(np.argmin(change[::-1]))

    def add(self, piece: Piece) -> None:
        while len(piece.ids) > self.length:  # whole windows of a long document
            rest = piece.cut(len(piece.ids) - self.length)
            self.full([piece])
            piece = rest
        h = self.level(len(piece.ids))
        window = self.at[h].pop() if h else []
        window.append(piece)
        self.open += h == 0
        if h:
            self._counted(h)
        h += len(piece.ids)
        if h == self.length:
            self.open -= 1
            self.full(window)
            return
        self.at[h].append(window)
        self._counted(h)
        if self.open >= OPEN:
            rest = self.pour()
            self._empty()
            if rest:
                h = sum(len(p.ids) for p in rest)
                self.at[h].append(rest)
                self._counted(h)
                self.open = 1

    def pour(self) -> list[Piece]:
        """Lets open windows that would need padding fill each other up, the fullest from the emptiest; gives the one that is left."""
        open_ = [w for h in range(self.length - 1, 0, -1) for w in self.at[h] if not self.free[h]]
        for h in np.flatnonzero(self.free[: self.length]).tolist():
            for w in self.at[h]:
                self.full(w)
        i, j = 0, len(open_) - 1
        while i < j:
            space = self.length - sum(len(p.ids) for p in open_[i])
            while space and i < j:
                last = open_[j].pop()
                taken = last if len(last.ids) <= space else last.cut(space)
                if taken is not last:
                    open_[j].append(last)
                open_[i].append(taken)
                space -= len(taken.ids)
                if not open_[j]:
                    j -= 1
            if not space:
                self.full(open_[i])
                i += 1
        return open_[i] if i == j and i < len(open_) else []

    def close(self) -> None:
        """Ends all windows; the one that is left is cut into lengths that are powers of two."""
        rest = self.pour()
        left = sum(len(p.ids) for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            window, left = [], left - size
            while size:
                first = rest.pop(0)
                if len(first.ids) > size:
                    rest.insert(0, first.cut(len(first.ids) - size))
                window.append(first)
                size -= len(first.ids)
            self.full(window)
        self._empty()


def pack(docs: DataFrame, length: int = LENGTH, eos: int = EOS, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), a row for each piece; digests: ids_crc32 instead of ids.

    Every row is a document: its ids, then eos. A null or empty text is the eos alone; null ids and repeated rows are rows
    like others; a document longer than `length` fills whole windows first, whatever its size; ties of levels go to the fullest.
    No rows give none; other columns are ignored. Pieces of a sequence follow each other from offset 0. A sequence holds
    `length` ids or a power of two, so none needs padding. Sequence ids start from the number of the partition, so
    they agree in reruns over the same partitions. `vocabulary` is a tokenizers file of a tokenizer that drops white space;
    the path must exist on every worker. `length` must be a power of two.
    """
    if length < 2 or length & (length - 1):
        raise ValueError("length must be a power of two")
    path = vocabulary or default_vocabulary()
    shape = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()) if digests else ("ids", pa.list_(pa.int32())), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, sequence = word_tokens(path), TaskContext.get().partitionId() << 33
        done: list[tuple] = []

        def full(window: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for p in window:
                done.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()) if digests else p.ids, p.total, sequence, offset))
                offset += len(p.ids)
            sequence += 1

        def out() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [[]] * len(shape)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)
            done.clear()
            return batch

        packer = Packer(length, full)
        for batch in batches:
            for rows, data, edges in C.slices(batch, "text", _SLICE):
                ids, at = tokens(C.whole(data, edges), eos)
                for doc, a, b in zip(rows.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    # a copy, so that an open window does not hold the ids of a whole slice
                    packer.add(Piece(doc, 0, ids[a:b].copy() if b - a < length else ids[a:b], b - a))
                    if len(done) >= BATCH_ROWS:
                        yield out()
        packer.close()
        yield out()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), C.text_column(docs, text_col).alias("text"))
    kinds = "ids_crc32 long" if digests else "ids array<int>"
    return rows.mapInArrow(run, f"doc_id long, start long, length long, {kinds}, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids, doc_ids, padding) from what `pack` gives with ids: the windows as a trainer reads them.

    padding is how many ids are short of `length`, none at a power of two. A group holds at most `length` ids.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n"))
    power = F.bit_count(F.col("n")) == 1
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.when(power, F.lit(0)).otherwise(length - F.col("n")).cast("long").alias("padding"))
