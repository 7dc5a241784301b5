"""What workers hold at once does not follow the batches that they are given."""

import random

import numpy as np
import pyarrow as pa

from whetstone.llm import common, lines


def _near(n, chars):
    """(a, b, na, nb) of pairs, every other one near."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    other, out = str.maketrans("abcdefgh", "pqrstuvw"), []
    for i in range(n):
        x = " ".join(word() for _ in range(chars // 8))
        out.append((2 * i, 2 * i + 1, x, x + "y" if i % 2 else x.translate(other)))
    return pa.RecordBatch.from_pylist([dict(zip(("a", "b", "na", "nb"), x, strict=True)) for x in out])


def test_lines_are_verified_in_pieces(monkeypatch):
    """A batch of many pairs or long lines is compared piece by piece, with the same result."""
    held, codes = [], lines._codes
    monkeypatch.setattr(lines, "_codes", lambda texts: held.append((len(texts), sum(map(len, texts)))) or codes(texts))
    for batch in (_near(5000, 16), _near(40, 120_000)):
        got = pa.Table.from_batches(lines._verify([batch])).to_pydict()
        odd = [i for i in range(batch.num_rows) if i % 2]
        assert sorted(got["a"]) == [2 * i for i in odd] and sorted(got["b"]) == [2 * i + 1 for i in odd]
    assert max(n for n, _ in held) <= 2 * lines.PIECE_PAIRS
    assert max(c for _, c in held) <= lines.PIECE_BYTES


def test_pieces_hold_every_pair_once():
    r = np.random.default_rng(3)
    size = r.integers(0, 3000, 10_000)
    size[[0, 77, 9999]] = 5_000_000  # longer than a piece
    cuts = list(lines._pieces(size))
    assert [x for i, j in cuts for x in range(i, j)] == list(range(len(size)))
    assert all(j - i == 1 or size[i:j].sum() <= lines.PIECE_BYTES for i, j in cuts)
    assert list(lines._pieces(size[:0])) == []


def test_lean_gives_back_once_the_batches_are_over(monkeypatch):
    said = []

    class Pool:
        def release_unused(self):
            said.append("released")

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    assert list(common.lean(lambda batches: (said.append(b) or b for b in batches))(iter([1, 2]))) == [1, 2]
    assert said == [1, 2, "released"]
