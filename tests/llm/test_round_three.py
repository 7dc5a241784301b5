"""Packing, importance resampling, the Merkle manifest and the scope of intermediate tables, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from whetstone.llm import common, merkle, packing, resampling


def _rows(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


# packing


def _library_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(_library_ids, "held"):
        _library_ids.held = Tokenizer.from_file(packing.default_vocabulary())
        _library_ids.held.encode_special_tokens = True
    return [*_library_ids.held.encode(text or "", add_special_tokens=False).ids, 1]


def _check_pieces(pieces, docs, length):
    """Every id of every document lies in one piece, and pieces fill sequences from 0 up to a length that needs no padding."""
    by_sequence, by_place = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == p.length > 0
        by_sequence[p.sequence_id].append(p)
        by_place[p.doc_id, p.doc_tokens].append(p)
    for ps in by_sequence.values():
        end = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == end
            end += p.length
        assert end == length or end & (end - 1) == 0
    want = Counter((d, tuple(_library_ids(t))) for d, t, *_ in docs)
    got = Counter()
    for (doc, total), ps in by_place.items():
        starts = defaultdict(list)
        for p in ps:
            starts[p.start].append(p)
        while starts:  # repeated rows have the same pieces, cut alike or not
            at, ids = 0, []
            while at < total:
                p = starts[at].pop()
                if not starts[at]:
                    del starts[at]
                ids += p.ids
                at += p.length
            got[doc, tuple(ids)] += 1
    assert got == want


def test_pack_odd(odd_docs, no_docs):
    docs = _rows(odd_docs)
    _check_pieces(packing.pack(odd_docs).collect(), docs, 2048)
    _check_pieces(packing.pack(odd_docs, length=16).collect(), docs, 16)
    assert packing.pack(no_docs).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd_docs, length=1000)


def test_pack_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _check_pieces(packing.pack(docs).collect(), _rows(docs), 2048)
    digests = {(r.doc_id, r.start): r.ids_crc32 for r in packing.pack(docs, digests=True).collect()}
    for r in packing.pack(docs).collect():
        assert digests[r.doc_id, r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    seqs = packing.sequences(packing.pack(docs)).collect()
    assert sum(r.padding for r in seqs) == 0
    assert sum(len(r.ids) for r in seqs) == sum(len(_library_ids(r.text)) for r in docs.collect())


def test_sum_of_squares_placement():
    """Each placement is the one that a search over all open windows gives."""
    rng = np.random.default_rng(3)
    done = []
    packer = packing.Packer(64, done.append)
    for i, size in enumerate(rng.integers(1, 64, 3000).tolist()):
        counts = {h: len(packer.at[h]) for h in range(1, 64)}

        def squares(h, size=size, counts=counts):
            after = dict(counts)
            if h:
                after[h] -= 1
            if h + size < 64:
                after[h + size] += 1
            return sum(n * n for k, n in after.items() if k & (k - 1))

        best = min((squares(h), -h) for h in range(64 - size + 1) if h == 0 or counts[h])
        assert packer.level(size) == -best[1]
        packer.add(packing.Piece(i, 0, np.full(size, 7, np.int32), size))
    packer.close()
    assert sum(len(p.ids) for w in done for p in w) == int(np.random.default_rng(3).integers(1, 64, 3000).sum())


def test_pour_bounds_open_windows(monkeypatch):
    monkeypatch.setattr(packing, "OPEN", 50)
    done = []
    packer = packing.Packer(64, done.append)
    for i in range(1000):  # no two of these fit together
        packer.add(packing.Piece(i, 0, np.zeros(33, np.int32), 33))
        assert packer.open < 50
    packer.close()
    assert sum(len(p.ids) for w in done for p in w) == 33_000
    assert all((n := sum(len(p.ids) for p in w)) & (n - 1) == 0 for w in done)


# importance resampling


def _features(text, least, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize(("least", "most"), [(1, 1), (1, 3), (2, 2)])
def test_resampled(spark, odd_docs, no_docs, sf_dir, least, most):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bucket = lambda f: zlib.crc32(f.encode()) % 500
    s = Counter(bucket(f) for r in _rows(odd_docs) for f in _features(r[1], least, most)[1])
    t = Counter(bucket(f) for r in target.collect() for f in _features(r.text, least, most)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 500) / ((s[b] + 1) * (t.total() + 500)))) for b in range(500)]
    want = []
    for d, text, *_ in _rows(odd_docs):
        w, f = _features(text, least, most)
        h = int(hashlib.sha256(f"2024:{'-' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        want.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((x for x in want if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0], x[1]))
    drawn = len(able) * 10 // 100
    want = Counter([(*x[:4], i + 1 if i < drawn else None) for i, x in enumerate(able)] + [(*x[:4], None) for x in want if x[4] < 20])
    got = Counter(tuple(r) for r in resampling.resampled(odd_docs, target, least=least, most=most, buckets=500).collect())
    assert got == want
    assert drawn > 2
    assert resampling.resampled(no_docs, target).count() == 0
    assert resampling.resampled(odd_docs, no_docs, least=least, most=most).count() == odd_docs.count()


def test_features_and_tokens_of_slices():
    """Slices of a batch give what the same texts give alone."""
    import pyarrow as pa

    texts = [None if i % 7 == 3 else f"Wörd{i}! ÉCOLE it's {i} " * (i % 5) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(43)), pa.array(["é" * 9, None, "x", *texts])], names=["doc_id", "text"]).slice(3)
    ids, at, counts, tokens = [], [], [], packing.WordTokens(packing.default_vocabulary())
    for rows, data, edges in common.slices(batch, "text", 100):
        assert rows.num_rows < 40
        h, n, words = resampling.features(common.whole(data, edges), 1, 1, 1 << 32)
        counts += list(zip(np.split(h, np.cumsum(n)[:-1]), words.tolist(), strict=True))
        i, a = tokens(common.whole(data, edges), 1)
        ids += [i[x:y].tolist() for x, y in zip(a[:-1], a[1:], strict=True)]
    assert [(h.tolist(), n) for h, n in counts] == [([zlib.crc32(f.encode()) for f in _features(t, 1, 1)[1]], len(_features(t, 1, 1)[0])) for t in texts]
    assert ids == [_library_ids(t) for t in texts]


def test_sample_prefers_target(spark, sf_dir):
    """Documents that hold passages of the target are drawn far more often than others."""
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drawn = resampling.sample(docs, target, percent=20)
    assert set(drawn.columns) == set(docs.columns)
    rows = resampling.resampled(docs, target, percent=20).collect()
    assert drawn.count() == sum(r["rank"] is not None for r in rows)
    mean = lambda x: sum(x) / len(x)
    assert mean([r.weight for r in rows if r["rank"]]) > mean([r.weight for r in rows if not r["rank"]])


# Merkle manifest


def _h(*parts):
    return hashlib.sha256("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts).encode()).hexdigest()


def _tree(leaves, fan_out):
    """Root and each leaf's proof, as the text of its siblings."""
    proofs, of, level = [""] * len(leaves), list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, at in enumerate(of):
            first = at - at % fan_out
            proofs[i] += "".join(x for j, x in enumerate(level[first : first + fan_out], first) if j != at)
        level = [hashlib.sha256("".join(level[i : i + fan_out]).encode()).hexdigest() for i in range(0, len(level), fan_out)]
        of = [at // fan_out for at in of]
    return level[0], proofs


@pytest.mark.parametrize("fan_out", [8, 2, 3])
def test_merkle(odd_docs, no_docs, fan_out):
    parts = defaultdict(list)
    for d, text, lang, source, n in _rows(odd_docs):
        other = text and re.sub("[A-Z]", lambda m: m[0].lower(), text)
        parts[lang].append((d, _h(d, source, lang, n, text), _h(d, source, lang, n, other)))
    langs = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    for x in parts.values():
        x.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1]))
    tops = [_tree([x[1] for x in parts[p]], fan_out) for p in langs]
    root, above = _tree([t[0] for t in tops], fan_out)
    want = Counter()
    for p, (subroot, proofs), over in zip(langs, tops, above, strict=True):
        for (d, leaf, other), proof in zip(parts[p], proofs, strict=True):
            want[d, leaf, subroot, root, hashlib.sha256((proof + over).encode()).hexdigest(), leaf == other] += 1
    out = merkle.audited(odd_docs, {"text": merkle.lower_ascii(odd_docs["text"])}, fan_out=fan_out).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.verified) for r in out) == want
    assert all((r.folded_root == root) == r.verified for r in out)
    assert merkle.audited(no_docs).count() == 0


def test_merkle_one_part(spark):
    one = spark.createDataFrame([(1, "s", None, 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")
    (r,) = merkle.audited(one).collect()
    assert r.leaf == r.subroot == r.root == _h(1, "s", None, 3, "abc") and r.verified and r.proof_sha256 == hashlib.sha256(b"").hexdigest()


# shared helpers


def test_numbered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") % 10).cast("string").alias("k"), (F.col("id") * 7919 % 5000).alias("v")).withColumn("k", F.when(F.col("k") != "3", F.col("k")))
    rows = common.numbered(df, [F.col("v")], "k").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.k].append((r.i, r.v))
    for x in by.values():
        assert [i for i, _ in sorted(x)] == list(range(len(x)))
        assert [v for _, v in sorted(x)] == sorted(v for _, v in x)
    assert sorted(r.i for r in common.numbered(df, [F.desc("v")]).collect()) == list(range(5000))


def test_intermediates_are_scoped(spark):
    df = spark.range(10)
    held = common.durable(df)
    with common.intermediates(spark) as outer:
        mine = common.durable(df)
        with common.intermediates(spark) as inner:
            common.durable(df)
        assert len(inner) == 1 and len(outer) == 1
        assert mine.count() == 10
    assert held.count() == 10  # written outside, so it stays
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|not exist"):
        mine.count()


# quality rules: copies and strata


def _measured(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, stratum string, h long, base_failed boolean, symbols double, dup_lines double, repeats double, upper double, word_length double")


def test_copies_buy_no_confidence(spark):
    from whetstone.llm import rules

    once = [(i, "en", i, False, 0.01, 0.0, 0.0, 0.0, 5.0) for i in range(500)]
    labels = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    few, many = (rules.cutoffs(_measured(spark, once * k), labels).first() for k in (1, 10))
    assert few == many and many["n"] == 500 and many["cut_symbols"] == math.inf


def test_stratum_bounds(spark):
    """The bound is the exact binomial one of the stratum's own rows."""
    from whetstone.llm import rules

    sizes = {"en": (4000, 3), "fr": (300, 0), "de": (200, 2), "xx": (0, 0)}
    rows, i = [(10**6, "xx", 0, False, 0.5, 0.0, 0.0, 0.0, 5.0)], 0
    for k, (n, bad) in sizes.items():
        for j in range(n):
            rows.append((i, k, i, False, 0.25 if j < bad else 0.01, 0.0, 0.0, 0.0, 5.0))
            i += 1
    labels = spark.range(i).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    df = _measured(spark, rows)
    cuts = df.select("stratum").distinct().withColumns({"tested_as": F.lit("all"), "n": F.lit(4500)} | {f"cut_{r}": F.lit(0.2 if r == "symbols" else math.inf) for r in rules.CUTOFFS} | {f"rejected_{r}": F.lit(0) for r in rules.CUTOFFS})
    got = {(r.stratum, r.rule): r for r in rules.stratum_bounds(df, labels, cuts).collect()}
    level = 0.05 / (4 * len(rules.CUTOFFS))
    for k, (n, bad) in sizes.items():
        x = got[k, "symbols"]
        assert (x.n, x.rejected) == (n, bad) and got[k, "upper"].bound == 0
        if not n:
            assert x.bound == 1
            continue
        tail = math.fsum(math.comb(n, j) * x.bound**j * (1 - x.bound) ** (n - j) for j in range(bad + 1))
        assert math.isclose(tail, level, rel_tol=1e-5)


def test_long_pieces(monkeypatch):
    """Pieces in flat arrays give the ids of the lists, and of the library."""
    import base64
    from random import Random

    import tiktoken

    from whetstone.llm import bpe

    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    c, r = bpe.codec(path, pattern), Random(2)
    for text in ["".join(r.choice("abcdefgh") for _ in range(300)), "z" * 777, "é🙂ab" * 90, "".join(r.choice("aé東x") for _ in range(500)), " " * 300]:
        want = c.piece(text.encode())
        monkeypatch.setattr(bpe, "LONG", 10)
        assert list(c.piece(text.encode())) == list(want)
        assert np.frombuffer(c.encode(text), "<u4").tolist() == known.encode_ordinary(text)
        monkeypatch.undo()


def test_line_verdicts_do_not_follow_size(spark):
    """What becomes of two lines does not depend on how many others there are."""
    from whetstone.llm import lines

    r = random.Random(21)
    rows = []
    for i in range(150):  # few long words, one of them with another letter: near by edits, but with a third of the words apart
        w = ["".join(r.choice("bcdfghjklm") for _ in range(12)) for _ in range(5)]
        rows.append((2 * i, " ".join(w)))
        w[r.randrange(5)] += "x"
        rows.append((2 * i + 1, " ".join(w)))
    many = [(1000 + i, "\n".join(" ".join("".join(r.choice("npqrstvwz") for _ in range(6)) for _ in range(6)) for _ in range(200))) for i in range(200)]
    of = lambda some: {(x.doc_id, x.keep_doc) for x in lines.line_verdicts(spark.createDataFrame(some, "doc_id long, text string").repartition(4)).where("doc_id < 1000").collect()}
    alone = of(rows)
    assert len(alone) > 100 and alone == of(rows + many)
