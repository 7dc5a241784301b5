"""Operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from whetstone.llm import bpe, chat, embeddings, jaccard, lines, mixing, quality_cnn, rules, sharding, suffix
from whetstone.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, kind string, a int, n int, h1 string, __k int"


def _prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgéßñ") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    long = _prose(1, 40_000)
    base = _prose(2, 120)
    near = base.replace(base.split()[7], "changed")
    lined = "\n".join(_prose(i, 12) for i in range(6))
    return {
        0: None, 1: "", 2: " \n\t ", 3: "one", 4: "Two words", 5: base, 6: base, 7: near, 8: long, 9: long + " tail", 10: lined,
        11: lined.replace("\n", "\r\n", 1), 12: "a" * 1000, 13: "a" * 1000 + "b", 14: "same same same same same same same", 15: _prose(5, 200) + base, 16: "\x00" + "é🙂" * 80, 17: "é🙂" * 80,
    }


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, 1, "k", 2, 3, "h", 4) for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, None if i == 3 else int(i % 3 > 0), 0, "x") for i in range(18)] + [(None, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def _with_odd_rows(spark, docs):
    """A row without an id and a row twice."""
    odd = spark.createDataFrame([(None, "no id here", "en", "s1", 1, 1, "k", 2, 3, "h", 4)], DOCS)
    return docs.unionByName(odd).unionByName(docs.where("doc_id = 5"))


def _sets(texts):
    out = {}
    for i, t in texts.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def _classes(nodes, links):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 8), (5, 5), (4, None), (100, 3), *((i, i + 1) for i in range(1000, 1200))]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 100: 1, 8: 8, 9: 8, **{i: 1000 for i in range(1000, 1201)}}


def test_jaccard(spark, docs, texts, none):
    sets = _sets(texts)
    ids = sorted(sets)
    want = _classes(ids, [(a, b) for a in ids for b in ids if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in ids}
    assert jaccard.jaccard_classes(_with_odd_rows(spark, docs)).count() == len(ids) + 1
    assert jaccard.jaccard_classes(none).count() == 0


def test_one_id_two_texts(spark):
    """Different texts of one id are documents of their own, in each operator that orders or links by id."""
    a, b = _prose(60, 60), _prose(61, 40)
    near = " ".join(b.split()[:-1] + ["other"])
    df = spark.createDataFrame([(5, a), (5, b), (9, near), (9, near), (7, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df).collect())
    assert got == [(5, 36, 5), (5, 56, 5), (7, 56, 5), (9, 36, 5), (9, 36, 5)]
    kept = sorted((r.doc_id, r.n_removed > 0) for r in suffix.without_repeats(df).collect())
    assert kept == [(5, False), (5, False), (7, True), (9, True), (9, True)]
    kept = sorted((r.doc_id, r.n_removed) for r in lines.dedup_lines(df).collect())
    assert kept == [(5, 0), (5, 0), (7, 1), (9, 1), (9, 1)]


def test_hot_anchor(spark):
    """A passage in so many documents, each time in other words, that its anchor is split by window."""
    r = random.Random(4)
    passage = _prose(70, 24)[:110]
    texts = {i: f"{r.random()} {r.random()} {r.random()} {r.random()} {passage} {r.random()} {r.random()} {r.random()} {r.random()}" for i in range(suffix.HOT + 2000)}
    seen, want = set(), {}
    for i in range(len(texts)):
        t = texts[i].encode()
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - 99):
            h = hash(t[j : j + 100])
            if h in seen:
                gone[j : j + 100] = True
            seen.add(h)
        want[i] = int(gone.sum())
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.n_removed for x in suffix.without_repeats(df).collect()} == want and sum(want.values()) > 10**6


def test_long_text_in_segments(spark):
    text = _prose(71, 30_000)
    a, b = (suffix._anchors(np.frombuffer(x, np.uint8), np.array([0, len(x)]), np.array([1]), 100) for x in (text.encode(), text.encode()[: 1 << 16]))
    assert set(b["pos"].tolist()) <= set(a["pos"].tolist()) | set(b["pos"][-2:].tolist())


def test_jaccard_large_groups(spark):
    """Near copies beyond the size of a star, a passage that many share, and small sets at the threshold."""
    r = random.Random(3)
    base = _prose(50, 150).split()
    passage = _prose(51, 60)
    texts = {}
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    for i in range(60, 140):
        texts[i] = _prose(i, r.randint(10, 150)) + " " + passage
    for i in range(140, 200):
        w = _prose(7, 14).split()[: r.randint(5, 14)]
        texts[i] = " ".join(w + [f"y{r.randrange(4)}"] * r.randint(0, 2))
    sets = _sets(texts)
    ids = sorted(sets)
    want = _classes(ids, [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {x.doc_id: x.component_id for x in jaccard.jaccard_classes(df).collect()} == want


def test_suffix(spark, docs, texts, none):
    seen, want = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                gone[j : j + 100] = True
            seen.add(b[j : j + 100])
        want[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.without_repeats(docs).collect()}
    assert got == want
    assert suffix.without_repeats(_with_odd_rows(spark, docs)).count() == len(texts) + 1
    assert suffix.without_repeats(none).count() == 0


def test_two_stage():
    rng = np.random.default_rng(1)
    for trial in range(30):
        t = rng.integers(1, int(rng.integers(2, 5)) + 1, int(rng.integers(1, 300))).astype(np.int16)
        t = np.concatenate([t, [0], t[3:], [0]] if trial % 3 and len(t) > 5 else [t, [0]]).astype(np.int16)
        order, common = suffix.two_stage(t)
        long = np.concatenate((t, np.zeros(120, np.int16)))
        keys = [tuple(long[i : i + 105]) for i in order]
        assert sorted(order) == list(range(len(t))) and keys == sorted(keys)
        for k in range(1, len(t)):
            same = next((j for j in range(105) if keys[k][j] != keys[k - 1][j]), 105)
            assert common[k] == same


def test_lines(spark, docs, texts, none):
    a, b = "The quick brown fox jumps over the lazy dog near the river bank today", "A wholly different sentence about sorting many records by their key columns"
    rows = [(3, f"{b}\nshort\nshort"), (1, f"{a}\nshort\n{a}"), (2, f"{a.upper()}  \n{b}\n{a} and then some more words follow which are not the same at all"), (4, None), (5, "")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (3, 1, f"{a}\nshort") and got[2][:2] == (3, 1) and got[3] == (3, 3, "")
    assert got[4] == (1, 0, "") and got[5] == (1, 0, "")
    assert lines.dedup_lines(_with_odd_rows(spark, docs)).count() == len(texts) + 1
    assert lines.dedup_lines(none).count() == 0


def test_near_lines(spark):
    """Lines within the bits and the edit similarity form a class; brute force over all pairs."""
    r = random.Random(9)
    base = [_prose(i, 60) for i in range(4)]
    rows = []
    for i in range(120):
        w = r.choice(base).split()
        w[r.randrange(60)] = r.choice(["qq", "zz", w[0]])
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    text = dict(rows)

    def distance(a, b):
        b, steps = np.array(list(b)), np.arange(len(b) + 1)
        row = steps
        for x in a:
            row = np.concatenate((row[:1] + 1, np.minimum(row[1:] + 1, row[:-1] + (b != x))))
            row = np.minimum.accumulate(row - steps) + steps
        return row[-1]

    links = [(a, b) for a in text for b in text if a < b and distance(text[a], text[b]) <= len(max(text[a], text[b], key=len)) // 10]
    want = _classes(text, links)
    assert {x.doc_id for x in lines.dedup_lines(df).where("n_removed = 0").collect()} == {i for i in text if want[i] == i}


def _near(a, b):
    """Edit similarity of 0.9 or more, by the furthest place on each diagonal, one pair at a time."""
    most = max(len(a), len(b)) // 10
    far = {0: 0}
    for e in range(most + 1):
        for d, i in far.items():
            while i < len(a) and i + d < len(b) and a[i] == b[i + d]:
                i += 1
            far[d] = i
        if far.get(len(b) - len(a), -1) >= len(a):
            return True
        far = {d: min(max(far.get(d, -9) + 1, far.get(d + 1, -9) + 1, far.get(d - 1, -9)), len(a), len(b) - d) for d in range(-e - 1, e + 2)}
        far = {d: i for d, i in far.items() if i >= 0 and i + d >= 0}
    return False


def test_near_lines_recall(spark, sf_dir):
    """Of the near pairs among all lines of the documents, found by edit distance alone, at least nine in ten are in one group."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where(F.length("text") < 20_000)
    norm = lambda x: re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ")))
    first = {}
    for r in docs.orderBy("doc_id").collect():
        for i, x in enumerate((r.text or "").split("\n")):
            if norm(x):
                first.setdefault(norm(x), (r.doc_id, i))
    texts = [x for x in first if len(x) <= 1500]
    bags = np.array([np.bincount([ord(c) % 64 for c in x], minlength=64) for x in texts], np.int16)
    grams = np.array([np.bincount([(31 * ord(a) + 7 * ord(b)) % 256 for a, b in zip(x, x[1:], strict=False)], minlength=256) for x in texts], np.int16)
    n = np.array([len(x) for x in texts])
    pairs = []
    for i in range(len(texts)):
        most = np.maximum(n, n[i]) // 10
        near = np.flatnonzero((np.abs(n - n[i]) <= most) & (np.abs(bags - bags[i]).sum(1) <= 2 * most))
        near = near[np.abs(grams[near] - grams[i]).sum(1) <= 4 * most[near]]  # an edit changes two pairs of neighbours on either side at most
        pairs += [(i, j) for j in near.tolist() if j > i and most[j] and _near(texts[i], texts[j])]
    of = {(r.doc_id, r.line): (r.keep_doc, r.keep_line) for r in lines.line_verdicts(docs).collect()}
    at = [first[x] for x in texts]
    found = sum(of.get(at[i], at[i]) == of.get(at[j], at[j]) for i, j in pairs)
    assert len(pairs) > 10 and found >= 0.9 * len(pairs), (found, len(pairs))


def test_near_pairs():
    """Edit similarity of many pairs at once, against the full table."""
    r = random.Random(8)
    texts = []
    for _ in range(60):
        a = "".join(r.choice("abcde ") for _ in range(r.choice([0, 1, 9, 10, 11, 40, 130])))
        b = list(a)
        for _ in range(r.randint(0, 14)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 2)] = r.choice(["", "a", "xé"])
        texts += [a, "".join(b)]
    x, y = np.divmod(np.arange(len(texts) ** 2), len(texts))
    got = lines.near_pairs(*lines._codes(texts), x, y)
    for i, j, ok in zip(x.tolist(), y.tolist(), got.tolist(), strict=True):
        a, b = texts[i], texts[j]
        row = list(range(len(b) + 1))
        for k, c in enumerate(a, 1):
            row, prev = [k], row
            for m, d in enumerate(b, 1):
                row.append(min(prev[m] + 1, row[-1] + 1, prev[m - 1] + (c != d)))
        assert ok == (row[-1] <= max(len(a), len(b)) // 10), (a, b)


def test_near_lines_without_bits(spark):
    """Every line within the edit similarity of another goes with it, whatever bits their SimHashes differ in."""
    r = random.Random(12)
    rows = []
    for i in range(150):  # pairs of which the second has one or two other words
        w = _prose(1000 + i, r.randint(12, 60)).split()
        rows.append((2 * i, " ".join(w)))
        for _ in range(r.randint(1, 2) if len(w) > 30 else 1):
            w[r.randrange(len(w))] = f"w{r.randrange(100)}"
        rows.append((2 * i + 1, " ".join(w)))
    near = [i for i in range(150) if _near(rows[2 * i][1], rows[2 * i + 1][1])]
    gone = {x.doc_id for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("n_removed > 0").collect()}
    assert len(near) > 100 and gone <= {2 * i + 1 for i in near} and len(gone) >= 0.98 * len(near)


def test_mixing(spark, docs, texts, none):
    got = mixing.mix(docs).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    assert {r.doc_id: r["size"] for r in got} == size
    assert all(r.taken <= 2 * r["size"] for r in got) and abs(sum({r.source_size: r.target for r in got}.values()) - 1.5 * sum(size.values())) < 1e-6
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(_with_odd_rows(spark, docs)).count() == len(texts) + 2
    assert mixing.mix(none).count() == 0


def test_mixing_targets(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 60), None if i % 7 == 0 else f"s{i % 5}") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    got["source"] = got["doc_id"].map({i: s or "~" for i, _, s in rows})
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    sizes, weight = by["size"].to_dict(), dict(zip(sorted(by.index), [5, 2, 1, 5, 2, 1], strict=True))
    open_, left, target = set(sizes), 1.5 * sum(sizes.values()), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    for s in sizes:
        assert math.isclose(by.target[s], target[s], rel_tol=1e-9) and abs(by.taken[s] - target[s]) <= 60


def test_sharding(spark, docs, texts, none):
    odd = _with_odd_rows(spark, docs)
    got = sharding.shard(odd).collect()
    assert len(got) == len(texts) + 2 and all(r.law == "bytes" and r.grown_shard is None for r in got)
    for r in got:
        if r.doc_id is not None:
            b = (texts[r.doc_id] or "").encode()
            assert r["size"] == len(b) + 16 and r.text_crc32 == zlib.crc32(b)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    of = {r.doc_id: r.shard for r in got}
    assert of[5] == of[6] and of[0] == of[1]
    assert sharding.shard(none).count() == 0
    r = random.Random(1)
    many = spark.createDataFrame([(i, _prose(i % 900, r.randint(1, 9))) for i in range(3000)], "doc_id long, text string")
    loads = [x["s"] for x in sharding.shard(many).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(loads) == 40 and max(loads) - min(loads) < 0.1 * max(loads)


def test_longest_first():
    items = [(i, s) for i, s in enumerate([7, 7, 6, 6, 5, 4, 4])]
    placed = sharding.longest_first(items, 3)
    loads = [sum(s for i, s in items if placed[i] == k) for k in range(3)]
    assert sorted(loads) == [12, 12, 15]


def test_chat(spark, none):
    t = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"), (3, 0, "user", "hi"), (3, 1, "assistant", "hello"), (3, 2, "user", "bye"), (4, 0, None, None), (5, None, "user", "x"), (5, 1, "user", ""), (None, 0, "user", "lost"), (6, 0, "user", "hello"), *((7, i, "user", f"m{i}") for i in range(600)), *((8, i, "user", f"m{i}") for i in range(599)), (9, 3, "user", "tie"), (9, 3, "user", "tie")]
    got = {(r.conv_id, r.part): (r.n_turns, r.text) for r in chat.formatted(spark.createDataFrame([(*x, 1, "p") for x in t], "conv_id long, turn int, role string, text string, pos int, part string")).collect()}
    assert set(got) == {(2, 0), (4, 0), (5, 0), (6, 0), (7, 0), (7, 1), (7, 2), (9, 0)}
    assert got[2, 0] == (3, "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nbye\n") and got[4, 0] == (1, "<||>\n\n") and got[5, 0][1] == "<|user|>\nx\n<|user|>\n\n"
    assert "".join(got[7, i][1] for i in range(3)) == "".join(f"<|user|>\nm{i}\n" for i in range(600))
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_rules(spark, docs, texts, labels, no_labels, none):
    want = {}
    for i, t in texts.items():
        t = t or ""
        w, seen, cover = WORD.findall(t), {}, set()
        for j in range(len(w) - 4):
            seen.setdefault(tuple(w[j : j + 5]), []).append(j)
        for at in seen.values():
            if len(at) > 1:
                cover.update(k for j in at for k in range(j, j + 5))
        ls = [x for x in t.split("\n") if WORD.search(x)]
        want[i] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))
    got = {r.doc_id: tuple(r)[1:7] for r in rules.judged(docs, labels).collect()}
    assert got == want
    assert {r.doc_id for r in rules.judged(docs, no_labels).where("kept").collect()} == {i for i, x in want.items() if not x[5]}
    assert rules.judged(_with_odd_rows(spark, docs), labels).count() == len(texts) + 2
    assert rules.judged(none, labels).count() == 0


def test_cutoffs(spark):
    """A cutoff that would reject clean rows does not hold; one that rejects few enough does."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("stratum"), F.lit(False).alias("base_failed"), F.when(F.col("id") % 10 == 0, 0.12).otherwise(0.01).alias("symbols"), F.lit(0.0).alias("dup_lines"), F.lit(0.0).alias("repeats"), F.lit(0.0).alias("upper"), F.lit(5.0).alias("word_length"))
    cut = rules.cutoffs(rows, spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))).first()
    assert cut["cut_symbols"] == 0.13 and cut["cut_upper"] == 0.30
    few = rules.cutoffs(rows.limit(100), spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))).first()
    assert few["cut_symbols"] == math.inf


def test_cutoffs_of_small_strata(spark):
    """Strata too small to certify anything alone are tested together; a large one stays by itself."""
    def cut(sizes):
        n = sum(sizes.values())
        lang = [k for k, v in sizes.items() for _ in range(v)]
        rows = spark.createDataFrame([(i, k, False, 0.01, 0.0, 0.0, 0.0, 5.0) for i, k in enumerate(lang)], "doc_id long, stratum string, base_failed boolean, symbols double, dup_lines double, repeats double, upper double, word_length double")
        return {r["stratum"]: (r["tested_as"], r["n"], r["cut_symbols"], r["rejected_symbols"]) for r in rules.cutoffs(rows, spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))).collect()}

    assert cut({"en": 2000, "fr": 500, "de": 500, "es": 300}) == {k: ("small", 3300, 0.03, 0) for k in ("en", "fr", "de", "es")}
    assert cut({"en": 6000, "fr": 500, "de": 400}) == {"en": ("en", 6000, 0.03, 0), "fr": ("all", 6900, 0.03, 0), "de": ("all", 6900, 0.03, 0)}
    assert cut({"en": 200, "fr": 100}) == {k: ("all", 300, math.inf, 0) for k in ("en", "fr")}


def test_binomial_tail(spark):
    cases = [(0, 1000, 0.002), (3, 4000, 0.002), (5, 30, 0.3), (0, 5, 0.5), (190, 120_000, 0.002)]
    for k, n, p in cases:
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got = spark.createDataFrame([(k, n)], "k long, n long").select(rules.binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
        assert math.isclose(got, want, rel_tol=1e-8)


def test_bpe(spark, docs, texts, none):
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.tokenised(docs).collect()}
    for i, t in texts.items():
        want = known.encode_ordinary(t or "")
        assert got[i].n_tokens == len(want) and bytes(got[i].ids) == np.array(want, "<u4").tobytes() and bytes(got[i].decoded) == (t or "").encode()
    c = bpe.codec(path, pattern)
    r = random.Random(5)
    for _ in range(300):
        t = "".join(r.choice("aabehinorst 'é漢🙂\n0") for _ in range(r.randint(0, 80))).replace(" ", "", r.randint(0, 9))
        assert np.frombuffer(c.encode(t), "<u4").tolist() == known.encode_ordinary(t)
    assert bpe.tokenised(_with_odd_rows(spark, docs)).count() == len(texts) + 2
    assert bpe.tokenised(none).count() == 0


def test_classifier(spark, docs, texts, labels, no_labels, none, sf_dir):
    got = quality_cnn.scored(docs, labels).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in texts}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality_cnn.scored(_with_odd_rows(spark, docs), no_labels).count() == len(texts) + 2
    assert quality_cnn.scored(none, labels).count() == 0


def test_classifier_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_cnn.scored(spark.read.parquet(f"{d}/documents.parquet"), marks).join(marks, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9 and got[got.quality == 1].predicted.mean() > 0.97


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    x = [base[i % 40] + 0.15 * rng.standard_normal(16) * (i > 40) for i in range(400)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(1000, rows[3][1]), (1001, [float(2 * y) for y in rows[3][1]]), (1002, None), (1003, [0.0] * 16), (1004, [None] + [1.0] * 15), (1005, [float("nan")] * 16), (1006, [1.0] * 8), (1007, [1.0] * 8), (1008, []), (None, rows[3][1]), rows[3]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, dim int").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect()}
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = []
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95:
                links.append((a, b))
    ids = [i for i in {r[0] for r in rows} if i is not None]
    want, n = _classes(ids, links), {i: 0 for i in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    found = sum(x[0] for x in got.values()) / max(1, 2 * len(links))
    assert len(links) > 100 and 0.98 <= found <= 1
    if found == 1:
        assert got == {i: (n[i], want[i], want[i] == i) for i in ids}
    assert embeddings.near_vectors(df.where("false")).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.01]), (4, [0.01, 1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_vectors(two).collect())) == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False)]


def test_embedding_growth():
    """Chance meetings stay few a vector as vectors grow, and the least count grows with them."""
    for n in (10_000, 200_000, 10**9):
        drawn, outer, least = embeddings.calibrated(n, 64, 0.95)
        assert drawn == embeddings.LINES and n * math.comb(outer, least) ** 2 <= embeddings.CHANCE * math.comb(embeddings.LINES, least) * 2**least


def test_pipeline(spark, sf_dir):
    """Each stage against the brute force of its operator on the stage's own input."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stage = docs.columns, dict(p.STAGES)
    kept = stage["quality_rules"](spark, docs, sf_dir)
    assert kept.columns == columns and 0 < kept.count() <= docs.count()
    lined = stage["line_dedup"](spark, kept, sf_dir)
    assert lined.columns == columns
    texts = {r.doc_id: r.text for r in lined.collect()}
    sets = _sets(texts)
    ids = sorted(sets)
    want = _classes(ids, [(a, b) for a in ids for b in ids if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    single = stage["near_duplicates"](spark, lined, sf_dir)
    assert {r.doc_id for r in single.select("doc_id").collect()} == {i for i in ids if want[i] == i}
    mixed = stage["mixing"](spark, single, sf_dir)
    assert mixed.columns == columns and mixed.count() > 0
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    out = p.run(spark, sf_dir).collect()
    by = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in mixed.collect()}
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed.collect()) and all(r.decoded_sha256 == by[r.doc_id] for r in out)


ODD = "doc_id long, text string, lang string, source string, n_removed int, kept string, row int, h string, __kept string, again int, copies int, held string, n int, id string"


def test_stages_on_odd_tables(spark, sf_dir, texts):
    """Nulls, repeated rows, clashing column names, no n_chars and no rows, in every stage but the last."""
    import corpus_pipeline as p

    rows = [(i, t, "en", f"s{i % 3}", i, "k", i, "h", "x", 1, 2, "held", 3, "id") for i, t in texts.items() if i not in (8, 9)]
    rows += [(None, "no id", None, None, *rows[0][4:]), (20, None, None, None, *rows[0][4:])] + rows[3:8]
    df = spark.createDataFrame(rows, ODD)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns and stage(spark, df.where("false"), sf_dir).count() == 0
        got = [tuple(r) for r in out.collect()]
        if name == "near_duplicates":
            assert len(set(got)) == len(got)
        if name != "line_dedup":
            assert set(got) <= set(rows)
    lined = p.line_dedup(spark, spark.createDataFrame([(1, "one line", *rows[0][2:])] * 3 + [(2, "another one", *rows[0][2:])], ODD), sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in lined) == [(1, "one line")] * 3 + [(2, "another one")]
    assert p.tokens(spark, df, sf_dir).count() == len(rows) and p.tokens(spark, df.where("false"), sf_dir).count() == 0


def test_kept_by_brute_force(spark):
    """The verdicts of the rules on all documents, with exact binomial bounds and fixed-sequence tests worked out in Python."""
    d = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r for r in rules.judged(docs, marks).collect()}
    clean = {r.doc_id for r in marks.where("quality = 1").collect()}
    measured = {}
    for r in docs.collect():
        t = r.text or ""
        w, g = WORD.findall(t), got[r.doc_id]
        chars, ls = sum(map(len, w)), [x for x in t.split("\n") if WORD.search(x)]
        m = {"symbols": g.n_symbols / chars if chars else 0, "dup_lines": g.n_dup_lines / len(ls) if ls else 0, "repeats": g.n_repeat_words / len(w) if w else 0, "upper": len(re.findall("[A-Z]", t)) / chars if chars else 0, "word_length": chars / len(w) if w else 0}
        measured[r.doc_id] = (r.lang or "", m)

    def tail(k, n, p):
        return math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    hold = {i: x for i, x in measured.items() if i in clean and not got[i].base_failed}
    strata = {s for s, _ in measured.values()}
    n = {s: sum(x == s for x, _ in hold.values()) for s in strata}
    small = {s for s in strata if (1 - rules.LIMIT) ** n[s] > rules.DELTA / ((len(strata) + 1) * len(rules.CUTOFFS))}
    assert small == strata  # so all are one pool
    cut = {}
    for rule, cs in rules.CUTOFFS.items():
        cut[rule] = math.inf
        for c in cs:
            if tail(sum(m[rule] > c for _, m in hold.values()), len(hold), rules.LIMIT) > rules.DELTA / len(rules.CUTOFFS):
                break
            cut[rule] = c
    assert any(math.isfinite(c) for c in cut.values())
    want = {i: not got[i].base_failed and all(m[r] <= c for r, c in cut.items()) for i, (_, m) in measured.items()}
    assert {i: r.kept for i, r in got.items()} == want
    assert sum(not got[i].base_failed and not want[i] for i in want) > 100


def test_scores_by_brute_force():
    """A text's score as plain sums over filters, places and chunks, and long texts piece by piece as whole ones."""
    r = random.Random(3)
    texts = [_prose(i, r.randint(1, 300)).encode() for i in range(40)]
    model = quality_cnn.train(texts, [i % 2 for i in range(40)])
    for t in [b"", b"ab", texts[0], texts[1] * 3]:
        data = list(t) + [0] * max(0, quality_cnn.GRAM - len(t))
        acts = [[sum(float(model["filters"][k][data[i + k]][f]) for k in range(quality_cnn.GRAM)) + float(model["shift"][f]) for f in range(quality_cnn.FILTERS)] for i in range(max(1, len(t) - quality_cnn.GRAM + 1))]
        halves = [[max(a[f] for a in acts[i : i + quality_cnn.HALF]) for f in range(quality_cnn.FILTERS)] for i in range(0, len(acts), quality_cnn.HALF)]
        chunks = [[max(0.0, x, y) for x, y in zip(p, q, strict=True)] for p, q in zip(halves, halves[1:], strict=False)] or [[max(0.0, x) for x in halves[0]]]
        f = [sum(c[i] for c in chunks) / len(chunks) for i in range(quality_cnn.FILTERS)] + [max(c[i] for c in chunks) for i in range(quality_cnn.FILTERS)]
        z = sum(a * float(b) for a, b in zip(f, model["weights"], strict=True)) + float(model["bias"][0])
        assert math.isclose(quality_cnn.score(model, t), 1 / (1 + math.exp(-z)), rel_tol=1e-3)
