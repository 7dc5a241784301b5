"""Operators on empty tables, nulls, short values, ties and zero groups, and those without SQL against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from whetstone import registry
from whetstone.functions import sqltext as Q
from whetstone.functions import text as X
from whetstone.operators import alike
from whetstone.operators import analytics as A
from whetstone.operators import documents as D
from whetstone.operators import feedback as B
from whetstone.operators import metadata as M
from whetstone.sources import catalog as S
from whetstone.sources import files
from whetstone.streaming import jobs as J


def rows(df):
    return [tuple(x) for x in df.collect()]


def test_similar_values(spark):
    r = random.Random(1)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(1, 7))) for _ in range(150)} | {"a", "é🙂", "AB"})
    grams = {w: {w.lower()[i : i + 3] for i in range(len(w) - 2)} or {w.lower()} for w in words}
    want = {(a, b) for a in words for b in words if a < b and len(grams[a] & grams[b]) >= 0.3 * len(grams[a] | grams[b])}
    values = spark.createDataFrame([(w,) for w in words] + [(None,), (words[0],)], "value string")
    assert {(x.a, x.b) for x in M.similar_values(values).collect()} == want
    found = {(x.a, x.b) for x in M.similar_values_lsh(values.where("value is not null").distinct()).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)
    assert M.similar_values(values.where("false")).count() == 0


@pytest.mark.parametrize("least", [0.6, 0.75, 0.9])
def test_similar_words(spark, least):
    """Words that meet by three grams together, by fewer, and long ones that meet by one; against brute force."""
    r = random.Random(3)
    syllables = ["er", "chen", "on", "tion", "é🙂", "ab", "a", "th"]
    words = {"".join(r.choice(syllables) for _ in range(r.randint(1, 16))) for _ in range(250)} | {"a" * n for n in range(1, 9)} | {"ab" * n for n in range(1, 6)}
    for w in sorted(words)[::2]:
        at = r.randrange(len(w))
        words.add(w[:at] + r.choice("xyß") + w[at + r.randint(0, 1) :])
    words = sorted(w for w in words if w)
    grams = {w: {w.lower()[i : i + 3] for i in range(len(w) - 2)} or {w.lower()} for w in words}
    want = {(a, b) for a in words for b in words if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= least}
    assert {len(grams[a]) > M.SHORT for a, _ in want} == {True, False}
    got = rows(M.similar_values(spark.createDataFrame([(w,) for w in words], "value string"), least))
    assert len(got) == len(want) and {x[:2] for x in got} == want


def test_candidates_are_compared_where_they_meet(spark):
    """By three grams together, far fewer short words meet than by one, and none of those pairs is shuffled before it is compared."""
    plan = M.similar_values(spark.createDataFrame([("common",), ("commune",)], "value string"), 0.75)._jdf.queryExecution().optimizedPlan().toString()
    last = plan[plan.index("Aggregate") :].split("\n")
    assert "xxhash64" in plan and any("array_intersect" in x and "Join" in x for x in last)


def test_alike_by_parts(spark):
    """Pairs that the parts of their grams bring together are written once, by far fewer meetings than words that share a syllable."""
    from itertools import product

    syllables = ["tion", "ing", "er", "heit", "che", "ó"]
    words = sorted({"".join(x) for n in (2, 3, 4) for x in product(syllables, repeat=n)})
    grams = {w: {w[i : i + 3] for i in range(len(w) - 2)} or {w} for w in words}
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.75}
    upper = [w.upper() if i % 7 == 0 else w for i, w in enumerate(words)]
    found, met = [], 0
    blocks = pa.Table.from_batches(alike.keys(0.75, 5)([pa.RecordBatch.from_pydict({"value": v, "lower": w}) for v, w in ((upper[:99], words[:99]), (upper[99:], words[99:]))]))
    for task in range(5):
        own = blocks.filter(pa.array(blocks["task"].to_numpy() == task))
        keys = alike.unpacked(own["rows"])["key"].to_numpy()
        met += sum(n * (n - 1) // 2 for n in np.unique(keys, return_counts=True)[1].tolist())
        found += alike.met(0.75)(own).to_pylist()
    lower = [tuple(sorted((x["a"].lower(), x["b"].lower()))) for x in found]
    assert len(lower) == len(want) and set(lower) == want and all(x["a"] < x["b"] and {x["a"], x["b"]} <= set(upper) for x in found)
    assert all(abs(x["similarity"] - len(grams[a] & grams[b]) / len(grams[a] | grams[b])) < 1e-12 for x, (a, b) in zip(found, lower, strict=True))
    assert met < len(words) ** 2 / 20
    plan = M.similar_values(spark.createDataFrame([("common",), ("commune",)], "value string"), 0.75)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_every_word_is_compared(spark, tmp_path):
    """Words of any length and script are compared, not only those of six ASCII letters or more."""
    texts = ["größer größere 東京 abc 1234567 Abc", "größerer 12345678 ABCD", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(registry.queries()["t2_similar_words"](spark, str(tmp_path)).select("a", "b"))
    assert sorted(got) == [("1234567", "12345678"), ("größer", "größere"), ("größere", "größerer")]


def test_profile(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, "y"), (2, None, None)], "a int, b string, c string")
    assert sorted(rows(M.profile(df))) == [("a", 2, 0.0, "1", "2"), ("b", 0, 100.0, None, None), ("c", 2, 33.33, "x", "y")]
    assert {x.column: x.distinct_count for x in M.profile(df.where("false")).collect()} == {"a": 0, "b": 0, "c": 0}


def test_formats_and_evidence(spark):
    df = spark.createDataFrame([("000123", "a@b", None, "1234"), ("000124", "", None, "12345")], "a string, b string, c string, d string")
    assert sorted(rows(M.formats(df)), key=str) == sorted([("a", "6-digit zero-padded string"), ("b", "email"), ("c", None), ("d", None)], key=str)
    e = spark.createDataFrame([(i, f"v{i % 3}", None) for i in range(30)], "n int, v string, z string")
    assert dict(rows(D.evidence(e))) == {"n": "0 to 29", "v": "v0, v1, v2", "z": ""}


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0] * 4)]
    e = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for q, v, s, k in rows(M.nearest(e.where("vec_id % 50 = 0 or vec_id > 899"), e, 4).orderBy("query_id", "rank").select("query_id", "vec_id", "similarity", "rank")):
        got.setdefault(q, []).append(v)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        assert got[q] == [i for i in np.argsort(-(u @ u[q]), kind="stable").tolist() if i != q][:4]
    assert not {900, 901, 902} & set(got)


def test_cells_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = e.where("vec_id % 50 = 0")
    true = {(x[0], x[1]) for x in rows(M.nearest(q, e, 5).select("query_id", "vec_id"))}
    found = {(x[0], x[1]) for x in rows(M.nearest_in_cells(q, e, 5).select("query_id", "vec_id"))}
    assert len(true) == 200 and len(true & found) >= 0.9 * len(true)
    assert M.nearest_in_cells(q.where("false"), e.where("false"), 5).count() == 0


def test_cells_by_products(spark, monkeypatch):
    """Similarities in cells are sums in order whatever the blocks, equal vectors tie by id, and no pair outside the k best of a block leaves its task."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 6)).astype(np.float32)
    x[300:] = x[:100]
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6)], "vec_id long, embedding array<float>")
    u = x.astype(float)
    u /= np.sqrt(sum(u[:, j] * u[:, j] for j in range(6)))[:, None]
    want = {}
    for q in range(0, 400, 50):
        s = sum(u[:, j] * u[q, j] for j in range(6))
        s[q] = -np.inf
        want[q] = [(i, s[i]) for i in np.lexsort((np.arange(400), -s))[:3].tolist()]
    for block, queries in ((8192, 30_000), (7, 3)):
        monkeypatch.setattr(M, "CORPUS_BLOCK", block)
        monkeypatch.setattr(M, "PROBING", queries, raising=False)
        found = M.nearest_in_cells(e.where("vec_id % 50 = 0"), e, 3, recall=1.0)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.similarity))
        assert got == want
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" in plan and "zip_with" not in plan


def test_cumulative_share(spark):
    data = [(i, float(v)) for i, v in enumerate([5, 5, 5, 5, 1, 0, 9] * 40)]
    got = rows(A.cumulative_share(spark.createDataFrame(data, "k int, v double"), "k", "v").orderBy(F.desc("v"), "k").select("k", "running"))
    run = 0.0
    for (k, running), (i, v) in zip(got, sorted(data, key=lambda x: (-x[1], x[0])), strict=True):
        run += v
        assert k == i and math.isclose(running, run)


def test_chunks_by_places(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["\n", "\n", ". ", ".", " ", "é🙂", "w" * 40]) for _ in range(r.randint(300, 3000))) for _ in range(20)] + [". " * 6000, "\n" * 9000, "a" * 2001 + "\n\n\n" + "b" * 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for x in D.split_long(df, ["doc_id"]).orderBy("doc_id", "part").collect():
        got.setdefault(x.doc_id, []).append((x.start, x.text))
    for i, t in enumerate(texts):
        assert got.get(i, []) == [(a, t[a:b].strip(D.SPACE)) for a, b in D.cuts(t) if t[a:b].strip(D.SPACE)]
    plan = D.split_long(df, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "spans_of(text" not in plan  # no text goes to Python


def test_chunks(spark):
    r = random.Random(4)
    texts = ["", "  ", None, "short", "x" * 9000, *("".join(r.choice(["word ", "end. ", "\n\n", "é🙂 "]) for _ in range(r.randint(500, 4000))) for _ in range(6))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for x in D.split_long(df, ["doc_id"]).orderBy("doc_id", "part").collect():
        got.setdefault(x.doc_id, []).append(x.text)
    for i, t in enumerate(texts):
        want = [t[a:b].strip(D.SPACE) for a, b in D.cuts(t or "")] if t else []
        assert got.get(i, []) == [w for w in want if w]
    assert D.cuts("a" * 3999 + "b" * 3000) == [(0, 4000), (3600, 6999)]
    assert D.cuts("a" * 3000 + "\n\n" + "b" * 3000)[0] == (0, 3002) and D.cuts("a" * 3000 + ". " + "b" * 3000)[1][0] == 2602


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n# A\ntext\n## B  \n\n####no\n# \n"), (2, ""), (3, None)], "doc_id int, text string")
    got = rows(D.sections(df, ["doc_id"]).orderBy("section").select("header", "level"))
    assert got[:3] == [("", 0), ("A", 1), ("B", 2)]
    numbered = spark.createDataFrame([(1, "top\n1. One\nx\n2. Two")], "doc_id int, text string")
    assert rows(D.sections(numbered, ["doc_id"], True).orderBy("section").select("header")) == [("",), ("One",), ("Two",)]
    long = spark.createDataFrame([(1, "# H\n" + "word. " * 2000)], "doc_id int, text string")
    assert [x.title for x in D.section_chunks(long, ["doc_id"]).orderBy("part").collect()][:2] == ["H (part 1)", "H (part 2)"]


def test_read_only(spark):
    good = ["SELECT 1", " with x as (select 1) select * from x;", "VALUES (1)", "/* a */ show tables", "SELECT 1 -- x; y"]
    bad = ["", None, "DROP TABLE x", "SELECT 1; SELECT 2", "WITH x AS (UPDATE t SET a = 1) SELECT 1", "REPLACE INTO t VALUES (1)", "REVOKE ALL"]
    df = spark.createDataFrame([(s, s in good) for s in good + bad], "s string, ok boolean")
    assert all(a == b for a, b in rows(df.select("ok", Q.read_only(F.col("s")))))


def test_feedback(spark):
    pairs = spark.createDataFrame([(" Q ", "a", None, 1), ("q", "b", "HIGH", 2), ("", "c", "HIGH", 3), ("z", None, "LOW", 4)], "question string, sql string, confidence string, created_at int")
    both = B.training_pairs(("one", pairs), ("two", pairs))
    assert both.count() == 4 and [(x.sql, x.source) for x in B.first_of_questions(both).collect()] == [("b", "one")]
    assert B.confident(pairs, "MEDIUM").count() == 2 and B.confident(pairs, "LOW").count() == 4
    assert B.shaped(pairs.limit(1).withColumn("source", F.lit("s")), "preference").first()[0] == '{"prompt":" Q ","chosen":"a","rejected":"","metadata":{"source":"s"}}'
    g = {x.plan: (x.scan_gb, x.rows, x.allowed) for x in B.guarded(spark.createDataFrame([("Input: 0.5TB 20 GB Output 5 rows",), ("600GB",), ("",), ("Output: 20000 rows",)], "plan string")).collect()}
    assert g["Input: 0.5TB 20 GB Output 5 rows"] == (512.0, 5, False) and g["600GB"] == (600.0, None, False) and g[""] == (0.0, None, True) and not g["Output: 20000 rows"][2]


def test_catalog_rules(spark):
    names = {"stg_orders": "bronze", "staging.x": "bronze", "FACT_x": "gold", "agg_y": "gold", "cleaned_z": "silver", "enriched": "silver", "other": "unknown"}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert dict(rows(df.select("n", S.layer(F.col("n"))))) == names
    t = spark.createDataFrame([("mview", "x", "gold"), ("a", "raw_x", "bronze"), ("silver", "y", "silver"), ("", "z", "other")], "s string, n string, w string")
    assert all(a == b for a, b in rows(t.select("w", S.tier(F.col("s"), F.col("n")))))
    c = spark.createDataFrame([("paid", "varchar", False), ("Region", "text", True), ("Region", "int", False)], "n string, t string, w boolean")
    assert all(a == b for a, b in rows(c.select("w", S.listable(F.col("n"), F.col("t")))))


def test_csv_round_trip(spark):
    data = [(1, 'a "b"', "SELECT 1,\n2"), (2, None, "x"), (3, "n", "nan"), (4, "n", None), (5, "é🙂", "SELECT ''")]
    df = spark.createDataFrame(data, "id int, name string, query string")
    path = files.scratch(spark, "csv")
    files.write_csv(df, path)
    assert sorted((int(x.id), x.name, x.query) for x in files.read_questions(spark, path).collect()) == [data[0], data[4]]


def test_paths_without_folder(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = {x.node: x.path for x in M.shortest_paths(e, spark.createDataFrame([("a",)], "node string"), None).collect()}
    assert got == {"a": "a", "b": "a>b", "c": "a>b>c"}
    keys = M.hop_keys(spark.createDataFrame([("a", "c", "a>b>c")], "start string, node string, path string"), e.withColumn("join_key", F.when(F.col("src") == "b", "k")))
    assert rows(keys.orderBy("hop").select("join_key")) == [("a.id",), ("k",)]


@pytest.fixture(scope="module")
def events(sf_dir, spark):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    df["at"] = df["ts"].astype("datetime64[us]").astype("int64") / 1e6
    return df


def stream(spark, sf_dir):
    from whetstone.registry import Reader

    return Reader(spark, sf_dir).stream("events")


def test_rate_limit(spark, sf_dir, events):
    want = {}
    for _, rows_ in events.groupby("user_id"):
        passed = []
        for e, at in zip(rows_["event_id"], rows_["at"], strict=True):
            passed = [t for t in passed if t > at - 21600]
            want[e] = len(passed) < 2
            if want[e]:
                passed.append(at)
    got = {x.event_id: x.allowed for x in J.drained(J.limited(stream(spark, sf_dir), "user_id", 2, 21600), "limit").collect()}
    assert got == want and False in want.values()


def test_cache(spark, sf_dir, events):
    want, stored = {}, {}
    for u, t, e, at in zip(events["user_id"], events["event_type"], events["event_id"], events["at"], strict=True):
        want[e] = (u, t) in stored and at - stored[u, t] <= 36000
        if t != "error" and not want[e]:
            stored[u, t] = at
    got = {x.event_id: x.hit for x in J.drained(J.cached(stream(spark, sf_dir), "concat(user_id, ':', event_type)", "event_type <> 'error'", 36000), "cache").collect()}
    assert got == want and True in want.values()


def test_states_by_bucket(spark):
    """Keys share the states of a few buckets, over several batches: each key still has its own times, also the null one, and what the watermark is past is forgotten."""
    r = random.Random(3)
    path = files.scratch(spark, "shared")
    data, stored, passed = [], {}, {}
    hits, allowed = {}, {}
    for batch in range(3):
        some = sorted((36000 * batch + r.randint(0, 35000), 1000 * batch + i, r.choice([None, *range(40)])) for i in range(400))
        for at, e, u in some:
            hits[e] = u in stored and at - stored[u] <= 900
            if e % 5 and not hits[e]:
                stored[u] = at
            kept = [t for t in passed.get(u, []) if t > at - 1800]
            allowed[e] = len(kept) < 2
            passed[u] = kept + [at] * allowed[e]
        data.append(some)

    def run(how):
        most = 0
        out = files.scratch(spark, "shared-out")
        for some in data:
            held = f"{path}-{how}"
            spark.createDataFrame(some, "at long, event_id long, user_id long").select("event_id", "user_id", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(held)
            e = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(held)
            made = J.cached(e, "user_id", "event_id % 5 <> 0", 900, buckets=4) if how == "cached" else J.limited(e, "user_id", 2, 1800, buckets=4)
            q = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
            q.awaitTermination()
            most = max([most, *[o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]]])
        return spark.read.parquet(out).collect(), most

    got, states = run("cached")
    assert {x.event_id: x.hit for x in got} == hits and True in hits.values() and 0 < states <= 4
    assert {x.event_id: x.key for x in got} == {e: None if u is None else str(u) for some in data for _, e, u in some}
    got, states = run("limited")
    assert {x.event_id: x.allowed for x in got} == allowed and False in allowed.values() and 0 < states <= 4
    assert {x.event_id: x.client for x in got} == {e: u for some in data for _, e, u in some}


def test_late_rows(spark):
    """A row older than the watermark is dropped; the windows before it come out once."""
    path = files.scratch(spark, "late")
    schema = "ts timestamp, event_type string"
    for i, some in enumerate([["2024-01-01 10:00:30"], ["2024-01-01 12:00:00"], ["2024-01-01 10:01:00", "2024-01-01 13:00:00"]]):
        spark.createDataFrame([(t, "x") for t in some], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(path)
        out = J.drained(J.rates(spark.readStream.schema(schema).parquet(path), ["event_type"]), "rates", path=f"{path}-out")
    got = {x.start.strftime("%H:%M"): x.n for x in out.collect()}
    assert got["10:00"] == 1 and sum(n for s, n in got.items() if s < "11:00") == 5


def test_pii_words():
    assert len(re.findall(X.POLICY[0], "1234567890 12345")) == 1


def test_minhash_error(spark):
    """Over pairs of known similarity the estimate of 128 hashes errs by three standard deviations at most."""
    r = random.Random(5)
    data = []
    for i in range(60):
        a = [f"{r.random():.6f}" for _ in range(40)]
        b = a[: r.randint(0, 40)] + [f"{r.random():.6f}" for _ in range(20)]
        data.append((i, a, b))
    df = spark.createDataFrame(data, "i int, a array<string>, b array<string>")
    same = F.aggregate(F.zip_with(X.minhash(F.col("a"), 128), X.minhash(F.col("b"), 128), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / 128
    for i, est in rows(df.select("i", same)):
        j = len(set(data[i][1]) & set(data[i][2])) / len(set(data[i][1]) | set(data[i][2]))
        assert abs(est - j) <= 3 * math.sqrt(max(j * (1 - j), 0.01) / 128) + 0.01


@pytest.mark.parametrize("sent", [16 << 20, 0])
def test_nearest_with_bonus(spark, monkeypatch, sent):
    """A row of the query's label gains 0.1 up to 1: rows that reach 1 tie and go by id, as do copies; a null label gains nothing."""
    from whetstone.plans import answers

    monkeypatch.setattr(M, "SENT_BYTES", sent)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((6, 8))
    x = (centre[rng.integers(0, 6, 400)] + 0.1 * rng.standard_normal((400, 8))).astype(np.float32)
    x[200:300] = x[100:200]  # copies
    labels = [None if i % 7 == 6 else i % 7 // 3 for i in range(400)]
    e = spark.createDataFrame([(i, v.tolist(), labels[i]) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float)
    u = u / np.sqrt((u * u).sum(1, keepdims=True))
    want = set()
    for q in range(0, 400, 50):
        s = [(-min(1.0, round(float(u[i] @ u[q]), 12) + 0.1 * (labels[i] is not None and labels[i] == labels[q])), i) for i in range(400) if i != q]
        want |= {(q, i, round(-v, 6)) for v, i in sorted(s)[:5]}
    got = rows(answers.x23(lambda _: e))
    assert len(got) == len(want) and set(got) == want
    at_one = [i for _, i, v in got if v == 1.0]
    assert len(at_one) > 10


def test_first_of_batches():
    """Cells give k rows of each query a batch, in the order of the window after them: NaN first, nulls last, ties by id."""
    import pyarrow as pa

    nan = float("nan")
    b = pa.RecordBatch.from_pydict({"query_id": [2, 1, 1, 1, 2, 1, 3], "vec_id": [5, 9, 4, 7, 6, 8, 1], "similarity": pa.array([0.1, 0.5, 0.5, nan, None, 0.9, None], pa.float64())})
    got = [next(M._first_of(k)(iter([b]))) for k in (1, 2, 3)]
    assert [x["vec_id"].to_pylist() for x in got] == [[7, 5, 1], [7, 8, 5, 6, 1], [7, 8, 4, 5, 6, 1]]
    assert got[1]["similarity"].to_pylist()[3:] == [None, None]
