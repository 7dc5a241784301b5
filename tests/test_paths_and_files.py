"""Paths between pairs, document files, table functions, calls that fail and the quantised index."""

import json
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from whetstone.functions import udtf
from whetstone.operators import calls, paths, vectors
from whetstone.operators import documents as D
from whetstone.operators import metadata as M
from whetstone.sources import documents as kinds


def _shortest(edges, start, end):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
    front, seen = {start: start}, set()
    n = 0
    while front:
        if end in front:
            return front[end], n
        seen |= front.keys()
        new = {}
        for x, p in front.items():
            for y in near[x] - seen:
                new[y] = min(new.get(y, "~~~"), f"{p}>{y}")
        front, n = new, n + 1
    return None


def test_paths_between(spark):
    r = random.Random(1)
    nodes = [f"n{i}" for i in range(60)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(90)] + [(f"line{i}", f"line{i + 1}") for i in range(12)] + [(None, "n1")]
    pairs = [(r.choice(nodes), r.choice(nodes)) for _ in range(80)] + [("line0", "line6"), ("line0", "line12"), ("n1", "n1"), ("absent", "n1"), (None, "n1")]
    e = spark.createDataFrame(edges, "src string, dst string")
    got = {(x.start, x.node): (x.path, x.n) for x in paths.paths_between(e, spark.createDataFrame(pairs + pairs[:9], "start string, node string"), 6).collect()}
    want = {(a, b): x for a, b in set(pairs) if a and (x := _shortest([p for p in edges if p[0]], a, b)) and x[1] <= 6}
    want.pop(("absent", "n1"), None)
    assert got == want and max(n for _, n in got.values()) == 6 and ("line0", "line12") not in got


def test_connected(spark):
    edges = [("a", "b"), ("c", "b"), ("c", "d"), ("x", "y"), ("d", "e")]
    sets = [(1, "a"), (1, "d"), (2, "a"), (2, "x"), (3, "e"), (3, "d"), (3, None)]
    got = {(r.set, r.node): r.is_bridge for r in paths.connected(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(sets, "set int, member string")).collect()}
    assert got == {(1, "a"): False, (1, "b"): True, (1, "c"): True, (1, "d"): False, (2, "a"): False, (2, "x"): False, (3, "e"): False, (3, "d"): False}
    g = spark.createDataFrame([("a", "b", "k"), ("b", "c", None)], "src string, dst string, join_key string")
    found = paths.paths_between(g, spark.createDataFrame([("a", "c")], "start string, node string"))
    assert [(r.hop, r.join_key) for r in paths.pair_hop_keys(found, g).orderBy("hop").collect()] == [(1, "k"), (2, "b.id")]


def test_files_by_kind(spark, tmp_path):
    path = str(tmp_path / "docs")
    entity = [{"name": "t", "description": "d", "columns": [{"name": "c", "dataType": "int"}]}, {"name": "u", "description": "", "columns": []}]
    long = "word. " * 2000
    rows = [
        ("a/x.md", f"intro\n# One\ntext\n### Three\n{long}\n#### four is text"), ("a/x.txt", "1. First\nbody\n12. Second\nmore"), ("b/p.html", "<h1>Head</h1><script>no</script><p>Body</p><h2>Sub</h2>x"),
        ("b/m.json", json.dumps(entity)), ("b/bad.json", "{"), ("b/skip.bin", "# no"), ("c/same.md", "# One\ntext"), ("c/empty.txt", ""),
    ]
    df = spark.createDataFrame(rows, "name string, content string").repartition(3)
    assert kinds.write_files(df, path) == len(rows)
    assert kinds.write_files(df, path) == len(rows)  # again: the same files
    (tmp_path / "docs" / "c" / "latin.txt").write_bytes(b"1. caf\xe9")
    files = kinds.read_files(spark, path)
    assert files.count() == 7  # none for the file without a byte, and none for .bin
    got = sorted((kinds_name, r.section, r.header, r.level) for r in kinds.file_sections(files).collect() for kinds_name in [r.path.rsplit("/", 1)[-1]])
    assert got == sorted([
        ("x.md", 0, "", 0), ("x.md", 1, "One", 1), ("x.md", 2, "Three", 3), ("x.txt", 0, "First", 0), ("x.txt", 1, "Second", 0), ("p.html", 0, "Head", 1), ("p.html", 1, "Sub", 2),
        ("m.json", 0, "t", 0), ("m.json", 1, "u", 0), ("same.md", 0, "One", 1), ("latin.txt", 0, "caf�", 0),
    ])
    chunks = kinds.file_chunks(files)
    titles = [r.title for r in chunks.where("path like '%x.md' and section = 2").orderBy("part").collect()]
    assert titles == [f"Three (part {i + 1})" for i in range(len(titles))] and len(titles) > 2
    one = kinds.distinct_chunks(chunks)
    assert one.count() == chunks.select("hash").distinct().count() < chunks.count()
    assert one.where("path like '%same.md'").count() == 0  # the first by path stays


def test_files_are_read_once(spark, tmp_path):
    """One scan serves every kind of file and both long and short sections; a list with a null entity and a file that is no list keep their rows as they were."""
    path = tmp_path.as_posix()
    content = {"a.md": "top\n# One\n" + "x. y " * 900 + "\n#### no\n## \n Two", "b.txt": "1. First\nx\n22. Second", "c.html": "<h2>H</h2><p>t</p>", "d.json": '[{"name":"n","description":"d"},null,{"columns":[{"name":"c","dataType":"t"}]}]', "e.json": "{"}
    kinds.write_files(spark.createDataFrame(list(content.items()), "name string, content string"), path)
    files = kinds.read_files(spark, path)
    plan = kinds.file_chunks(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Relation") == 1
    got = [tuple(r) for r in kinds.file_sections(files).select("kind", "section", "header", "level", F.substring("text", 1, 12)).orderBy("kind", "section").collect()]
    assert got == [("html", 0, "H", 2, "## H\nt"), ("json", 0, "n", 0, "n\nd"), ("json", 2, "", 0, "Columns: c t"), ("md", 0, "", 0, "top"), ("md", 1, "One", 1, "# One\nx. y x"), ("md", 2, "Two", 2, "## \n Two"), ("txt", 0, "First", 0, "1. First\nx"), ("txt", 1, "Second", 0, "22. Second")]



def test_table_functions(spark):
    udtf.register(spark)
    texts = [(1, "one. " * 3000), (2, None), (3, ""), (4, "short"), (5, "  \n "), (1, "again")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    columns = ["doc_id", "part", "parts", "start", "text", "hash", "char_count"]
    for most, overlap in ((4000, 400), (100, 10)):
        want = sorted(tuple(r) for r in D.split_long(docs, ["doc_id"], most, overlap).select(*columns).collect())
        got = spark.sql(f"SELECT d.doc_id, c.* FROM {{docs}} d, LATERAL split_text(d.text, most => {most}, overlap => {overlap}) c", docs=docs)
        assert sorted(tuple(r) for r in got.select(*columns).collect()) == want
        docs.createOrReplaceTempView("texts_to_split")
        over = spark.sql(f"SELECT * FROM split_rows(TABLE(texts_to_split) PARTITION BY doc_id, most => {most}, overlap => {overlap})")
        assert sorted(tuple(r) for r in over.select(*columns).collect()) == want
        numbers = sorted(r.chunk for r in over.where("doc_id = 1").collect())
        assert numbers == list(range(len(numbers)))
    for bad in ("split_text(1)", "split_text('a', most => 10, overlap => 6)"):
        with pytest.raises(Exception, match="must be"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_settled():
    sent, waits = [], []

    def call(texts):
        sent.append(list(texts))
        if "bad" in texts:
            raise ValueError("no")
        if len(sent) == 1:
            raise calls.Retry("later")
        return [t.upper() for t in texts]

    assert calls.settled(call, ["a", "b"], sleep=waits.append) == [("A", None), ("B", None)]
    assert sent == [["a", "b"], ["a", "b"]] and waits == [1.0]
    got = calls.settled(call, ["a", "b", "bad", "c", "d"], sleep=waits.append)
    assert [x for x, _ in got] == ["A", "B", None, "C", "D"] and got[2][1] == "ValueError: no" and waits == [1.0]

    def never(texts):
        raise calls.Retry("busy")

    assert calls.settled(never, ["a"], sleep=waits.append) == [(None, "Retry: busy")] and waits == [1.0, 1.0, 2.0]
    assert calls.settled(lambda t: t[:-1], ["a", "b"]) == [(None, "ValueError: 0 results for 1 texts")] * 2
    assert calls.settled(call, []) == []


def test_waves_are_not_done_twice(spark, tmp_path):
    path, marks = str(tmp_path / "out"), tmp_path / "marks"
    marks.mkdir()
    texts = spark.range(200).select("id", F.concat(F.lit("t"), "id").alias("text"))

    def how(fail):
        def call(some):
            for t in some:
                if fail and t == "t7":
                    raise SystemExit("lost")
                with open(marks / t, "a") as f:
                    f.write("x")
            return [[float(len(t)), 0.0] for t in some]

        return lambda df: calls.called(df.coalesce(1), call, T.ArrayType(T.FloatType()), batch=10, wait=0.0)

    with pytest.raises(Exception):  # noqa: B017
        calls.called_in_waves(texts, path, F.col("id"), 5, how(True))
    done = {m.name for m in marks.iterdir()}
    finished = {r.text for r in spark.read.option("recursiveFileLookup", True).parquet(*[str(p) for p in (tmp_path / "out").glob("wave=*") if (p / "_SUCCESS").exists()]).collect()} if list((tmp_path / "out").glob("wave=*/_SUCCESS")) else set()
    out = calls.called_in_waves(texts, path, F.col("id"), 5, how(False)).collect()
    assert len(out) == 200 and all(r.error is None and list(r.result) == [float(len(r.text)), 0.0] for r in out)
    assert finished <= done and all((marks / t).read_text() == "x" for t in finished)


def test_native_embeddings(spark):
    df = calls.hashed_embeddings(spark.createDataFrame([(1, "Hello there"), (2, "hello THERE"), (3, "ab"), (4, None), (5, "x\ny" * 9)], "id int, text string"), 64)
    e = {r.id: np.array(r.embedding) for r in df.collect()}
    assert np.allclose(e[1], e[2]) and abs(np.linalg.norm(e[1]) - 1) < 1e-6 and not e[3].any() and not e[4].any() and e[5].any()


def test_nearest_by_blocks_and_labels(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    x[5] = x[6]
    rows = [(i, [float(a) for a in v], i % 3 if i % 7 else None) for i, v in enumerate(x)] + [(500, None, 1), (501, [0.0] * 6, 1), (502, [1.0, 2.0], 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    s = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    for sent in (1 << 20, 0):
        monkeypatch.setattr(M, "SENT_BYTES", sent)
        got = {(r.query_id, r.label, r["rank"]): r.vec_id for r in M.nearest(e.where("vec_id % 50 = 0"), e, 3, by="label").collect()}
        want = {}
        for q in range(0, 400, 50):
            for label in (0, 1, 2, None):
                mine = sorted((i for i in range(400) if rows[i][2] == label and i != q), key=lambda i: (-round(s[q, i], 12), i))[:3]
                want |= {(q, label, k + 1): i for k, i in enumerate(mine)}
        assert got == want
        every = {(r.query_id, r.vec_id) for r in M.nearest(e.where("vec_id % 50 = 0"), e, None, 0.3).collect()}
        assert every == {(q, i) for q in range(0, 400, 50) for i in range(400) if i != q and s[q, i] >= 0.3}


def test_quantised_recall(spark, tmp_path):
    """Against exact neighbours, the query itself left out, on clustered vectors and on those of no structure."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate((centres[rng.integers(0, 40, 5000)] + 0.35 * rng.normal(size=(5000, 32)), rng.normal(size=(1000, 32))))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [0.0] * 32), (9001, None)], "vec_id long, embedding array<double>").repartition(4)
    path = str(tmp_path / "index")
    vectors.build(e, path)
    found = vectors.search(e.where("vec_id % 50 = 0"), path, 10)
    got = {(r.query_id, r.vec_id) for r in found.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = set()
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -2
        true |= {(q, int(i)) for i in np.argsort(-s)[:10]}
    assert not any(a == b for a, b in got)
    assert len(got & true) / len(true) >= 0.9
    assert all(abs(r.similarity - u[r.query_id] @ u[r.vec_id]) < 1e-9 for r in found.collect())
    assert spark.read.parquet(f"{path}/codes").count() == 6000
    assert vectors.read_bytes(spark, path) < 6000 * 32 * 8 / 4  # against the bytes of all vectors
    assert vectors.search(e.where("false"), path, 10).count() == 0


def test_quantised_odd(spark, tmp_path):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    vectors.build(empty, str(tmp_path / "none"))
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, -1.0])], "vec_id long, embedding array<double>")
    assert vectors.search(empty, str(tmp_path / "none"), 3).count() == 0
    vectors.build(one, str(tmp_path / "few"))
    got = {(r.query_id, r.vec_id): round(r.similarity, 6) for r in vectors.search(one, str(tmp_path / "few"), 3, probes=9).collect()}
    assert got == {(1, 2): 1.0, (2, 1): 1.0, (1, 3): 0.0, (3, 1): 0.0, (2, 3): 0.0, (3, 2): 0.0}


def test_unbounded_paths_carry_numbers(spark):
    """As brute force, and no step shuffles the texts of its paths."""
    import random

    from whetstone.operators import metadata as M

    r = random.Random(3)
    names = [f"{r.choice('ab')}{i}" for i in range(40)] + ["a", "a1 ", "a1!", "a1~", "é"]
    edges = sorted({(r.choice(names), r.choice(names)) for _ in range(130)})
    want = {}
    for start in names[:3] + ["a"]:
        front = {start: start}
        seen = dict(front)
        while front:
            new = {}
            for u, path in front.items():
                for a, b in edges:
                    if a == u and b not in seen:
                        new[b] = min(new.get(b, f"{path}>{b}"), f"{path}>{b}", key=str.encode)
            seen |= new
            front = new
        want |= {(start, k): v for k, v in seen.items()}
    starts = spark.createDataFrame([(x,) for x in [*names[:3], "a"]], "node string")
    e = spark.createDataFrame(edges, "src string, dst string")
    texts = []
    kept, M.reread = M.reread, lambda df, path, *a: (texts.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, path, *a))[1]
    try:
        got = M.shortest_paths(e, starts, hops=None).collect()
    finally:
        M.reread = kept
    assert {(x.start, x.node): x.path for x in got} == want and len(got) == len(want)
    assert not any("min(path" in t for t in texts)


def test_fronts_are_shared_by_pairs(spark, monkeypatch):
    """Pairs with one end in common grow one front from it; the paths are those of brute force."""
    import random
    from collections import defaultdict

    from whetstone.operators import paths

    r = random.Random(6)
    edges = {(f"a{i}", f"b{r.randrange(40)}") for i in range(60) for _ in range(4)} | {(f"b{i}", f"c{r.randrange(12)}") for i in range(40) for _ in range(2)} | {(f"c{i}", f"d{i % 2}") for i in range(12)} | {("d0", "a1"), ("a2", "d1")}
    asked = [(f"a{i}", f"d{k}") for i in range(60) for k in range(2)] + [("a3", "a3"), ("d1", "a0"), (None, "d0"), ("a1", "d0")]
    rows, write = [], paths.reread

    def counted(df, path, *more):
        out = write(df, path, *more)
        if "/front-" in path:
            rows.append(out.count())
        return out

    monkeypatch.setattr(paths, "reread", counted)
    got = {(x.start, x.node): (x.path, x.n) for x in paths.paths_between(spark.createDataFrame(sorted(edges), "src string, dst string"), spark.createDataFrame(asked, "start string, node string"), 5).collect()}
    onward = defaultdict(list)
    for a, b in edges:
        onward[a].append(b)
    want = {}
    for a, b in {x for x in asked if None not in x}:
        level, seen = {a: a}, {a}
        for n in range(6):
            if b in level:
                want[a, b] = (level[b], n)
                break
            step = {}
            for x, p in level.items():
                for y in onward[x]:
                    if y not in seen:
                        step[y] = min(step.get(y, p + ">" + y), p + ">" + y)
            seen |= set(step)
            level = step
    assert got == want and len(want) > 100
    assert sum(rows) < 600  # 120 pairs, each with fronts of its own, make more
