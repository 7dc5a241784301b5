"""Stored entity values, metrics over several tables, the taxonomy, terms and the merged feed, against brute force."""

import random
import re
from graphlib import CycleError

import pytest
from pyspark.sql import functions as F

from whetstone.operators import entities as E
from whetstone.operators import semantic as S
from whetstone.operators import taxonomy as T
from whetstone.operators import terms
from whetstone.plans import entities as plans
from whetstone.streaming.merge import KeyedTable

VALUES = "tab string, col string, value string"


def _grams(v):
    v = v.lower()
    return {v} if len(v) < 3 else {v[i : i + 3] for i in range(len(v) - 2)}


def _best(keyword, values, k=5, least=0.3):
    g = _grams(keyword.strip())
    near = [(t, c, v, len(g & _grams(v)) / len(g | _grams(v))) for t, c, v in values]
    return sorted((x for x in near if x[3] >= least), key=lambda x: (-x[3], x[0], x[1], x[2]))[:k]


@pytest.fixture(scope="module")
def values():
    r = random.Random(4)
    words = ["".join(r.choice("abcdeéßñ東京Жя") for _ in range(r.randint(2, 9))) for _ in range(60)]
    return sorted({(f"t{r.randint(0, 3)}", f"c{r.randint(0, 3)}", " ".join(r.sample(words, r.randint(1, 4)))) for _ in range(1500)})


def test_match_keywords(spark, tmp_path, values, monkeypatch):
    r = random.Random(5)
    path = str(tmp_path / "index")
    df = spark.createDataFrame(values, VALUES)
    for i in range(3):  # appended in three calls, which overlap
        E.add_values(df.where(F.pmod(F.xxhash64("value"), F.lit(3)) <= i).unionByName(df.limit(20)), path)
    assert spark.read.parquet(f"{path}/values").count() == len(values)
    E.add_values(df, path)
    assert spark.read.parquet(f"{path}/values").count() == len(values)
    asked = [v[: len(v) // 2] + r.choice("xyz") + v[len(v) // 2 + 1 :] for _, _, v in r.sample(values, 60)] + ["東京", "a", " ab ", "", None, "Ж" * 40]
    keywords = spark.createDataFrame([(k,) for k in asked + asked[:5]], "keyword string")
    want = {(k, *x[:3], i + 1) for k in asked if k for i, x in enumerate(_best(k, values))}
    for rows in (200_000, 0):  # broadcast, then by shuffle
        monkeypatch.setattr(E, "BROADCAST_ROWS", rows)
        got = E.match_keywords(keywords, path).collect()
        assert {(x.keyword, x.tab, x.col, x.value, x["rank"]) for x in got} == want and len(got) == len(want)
        assert all(abs(x.similarity - len(_grams(x.keyword.strip()) & _grams(x.value)) / len(_grams(x.keyword.strip()) | _grams(x.value))) < 1e-12 for x in got)
    assert len(want) > 100


def test_keywords_among_like_values(spark, tmp_path, monkeypatch):
    """Where nearly all values share most grams, a keyword meets those that can be among its best, not all of them."""
    values = [("t", "c", f"Customer#{i:09d}") for i in range(4000)]
    path = str(tmp_path / "index")
    E.add_values(spark.createDataFrame(values, VALUES), path)
    asked = [f"customer {i:09d}" for i in range(1200, 4000, 400)]
    seen = []
    compare = E.X.jaccard
    met = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: met.add(1) or x, "double")
    monkeypatch.setattr(E.X, "jaccard", lambda a, b: seen.append(1) or count(compare(a, b)))
    got = E.match_keywords(spark.createDataFrame([(k,) for k in asked], "keyword string"), path).collect()
    assert {(x.keyword, x.tab, x.col, x.value, x["rank"]) for x in got} == {(k, *x[:3], i + 1) for k in asked for i, x in enumerate(_best(k, values))}
    assert seen and met.value < len(asked) * len(values) / 2


@pytest.mark.parametrize("small", [500_000, 600])
def test_few_pairs_leave_a_block(spark, tmp_path, monkeypatch, small):
    """Of many values that are like a keyword each block gives no more than the best, and ties go by table, column and value in one block as in many."""
    monkeypatch.setattr(E, "SMALL_BLOCK", small, raising=False)
    values = [(f"t{i % 3}", "c", f"Customer#{i:06d}") for i in range(900)] + [("t0", "d", f"{w} x") for w in ("customer", "CUSTOMER", "Customer")]
    path = str(tmp_path / "index")
    E.add_values(spark.createDataFrame(values, VALUES), path)
    asked = [f"customer {i:06d}" for i in range(200, 900, 100)] + ["customer", "customer#00", "zzz"]
    met = spark.sparkContext.accumulator(0)
    count, compare = F.udf(lambda x: met.add(1) or x, "double"), E.X.jaccard
    monkeypatch.setattr(E.X, "jaccard", lambda a, b: count(compare(a, b)))
    got = E.match_keywords(spark.createDataFrame([(k,) for k in asked], "keyword string"), path).collect()
    assert {(x.keyword, x.tab, x.col, x.value, x["rank"]) for x in got} == {(k, *x[:3], i + 1) for k in asked for i, x in enumerate(_best(k, values))}
    assert met.value <= 20 * len(asked) * (1 if small > 600 else 30)


def test_half_written_values_do_not_count(spark, tmp_path, values):
    path = str(tmp_path / "index")
    E.add_values(spark.createDataFrame(values[:100], VALUES), path)
    key = spark.createDataFrame([(values[0][2],)], "keyword string")
    before = sorted(E.match_keywords(key, path).collect())
    postings = spark.read.parquet(f"{path}/postings").drop("run")
    postings.write.partitionBy("bucket").parquet(f"{path}/postings/run=lost")  # a call that failed before it wrote its values
    assert sorted(E.match_keywords(key, path).collect()) == before


def _model(**metrics):
    return S.Model(
        tables={
            "line": S.Table(dimensions={"flag": "flag"}, measures={"qty": S.Measure("sum", "qty"), "n": S.Measure("count"), "kinds": S.Measure("count_distinct", "flag"), "mean": S.Measure("avg", "qty", "flag = 'a'"), "top": S.Measure("max", "qty")}),
            "sale": S.Table(measures={"total": S.Measure("sum", "total"), "n": S.Measure("count")}, time="day"),
            "person": S.Table(dimensions={"town": "town"}),
        },
        relationships=(S.Relationship("line", "sale", "sale_id", "id"), S.Relationship("sale", "person", "person_id", "pid")),
        metrics=metrics,
    )


@pytest.fixture(scope="module")
def frames(spark):
    line = [(1, "a", 2), (1, "b", 3), (2, "a", 5), (3, None, 7), (99, "a", 11), (None, "b", 13)]
    sale = [(1, 10, 100, "2024-01-05"), (2, 10, 200, "2024-02-05"), (3, 20, 400, "2024-02-06"), (4, None, 800, "2024-02-07")]
    return {
        "line": spark.createDataFrame(line, "sale_id long, flag string, qty long"),
        "sale": spark.createDataFrame(sale, "id long, person_id long, total long, day string").withColumn("day", F.to_timestamp("day")),
        "person": spark.createDataFrame([(10, "x"), (20, None), (30, "z")], "pid long, town string"),
    }


def test_metrics_do_not_fan_out(frames):
    m = S.metrics(_model(per_sale="{line.qty} / {sale.n}", twice="2 * {per_sale}"), frames, ["twice", "sale.total", "line.kinds", "line.mean", "line.top"], ["person.town"])
    got = {r.person__town: tuple(r)[1:] for r in m.collect()}
    # sales 3 (a person without a town) and 4 (without a person) and lines 99 and null (without a sale) have no town
    assert got == {"x": (2 * 10 / 2, 300, 2, 3.5, 5), None: (2 * 31 / 2, 1200, 2, 11.0, 13)}


def test_metrics_without_dimensions_and_by_own_dimension(frames):
    assert [tuple(r) for r in S.metrics(_model(), frames, ["line.qty", "sale.total"]).collect()] == [(41, 1500)]
    by = {r.line__flag: r.line__n for r in S.metrics(_model(), frames, ["line.n"], ["line.flag"]).collect()}
    assert by == {"a": 3, "b": 2, None: 1}
    months = {r.period.month: r.sale__n for r in S.metrics(_model(), frames, ["sale.n"], grain="month").collect()}
    assert months == {1: 1, 2: 3}


def test_metric_errors(frames):
    with pytest.raises(CycleError):
        S.metrics(_model(a="{b} + 1", b="{a} + 1"), frames, ["a"])
    with pytest.raises(ValueError, match="no many-to-one way"):
        S.metrics(_model(), frames, ["sale.n"], ["line.flag"])
    with pytest.raises(ValueError, match="no time"):
        S.metrics(_model(), frames, ["line.n"], grain="month")


def test_fact_is_scanned_once(frames):
    plan = S.metrics(_model(a="{line.qty} + {line.n} + {line.top}"), frames, ["a"], ["person.town"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("qty#") and plan.count("sale_id#") and plan.count("LogicalRDD [sale_id") == 1


def _class(message):
    m = (message or "").lower()
    for c, s, d in T.TAXONOMY:
        if any(w in m for w in d.lower().split() if len(w) >= T.LEAST):
            return c, s
    return next(((c, s) for c, s, ws in T.PHRASES if any(w in m for w in ws)), T.DEFAULT)


def test_taxonomy(spark):
    assert len({c for c, _, _ in T.TAXONOMY}) == 11 and len(T.TAXONOMY) == 36
    texts = [None, "", "zzz", "CANNOT CAST to day", "must be an aggregate", "xambiguousx", "group\nby", "the DATE 1", "nowhere", "tab\tjoin", "un unexpectedly", *(d for _, _, d in T.TAXONOMY), *(w for _, _, ws in T.PHRASES for w in ws)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(2, "zzz")], "id long, message string").distinct()
    got = {r.id: (r.category, r.subtype) for r in T.classified(df, T.rules(spark), ["id"]).collect()}
    assert got == {i: _class(t) for i, t in enumerate(texts)}
    assert {c for c, _ in got.values()} >= {"syntax", "schema_link", "join", "filter", "aggregation", "date_time", "others"}


def test_taxonomy_reads_messages_once(spark):
    """No message is shuffled or cut into rows, rows with one key keep their own classes, and a word within an earlier one does not hide it."""
    rules = spark.createDataFrame([(0, "a", "x", "typed", False), (1, "b", "y", "type", False), (2, "c", "z", "types", False), (3, "d", "w", "a b", True)], "rank int, category string, subtype string, word string, is_phrase boolean")
    df = spark.createDataFrame([(1, "TYPED"), (1, "retype"), (1, "types typed"), (None, "prototypes"), (2, "a b"), (2, "a\nb"), (3, None)], "id long, message string")
    out = T.classified(df, rules, ["id"])
    assert sorted((r.message or "", r.category) for r in out.collect()) == [("", "syntax"), ("TYPED", "a"), ("a\nb", "syntax"), ("a b", "d"), ("prototypes", "b"), ("retype", "b"), ("types typed", "a")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1


def _terms(text, aliases, most=4):
    w = re.findall(r"\w+", (text or "").lower())
    out, i = [], 0
    while i < len(w):
        n = next((n for n in range(min(most, len(w) - i), 0, -1) if tuple(w[i : i + n]) in aliases), 0)
        if n:
            out.append((i, n, aliases[tuple(w[i : i + n])]))
        i += max(n, 1)
    return out


def test_terms(spark, monkeypatch):
    r = random.Random(6)
    words = ["ab", "ä", "東京", "жя", "c1", "dd", "e"]
    aliases = [(" ".join(r.choice(words) for _ in range(r.randint(1, 5))), r.randint(1, 9)) for _ in range(60)] + [("", 1), (None, 2), ("AB,  Ä", 0), ("x", None)]
    table = {}
    for a, c in aliases:
        k = tuple(re.findall(r"\w+", (a or "").lower()))
        if k and c is not None:
            table[k] = min(c, table.get(k, c))
    texts = [(i, " ".join(r.choice(words) + r.choice(["", ",", "!"]) for _ in range(r.randint(0, 60)))) for i in range(40)] + [(50, None), (51, ""), (52, "東京"), (3, "ab ä")]
    want = sorted((i, *x) for i, t in texts for x in _terms(t, table))
    a, d = spark.createDataFrame(aliases, "alias string, canonical int"), spark.createDataFrame(texts, "doc_id long, text string")
    for rows in (100_000, 0):
        monkeypatch.setattr(terms, "BROADCAST_ROWS", rows)
        assert sorted((x.doc_id, x.place, x.n, x.canonical) for x in terms.found_terms(d, a).collect()) == want
    assert {n for _, _, n, _ in want} == {1, 2, 3, 4}


def test_keyed_merge(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", "v", ["at"], buckets=4)
    known = spark.range(20).select(F.col("id").alias("k"))
    batches = [[(1, "a", 1), (1, "b", 2), (77, "u", 1), (None, "n", 1)], [(1, "old", 0), (2, "c", 5)], [(88, "u", 2)], [(1, "d", 9), (3, "e", 1), (3, "f", 1)]]
    assert table.read() is None
    state = {}
    for i, b in enumerate(batches):
        df = spark.createDataFrame(b, "k long, v string, at int")
        for _ in range(2):  # each batch comes twice
            table.merge(df, i, known)
        for k, v, at in b:
            if k is not None and k < 20:
                state[k] = max(state.get(k, (-1, "")), (at, v))
        assert {r.k: (r.at, r.v) for r in table.read().collect()} == state
    unknown = sorted((r.k or 0, r.v) for r in table.unknown().collect())
    assert unknown == [(0, "n"), (77, "u"), (88, "u")]
    # an earlier batch again, after later ones: what was merged since stays
    table.merge(spark.createDataFrame(batches[1], "k long, v string, at int"), 1, known)
    assert {r.k: (r.at, r.v) for r in table.read().collect()} == state


def test_feed_goes_on(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", "v", ["at"], buckets=4)
    known, source = spark.range(20).select(F.col("id").alias("k")), str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(j, f"{i}", i) for j in range(i, 20)], "k long, v string, at int").write.mode("append").parquet(source)
        table.follow(spark.readStream.schema("k long, v string, at int").parquet(source), known)
    assert {r.k: r.v for r in table.read().collect()} == {j: str(min(j, 2)) for j in range(20)}


def test_every_order_is_there(spark, sf_dir):
    from whetstone.registry import Reader

    r = Reader(spark, sf_dir)
    assert plans.st6_merged(r).count() == r("orders").count()
