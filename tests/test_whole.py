"""Queries over all rows, against brute force."""

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from whetstone.functions import text as X
from whetstone.plans import corpus, warehouse


def test_x14_all(spark):
    r = random.Random(2)
    rows = [(o, r.randrange(12)) for o in range(150, 350) for _ in range(r.randint(1, 7))]
    sets = {}
    for o, s in rows:
        sets.setdefault(o, set()).add(s)
    want = {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long")
    got = [tuple(x) for x in corpus.x14_all(lambda _: df).collect()]
    assert len(got) == len(want) and set(got) == want


def test_baskets_of_all_sizes(spark):
    """Baskets that meet by one item, by two, and those too wide for two; and few candidates where many baskets share their items."""
    from whetstone.operators import analytics as A

    r = random.Random(4)
    sets = {o: set(r.sample(range(40), r.choice([1, 1, 2, 3, 5, 7, 20, 23, 26, 30]))) for o in range(250)}
    for o in range(0, 250, 3):
        sets[o + 1000] = set(list(sets[o])[1:]) | {r.randrange(40)}
    df = spark.createDataFrame([(o, i) for o, s in sets.items() for i in s], "o long, i long")
    for percent in (50, 80):
        want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        got = [(x.a, x.b) for x in A.similar_baskets(df, "o", "i", percent).collect()]
        assert len(got) == len(want) and set(got) == want
    # baskets of four items have to share two, and meet by two together: one item in common makes no candidate
    four = spark.createDataFrame([(o, i) for o in range(60) for i in (0, 3 * o + 1, 3 * o + 2, 3 * o + 3)], "o long, i long")
    plan = A.similar_baskets(four, "o", "i")
    assert plan.count() == 0 and "xxhash64" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_k3_all(spark):
    df = spark.createDataFrame([(i, i % 50) for i in range(300)], "p_partkey long, p_size int")
    got = [tuple(x) for x in corpus.k3_all(lambda _: df).collect()]
    assert got == sorted(((i, i % 50 if i % 50 <= 40 else None) for i in range(300)), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))


def test_g4_all(spark):
    r = random.Random(6)
    rows = [(r.randrange(40), r.randrange(25)) for _ in range(45)]
    near = {}
    for p, s in rows:
        near.setdefault(f"p{p}", set()).add(f"s{s}")
        near.setdefault(f"s{s}", set()).add(f"p{p}")
    want = {}
    for start in [f"s{s}" for s in sorted({s for _, s in rows})[:3]]:
        front = {start: start}
        n, seen = 0, {}
        while front:
            seen |= {x: (path, n) for x, path in front.items()}
            new = {}
            for x, path in front.items():
                for y in near[x] - seen.keys():
                    new[y] = min(new.get(y, "~"), f"{path}>{y}")
            front, n = new, n + 1
        want |= {(start, x): v for x, v in seen.items()}
    df = spark.createDataFrame(rows, "l_partkey long, l_suppkey long")
    got = {(x.start, x.node): (x.path, x.n) for x in warehouse.g4_all(lambda _: df).collect()}
    assert got == want and max(n for _, n in want.values()) > 4


def test_t11_all(spark):
    texts = {1: "mail ann@x.org, 123-456-7890; 123.456.7890", 2: "card 1234567890123456 or 1234567890", 3: "é🙂 10.0.0.1 and 10.0.0.1x 10.0.0.1", 4: "x TIMESTAMP '2024-01-01' 1.2.3.4", 5: "Web@Site.org", 6: None, 7: "a" * 60 + "@b.org", 8: "none", 9: "id deadbeef-cafe-babe-face-abcdefabcdef and ABCDEF01-2345-6789-abcd-0123456789ab", 10: ""}
    want = set()
    for i, t in texts.items():
        for k, p in zip(X.POLICY_KINDS, X.POLICY, strict=True):
            for m in re.finditer(p, t or "", re.ASCII):
                around = t[max(0, m.start() - 20) : m.end() + 20]
                if m.group().lower() != "web@site.org" and not any(re.search(s, around) for s in X.SAFE):
                    want.add((i, k, m.start(), m.group()[:50]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = [tuple(x) for x in X.pii_matches(docs, spark.createDataFrame([("WEB@site.org",)], "name string")).collect()]
    assert len(got) == len(want) and set(got) == want and {k for _, k, _, _ in got} == set(X.POLICY_KINDS)


def test_redacted_letters(spark):
    """A UUID of letters alone goes too, whatever else the text holds."""
    texts = ["a deadbeef-cafe-babe-face-abcdefabcdef b", "a DEADBEEF-cafe-babe-face-abcdefabcdef b 7", "no data", None, "x@y.zz"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [r.x for r in df.select("i", X.redacted(F.col("text")).alias("x")).orderBy("i").collect()] == ["a [REDACTED] b", "a [REDACTED] b 7", "no data", None, "[REDACTED]"]


def test_whole_words(spark):
    """Words end at letters that are not ASCII, as they do in the SQL."""
    from whetstone.plans import answers

    texts = ["ärank", "rankä", "total über", "xrank", "rank_", "rank7", "Top", "orderſ", "nothing", None, "日count日", "e\u0301sum\u0301"]
    df = spark.createDataFrame(list(enumerate(texts)), "turn int, text string").withColumn("conv_id", F.lit(1))
    got = {r.turn for r in answers.f16(lambda _: df).collect()}
    assert got == {i for i, t in enumerate(texts) if t and re.search(rf"(?<![0-9A-Za-z_])(?i:{X.DATA_WORDS})(?![0-9A-Za-z_])", t)} >= {0, 1, 2, 7, 10, 11}


def test_limits_of_shares(spark):
    """A running sum a cent above 0.8 or 0.95 of a large total is beyond it, though the rounded share is not."""
    orders = spark.createDataFrame([(c, float(v)) for c, v in enumerate(["800000000.00", "150000000.00", "49999999.99", "0.01"])], "o_custkey long, o_totalprice double")
    assert [tuple(x) for x in corpus.w7(lambda _: orders).collect()] == [(4, 1, 25.0)]
    assert {x[0]: (x[1], x[2]) for x in corpus.w8(lambda _: orders).collect()} == {"A": (1, 8e8), "B": (1, 1.5e8), "C": (2, 5e7)}
    over = spark.createDataFrame([(c, float(v)) for c, v in enumerate(["800000000.01", "150000000.00", "49999999.99"])], "o_custkey long, o_totalprice double")
    assert [tuple(x) for x in corpus.w7(lambda _: over).collect()] == [(3, 0, 0.0)]
    assert {x[0]: x[1] for x in corpus.w8(lambda _: over).collect()} == {"B": 1, "C": 2}


def test_baskets_by_lines(spark):
    """Pairs of an order's distinct parts, counted in as many tasks as the lines ask for; nulls, repeats and single parts make no pair."""
    r = random.Random(8)
    lines = [(r.choice([None, *range(30)]), r.choice([None, *range(12)])) for _ in range(300)] + [(99, 1), (98, 2), (98, 2)]
    want = {}
    for o in {o for o, _ in lines if o is not None}:
        for pair in combinations(sorted({p for x, p in lines if x == o and p is not None}), 2):
            want[pair] = want.get(pair, 0) + 1
    got = corpus._baskets(spark.createDataFrame(lines, "l_orderkey long, l_partkey long"), "l_orderkey", "l_partkey", each=20)
    assert {(x.part_a, x.part_b): x.n for x in got.collect()} == want
    assert got.rdd.getNumPartitions() >= len([1 for o, p in lines if o is not None and p is not None]) // 20
    assert corpus._baskets(spark.createDataFrame([], "l_orderkey long, l_partkey long"), "l_orderkey", "l_partkey").count() == 0


def test_export_is_dealt_by_lines(spark, sf_dir, monkeypatch):
    """The export's tasks follow the number of lines, not compressed bytes; no row depends on it."""
    from whetstone.plans import catalog
    from whetstone.registry import Reader

    r = Reader(spark, sf_dir)
    whole = sorted(map(tuple, catalog.s11(r).collect()))
    monkeypatch.setattr(catalog, "LINES", 300)
    dealt = catalog.s11(r)
    assert dealt.rdd.getNumPartitions() >= r("lineitem").count() // 300
    assert sorted(map(tuple, dealt.collect())) == whole and len(whole) == r("orders").count()
