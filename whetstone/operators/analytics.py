"""Recurring analytical patterns: as-of joins, funnels, cohorts, cumulative shares, histograms and the metric layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whetstone.sources.files import reread, scratch


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: Sequence[str]) -> DataFrame:
    """For each left row the values of the latest right row of its key that is not later. One shuffle by key, no range join.

    Left and right rows are sorted together; right rows come first among equal times. Without such a row, values are null.
    """
    state = F.struct(*[F.col(v).alias(v) for v in values])
    a = left.select(F.col(key).alias("__k"), F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row")).withColumn("__state", F.lit(None).cast(right.select(state).schema[0].dataType))
    b = right.select(F.col(key).alias("__k"), F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), state.alias("__state"))
    w = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__state", F.last("__state", ignorenulls=True).over(w))
    return both.where("__side = 1").select("__row.*", *[F.col("__state")[v].alias(v) for v in values])


def snapshot(df: DataFrame, key: str, ts: str, at: Column, tie: str) -> DataFrame:
    """The state of a history at a time: of each key the latest row that is not later."""
    return df.where(F.col(ts) <= at).groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(ts, tie)).alias("__r")).select("__r.*")


def funnel(events: DataFrame, user: str, ts: str, kind: str, stages: Sequence[str]) -> DataFrame:
    """(stage, users): users who reached each stage after the one before it; one shuffle by user, first times only."""
    firsts = events.groupBy(user).agg(*[F.min(F.when(F.col(kind) == s, F.col(ts))).alias(f"t{i}") for i, s in enumerate(stages)])
    reached, cond = [], F.lit(True)
    for i in range(len(stages)):
        cond = cond & F.col(f"t{i}").isNotNull() & (F.col(f"t{i}") >= F.col(f"t{i - 1}") if i else F.lit(True))
        reached.append(F.count_if(cond).alias(f"n{i}"))
    counts = firsts.agg(*reached)
    return counts.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("stage"), F.col(f"n{i}").alias("users")) for i, s in enumerate(stages)])))


def cumulative_share(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with `running`, `total` and `share`: values summed from the largest on, over the total, ties by key. Limits go by `within`, as a share of decimals is rounded.

    Rows are dealt by range of (value, key), so equal values part by key; sums of ranges precede sums within a range, and no
    task holds all rows.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, F.desc(value), key).withColumn("__p", F.spark_partition_id())
    dealt = reread(dealt, scratch(spark, "ranges"))
    sums = dealt.groupBy("__p").agg(F.sum(value).alias("s"))
    every = Window.orderBy("__p")  # a row for each range
    ahead = sums.select("__p", (F.sum("s").over(every) - F.col("s")).alias("__ahead"), F.sum("s").over(Window.partitionBy(F.lit(0))).alias("total"))
    w = Window.partitionBy("__p").orderBy(F.desc(value), key).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(ahead), "__p").withColumn("running", F.col("__ahead") + F.sum(value).over(w))  # `parts` rows at most
    return out.withColumn("share", F.col("running") / F.col("total")).drop("__p", "__ahead")


def within(percent: int) -> Column:
    """Of `cumulative_share`: whether the running sum is at most so much of the total, by multiplication, which is exact for decimals."""
    return F.col("running") * 100 <= F.col("total") * percent


def bucket_counts(df: DataFrame, value: str, bounds: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """(labels, le, cum, total, sum): cumulative histogram counts in one pass; the last bound is infinite."""
    every = [*bounds, float("inf")]
    agg = df.groupBy(*labels).agg(F.sum(value).alias("sum"), F.count(value).alias("total"), *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(every)])
    return agg.select(*labels, "sum", "total", F.inline(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("cum")) for i, b in enumerate(every)])))


def bucket_quantile(buckets: DataFrame, q: float, labels: Sequence[str] = ()) -> DataFrame:
    """(labels, value): the q-quantile from cumulative buckets, linear inside a bucket; the lower bound of the last one."""
    w = Window.partitionBy(*labels).orderBy("le") if labels else Window.orderBy("le")
    b = buckets.withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("before", F.coalesce(F.lag("cum").over(w), F.lit(0)))
    rank = q * F.col("total")
    inside = F.when(F.col("le") == float("inf"), F.col("lo")).otherwise(F.col("lo") + (F.col("le") - F.col("lo")) * (rank - F.col("before")) / F.nullif(F.col("cum") - F.col("before"), F.lit(0)))
    return b.where(F.col("cum") >= rank).withColumn("value", inside).groupBy(*labels).agg(F.min_by("value", "le").alias("value"))


def metric(df: DataFrame, measures: dict[str, str], dimensions: Sequence[str] = (), time_col: str | None = None, grain: str | None = None, rules: Sequence[str] = ()) -> DataFrame:
    """The metric layer: named SQL aggregates by dimensions and a time grain, under filter rules, all SQL expressions."""
    for r in rules:
        df = df.where(F.expr(r))
    keys = [F.expr(d).alias(d) if d in df.columns else F.expr(d) for d in dimensions]
    if time_col and grain:
        keys.append(F.date_trunc(grain, F.col(time_col)).alias("period"))
    return df.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in measures.items()])


def top_k(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def page_after(df: DataFrame, key: str, last: int, size: int) -> DataFrame:
    """Keyset paging: the next rows by key; the filter is pushed to the scan."""
    return df.where(F.col(key) > last).orderBy(key).limit(size)


def path_join(frames: dict[str, DataFrame], path: Sequence[tuple[str, str, str]], start: str) -> DataFrame:
    """Joins along a path of (table, left column, right column) from a start table."""
    out = frames[start]
    for table, a, b in path:
        out = out.join(frames[table], F.col(a) == F.col(b))
    return out


def scan_partitioned(df: DataFrame, column: str, low, high) -> DataFrame:
    """A scan that refuses to run without both bounds of its partition column."""
    if low is None or high is None:
        raise ValueError(f"a scan needs bounds on {column}")
    return df.where((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high)))


#: Items up to which a basket is found by two of its items together.
WIDE = 24


def similar_baskets(df: DataFrame, basket: str, item: str, percent: int = 50) -> DataFrame:
    """(a, b, jaccard): all pairs a < b of baskets whose item sets have a Jaccard similarity of percent / 100 or more.

    Prefix filter: two sets that must share `need` items share k of them within the n - need + k rarest items of each. Where two items or more must be
    shared, baskets of up to WIDE items meet by two together, others by one. A pair counts at its first such items only.
    """
    items = df.select(F.col(basket).alias("o"), F.col(item).alias("i")).dropna().distinct()
    ranked = items.join(items.groupBy("i").agg(F.count("*").alias("f")), "i")
    sets = ranked.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("f", "i"))).alias("s")).select("o", F.transform("s", lambda x: x["i"]).alias("s"), F.size("s").alias("n"))
    sets = sets.withColumn("need", F.floor((F.col("n") * percent + 99) / 100).cast("int"))
    sets = reread(sets, scratch(df.sparkSession, "baskets"))
    single, double = "transform(p, x -> xxhash64(x))", "flatten(transform(p, (x, j) -> transform(slice(p, j + 2, size(p)), y -> xxhash64(x, y))))"
    # a pair meets by two items if the larger set must share two; a set that must share one is there for its larger partners
    some = {1: (single, (F.col("need") <= 1) | (100 * F.col("n") > percent * WIDE)), 2: (double, F.col("n").between(2, WIDE))}
    parts = []
    for k, (keys, where) in some.items():
        p = sets.where(where).withColumn("p", F.slice("s", F.lit(1), F.col("n") - F.greatest("need", F.lit(k)) + k))
        parts.append(p.select("o", "s", "n", "need", "p", F.lit(k).alias("k"), F.explode(F.expr(keys)).alias("key")))
    index = parts[0].unionByName(parts[1])
    x, y = (index.select("k", "key", F.col("o").alias(c), *(F.col(v).alias(f"{v}{c}") for v in ("s", "n", "need", "p"))) for c in "ab")
    level = F.when(F.greatest("na", "nb") > WIDE, 1).otherwise(F.least(F.lit(2), F.greatest("needa", "needb")))
    common = F.array_intersect("pa", "pb")
    first = F.when(F.col("k") == 1, F.xxhash64(F.get(common, F.lit(0)))).otherwise(F.xxhash64(F.get(common, F.lit(0)), F.get(common, F.lit(1))))
    met = x.join(y, ["k", "key"]).where((F.col("a") < F.col("b")) & (level == F.col("k")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (first == F.col("key")))
    both = met.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("both"))
    union = F.col("na") + F.col("nb") - F.col("both")
    return both.where(100 * F.col("both") >= percent * union).select("a", "b", (F.col("both") / union).alias("jaccard"))
