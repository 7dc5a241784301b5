"""A stored index of column values, probed by batches of keywords that may be misspelt.

The index is an inverted list of character 3-grams in folders by bucket of the gram. Beside each gram a posting holds the
number of grams its value has and the class of that number, so the list of a frequent gram is split by length and a keyword
reads only the classes that can reach the wanted similarity. Postings give candidates, whose similarity is taken from all of their
grams, so it is exact. Values are added by appending; known ones are skipped.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whetstone.functions import text as X
from whetstone.sources.files import reread, scratch

#: Folders of postings; growth of the length classes; rows of a probe that are broadcast at most.
BUCKETS, GROWTH, BROADCAST_ROWS = 32, 1.5, 200_000
#: Postings of a block of values: at most, about, and so many where there are less blocks than two a core.
BLOCK, SMALL_BLOCK = 4_000_000, 500_000
#: Grams of a keyword, the rarest of a block, that are taken first, and values met that are compared for a bound.
PROBED, TRIED = 2, 64


def column_values(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]]) -> DataFrame:
    """(tab, col, value): distinct trimmed values of two characters or more, all columns of a table in one pass."""
    parts = []
    for table, names in columns.items():
        one = F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.trim(F.col(c).cast("string")).alias("value")) for c in names]))
        parts.append(tables[table].select(F.lit(table).alias("tab"), one))
    return reduce(DataFrame.unionByName, parts).where(F.length("value") >= 2).distinct()


def _key(value: Column) -> Column:
    """Of the lower-case value: what postings know it by. The final similarity is taken from the values themselves."""
    return F.xxhash64(F.lower(value))


def _length_class(n: Column) -> Column:
    return F.floor(F.log(GROWTH, n)).cast("int")


def _postings(values: DataFrame) -> DataFrame:
    g = values.select(_key(F.col("value")).alias("key"), X.grams(F.lower("value")).alias("g")).dropDuplicates(["key"])
    each = g.select("key", F.size("g").alias("n"), F.explode("g").alias("gram"))
    return each.select("gram", _length_class(F.col("n")).alias("class"), "n", "key", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def add_values(values: DataFrame, path: str) -> None:
    """Appends the (tab, col, value) rows that the index at `path` does not have; null values and repeated rows add nothing.

    Each call is a run with folders of its own. Postings are written before values, and readers take the postings of runs
    that have their values only, so a call that fails halfway adds nothing.
    """
    spark, run = values.sparkSession, uuid.uuid4().hex
    new = values.select("tab", "col", "value").dropna(subset=["value"]).distinct()
    fresh = new
    if _exists(spark, f"{path}/values"):
        known = spark.read.parquet(f"{path}/values")
        same = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("tab", "col", "value")])
        new = new.alias("a").join(known.alias("b"), same("a", "b"), "left_anti")
        fresh = new.withColumn("key", _key(F.col("value"))).join(known.select("key").distinct(), "key", "left_anti").drop("key")
    by_bucket = _postings(fresh).hint("rebalance", "bucket")  # a large bucket is dealt to several tasks
    by_bucket.sortWithinPartitions("bucket", "gram", "class").write.partitionBy("bucket").parquet(f"{path}/postings/run={run}")
    new.withColumn("key", _key(F.col("value"))).write.parquet(f"{path}/values/run={run}")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _scan(k: int, least: float):
    """Of keywords (id, codes) and a block's values (key, tab, col, value) and postings (key, code, n): for each keyword its k best values of the block, (id, key, similarity).

    A keyword's grams are taken from the rarest of the block on. The k-th best of the values met so far is a bound; once a value without any of
    the grams taken cannot reach it, of those met only the ones whose further grams could take them there are compared by all their grams.
    """
    import numpy as np
    import pyarrow as pa

    def run(left: pa.Table, postings: pa.Table) -> pa.Table:
        words, named = left.filter(left["id"].is_valid()), left.filter(left["key"].is_valid())
        out = []
        if len(words) and len(postings):
            keys, value = np.unique(postings["key"].to_numpy(), return_inverse=True)
            codes, gram = np.unique(postings["code"].to_numpy(), return_inverse=True)
            sizes = np.zeros(len(keys), np.int64)
            sizes[value] = postings["n"].to_numpy()
            by_gram, by_value = np.argsort(gram, kind="stable"), np.argsort(value, kind="stable")
            lists, begin = value[by_gram].astype(np.int32), np.searchsorted(gram[by_gram], np.arange(len(codes) + 1))
            rows, row = gram[by_value].astype(np.int32), np.searchsorted(value[by_value], np.arange(len(keys) + 1))
            del value, gram, by_gram, by_value, postings
            place = np.zeros(len(keys), np.int64)  # ties go by table, column and value
            order = named.sort_by([(c, "ascending") for c in ("tab", "col", "value")])["key"].to_numpy()
            at = np.minimum(np.searchsorted(keys, order), len(keys) - 1)
            there = keys[at] == order
            place[at[there]] = np.flatnonzero(there)
            asked = np.zeros(len(codes), bool)

            def similarity(some, n):
                """By all grams of the values, of those of the keyword that `asked` marks."""
                lengths = row[some + 1] - row[some]
                ends = np.cumsum(lengths)
                both = np.add.reduceat(asked[rows[np.repeat(row[some] - ends + lengths, lengths) + np.arange(ends[-1])]].astype(np.int64), ends - lengths)
                return both / (n + sizes[some] - both)

            flat, ends = words["codes"].combine_chunks(), words["codes"].combine_chunks().offsets.to_numpy()
            flat = flat.values.to_numpy()
            for i, word in enumerate(words["id"].to_pylist()):
                own = flat[ends[i] : ends[i + 1]]
                n, g = len(own), np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                g = g[codes[g] == own]
                if not len(g):
                    continue
                g = g[np.argsort(begin[g + 1] - begin[g], kind="stable")]
                asked[g] = True
                bound, used = least - 1e-9, min(PROBED, len(g))
                while True:
                    touched = np.concatenate([lists[begin[x] : begin[x + 1]] for x in g[:used]])
                    if len(touched) * 16 < len(keys):
                        some, met = np.unique(touched, return_counts=True)
                    else:
                        met = np.bincount(touched, minlength=len(keys))
                        some = np.flatnonzero(met >= max(1.0, bound * n - (len(g) - used)))
                        met = met[some]
                    most = np.minimum(met + (len(g) - used), sizes[some])
                    most = most / (n + sizes[some] - most)
                    if len(some) >= k:
                        first = some[np.argpartition(-most, TRIED - 1)[:TRIED]] if len(some) > TRIED else some
                        bound = max(bound, np.partition(similarity(first, n), len(first) - k)[len(first) - k] - 1e-9)
                    needed = min(int(n - bound * n) + 1 - (n - len(g)), len(g))  # without so many of its rarest grams a value stays below the bound
                    if used >= needed:
                        break
                    used = min(needed, 2 * used)
                some = some[most >= bound]
                if len(some):
                    s = similarity(some, n)
                    some, s = some[s >= bound], s[s >= bound]
                    best = np.lexsort((place[some], -s))[:k]
                    out.append((np.full(len(best), word), keys[some[best]], s[best]))
                asked[g] = False
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("id", "key", "similarity"), cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return run


def match_keywords(keywords: DataFrame, path: str, k: int = 5, least: float = 0.3) -> DataFrame:
    """(keyword, tab, col, value, similarity, rank): of each distinct keyword the k values of greatest Jaccard similarity from `least` on.

    Ties go by table, column and value. Null and empty keywords match nothing. Of the index those postings are read whose gram a keyword has and whose
    length class can reach `least` with it. They are dealt to tasks by blocks of values; each holds a block's lists and looks up all keywords in them,
    so no pair of a keyword and a value leaves a task unless it is among the block's k best.
    The grams that matter are broadcast to the postings where they are few (after a count), else joined by shuffle; only their folders are read then.
    """
    spark = keywords.sparkSession
    values = spark.read.parquet(f"{path}/values")
    whole = [r["run"] for r in values.select("run").distinct().collect()]  # one a call of add_values
    postings = spark.read.parquet(f"{path}/postings").where(F.col("run").isin(whole)).select("bucket", "gram", "class", "n", "key")
    asked = keywords.select(F.col("keyword")).where("keyword is not null and keyword <> ''").distinct()
    asked = asked.select(F.monotonically_increasing_id().alias("id"), "keyword", X.grams(F.lower(F.trim("keyword"))).alias("g"))
    asked = reread(asked.select("id", "keyword", "g", F.transform("g", X.gram_code).alias("codes")), scratch(spark, "asked"))  # ids must stay
    n = F.size("g")
    classes = F.sequence(_length_class(F.greatest(F.ceil(F.lit(least) * n - 1e-9), F.lit(1))), _length_class(F.floor(n / F.lit(least) + 1e-9)))
    reach = asked.select(F.explode("g").alias("gram"), classes.alias("classes")).distinct().select("gram", F.explode("classes").alias("class")).distinct()
    reach = reread(reach.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")), scratch(spark, "reach"))
    few = reach.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        folders = [r["bucket"] for r in reach.select("bucket").distinct().collect()]  # BUCKETS rows at most
        postings = postings.where(F.col("bucket").isin(folders))
    postings = postings.join(F.broadcast(reach) if few else reach, ["bucket", "gram", "class"], "left_semi").select("key", X.gram_code(F.col("gram")).alias("code"), F.col("n").cast("long").alias("n"))
    held = postings.count()
    blocks = max(1, math.ceil(held / BLOCK), min(2 * spark.sparkContext.defaultParallelism, math.ceil(held / SMALL_BLOCK)))
    block = F.pmod(F.xxhash64(F.lit("block"), "key"), F.lit(blocks)).cast("int").alias("block")
    none = lambda t, *names: [F.lit(None).cast(t).alias(x) for x in names]
    words = asked.select("id", "codes", *none("long", "key"), *none("string", "tab", "col", "value"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    named = values.groupBy("key").agg(F.min(F.struct("tab", "col", "value")).alias("v")).select(*none("long", "id"), *none("array<long>", "codes"), "key", "v.*", block)
    met = words.unionByName(named).groupBy("block").cogroup(postings.withColumn("block", block).groupBy("block")).applyInArrow(_scan(k, least), "id long, key long, similarity double")
    met = met.withColumn("r", F.rank().over(Window.partitionBy("id").orderBy(F.desc("similarity")))).where(F.col("r") <= k).select("id", "key")  # of all blocks; ties stay
    met = reread(met, scratch(spark, "met"))
    sets = values.join(met.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("value").alias("value")).select("key", F.transform(X.grams(F.lower("value")), X.gram_code).alias("codes_of"))
    near = met.join(asked.select("id", "keyword", "codes"), "id").join(sets, "key").select("keyword", "key", X.jaccard(F.col("codes"), F.col("codes_of")).alias("similarity")).where(F.col("similarity") >= least)
    w = Window.partitionBy("keyword").orderBy(F.desc("similarity"), "tab", "col", "value")
    return near.join(values.drop("run"), "key").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("keyword", "tab", "col", "value", "similarity", "rank")
