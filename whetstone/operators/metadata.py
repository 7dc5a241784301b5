"""Profiles, catalogs, lineage graphs, entity matching, retrieval and the query log."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from whetstone.functions import text as X
from whetstone.operators import alike
from whetstone.sources.files import reread, scratch


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, distinct_count, null_pct, min, max) of each column.

    Approximate counts take one pass over the table. Exact ones come from (column, value) counts: two aggregations by
    value and then by column, so no row is expanded by the distinct columns of one aggregate.
    """
    cols = df.columns
    total = df.agg(F.count("*").alias("__n"), *[x for i, c in enumerate(cols) for x in (F.approx_count_distinct(c).alias(f"d{i}"), F.count_if(F.col(c).isNull()).alias(f"z{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("distinct_count"), F.round(100.0 * F.col(f"z{i}") / F.nullif(F.col("__n"), F.lit(0)), 2).alias("null_pct"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)]
    about = total.select(F.inline(F.array(*rows)))
    if not exact:
        return about
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))).where("value is not null")
    counts = values.groupBy("column", "value").agg(F.lit(1)).groupBy("column").agg(F.count("*").alias("exact"))
    return about.join(counts, "column", "left").select("column", F.coalesce("exact", F.lit(0)).alias("distinct_count"), "null_pct", "min", "max")


def enumerated(df: DataFrame, columns: Sequence[str], most: int = 50) -> DataFrame:
    """(column, values, case_sensitive) of string columns with at most `most` values: counted first, listed only then."""
    counts = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first().asDict()
    few = [c for c in columns if counts[c] <= 2 * most]
    sets = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in few]))).where("value is not null").distinct()
    out = sets.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("values")).where(F.size("values") <= most)
    return out.withColumn("case_sensitive", F.size(F.array_distinct(F.transform("values", F.lower))) < F.size("values"))


def merged_edges(*sources: DataFrame) -> DataFrame:
    """Edges (src, dst, weight, source, join_key) of several sources: largest weight, sorted source names, the join key of the last source that has one."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x.withColumn("__i", F.lit(i)) for i, x in enumerate(sources)])
    if "join_key" not in every.columns:
        every = every.withColumn("join_key", F.lit(None).cast("string"))
    last = F.max(F.when(F.col("join_key").isNotNull(), F.struct("__i", "join_key")))["join_key"]
    return every.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("source"), last.alias("join_key"))


def shortest_paths(edges: DataFrame, starts: DataFrame, hops: int | None = 4) -> DataFrame:
    """(start, node, path, n): the least text among shortest directed paths, breadth first, one join a hop; visited nodes are not visited again. Without hops, until no new node is found.

    Each hop is written to the shared folder, so the plan does not grow with the hops. Without hops, most edges lead back to visited nodes. There
    they carry a number instead of the path they go on from: its place in the order of all paths of the last hop, from a sort of these alone.
    The least number into a node is then its least text, and texts are made for new nodes only; names hold no '>' there.
    """
    spark = edges.sparkSession
    edges = reread(edges, scratch(spark, "edges"))
    seen = starts.select(F.col("node").alias("start"), "node", F.col("node").cast("string").alias("path"), F.lit(0).alias("n"))
    front = seen
    for hop in count(1) if hops is None else range(1, hops + 1):
        longer = F.concat_ws(">", "path", F.col("dst").cast("string")).alias("path")
        if hops is None:
            # partitions of a sorted table are in order, and so are these numbers; '>' as that is what follows each path
            held = front.orderBy(F.concat("path", F.lit(">"))).select("start", F.col("node").alias("src"), "path", F.monotonically_increasing_id().alias("place"))
            held = reread(held, scratch(spark, "places"))
            step = held.join(edges, "src").groupBy("start", "dst").agg(F.min("place").alias("place"))
            new = step.join(seen.select("start", F.col("node").alias("dst")), ["start", "dst"], "left_anti").join(held.select("place", "path"), "place").select("start", F.col("dst").alias("node"), longer, F.lit(hop).alias("n"))
        else:
            step = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node"), longer)
            new = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("path").alias("path")).withColumn("n", F.lit(hop))
        front = reread(new, scratch(spark, "front"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


#: Grams of a value up to which it is found by parts of its grams, and the similarity from which that is done.
SHORT, ALIKE = alike.MOST, 0.6
#: Keys of values in a task, at most, about, and so many where there are less tasks than four a core; keys of a value.
KEYS, FEW_KEYS, KEYS_EACH = 400_000, 50_000, 20


def similar_values(values: DataFrame, least: float = 0.3) -> DataFrame:
    """(a, b, similarity) of values whose gram sets' Jaccard reaches `least`, exactly.

    From ALIKE on, values of up to SHORT grams meet by parts of their grams that must be equal (`operators/alike.py`), and are compared where they meet, so
    that only similar pairs leave a task. All others meet by one gram: grams are ordered from the rarest on, and two sets
    that must share `need` grams share one within the first n - need + 1 of each.
    """
    spark = values.sparkSession
    most = SHORT if least >= ALIKE else 0
    known = values.where("value is not null").select("value").distinct()
    if most:
        known = reread(known, scratch(spark, "values"))
    g = known.where(F.length(F.lower("value")) - 2 >= least * most) if most else known  # others have too few grams
    g = g.select("value", F.transform(X.grams(F.lower("value")), X.gram_code).alias("g"))
    often = g.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count("*").alias("often"))
    ranked = g.select("value", F.explode("g").alias("gram")).join(often, "gram").groupBy("value").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("r"))
    ranked = reread(ranked.select("value", F.col("r.gram").alias("g"), F.size("r").alias("n")), scratch(spark, "grams"))
    need = F.ceil(F.lit(least) * F.col("n")).cast("int")
    sizes = F.least("na", "nb") >= least * F.greatest("na", "nb")
    similarity = X.jaccard(F.col("ga"), F.col("gb"))
    # one gram
    first = F.slice("g", F.lit(1), F.col("n") - need + 1)
    index = ranked.where(F.col("n") >= least * most).select("value", "n", *(["g"] if most else []), F.explode(first).alias("gram"))
    side = lambda c: index.select("gram", F.col("value").alias(c), *(F.col(x).alias(f"{x}{c}") for x in index.columns if x in ("n", "g")))
    met = side("a").join(side("b"), "gram").where((F.col("a") < F.col("b")) & sizes & (F.greatest("na", "nb") > most))
    if not most:
        of = lambda c: ranked.select(F.col("value").alias(c), F.col("g").alias(f"g{c}"))
        pairs = met.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
        return pairs.withColumn("similarity", similarity).where(F.col("similarity") >= least).select("a", "b", "similarity")
    out = met.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least).distinct()
    keys = known.count() * KEYS_EACH
    tasks = max(1, -(-keys // KEYS), min(4 * spark.sparkContext.defaultParallelism, keys // FEW_KEYS))
    dealt = known.select("value", F.lower("value").alias("lower")).repartition(tasks, F.xxhash64("value"))  # files of values may be few and of any size
    blocks = dealt.mapInArrow(alike.keys(least, tasks), alike.SCHEMA)
    return out.unionByName(blocks.groupBy("task").applyInArrow(alike.met(least), "a string, b string, similarity double"))


def similar_values_lsh(values: DataFrame, least: float = 0.3, bands: int = 63, rows: int = 2) -> DataFrame:
    """The same by MinHash bands: candidates share a band, then the true Jaccard decides. At 0.3 a pair shares one in 0.997 of cases."""
    g = values.select("value", X.grams(F.lower("value")).alias("g")).withColumn("m", X.minhash(F.col("g"), bands * rows))
    banded = g.select("value", "g", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(F.slice("m", b * rows + 1, F.lit(rows))))).alias("band", "bucket"))
    pairs = banded.select(F.col("value").alias("a"), "band", "bucket").join(banded.select(F.col("value").alias("b"), "band", "bucket"), ["band", "bucket"]).where("a < b").select("a", "b").distinct()
    ga, gb = g.select(F.col("value").alias("a"), F.col("g").alias("ga")), g.select(F.col("value").alias("b"), F.col("g").alias("gb"))
    return pairs.join(ga, "a").join(gb, "b").withColumn("similarity", X.jaccard(F.col("ga"), F.col("gb"))).where(F.col("similarity") >= least).select("a", "b", "similarity")


#: Vectors of a block of the corpus and of the queries, and bytes of queries that are sent to every task at most.
CORPUS_BLOCK, QUERY_BLOCK, SENT_BYTES = 8192, 1024, 16 << 20


def _best(ids, x, labels, asked, q, own, k: int | None, floor: float, bonus: float):
    """(query ids, corpus ids, similarities) of one block: for each query the k best from `floor` on, of each label; ties by id; all if k is None. Vectors as rows.

    Rows with the query's own label gain `bonus`, up to 1 in all. Equal vectors have equal cosines wherever they stand, so each row is summed by itself.
    """
    import numpy as np

    def norms(v):
        return np.sqrt(np.einsum("ij,ij->i", v, v))

    x, q = np.nan_to_num(x, nan=0.0), np.nan_to_num(q, nan=0.0)
    good = norms(x) > 0
    order = np.flatnonzero(good)[np.argsort(ids[good], kind="stable")]
    ids, labels, x = ids[order], labels[order], x[order]
    fine = norms(q) > 0
    asked, q, own = asked[fine], q[fine], own[fine]
    if not len(ids) or not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    length, lengths, groups, out = norms(x), norms(q), [np.flatnonzero(labels == one) for one in np.unique(labels)], []
    for at, v, mark, n in zip(asked.tolist(), q, own.tolist(), lengths.tolist(), strict=True):
        s = np.einsum("ij,j->i", x, v) / (length * n)
        if bonus:
            s = np.minimum(s + np.where(labels == mark, bonus, 0.0), 1.0)
        s[ids == at] = -np.inf
        for g in groups:
            mine = s[g]
            cut = np.partition(mine, -k)[-k] if k is not None and len(mine) > k else -np.inf
            some = np.flatnonzero((mine >= max(cut, floor)) & (mine > -np.inf))
            some = g[some[np.argsort(-mine[some], kind="stable")][:k]]
            out.append((np.full(len(some), at), ids[some], s[some]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(queries: DataFrame, corpus: DataFrame, k: int | None, floor: float = -1.0, by: str | None = None, bonus: float = 0.0) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k nearest by cosine, ties by id; a stated set of queries against all rows. All from `floor` on if k is None.

    With `by`, a column of the corpus, the k nearest of each of its values (nulls are one), which is then a column of the result. With
    `bonus` too, rows whose value is that of the query (which then has the column; null equals none) gain it, up to 1 in all, before they are ranked: similarity is the sum.
    Queries whose size, checked first, is bounded go to every task, and the corpus stays where it is: each batch of it gives k rows a
    query, which are merged. More queries are dealt in blocks that meet blocks of the corpus. A row is no neighbour of
    itself; null and zero vectors, and others of another length, are nobody's.
    """
    import numpy as np
    import pyarrow as pa

    spark = corpus.sparkSession
    vectors = lambda df, *more: df.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), *more)
    label = F.dense_rank().over(Window.orderBy(F.col(by).asc_nulls_first())) if by else None
    if by:  # labels as numbers: a row for each value
        values = corpus.select(by).distinct()
        values = values.select(F.col(by).alias("__value"), label.cast("long").alias("__label"))
        values = F.broadcast(values) if values.limit(10_001).count() <= 10_000 else values
        corpus = corpus.join(values, F.col(by).eqNullSafe(F.col("__value")))
    if bonus:  # -1: no row's label
        queries = queries.join(values, F.col(by) == F.col("__value"), "left")
    held = vectors(corpus, F.col("__label") if by else F.lit(0).cast("long").alias("__label"))
    asking = vectors(queries, F.coalesce("__label", F.lit(-1)).cast("long").alias("__label") if bonus else F.lit(-1).cast("long").alias("__label"))
    schema = "query_id long, vec_id long, similarity double, __label long"

    def rows(got, labels_of):
        cols = [pa.array(c, t) for c, t in zip(got, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
        return [*cols, pa.array(labels_of, pa.int64())]

    size = queries.where("vec_id is not null and embedding is not null").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("numbers")).first()
    if 8 * size["numbers"] <= SENT_BYTES:
        by_length: dict[int, list] = {}
        for r in asking.collect():  # bounded: SENT_BYTES
            by_length.setdefault(len(r["embedding"]), []).append((r["vec_id"], [np.nan if v is None else v for v in r["embedding"]], r["__label"]))
        sent = spark.sparkContext.broadcast({d: (np.array([i for i, _, _ in some], np.int64), np.array([v for _, v, _ in some]).reshape(len(some), d), np.array([o for _, _, o in some], np.int64)) for d, some in by_length.items()})

        def run(batches):
            for b in batches:
                lists, ids, labels = b["embedding"], b["vec_id"].to_numpy(), b["__label"].to_numpy()
                lengths = np.diff(np.asarray(lists.offsets))
                for d in np.unique(lengths).tolist():
                    if d and d in sent.value:
                        at = np.flatnonzero(lengths == d)
                        x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                        q, c, s = _best(ids[at], x, labels[at], *sent.value[d], k, floor, bonus)
                        of = dict(zip(ids[at].tolist(), labels[at].tolist(), strict=True)) if by else {}
                        yield pa.RecordBatch.from_arrays(rows((q, c, s), [of.get(i, 0) for i in c.tolist()]), names=["query_id", "vec_id", "similarity", "__label"])

        found = held.mapInArrow(run, schema)
    else:
        nc, nq = (max(1, -(-n // each)) for n, each in ((corpus.count(), CORPUS_BLOCK), (size["n"], QUERY_BLOCK)))
        own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = asking.withColumns({"asks": F.lit(True), "q": own(nq)}).withColumn("c", every(nc))
        right = held.withColumns({"asks": F.lit(False), "c": own(nc)}).withColumn("q", every(nq))
        task = F.struct(F.col("c").cast("long").alias("c"), F.col("q").cast("long").alias("q"))
        both = left.unionByName(right).select("vec_id", "embedding", "__label", "asks", F.size("embedding").alias("dim"), task.alias("task"))

        def top(table: pa.Table) -> pa.Table:
            d = table["dim"][0].as_py()
            x = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d) if d else np.zeros((len(table), 0))
            ids, asks, labels = table["vec_id"].to_numpy(), table["asks"].to_numpy(), table["__label"].to_numpy()
            q, c, s = _best(ids[~asks], x[~asks], labels[~asks], ids[asks], x[asks], labels[asks], k, floor, bonus)
            of = dict(zip(ids[~asks].tolist(), labels[~asks].tolist(), strict=True)) if by else {}
            return pa.Table.from_arrays(rows((q, c, s), [of.get(i, 0) for i in c.tolist()]), names=["query_id", "vec_id", "similarity", "__label"])

        found = both.groupBy("task", "dim").applyInArrow(top, schema)
    w = Window.partitionBy("query_id", *(["__label"] if by else [])).orderBy(F.desc("similarity"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w))
    ranked = ranked if k is None else ranked.where(F.col("rank") <= k)
    if by:
        ranked = ranked.join(values, "__label").withColumnRenamed("__value", by)
    return ranked.select("query_id", "vec_id", "similarity", "rank", *([by] if by else []))


def chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, part, text, hash, char_count): strides of a fixed size, trimmed, without empty ones."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(size - overlap))
    parts = docs.select("doc_id", "text", F.posexplode(starts).alias("part", "at"))
    out = parts.select("doc_id", "part", F.trim(F.substring("text", F.col("at"), F.lit(size))).alias("chunk")).where("chunk <> ''")
    return out.select("doc_id", "part", F.col("chunk").alias("text"), X.short_hash(F.col("chunk")).alias("hash"), F.length("chunk").alias("char_count"))


def extremes(df: DataFrame) -> DataFrame:
    """(column, min, max, format) of numeric, date and timestamp columns as text, in one pass; other columns are left out."""
    kinds = {c: t for c, t in df.dtypes if t.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "date", "timestamp"))}
    form = lambda t: "YYYY-MM-DD HH:MM:SS" if t.startswith("timestamp") else "YYYY-MM-DD" if t == "date" else "numeric"
    text = lambda c, t: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if t.startswith("timestamp") else c.cast("string")
    one = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), text(F.min(c), t).alias("min"), text(F.max(c), t).alias("max"), F.lit(form(t)).alias("format")) for c, t in kinds.items()]).alias("x"))
    return one.select(F.inline("x"))


#: Formats that all values of a column may have, the first that fits counts.
FORMATS = {"6-digit zero-padded string": r"^\d{6}$", "4-digit code": r"^\d{4}$", "email": "@", "UUID": r"^[0-9a-fA-F-]{36}$"}


def formats(df: DataFrame) -> DataFrame:
    """(column, format) of text columns by all their values, nulls and empty ones aside; null where none fits or there is no value."""
    def of(c):
        v = F.when(F.col(c) != "", F.col(c))
        found = F.lit(None).cast("string")
        for name, p in reversed(FORMATS.items()):
            found = F.when(F.bool_and(v.rlike(p)), name).otherwise(found)
        return F.struct(F.lit(c).alias("column"), found.alias("format"))

    return df.agg(F.array(*[of(c) for c, t in df.dtypes if t == "string"]).alias("x")).select(F.inline("x"))


def bridges(paths: DataFrame) -> DataFrame:
    """(start, node, bridge): the nodes between the ends of each path."""
    between = F.split("path", ">")
    return paths.select("start", "node", F.explode(F.slice(between, F.lit(2), F.greatest(F.size(between) - 2, F.lit(0)))).alias("bridge"))


def hop_keys(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node, hop, join_key) of each hop of each path, from 1; an edge without a key joins on '<src>.id'."""
    nodes = F.split("path", ">")
    hops = F.transform(F.sequence(F.lit(1), F.size(nodes) - 1), lambda i: F.struct(i.alias("hop"), F.element_at(nodes, i).alias("src"), F.element_at(nodes, i + 1).alias("dst")))
    flat = paths.select("start", "node", F.inline(hops))
    return flat.join(edges.select("src", "dst", "join_key"), ["src", "dst"], "left").select("start", "node", "hop", F.coalesce("join_key", F.concat("src", F.lit(".id"))).alias("join_key"))


#: Vectors that cells are fitted on, and queries that the number of probed cells is measured on: at most so many.
FIT_ROWS, CALIBRATION_ROWS = 20_000, 200
#: Queries that meet a block of a cell together, and their products with it that a task holds at once.
PROBING, PRODUCTS = 30_000, 4_000_000


def _first_of(k: int):
    """Of each batch of (query_id, vec_id, similarity) the k rows of each query that Spark's descending order puts first, ties by id."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            q, v, s = b["query_id"].to_numpy(), b["vec_id"].to_numpy(), b["similarity"].to_numpy(zero_copy_only=False)
            odd = np.where(b["similarity"].is_null().to_numpy(zero_copy_only=False), 1, np.where(np.isnan(s), -1, 0))  # NaN is largest, null least
            order = np.lexsort((v, -np.nan_to_num(s), odd, q))
            place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
            yield b.take(pa.array(order[place < k]))

    return run


def _best_of_cell(k: int):
    """Of queries (query_id, q) and a block of a cell (vec_id, e) the k best others of each query.

    Products of matrices choose them, with room for their rounding; the similarities of those chosen are summed number by number.
    """
    import numpy as np
    import pyarrow as pa

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            q = left["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(left), -1)
            x = right["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(right), -1)
            asks, ids, own = left["query_id"].to_numpy(), right["vec_id"].to_numpy(), np.ascontiguousarray(x.T)
            step = max(1, PRODUCTS // len(ids))
            for at in range(0, len(asks), step):
                s = q[at : at + step] @ own
                s[np.isnan(s)] = np.inf  # as the largest, which NaN is to Spark
                s[asks[at : at + step, None] == ids[None]] = -np.inf
                least = np.partition(s, -k, axis=1)[:, -k, None] if len(ids) > k else np.full((len(s), 1), -np.inf)
                i, j = np.nonzero((s >= least - 1e-9) & (s > -np.inf))
                similarity = np.zeros(len(i))
                for d in range(x.shape[1]):
                    similarity += x[j, d] * q[at + i, d]
                pairs = pa.RecordBatch.from_arrays([pa.array(asks[at + i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(similarity, pa.float64())], names=["query_id", "vec_id", "similarity"])
                out += _first_of(k)([pairs])
        return pa.Table.from_batches(out, pa.schema({"query_id": pa.int64(), "vec_id": pa.int64(), "similarity": pa.float64()}))

    return run


def nearest_in_cells(queries: DataFrame, corpus: DataFrame, k: int, recall: float = 0.95) -> DataFrame:
    """(query_id, vec_id, similarity, rank) as `nearest`, from the cells nearest to a query only.

    Cells are k-means centres of a bounded sample; every row is put into its cell. How many cells a query probes is the least
    number that finds `recall` of the true neighbours of a bounded sample of queries.
    """
    import numpy as np
    import pyarrow as pa

    spark = corpus.sparkSession
    unit = lambda df: df.where("vec_id is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("n", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))).where("n > 0").select("vec_id", F.transform(F.array("n"), lambda n: F.transform("e", lambda x: x / n))[0].alias("e"))  # noqa: E731  an outer variable holds the length, as it would be taken anew for each number
    rows = unit(corpus)
    total = corpus.count()
    if not total:
        return nearest(queries, corpus, k)
    drawn = rows.orderBy(F.xxhash64("vec_id")).limit(FIT_ROWS).collect()  # bounded: FIT_ROWS
    sample, names = np.array([x["e"] for x in drawn]), np.array([x["vec_id"] for x in drawn])
    cells = max(1, min(len(sample) // 16 or 1, int(total**0.5) // 4))  # as many as the sample can fit
    centres = sample[:: max(1, len(sample) // cells)][:cells].copy()
    for _ in range(8):
        near = (sample @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (near == c).any():
                m = sample[near == c].mean(0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)

    def ranked(probes):
        def run(batches):
            for b in batches:
                x = b["e"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                top = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["e"], pa.array(list(top.astype(np.int32)), pa.list_(pa.int32()))], names=["vec_id", "e", "cells"])

        return run

    asked = unit(queries)
    tried = asked.orderBy(F.xxhash64("vec_id")).limit(CALIBRATION_ROWS).collect()  # bounded
    some = np.array([x["e"] for x in tried]).reshape(-1, sample.shape[1])
    likeness = some @ sample.T
    likeness[np.array([x["vec_id"] for x in tried], np.int64)[:, None] == names[None]] = -np.inf  # a query is not its own neighbour
    true = np.argsort(-likeness, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(some @ centres.T), axis=1), axis=1)
    deep = np.take_along_axis(place, (sample @ centres.T).argmax(1)[true], 1)
    probes = int(np.quantile(deep, recall, method="higher")) + 1 if len(some) else 1
    schema = "vec_id long, e array<double>, cells array<int>"
    held = rows.mapInArrow(ranked(1), schema).select("vec_id", "e", F.col("cells")[0].alias("cell"))
    held = reread(held, scratch(spark, "cells"))
    blocks = reread(held.groupBy("cell").agg(F.ceil(F.count("*") / CORPUS_BLOCK).cast("int").alias("blocks")), scratch(spark, "blocks"))
    parts = max(1, -(-asked.count() // PROBING))
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
    probing = asked.mapInArrow(ranked(probes), schema).select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"), F.explode("cells").alias("cell"))
    left = probing.join(F.broadcast(blocks), "cell").select("query_id", "q", "cell", part, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = held.join(F.broadcast(blocks), "cell").select("vec_id", "e", "cell", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"))
    by = ("cell", "part", "block")
    both = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best_of_cell(k), "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def embedded(texts: DataFrame, dim: int = 256, embed=None, batch: int = 2048) -> DataFrame:
    """texts with an `embedding`: by `embed`, a function of a list of texts that is called in batches, else hashed 3-grams of unit length."""
    import numpy as np
    import pyarrow as pa

    def hashed(some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), dim), np.float32)
        for i, t in enumerate(some):
            raw = np.frombuffer(t.lower().encode(), np.uint8).astype(np.uint32)
            if len(raw) > 2:
                h = (raw[:-2] * np.uint32(40503) + raw[1:-1] * np.uint32(30011) + raw[2:] * np.uint32(20011)) * np.uint32(2654435761) >> np.uint32(16)
                out[i] = np.bincount(h % dim, minlength=dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    call = embed or hashed

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = np.asarray(call([t or "" for t in part["text"].to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(got), pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

    from pyspark.sql import types as T

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))
