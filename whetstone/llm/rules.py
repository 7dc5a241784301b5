"""Quality rules whose cutoffs are risk-controlled on labelled holdouts, in DataFrame operations only.

Each rule rejects a document whose measure is above a cutoff. Per stratum and rule, cutoffs are tried from the mildest
on: a cutoff holds if the exact binomial tail P(X <= rejected | n, limit) of the clean labelled rows is at most
delta / (strata * rules). The first that does not hold ends the sequence, so trying several cutoffs costs no more
confidence (fixed-sequence testing), and the division by strata and rules (Bonferroni) covers the rest: with confidence 1 - delta
no stratum's rule rejects more than `limit` of the clean documents.

A stratum whose clean labels are too few to certify even a cutoff that rejects none of them is small. Small strata are tested
as one pooled stratum; where they are too few together, all strata are. Which strata are pooled follows from their counts
alone, never from what a cutoff rejects, so the correction by the number of tested strata still holds; the bound is then on the
pool's clean documents as a whole. With too few labels in the pool, too, a rule rejects nothing. What a stratum's own labels
say of its share in a pool's rejections is told by `stratum_bounds`.

A labelled document counts once, however often its row is repeated: copies are no further evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whetstone.llm.common import WORD, durable

#: For each rule a measure and its cutoffs, mildest first.
CUTOFFS = {
    "symbols": (0.30, 0.25, 0.20, 0.16, 0.13, 0.10, 0.08, 0.06, 0.05, 0.04, 0.03),
    "dup_lines": (0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30),
    "repeats": (0.19, 0.17, 0.15, 0.13, 0.11, 0.09, 0.07, 0.05),
    "upper": (0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30),
    "word_length": (30.0, 25.0, 20.0, 16.0, 14.0, 12.0),
}
LIMIT, DELTA = 0.002, 0.05


def measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null counts as empty.

    Repeated windows are found within the array of a text's 5-word window hashes: sorted with their places, equal
    neighbours are repeats; covered words are counted from gaps between the places. Nothing is exploded or shuffled.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))

    def of_hashes(h):  # h: one hash a window
        def repeated(_):
            ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def places(s):
                near = F.filter(s[0], lambda x, i: ((i > 0) & (x["h"] == F.get(s[0], i - 1)["h"])) | ((i + 1 < F.size(s[0])) & (x["h"] == F.get(s[0], i + 1)["h"])))
                return F.array_sort(F.transform(near, lambda x: x["i"]))

            at = F.transform(F.array(F.array(ordered)), places)
            return F.transform(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.get(p, i + 1) - x, F.lit(5))).otherwise(F.lit(5))), F.lit(0).cast("long"), lambda a, x: a + x))[0]

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated(None))

    def of_words(w):
        windows = F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(5))))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            F.transform(F.array(windows), of_hashes)[0].alias("n_repeat_words"),
        )

    lines = F.transform(F.array(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))[0]
    words = F.transform(F.array(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))), of_words)[0]
    return F.struct(words.alias("w"), lines.alias("l"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"))


def _ln_factorial(n: Column) -> Column:
    """Stirling's series, exact to rounding from 16 on; below, a sum of logarithms."""
    x = F.greatest(n.cast("double"), F.lit(1.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    few = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n.cast("int"), F.lit(1)), F.lit(16))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    return F.when(n <= 16, few).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p): the probability of k, times the falling ratios down to 0, all of them."""
    odds = (1 - p) / p
    ln_k = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a, i):  # i = k .. 1: from the term of i to that of i - 1
        term = a["term"] * i / (n - i + 1) * odds
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(k > 0, F.sequence(k.cast("long"), F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>")), start, step)["sum"]
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(ln_k) * total)  # above the mean no bound of interest holds


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row a document with its counts, its base verdict and the measures of the rules."""
    m = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[stratum_col].cast("string"), F.lit("")).alias("stratum"), F.xxhash64(docs[text_col], docs[stratum_col]).alias("h"), measures(docs[text_col]).alias("m"))
    m = m.select("doc_id", "stratum", "h", "m.w.*", "m.l.*", "m.n_symbols", "m.n_upper")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return m.withColumn("base_failed", failed).withColumns({"symbols": ratio("n_symbols", "word_chars"), "dup_lines": ratio("n_dup_lines", "n_lines"), "repeats": ratio("n_repeat_words", "n_words"), "upper": ratio("n_upper", "word_chars"), "word_length": ratio("word_chars", "n_words")})


def cutoffs(rows: DataFrame, labels: DataFrame, limit: float = LIMIT, delta: float = DELTA) -> DataFrame:
    """(stratum, tested_as, n, rule cutoffs, rule rejections): of each stratum and rule the strictest cutoff that holds.

    A cutoff is infinite if none holds. tested_as is the stratum itself, 'small' or 'all' (module docstring), n the clean labelled rows tested and rejected_*
    how many of them the cutoff rejects. Clean rows are those labelled 1 that the base rules keep. Null labels and ids are left
    out; of several labels the largest counts. A stratum of rows without a label has none of its own and is small.
    """
    clean = labels.where("quality = 1").select("doc_id").distinct()
    hold = rows.where("not base_failed").join(clean, "doc_id", "left_semi").distinct()
    tries = [f"{r}_{i}" for r, cs in CUTOFFS.items() for i in range(len(cs))]
    own = hold.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, cs in CUTOFFS.items() for i, c in enumerate(cs)])
    own = durable(rows.select("stratum").distinct().join(own, "stratum", "left").na.fill(0))  # a row for each stratum
    # the least level a stratum may get is that with every stratum tested on its own: the same for all, known from counts
    alone = own.crossJoin(F.broadcast(own.agg(F.count("*").alias("many")))).withColumn("small", F.pow(F.lit(1 - limit), F.col("n")) > delta / ((F.col("many") + 1) * len(CUTOFFS)))
    small = alone.where("small").agg(F.lit("small").alias("as"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["n", *tries]])
    every = own.agg(F.lit("all").alias("as"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["n", *tries]])
    size = alone.agg(F.count_if(~F.col("small")).alias("large"), F.sum(F.when(F.col("small"), F.col("n")).otherwise(0)).alias("together"))
    size = size.select(F.when(F.pow(F.lit(1 - limit), F.col("together")) > delta / ((F.col("large") + 1) * len(CUTOFFS)), "all").otherwise("small").alias("pool"))
    placed = durable(alone.crossJoin(F.broadcast(size)).select("stratum", F.col("small").alias("pooled"), F.when(F.col("small"), F.col("pool")).alias("pool"), "n", *tries))
    pools = small.unionByName(every).join(placed.where("pooled").select(F.col("pool").alias("as")).distinct(), "as", "left_semi")
    counts = durable(placed.where("not pooled").select(F.lit(False).alias("pooled"), F.col("stratum").alias("as"), "n", *tries).unionByName(pools.select(F.lit(True).alias("pooled"), "as", "n", *tries)).withColumnRenamed("as", "stratum"))
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"{r}_{i}").alias("k")) for i, c in enumerate(cs)]).alias("tries")) for r, cs in CUTOFFS.items()])
    strata = counts.agg(F.count("*").alias("strata"))
    tests = counts.select("pooled", "stratum", "n", F.explode(each).alias("x")).select("pooled", "stratum", "n", "x.*").crossJoin(F.broadcast(strata))  # one row on the right
    level = delta / (F.col("strata") * len(CUTOFFS))
    tried = tests.select("pooled", "stratum", "rule", "n", level.alias("level"), F.posexplode("tries").alias("i", "t"))
    held = tried.withColumn("holds", binomial_tail(F.col("t.k"), F.col("n"), limit) <= F.col("level"))
    stop = held.groupBy("pooled", "stratum", "rule", "n").agg(F.min(F.when(~F.col("holds"), F.col("i"))).alias("stop"), F.max("i").alias("last"), F.array_sort(F.collect_list(F.struct("i", "t.c", "t.k"))).alias("cs"))
    best = F.coalesce(F.col("stop"), F.col("last") + 1)
    last = F.get(F.col("cs"), best - 1)
    chosen = stop.select("pooled", "stratum", "n", "rule", F.when(best > 0, last["c"]).otherwise(F.lit(float("inf"))).alias("cut"), F.when(best > 0, last["k"]).otherwise(0).alias("rejected"))
    wide = chosen.groupBy("pooled", "stratum", "n").agg(*[F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"{c}_{r}") for c in ("cut", "rejected") for r in CUTOFFS])
    tested = placed.select("stratum", "pooled", F.coalesce("pool", "stratum").alias("tested_as"))
    return tested.join(wide.withColumnRenamed("stratum", "tested_as"), ["pooled", "tested_as"]).select("stratum", "tested_as", "n", *[f"{c}_{r}" for c in ("cut", "rejected") for r in CUTOFFS])


def upper_bound(k: Column, n: Column, level: Column) -> Column:
    """The largest rate at which k or fewer of n are still seen with probability `level`: exact, by halving; 1 without rows."""
    tail = lambda p: F.when(k >= n, F.lit(1.0)).otherwise(_tail_at(k, n, p))

    def halve(ab, _):
        mid = (ab["a"] + ab["b"]) / 2
        above = tail(mid) > level
        return F.struct(F.when(above, mid).otherwise(ab["a"]).alias("a"), F.when(above, ab["b"]).otherwise(mid).alias("b"))

    steps = F.sequence(F.lit(1), F.lit(40))
    return F.when(n > k, F.aggregate(steps, F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("b")), halve, lambda ab: ab["b"])).otherwise(F.lit(1.0))


def _tail_at(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Bin(n, p) with p a column: the sum of its terms, each from its logarithm."""
    term = lambda i: F.exp(_ln_factorial(n) - _ln_factorial(i) - _ln_factorial(n - i) + i * F.log(p) + (n - i) * F.log(1 - p))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), F.lit(0.0), lambda a, i: a + term(i))


def stratum_bounds(rows: DataFrame, labels: DataFrame, cuts: DataFrame, delta: float = DELTA) -> DataFrame:
    """(stratum, tested_as, rule, cut, n, rejected, bound): what each stratum's own labels say of each cutoff in use, pooled or not.

    n and rejected count the stratum's own clean labelled documents; bound is the rate that its false rejections stay below with confidence
    1 - delta for all strata and rules together. Large where a stratum has few labels: that much the pooled test leaves
    open for it. A cutoff that rejects nothing has bound 0. rows: from `measured`; cuts: from `cutoffs`.
    """
    clean = labels.where("quality = 1").select("doc_id").distinct()
    hold = rows.where("not base_failed").join(clean, "doc_id", "left_semi").distinct()
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"cut_{r}").alias("cut"), F.col(r).alias("value")) for r in CUTOFFS])
    cut_of = cuts.select("stratum", "tested_as", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"cut_{r}").alias("cut")) for r in CUTOFFS])))
    seen = hold.join(cuts.drop("n"), "stratum").select("stratum", F.inline(each)).groupBy("stratum", "rule").agg(F.count("*").alias("n"), F.count_if(F.col("value") > F.col("cut")).alias("rejected"))
    both = cut_of.join(seen, ["stratum", "rule"], "left").na.fill(0, ["n", "rejected"])
    tests = cuts.count() * len(CUTOFFS)  # a row for each stratum
    bound = F.when(F.col("cut") == float("inf"), F.lit(0.0)).otherwise(upper_bound(F.col("rejected"), F.col("n"), F.lit(delta / max(tests, 1))))
    return both.select("stratum", "tested_as", "rule", "cut", "n", "rejected", bound.alias("bound"))


def rejections(judged: DataFrame, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang") -> DataFrame:
    """(stratum, rows, base_failed, rejected, clean, clean_rejected) of judged rows: how many the base rules and the cutoffs reject. Needs distinct ids."""
    of = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[stratum_col].cast("string"), F.lit("")).alias("stratum"))
    good = labels.where("quality = 1").select("doc_id", F.lit(True).alias("clean")).distinct()
    cut = ~F.col("base_failed") & ~F.col("kept")
    clean = F.coalesce("clean", F.lit(False)) & ~F.col("base_failed")
    return judged.join(of, "doc_id").join(good, "doc_id", "left").groupBy("stratum").agg(F.count("*").alias("rows"), F.count_if("base_failed").alias("base_failed"), F.count_if(cut).alias("rejected"), F.count_if(clean).alias("clean"), F.count_if(clean & cut).alias("clean_rejected"))


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    rows = durable(measured(docs, id_col, text_col, stratum_col))
    cuts = durable(cutoffs(rows, labels))
    # one row a stratum
    both = rows.join(cuts, "stratum", "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.coalesce(F.col(f"cut_{r}"), F.lit(float("inf"))), F.lit(r)) for r in CUTOFFS]))
    return both.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules) of each row.

    Null and empty texts have no words and fail the base rules. Null strata are one stratum. Repeated rows are judged alike,
    different texts of one id each by itself. Texts of any length are measured whole. No rows give none; other columns are ignored and
    may have any names.
    """
    return _judged(docs, labels, id_col, text_col, stratum_col).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that pass, as they are, with columns of any names. Rows without an id are left out; repeated rows pass alike."""
    keep = _judged(docs, labels, "doc_id", "text", "lang").where("kept").select(F.col("doc_id").alias("id"), "h").distinct()
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("held"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"], docs["lang"]).alias("h"))
    return rows.join(keep, ["id", "h"], "left_semi").select("held.*")
