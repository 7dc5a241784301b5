"""Terms of one to several words found in texts: an alias table by first word, longest match first, no overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: letters, digits and marks of any script.
WORD = r"[\p{L}\p{N}\p{M}_]+"
#: Rows of the prefix table that are broadcast at most.
BROADCAST_ROWS = 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def prefix_table(aliases: DataFrame, most: int = 4) -> DataFrame:
    """(first, options): by first word a map from the aliases of up to `most` words that start with it to their terms; aliases: (alias, canonical).

    Case and what stands between words do not count. An alias of several terms names the least of them; aliases without a word
    and null ones are left out.
    """
    w = aliases.select(words(F.col("alias")).alias("w"), "canonical").where(F.size("w").between(1, most)).dropna(subset=["canonical"])
    one = w.select(F.col("w")[0].alias("first"), F.array_join("w", " ").alias("alias"), "canonical").groupBy("first", "alias").agg(F.min("canonical").alias("canonical"))
    return one.groupBy("first").agg(F.map_from_entries(F.collect_list(F.struct("alias", "canonical"))).alias("options"))


def found_terms(texts: DataFrame, aliases: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """(id, place, n, alias, canonical): the aliases of up to `most` words in each text, from the left, the longest at each place, none overlapping.

    place counts words from 0. A place meets the prefix table by its word, and the runs that start there are looked up, longest first; only
    those found leave the join, so a text's group holds its candidates and not its words. Rows with equal ids are
    told apart. Null and empty texts have no terms; an alias of more than `most` words is never found.
    """
    table = prefix_table(aliases, most)
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    rows = texts.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    # a place with its word and those after it: each is taken by its number, so no part of a text is copied
    place = lambda x, i: F.struct(i.alias("place"), x.alias("first"), *(F.get(F.col("w"), i + k).alias(f"w{k}") for k in range(1, most)))
    near = rows.select("__row", "id", F.inline(F.transform("w", place))).join(table, "first")
    runs = [F.concat(F.col("first"), *(x for k in range(1, n) for x in (F.lit(" "), F.col(f"w{k}")))) for n in range(1, most + 1)]
    found = [F.struct(F.lit(n).alias("n"), run.alias("alias"), F.try_element_at("options", run).alias("canonical")) for n, run in enumerate(runs, 1)]
    best = F.coalesce(*[F.when(f["canonical"].isNotNull(), f) for f in reversed(found)])
    hit = near.select("__row", "id", "place", best.alias("o")).where("o is not null")
    hit = hit.select("__row", "id", F.struct("place", "o.n", "o.alias", "o.canonical").alias("hit"))
    kept = hit.groupBy("__row", "id").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    kind = "array<struct<place:int,n:int,alias:string,canonical:{}>>".format(dict(aliases.dtypes)["canonical"])
    start = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("kept"))

    def step(acc, x):
        free = x["place"] >= acc["end"]
        return F.struct(F.when(free, x["place"] + x["n"]).otherwise(acc["end"]).alias("end"), F.when(free, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept"))

    return kept.select(F.col("id").alias(id_col), F.inline(F.aggregate("hits", start, step, lambda a: a["kept"])))
