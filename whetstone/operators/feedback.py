"""Training pairs from logs, error classes, guards, scores and choices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def confident(pairs: DataFrame, least: str) -> DataFrame:
    """Pairs of at least a confidence; none counts as LOW."""
    ranks = F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv])
    return pairs.where(F.try_element_at(ranks, F.coalesce("confidence", F.lit("LOW"))) >= RANKS[least])


def training_pairs(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Pairs (question, sql, confidence, created_at) of several sources, earlier ones first, by question and SQL that are not blank."""
    every = [df.select("question", "sql", "confidence", "created_at", F.lit(s).alias("source"), F.lit(i).alias("priority")) for i, (s, df) in enumerate(sources)]
    return reduce(DataFrame.unionByName, every).where("trim(question) <> '' and trim(sql) <> ''")


def first_of_questions(pairs: DataFrame) -> DataFrame:
    """One pair a question but for case and outer spaces: of the first source, the latest, the least SQL."""
    w = Window.partitionBy(F.lower(F.trim("question"))).orderBy("priority", F.desc_nulls_last("created_at"), "sql", "question")
    return pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def shaped(pairs: DataFrame, shape: str, system: str = "Answer with one SQL statement.") -> DataFrame:
    """(value): pairs as JSON lines: chat messages, preference with an open negative, or raw."""
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    q, s = F.col("question"), F.col("sql")
    of = {
        "chat": F.struct(F.array(said("system", F.lit(system)), said("user", q), said("assistant", s)).alias("messages")),
        "preference": F.struct(q.alias("prompt"), s.alias("chosen"), F.lit("").alias("rejected"), F.struct("source", "confidence").alias("metadata")),
        "raw": F.struct("question", "sql", "source", "confidence"),
    }
    return pairs.select(F.to_json(of[shape]).alias("value"))


def classified(messages: DataFrame, rules: Sequence[tuple[str, str, Sequence[str]]], default: tuple[str, str]) -> DataFrame:
    """messages with category and subtype of the first rule one of whose words the message has; rules: (category, subtype, words)."""
    m, found = F.lower("message"), F.struct(F.lit(default[0]).alias("category"), F.lit(default[1]).alias("subtype"))
    for category, subtype, words in reversed(rules):
        hit = reduce(lambda a, b: a | b, [m.contains(w) for w in words])
        found = F.when(hit, F.struct(F.lit(category).alias("category"), F.lit(subtype).alias("subtype"))).otherwise(found)
    return messages.withColumn("__c", found).select("*", "__c.category", "__c.subtype").drop("__c")


def scan_gb(plan: Column) -> Column:
    """The largest size in gigabytes that a plan's text names in TB, GB or MB; 0 where none."""
    one = lambda unit, by: F.transform(F.regexp_extract_all(plan, F.lit(rf"(?i)(\d+(?:\.\d+)?)\s*{unit}"), F.lit(1)), lambda x: x.cast("double") * by)
    return F.coalesce(F.array_max(F.concat(one("TB", 1024.0), one("GB", 1.0), one("MB", 1 / 1024))), F.lit(0.0))


def output_rows(plan: Column) -> Column:
    return F.regexp_extract(plan, r"(?is)Output.*?(\d+)\s*rows", 1).try_cast("bigint")


def guarded(plans: DataFrame, max_gb: float = 500, max_rows: int = 10_000) -> DataFrame:
    """plans (plan) with scan_gb, rows, allowed and the reasons why not."""
    p = plans.withColumns({"scan_gb": scan_gb(F.col("plan")), "rows": output_rows(F.col("plan"))})
    over = F.when(F.col("scan_gb") > max_gb, F.concat(F.lit("scan of "), F.round("scan_gb", 1).cast("decimal(20,1)").cast("string"), F.lit(f" GB is over {max_gb:g}")))
    many = F.when(F.col("rows") > max_rows, F.concat("rows", F.lit(f" rows are over {max_rows}")))
    return p.withColumns({"reason": F.concat_ws("; ", over, many), "allowed": over.isNull() & many.isNull()})


def confidence(candidates: Column, errors: Column, cost_ok: Column, entities: Column, terms: Column, similarity: Column, probes: Column) -> Column:
    """(score, level): points out of ten, HIGH from 7 and MEDIUM from 4."""
    point = lambda c, n=1: F.when(c, n).otherwise(0)
    score = F.when(candidates >= 3, 2).when(candidates >= 2, 1).otherwise(0) + point(~errors, 2) + point(cost_ok) + point(entities >= 1) + point(terms >= 1) + F.when(similarity >= 0.7, 2).when(similarity >= 0.5, 1).otherwise(0) + point(probes >= 1)
    return F.struct(F.round(F.least(score / 10, F.lit(1.0)), 2).alias("score"), F.when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW").alias("level"))


def tournament(matches: DataFrame) -> DataFrame:
    """(round, candidate, points, won) of matches (round, a, b, winner): 1 for a win, 0.5 each for a tie; the least number wins ties."""
    won = lambda me: F.when(F.col("winner").isNull(), 0.5).when(F.col("winner") == F.col(me), 1.0).otherwise(0.0)
    sides = matches.select("round", F.explode(F.array(F.struct(F.col("a").alias("candidate"), won("a").alias("p")), F.struct(F.col("b").alias("candidate"), won("b").alias("p")))).alias("x"))
    points = sides.groupBy("round", "x.candidate").agg(F.sum("x.p").alias("points"))
    w = Window.partitionBy("round").orderBy(F.desc("points"), "candidate")
    return points.withColumn("won", F.row_number().over(w) == 1)


def applied(scopes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """scopes (scope, tables, notes) with accepted suggestions (scope, kind, name, note, at): tables once each, the latest note a name."""
    ok = suggestions.where("accepted")
    tables = ok.where("kind = 'table'").groupBy("scope").agg(F.array_sort(F.collect_set("name")).alias("more"))
    notes = ok.where("kind = 'note'").groupBy("scope", "name").agg(F.max_by("note", F.struct("at", "note")).alias("note")).groupBy("scope").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "note")))).alias("said"))
    both = scopes.join(tables, "scope", "left").join(notes, "scope", "left")
    kept = F.map_filter("notes", lambda k, _: ~F.map_contains_key(F.coalesce("said", F.create_map().cast("map<string,string>")), k))
    return both.select("scope", F.array_union("tables", F.coalesce("more", F.array().cast("array<string>"))).alias("tables"), F.map_concat(kept, F.coalesce("said", F.create_map().cast("map<string,string>"))).alias("notes"))
