"""Documents to chunks: sections, breaks at paragraphs and sentences, glossary entries, evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whetstone.functions import text as X

#: Characters of a chunk at most, and of its overlap with the one before.
CHUNK, OVERLAP = 4000, 400
SPACE = " \t\n\r"
#: Where a text may be cut, the better place first.
MARKS = ("\n\n", ". ")


def cuts(text: str, most: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text: at a blank line, else after a sentence, if that lies beyond the middle."""
    return _spans(len(text), lambda mark, start, end: text.rfind(mark, start, end), most, overlap)


def _spans(length: int, last: Callable[[str, int, int], int], most: int, overlap: int) -> list[tuple[int, int]]:
    """The rule of `cuts`; last(mark, start, end) is the last place of a mark that lies whole within these, below start if there is none."""
    if length <= most:
        return [(0, length)]
    out, start = [], 0
    while start < length:
        end = start + most
        if end < length:
            for mark in MARKS:
                at = last(mark, start, end)
                if at > start + most // 2:
                    end = at + len(mark)
                    break
        out.append((start, min(end, length)))
        start = end - overlap
    return out


def _cuts_at(pieces: np.ndarray, most: int, overlap: int) -> list[tuple[int, int]]:
    """`cuts` of a text of which only the lengths of its pieces are known, each but the first from a mark on: negative from a sentence's end."""
    places, sentence = np.cumsum(np.abs(pieces)), pieces[1:] < 0
    of = {MARKS[0]: places[:-1][~sentence], MARKS[1]: places[:-1][sentence]}

    def last(mark, start, end):
        i = np.searchsorted(of[mark], end - len(mark), "right")
        return int(of[mark][i - 1]) if i else -1

    return _spans(int(places[-1]), last, most, overlap)


def split_long(docs: DataFrame, keys: list[str], most: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(keys, part, parts, start, text, hash, char_count): trimmed chunks without empty ones; parts counts those of a text.

    Python sees the places where a text may be cut and never the text, so its memory does not follow the texts.
    """
    spans = "array<struct<start:int,end:int>>"

    @F.pandas_udf(spans)
    def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pieces in batches:
            yield pd.Series([None if p is None else [{"start": a, "end": b} for a, b in _cuts_at(np.asarray(p, np.int64), most, overlap)] for p in pieces])

    # cut before every mark, also where they overlap
    pieces_of = F.transform(F.split("text", r"(?=\n\n)|(?=\. )", -1), lambda x: F.when(x.startswith(". "), -F.length(x)).otherwise(F.length(x)))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.coalesce(F.length("text"), F.lit(0)).alias("end")))
    # only long texts need the sequential rule; one pass for both, as two branches would make `docs` twice
    both = docs.withColumn("c", F.coalesce(spans_of(F.when(F.length("text") > most, pieces_of)), whole.cast(spans)))
    pieces = F.transform("c", lambda c: F.struct(c["start"].alias("start"), F.btrim(F.substring("text", c["start"] + 1, c["end"] - c["start"]), F.lit(SPACE)).alias("text")))
    held = both.select(*keys, F.filter(pieces, lambda p: p["text"] != "").alias("p"))
    flat = held.select(*keys, F.size("p").alias("parts"), F.posexplode("p").alias("part", "x"))
    return flat.select(*keys, "part", "parts", F.col("x.start").alias("start"), F.col("x.text").alias("text"), X.short_hash(F.col("x.text")).alias("hash"), F.length("x.text").alias("char_count"))


def section_texts(text: Column, numbered: bool = False) -> Column:
    """The trimmed pieces of a text that is cut before Markdown headers, or before numbered lines; some may be empty."""
    before = r"(?m)(?=^\d+\.\s)" if numbered else r"(?m)(?=^#{1,3}\s)"
    return F.transform(F.split(text, before, -1), lambda t: F.btrim(t, F.lit(SPACE)))


def section_header(text: Column, numbered: bool = False) -> tuple[Column, Column]:
    """(header, level) of such a piece."""
    header = r"(?m)\A(\d+)\.\s+(.+?)$" if numbered else r"(?m)\A(#{1,3})\s+(.+?)$"
    return F.btrim(F.regexp_extract(text, header, 2), F.lit(SPACE)), F.lit(0) if numbered else F.length(F.regexp_extract(text, header, 1))


def sections(docs: DataFrame, keys: list[str], numbered: bool = False) -> DataFrame:
    """(keys, section, header, level, text): texts cut before Markdown headers, or before numbered lines."""
    parts = docs.select(*keys, F.posexplode(section_texts(F.col("text"), numbered)).alias("section", "text")).where("text <> ''")
    header, level = section_header(F.col("text"), numbered)
    return parts.select(*keys, "section", header.alias("header"), level.alias("level"), "text")


def section_chunks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, section, title, part, text, hash): long sections in parts, which their titles number if there are several."""
    s = sections(docs, keys)
    c = split_long(s, [*keys, "section", "header"])
    title = F.concat("header", F.when(F.col("parts") > 1, F.concat(F.lit(" (part "), F.col("part") + 1, F.lit(")"))).otherwise(""))
    return c.select(*keys, "section", title.alias("title"), "part", "text", "hash")


def page_text(html: Column) -> Column:
    """A page as Markdown: h1 to h3 as headers, other tags gone, scripts and styles with what they hold."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    for i in (1, 2, 3):
        x = F.regexp_replace(x, rf"(?is)<h{i}[^>]*>(.*?)</h{i}>", "\n" + "#" * i + " $1\n")
    x = F.regexp_replace(F.regexp_replace(x, r"(?is)</(p|li|div|article|nav)>", "\n"), r"(?s)<[^>]*>", "")
    return F.btrim(F.regexp_replace(x, r"\n\s*\n+", "\n\n"), F.lit(SPACE))


def glossary(model: DataFrame) -> DataFrame:
    """(kind, name, text, hash) of a model's tables: one row an entry, the first of equal texts.

    model: name, description, synonyms, dimensions, time_dimensions, metrics (name, expr, synonyms each), rules, queries,
    relationships (other, on).
    """
    def kind(k, rows, name, text):
        return rows.select(F.lit(k).alias("kind"), name.alias("name"), text.alias("text"))

    each = lambda c: model.where(F.size(c) > 0).select("name", F.explode(c).alias("x"))
    t, x = F.col("name"), F.col("x")
    parts = [kind("table", model, t, F.concat(t, F.lit(": "), "description")), kind("table_synonym", each("synonyms"), x, F.concat(x, F.lit(" is table "), t))]
    for c, k in (("dimensions", "dimension"), ("time_dimensions", "time_dimension"), ("metrics", "metric")):
        named = each(c)
        parts.append(kind(k, named, x["name"], F.concat(t, F.lit("."), x["name"], F.lit(" = "), x["expr"])))
        also = named.select("name", x["name"].alias("of"), F.explode(x["synonyms"]).alias("x"))
        parts.append(kind("synonym", also, F.col("x"), F.concat("x", F.lit(" is "), t, F.lit("."), "of")))
    parts += [kind("rule", each("rules"), t, x), kind("verified_query", each("queries"), t, x), kind("relationship", each("relationships"), t, F.concat(t, F.lit(" joins "), x["other"], F.lit(" on "), x["on"]))]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(X.short_hash(F.col("text")).alias("hash")).agg(F.min(F.struct("kind", "name", "text")).alias("e")).select("e.*", "hash")


def evidence(df: DataFrame, most: int = 20) -> DataFrame:
    """(column, summary): a column's values if they are few, a range if it is numeric, else how many there are."""
    numeric = {c for c, t in df.dtypes if t.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))}
    one = df.agg(*[x for i, c in enumerate(df.columns) for x in (F.approx_count_distinct(c).alias(f"d{i}"), F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"))])
    rough = one.first().asDict()
    few = [c for i, c in enumerate(df.columns) if rough[f"d{i}"] <= 2 * most]
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns]))).where("v is not null").groupBy("column", "v").agg(F.lit(1)).drop("1")
    counts = values.groupBy("column").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("column").isin(*few) if few else F.lit(False), F.col("v")))).alias("vs"))
    ranges = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in numeric).alias("numeric"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, c in enumerate(df.columns)])))
    n = F.coalesce("n", F.lit(0))
    text = F.when(n <= most, F.coalesce(F.array_join("vs", ", "), F.lit(""))).when(F.col("numeric"), F.concat("lo", F.lit(" to "), "hi")).otherwise(F.concat(n, F.lit(" distinct values")))
    return ranges.join(counts, "column", "left").select("column", text.alias("summary"))
