"""A folder of document files, read by extension: each kind of file has its own way of being cut into sections and chunks."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whetstone.operators import documents as D

#: Extensions in the order in which the first of equal chunks is kept.
KINDS = ("md", "html", "txt", "json")
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def write_files(files: DataFrame, path: str) -> int:
    """Writes (name, content) as one file each below `path`, from the executors; gives how many. A file that is there is written over.

    Each file is written under another name and then moved, so a task that runs again leaves the same files. Equal names are
    not for this sink: the last that is written stays.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                to = posixpath.join(root, name)
                where.create_dir(os.path.dirname(to), recursive=True)
                held = f"{os.path.dirname(to)}/.{uuid.uuid4().hex}"
                with where.open_output_stream(held) as out:
                    out.write(content.encode())
                where.move(held, to)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("name", "content").mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_files(spark: SparkSession, path: str, kinds: tuple[str, ...] = KINDS, stream: bool = False) -> DataFrame:
    """(path, kind, text) of the files below `path` that have one of the extensions; bytes that are no UTF-8 are replaced. Files without a byte have no row. With `stream`, files as they come."""
    source = (spark.readStream.schema(SCHEMA) if stream else spark.read).format("binaryFile")
    held = source.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(kinds) + "}").load(path)
    return held.select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("kind"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _entity(e: Column) -> Column:
    columns = F.array_join(F.transform(e["columns"], lambda c: F.concat_ws(" ", c["name"], c["dataType"])), ", ")
    return F.concat_ws("\n", e["name"], F.when(e["description"] != "", e["description"]), F.when(F.size(e["columns"]) > 0, F.concat(F.lit("Columns: "), columns)))


def file_sections(files: DataFrame) -> DataFrame:
    """(path, kind, section, header, level, text): Markdown and pages by headers, plain text by numbered lines, JSON by entity.

    A JSON file is a list of entities (name, description, columns); one that is not gives no section. Pages lose their tags. Works
    on streams.
    """
    kind = F.col("kind")
    entities = F.from_json("text", "array<struct<name:string,description:string,columns:array<struct<name:string,dataType:string>>>>")
    named = lambda name, text: F.struct(name.cast("string").alias("header"), text.alias("text"))
    cut = lambda numbered: F.transform(D.section_texts(F.col("text"), numbered), lambda t: named(F.lit(None), t))
    pieces = F.when(kind == "json", F.transform(entities, lambda e: named(F.coalesce(e["name"], F.lit("")), _entity(e)))).when(kind == "txt", cut(True)).when(kind.isin("md", "html"), cut(False))
    # one pass for all kinds: a union of a branch for each would read every file as often
    plain = files.withColumn("text", F.when(kind == "html", D.page_text(F.col("text"))).otherwise(F.col("text")))
    rows = plain.select("path", "kind", F.posexplode(pieces).alias("section", "x")).select("path", "kind", "section", "x.header", "x.text").where("text <> ''")
    by_line, by_mark = D.section_header(F.col("text"), True), D.section_header(F.col("text"), False)
    header = F.coalesce("header", F.when(kind == "txt", by_line[0]).otherwise(by_mark[0]))
    level = F.when(kind.isin("md", "html"), by_mark[1]).otherwise(0)
    return rows.select("path", "kind", "section", header.alias("header"), level.alias("level"), "text")


def file_chunks(files: DataFrame) -> DataFrame:
    """(path, kind, section, title, level, part, text, hash): sections in chunks of bounded length, whose titles number them where there are several."""
    s = file_sections(files)
    c = D.split_long(s, ["path", "kind", "section", "header", "level"])
    title = F.concat("header", F.when(F.col("parts") > 1, F.concat(F.lit(" (part "), F.col("part") + 1, F.lit(")"))).otherwise(""))
    return c.select("path", "kind", "section", title.alias("title"), "level", "part", "text", "hash")


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """One chunk of each hash: the first by kind of file, path, section and part."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    first = F.min_by(F.struct(*chunks.columns), F.struct(rank, "path", "section", "part"))
    return chunks.groupBy(F.col("hash").alias("__h")).agg(first.alias("x")).select("x.*")


def short_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


