"""Table functions that SQL text can call: chunks of a text, beside each row or over a partitioned table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from whetstone.operators import documents as D

_CHUNK = StructType().add("part", IntegerType()).add("parts", IntegerType()).add("start", IntegerType()).add("text", StringType()).add("hash", StringType()).add("char_count", IntegerType())


def _bounds(most: AnalyzeArgument | None, overlap: AnalyzeArgument | None) -> tuple[int, int]:
    """The two numbers, which must be constants and leave room for more than the overlap."""
    for x in (most, overlap):
        if x is not None and (not x.isConstantExpression or not isinstance(x.value, int)):
            raise ValueError("most and overlap must be constant whole numbers")
    a, b = most.value if most is not None else D.CHUNK, overlap.value if overlap is not None else D.OVERLAP
    if not 0 <= 2 * b <= a:  # else a chunk could start no later than the one before
        raise ValueError("overlap must be no more than half of most")
    return a, b


def _chunks(text: str | None, most: int, overlap: int) -> Iterator[tuple]:
    found = [(a, t) for a, b in D.cuts(text or "", most, overlap) if (t := (text or "")[a:b].strip(D.SPACE))]
    for part, (start, t) in enumerate(found):
        yield part, len(found), start, t, hashlib.sha256(t.encode()).hexdigest()[:16], len(t)


@udtf
class SplitText:
    """split_text(text [, most => n, overlap => n]): a row for each chunk of one text. For LATERAL calls; null and blank texts give none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, most: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("text must be a string")
        _bounds(most, overlap)
        return AnalyzeResult(_CHUNK)

    def eval(self, text, most=D.CHUNK, overlap=D.OVERLAP):
        yield from _chunks(text, most, overlap)


@udtf
class SplitRows:
    """split_rows(TABLE(t) [PARTITION BY key]): a row for each chunk of the texts of column `text`, numbered on through each partition.

    Columns: those of the table but text, then chunk (from 0 within the partition), part, parts, start, text, hash, char_count.
    """

    def __init__(self):
        self.chunk = 0

    @staticmethod
    def analyze(table: AnalyzeArgument, most: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable or "text" not in table.dataType.names:
            raise ValueError("split_rows takes a table with a column text")
        _bounds(most, overlap)
        out = StructType()
        for f in table.dataType.fields:
            if f.name != "text":
                out = out.add(f.name, f.dataType)
        out = out.add("chunk", LongType())
        for f in _CHUNK.fields:
            out = out.add(f.name, f.dataType)
        return AnalyzeResult(out)

    def eval(self, row: Row, most=D.CHUNK, overlap=D.OVERLAP):
        values = row.asDict()
        text = values.pop("text")
        for chunk in _chunks(text, most, overlap):
            yield (*values.values(), self.chunk, *chunk)
            self.chunk += 1


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL text of this session."""
    spark.udtf.register("split_text", SplitText)
    spark.udtf.register("split_rows", SplitRows)
