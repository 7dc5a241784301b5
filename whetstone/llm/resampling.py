"""Target-distribution importance resampling: hashed n-gram models of the corpus and of a target, gains per bucket, and a Gumbel draw.

Texts go through Arrow kernels: `ascii_lower`, `split_pattern_regex`, `list_flatten` and `dictionary_encode`. Shifted
dictionary indices form n-grams, only distinct ones are joined and hashed, and a document's weight is the gains of its
buckets, taken by index and added by segment. Both models are `buckets` numbers, whatever the corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whetstone.llm import common as C

#: What stands between words: ASCII characters that are no letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Numbers of the hashed models, and the seed of the draw.
BUCKETS, SEED = 10_000, 2024
#: Documents with fewer words are not drawn; so many of a hundred others are.
LEAST_WORDS, PERCENT = 20, 10
#: Bytes of texts that are handled at once.
_SLICE = 4_000_000


def features(texts: pa.Array, least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, their number in each text, words of each text); features are runs of least to most words."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BREAK)
    coded = pc.list_flatten(lists).dictionary_encode()
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    solid = np.fromiter(map(bool, words), bool, len(words))[index] if len(words) else np.zeros(0, bool)
    index, text = index[solid], text[solid]  # a text that begins or ends with a break has an empty word there
    n_words = np.bincount(text, minlength=len(lists))
    codes, names = index, words
    found, of = [], []
    for n in range(1, most + 1):
        if n > 1:  # a distinct run of n - 1 words and the next word make a pair of indices
            inside = text[n - 1 :] == text[: max(0, len(text) - n + 1)]
            pairs = codes[: len(inside)] * len(words) + index[n - 1 :]
            pairs[~inside] = -1
            distinct, codes = np.unique(pairs, return_inverse=True)
            names = [names[a] + b" " + words[b] if a >= 0 else b"" for a, b in zip((distinct // max(1, len(words))).tolist(), (distinct % max(1, len(words))).tolist(), strict=True)]
        if n >= least:
            crc = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % buckets
            good = text[n - 1 :] == text[: max(0, len(text) - n + 1)]
            found.append(crc[codes[: len(good)]][good] if len(codes) else np.zeros(0, np.int64))
            of.append(text[: len(good)][good])
    hashed, of = np.concatenate(found), np.concatenate(of)
    if most > least:
        order = np.argsort(of, kind="stable")
        hashed, of = hashed[order], of[order]
    return hashed, np.bincount(of, minlength=len(lists)), n_words


def bucket_counts(texts: DataFrame, text_col: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket that has any. Each task adds its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, at in C.slices(batch, "text", _SLICE):
                total += np.bincount(features(C.whole(data, at), least, most, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    per_task = texts.select(C.text_column(texts, text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    return per_task.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """A thousandth of a nat by bucket: how much likelier the target has it, with one added to each count. Reads two tables of `buckets` rows at most."""
    s, t = ({r["bucket"]: r["n"] for r in x.collect()} for x in (corpus, target))
    sum_s, sum_t = sum(s.values()), sum(t.values())
    return [math.floor(1000 * math.log(float(t.get(b, 0) + 1) * float(sum_s + buckets) / (float(s.get(b, 0) + 1) * float(sum_t + buckets)))) for b in range(buckets)]


def weighted(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", least: int = 1, most: int = 1) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of each row: the sum of the gains of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(gain, np.int64)
        for batch in batches:
            for rows, data, at in C.slices(batch, "text", _SLICE):
                hashed, n, n_words = features(C.whole(data, at), least, most, len(gain))
                upto = np.concatenate(([0], np.cumsum(table[hashed])))
                edge = np.concatenate(([0], np.cumsum(n)))
                weight = upto[edge[1:]] - upto[edge[:-1]]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, n_words, weight))], names=["doc_id", "n_features", "n_words", "weight"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), C.text_column(docs, text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", least: int = 1, most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row; rank is 1, 2, 3... for the rows drawn, null for others.

    The highest weight + Gumbel noise are a draw without replacement by the ratio of the two models. The noise follows from
    the id, so reruns agree. Null and empty texts have no features and weight 0; ties go to the smaller id; repeated rows
    are rows of their own with equal scores; a row without an id hashes as `-` and is last among equals. Without rows there is
    no result, with an empty target its counts are 0. Texts of any length are read whole; other columns are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, least, most, buckets), bucket_counts(target, target_text, least, most, buckets), buckets)
    rows = weighted(docs, gain, id_col, text_col, least, most)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    rows = C.durable(rows.withColumn("score", (F.col("weight") + noise).cast("long")))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    placed = C.numbered(able, [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("n_features")])
    rank = F.when(F.col("i") < drawn, F.col("i") + 1).cast("long")
    out = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*out, rank.alias("rank")).unionByName(rows.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))


def sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs whose ids are drawn, with all their columns. Ids must be distinct and not null."""
    drawn = resampled(docs, target, id_col, **how).where("rank is not null").select(F.col("doc_id").alias("__drawn"))
    return docs.join(drawn, docs[id_col] == F.col("__drawn"), "left_semi")


#: The registered query in SQL: CRC-32 by its table, once for each distinct word.
ORACLE = r"""
WITH crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) x(i))),
words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
aims AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
spelt AS (SELECT w, list_transform(range(length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT w FROM words UNION SELECT w FROM aims)),
hashed AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS bucket FROM spelt, crc_table),
s AS (SELECT bucket, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM aims JOIN hashed USING (w) GROUP BY 1),
gain AS (SELECT b AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS g FROM range(10000) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
per AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM words JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents d LEFT JOIN per USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 10 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= drawn THEN r END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
"""
