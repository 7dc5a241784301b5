"""A byte-level convolutional quality classifier in numpy.

Filters over GRAM consecutive bytes (one weight for each place and byte value) slide over the whole text. Overlapping
chunks of 2 * HALF bytes are max-pooled; a document's features are each filter's mean and largest chunk value, combined by a
logistic layer. It is trained on the driver from a bounded sample of labelled rows and applied to all rows in tasks.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whetstone.llm import common as C

FILTERS, GRAM, HALF = 16, 5, 256
#: The sample that training takes: rows, by hash order of their ids, and the most characters of one; a longer text is
#: trained on as PIECES pieces from all over it. Scores always read whole texts.
SAMPLE_ROWS, SAMPLE_CHARS, PIECES = 2400, 20_000, 40
EPOCHS, RATE = 8, 0.02


def _pool(model, data: np.ndarray):
    """Per half chunk the largest activation of each filter (and its place)."""
    table = model["filters"]
    n = max(1, len(data) - GRAM + 1)
    if len(data) < GRAM:
        data = np.concatenate((data, np.zeros(GRAM - len(data), np.uint8)))
    act = table[0].take(data[:n], axis=0)
    for k in range(1, GRAM):
        act += table[k].take(data[k : k + n], axis=0)
    return act, np.arange(0, n, HALF)


def _features(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks are two neighbouring halves; their values, and mean and largest of those over the document."""
    chunk = np.maximum(half[:-1], half[1:]) if len(half) > 1 else half
    chunk = np.maximum(chunk, 0)
    return chunk, np.concatenate((chunk.mean(0), chunk.max(0)))


def _half(model, data: np.ndarray) -> np.ndarray:
    act, at = _pool(model, data)
    return np.maximum.reduceat(act + model["shift"], at, axis=0)


def score(model, raw: bytes | np.ndarray) -> float:
    """0 to 1; long texts are pooled piece by piece, so that memory stays bounded."""
    data = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    step = HALF * 1024
    halves = [_half(model, data[i : i + step + GRAM - 1])[: 1024] for i in range(0, max(1, len(data) - GRAM + 1), step)]
    _, f = _features(np.concatenate(halves))
    z = float(f @ model["weights"] + model["bias"][0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], labels: list[int], seed: int = 11) -> dict[str, np.ndarray]:
    """Stochastic gradients with Adam; gradients of a maximum go to the place that has it. Without both labels all scores are the share of label 1."""
    rng = np.random.default_rng(seed)
    model = {"filters": rng.normal(0, 0.25, (GRAM, 256, FILTERS)).astype(np.float32), "shift": np.zeros(FILTERS, np.float32), "weights": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32)}
    y = np.array(labels, np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    model["bias"][0] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        model["weights"][:] = 0
        return model
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    m = {k: np.zeros_like(v) for k, v in model.items()}
    v = {k: np.zeros_like(x) for k, x in model.items()}
    step, batch = 0, 16
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for first in range(0, len(order), batch):
            grad = {k: np.zeros_like(x) for k, x in model.items()}
            for i in order[first : first + batch]:
                data = np.frombuffer(texts[i], np.uint8)
                act, at = _pool(model, data)
                act += model["shift"]
                half = np.maximum.reduceat(act, at, axis=0)
                chunk, f = _features(half)
                p = 1 / (1 + np.exp(-np.clip(float(f @ model["weights"] + model["bias"][0]), -30, 30)))
                d = (p - y[i]) * weight[i] / batch
                grad["weights"] += d * f
                grad["bias"] += d
                back = np.tile(d * model["weights"][:FILTERS] / len(chunk), (len(chunk), 1))
                back[chunk.argmax(0), np.arange(FILTERS)] += d * model["weights"][FILTERS:]
                back *= chunk > 0
                c, k = np.nonzero(back)
                if not len(c):
                    continue
                if len(half) > 1:
                    c_half = np.where(half[c, k] >= half[c + 1, k], c, c + 1)
                else:
                    c_half = c
                # the place of each half's maximum
                pad = np.full((len(at) * HALF, FILTERS), -np.inf, np.float32)
                pad[: len(act)] = act
                top = pad.reshape(len(at), HALF, FILTERS).argmax(1)
                place = c_half * HALF + top[c_half, k]
                g = back[c, k].astype(np.float32)
                np.add.at(grad["shift"], k, g)
                padded = data if len(data) >= GRAM else np.concatenate((data, np.zeros(GRAM - len(data), np.uint8)))
                for j in range(GRAM):
                    np.add.at(grad["filters"][j], (padded[place + j], k), g)
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * (epoch + first / len(order)) / EPOCHS))
            for k in model:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                model[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    # the training weighted both labels alike; scores are for the sample's own shares
    model["bias"][0] += np.log(share / (1 - share))
    return model


def held_out(doc_id):
    """crc32 of the id as text, mod 5, is 0. A null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[int]]:
    """At most SAMPLE_ROWS labelled rows outside the holdout, of any length, in hash order of their ids."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    text = C.text_column(docs, "text")
    each, n = SAMPLE_CHARS // PIECES, F.length(text)
    spread = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(text, F.floor(i * (n - each) / (PIECES - 1)).cast("int") + 1, F.lit(each))), "")
    some = docs.select(F.col("doc_id"), F.when(n <= SAMPLE_CHARS, text).otherwise(spread).alias("text")).where(~held_out(F.col("doc_id")))
    ids = some.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).join(known, "doc_id").orderBy("h", "doc_id").limit(SAMPLE_ROWS)
    got = C.durable(ids)
    rows = some.join(F.broadcast(got), "doc_id").orderBy("h", "doc_id", "text").limit(SAMPLE_ROWS).select("text", "quality").collect()  # bounded: SAMPLE_ROWS * SAMPLE_CHARS
    return [r["text"].encode("utf-8", "surrogatepass") for r in rows], [int(r["quality"]) for r in rows]


def scored(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, from its whole text, however long, piece by piece.

    Null texts are scored as empty, repeated rows alike; a null id is in the holdout as the empty text's. No rows give none,
    and without labels every score is the same. Other columns are ignored.
    """
    texts, marks = sample(docs, labels)
    out = io.BytesIO()
    np.savez(out, **train(texts, marks))
    blob = docs.sparkSession.sparkContext.broadcast(out.getvalue())  # FILTERS * GRAM * 256 weights

    def run(batches):
        model = dict(np.load(io.BytesIO(blob.value)))
        for batch in batches:
            data, at = C.raw(batch.column("text"))
            s = np.array([score(model, data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), C.text_column(docs, "text").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
