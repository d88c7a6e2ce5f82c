"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams.

Features are the presence of words, pairs of neighbours and skip-grams (first and third of three
words), hashed into 2**BITS buckets; a word longer than that also enters by its first four and
five bytes, so that inflected forms share a weight. Each coordinate has its own learning rate.
L1 keeps most weights at zero; its strength grows with the root of a coordinate's squared
gradients, so that common words need as clear a signal as rare ones and long texts do not drift.
So the model is a short list that is broadcast (never more than 2**BITS numbers, whatever the
input's size).

Learning uses at most about TRAIN_ROWS labelled rows, chosen by a hash of their id: every
labelled row while there are no more. They are split over SHARDS tasks that learn alone, and
their weights are averaged.

Edge cases: a null or empty text scores by the bias alone; without any labelled row all scores
are 0.5 (predicted 1). A document labelled several times counts as toxic if half or more of its labels say so;
null labels teach nothing. Repeated documents are learned and scored as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.texts import (
    LOWER,
    Chunk,
    Rolling,
    apart,
    chunks,
    fold,
    grams,
    mixed,
    released,
    runs,
    small_batches,
    table,
)

BITS = 20
TRAIN_ROWS = 16384
SHARDS = 2
EPOCHS = 4
STEMS = (4, 5)
ALPHA, BETA, L1, L2 = 0.3, 1.0, 2.0, 0.01
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, pairs and skip-grams of the chunk, and the document of each."""
    lower = LOWER[chunk.data]
    starts, ends, docs = runs(WORD[lower], chunk.offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rolling = Rolling(lower)
    hashes = rolling.spans(starts, ends)
    stems = [(rolling.spans(starts[longer], starts[longer] + size), docs[longer])
             for size in STEMS for longer in [np.flatnonzero(ends - starts > size)]]
    pairs, at = grams(hashes, docs, 2)
    skips = np.flatnonzero(docs[:-2] == docs[2:]) if len(docs) > 2 else np.zeros(0, np.int64)
    skip = mixed(hashes[skips] * np.uint64(0x9E3779B97F4A7C15) ^ hashes[skips + 2] if len(skips)
                 else np.zeros(0, np.uint64))
    shift = np.uint64(64 - BITS)
    values = np.concatenate([hashes, pairs, skip, *(mixed(~h) for h, _ in stems)]) >> shift
    return values.astype(np.int64), np.concatenate([docs, docs[at], docs[skips], *(d for _, d in stems)])


def _present(buckets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((docs.astype(np.int64) << BITS) | buckets)
    return both & ((1 << BITS) - 1), both >> BITS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """Labelled documents, at most about ``bound`` (picked by a hash of the id), with ``y``."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.avg(label) >= 0.5).cast("int").alias("y"))
    total = marks.count()
    if total > bound:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(bound / total * (1 << 30)))
    return docs.join(F.broadcast(marks), "doc_id")  # about bound rows of two numbers


def ftrl(rows: list[np.ndarray], marks: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes over the rows; the last place is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        l1 = np.where(at == size - 1, 0.0, L1 * np.sqrt(1.0 + n[at]))
        return np.where(np.abs(zs) <= l1, 0.0,
                        -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for row, y in zip(rows, marks, strict=True):
            at = np.append(row, size - 1)
            w = weights(at)
            g = float(_sigmoid(w.sum())) - y
            old = n[at]
            z[at] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
            n[at] = old + g * g
    return weights(np.arange(size))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic",
          bound: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that are not zero; place 2**BITS is the bias."""
    small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for chunk in chunks(batch.column(2)):
                buckets, of = _present(*features(chunk))
                cut = np.searchsorted(of, np.arange(chunk.size + 1))
                found += [buckets[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "y", "x"])

    def shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in frames if len(f)]
        if not frames:
            return
        rows = pd.concat(frames)
        rows = rows.assign(order=rows["order"].astype("int64")).sort_values(["order", "x"])
        w = ftrl([np.frombuffer(x, np.int32).astype(np.int64) for x in rows["x"]], rows["y"].to_numpy(float))
        at = np.append(np.flatnonzero(w[:-1]), len(w) - 1)
        yield pd.DataFrame({"place": at, "w": w[at], "shards": np.where(at == len(w) - 1, 1, 0)})

    picked = labelled_sample(docs.select("doc_id", F.col(text).cast("string").alias("text")), labels, label, bound)
    rows = picked.select(F.col("doc_id").cast("string"), "y", "text").mapInArrow(released(hashed), "doc_id string, y int, x binary")
    order = F.xxhash64("doc_id", "x")
    dealt = rows.select("y", "x", order.alias("order")).repartition(
        SHARDS, F.pmod(F.shiftright(order, 7), F.lit(SHARDS)))
    learned = dealt.mapInPandas(released(shard), "place long, w double, shards int").groupBy("place").agg(
        F.sum("w").alias("w"), F.sum("shards").alias("shards")).toPandas()
    if not len(learned):
        return np.zeros(0, np.int64), np.zeros(0)
    return learned["place"].to_numpy(np.int64), learned["w"].to_numpy() / learned["shards"].max()


def score(docs: DataFrame, places: np.ndarray, values: np.ndarray, keep: tuple[str, ...] = ("doc_id",),
          text: str = "text") -> DataFrame:
    """The ``keep`` columns of each row (the text may be one of them) with ``score``, the probability of the label 1."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast((places, values))
    at = keep.index(text) if text in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((1 << BITS) + 1)
        weights[model.value[0]] = model.value[1]
        for batch in batches:
            scores = [np.zeros(0)]
            for chunk in chunks(batch.column(at)):
                buckets, of = features(chunk)
                used = weights[buckets] != 0
                buckets, of = _present(buckets[used], of[used])
                sums = np.bincount(of, weights[buckets], chunk.size) if len(of) else np.zeros(chunk.size)
                scores.append(_sigmoid(sums + weights[-1]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(np.concatenate(scores))], [*keep, "score"])

    extra = [] if text in keep else [F.col(text).cast("string").alias("__text")]
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), *extra)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(keep)])
    return rows.mapInArrow(released(run), f"{kept}, score double")


def clean(docs: DataFrame, labels: DataFrame, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``, learned from labelled rows outside the held-out fold; columns as they were.
    If there is no usable label, nothing is learned and all documents are kept."""
    places, values = learn(docs.where(fold("doc_id", 5) != 0), labels, text)
    if not len(places):
        return docs
    safe, back = apart(docs, "doc_id", text)
    return back(score(safe, places, values, tuple(safe.columns), text).where(F.col("score") < limit))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    places, values = learn(docs.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return score(rows, places, values, keep=("doc_id", "held_out")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
