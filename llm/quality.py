"""Quality scores by a regularised quadratic discriminant over document statistics.

Each text gives the numbers in STATISTICS (transformed so that they are roughly normal). Per
class, count, mean and second moments are summed in every task and then over tasks, so all
labelled rows take part and only (1 + d + d * d) numbers a class reach the driver. The class
covariances are shrunk towards the pooled one and towards a multiple of the identity; their
Cholesky factors are computed once and broadcast. The score is the logistic of the difference
of the two log densities (Mahalanobis distance, log determinant, prior).

Edge cases: a null text counts as empty and is scored; without labelled rows of both classes
the score is the share of label 1 (0.5 without any). A document labelled several times
counts as good if half or more of its labels say so; null labels teach nothing. Repeated documents are learned and
scored as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.texts import SPACES, Chunk, Rolling, chunks, fold, released, runs, small_batches, table, words
from llm.written import written

STATISTICS = (
    "log words", "mean word length", "spread of word length", "letter share", "digit share",
    "symbol share", "bar share", "upper-case share", "non-ASCII share", "distinct word share",
    "share of the most frequent word", "share of repeated neighbours", "short word share",
    "log words per line", "sentence end share", "word entropy against length",
    "symbol-ended word share",
)
POOLED, RIDGE = 0.2, 0.02


def _class(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in members]] = True
    return out


_LETTERS = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS[128:] = True
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _class("0123456789")
_SYMBOLS = _class("#$%&*@^~_=<>+{}[]\\/`")
_ENDS = _class(".!?")


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 0, 1) * 0.998 + 0.001
    return np.log(share / (1 - share))


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of STATISTICS per document of the chunk."""
    data, docs = chunk.data, chunk.size
    size = np.diff(chunk.offsets).astype(float)
    starts, ends, of = words(chunk)
    lengths = (ends - starts).astype(float)
    count = np.bincount(of, minlength=docs).astype(float)
    some = np.maximum(count, 1)

    def per_byte(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[data])])
        return (sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]]).astype(float)

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of, flags.astype(float), docs)

    dense = np.maximum(size - per_byte(SPACES), 1)
    mean = per_word(lengths) / some
    spread = np.sqrt(np.maximum(per_word(lengths ** 2) / some - mean ** 2, 0))
    hashes = Rolling(data).spans(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, of))
    sorted_of, sorted_hash = of[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_of[1:] != sorted_of[:-1]) | (sorted_hash[1:] != sorted_hash[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(order))).astype(float)
    owner = sorted_of[first]
    top = np.zeros(docs)
    np.maximum.at(top, owner, times)
    entropy = np.log(some) - np.bincount(owner, times * np.log(np.maximum(times, 1)), docs) / some
    again = np.zeros(len(of), bool)
    again[1:] = (of[1:] == of[:-1]) & (hashes[1:] == hashes[:-1])
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    lines = per_byte(_class("\n")) + 1
    return np.column_stack([
        np.log1p(count), np.log1p(mean), np.log1p(spread), _logit(per_byte(_LETTERS) / dense),
        _logit(per_byte(_DIGITS) / dense), _logit(per_byte(_SYMBOLS) / dense),
        _logit(per_byte(_class("|")) / dense), _logit(per_byte(_UPPER) / dense),
        _logit((per_byte(np.arange(256) >= 128)) / dense), _logit(np.bincount(owner, minlength=docs) / some),
        _logit(top / some), _logit(per_word(again) / some), _logit(per_word(lengths <= 3) / some),
        np.log1p(count / lines), _logit(per_word(_ENDS[last]) / some),
        entropy / np.log(some + 1), _logit(per_word(_SYMBOLS[last]) / some),
    ]) if docs else np.zeros((0, len(STATISTICS)))


def described(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns of each row with ``x``, the statistics of its text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.zeros((0, len(STATISTICS)))]
            rows += [statistics(c) for c in chunks(batch.column(batch.num_columns - 1))]
            found = np.concatenate(rows)
            offsets = pa.array(np.arange(len(found) + 1) * len(STATISTICS), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))],
                [*batch.schema.names[:-1], "x"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(released(run), f"{kept}, x array<double>")


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum and second moments of ``x`` per class ``y``, for classes 0 and 1."""
    d = len(STATISTICS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in (0, 1):
                mine = x[y == c]
                sums[c] += np.concatenate([[len(mine)], mine.sum(0), (mine.T @ mine).ravel()])
        place = np.arange(sums.size)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums.ravel())], ["place", "value"])

    total = np.zeros(2 * (1 + d + d * d))
    for row in rows.select("y", "x").mapInArrow(released(add), "place long, value double").groupBy("place").agg(
            F.sum("value").alias("value")).collect():
        total[row["place"]] = row["value"]
    total = total.reshape(2, -1)
    return total[:, 0], total[:, 1:1 + d], total[:, 1 + d:].reshape(2, d, d)


def discriminant(count: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> list[tuple]:
    """Per class: mean, inverse of the Cholesky factor of the shrunk covariance, constant."""
    d = sums.shape[1]
    means = sums / count[:, None]
    raw = squares / count[:, None, None] - np.einsum("ci,cj->cij", means, means)
    pooled = np.einsum("c,cij->ij", count, raw) / count.sum()
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    out = []
    for c in (0, 1):
        shrunk = (1 - RIDGE) * ((1 - POOLED) * raw[c] + POOLED * pooled) + RIDGE * scale
        factor = np.linalg.cholesky(shrunk + 1e-9 * np.eye(d))
        constant = np.log(count[c] / count.sum()) - np.log(np.diag(factor)).sum()
        out.append((means[c], np.linalg.inv(factor), constant))
    return out


def score(rows: DataFrame, model: list[tuple] | float) -> DataFrame:
    """The rows with ``score`` in place of ``x``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            x = x.reshape(batch.num_rows, -1)
            if isinstance(shared.value, float):
                found = np.full(batch.num_rows, shared.value)
            else:
                logs = [k - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, k in shared.value]
                found = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)],
                                             [*batch.schema.names[:-1], "score"])

    kept = [c for c in rows.columns if c != "x"]
    rows = rows.select(*kept, "x")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(released(run), f"{names}, score double")


def learn(rows: DataFrame, labels: DataFrame, label: str = "quality") -> list[tuple] | float:
    """The discriminant from described rows and their labels."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.avg(label) >= 0.5).cast("int").alias("y"))
    count, sums, squares = moments(rows.join(marks, "doc_id"))
    if min(count) < 2:
        return float(count[1] / count.sum()) if count.sum() else 0.5
    return discriminant(count, sums, squares)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled rows outside the held-out fold. The texts
    are read once; their statistics are kept for learning and scoring."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 3) == 1)
    rows = written(described(docs, ("doc_id", "held_out")), "statistics")
    model = learn(rows.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return score(rows, model).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
