"""Language identification by multilingual mixture inference.

A document is a mixture of languages. Each letter run (a unit) has a likelihood under each
language from hashed byte trigrams; expectation-maximisation finds the proportions, and the
set of languages is the one among the nested sets of the largest proportions whose penalised
likelihood (BIC) is best.

Edge cases: a null text or one without a letter is ``und`` with score 0; the same holds for
all texts if nothing could be learned. Rows without lang, or in the held-out fold, teach
nothing. Repeated rows count as often as they occur, ties go to the language first by name.
A null id counts as the empty text for the fold. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.texts import CHUNK_BYTES, LOWER, Chunk, chunks, fold, released, runs, small_batches, table

BUCKETS = 1 << 16
MAX_LANGUAGES = 2048
SMOOTHING = 0.25
ROUNDS = 12
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _units(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram of letter bytes (a unit's edges count as 0), where each unit
    starts among them, and its document; the unit boundaries are those of the bytes."""
    inside = LETTER[chunk.data]
    starts, ends, docs = runs(inside, chunk.offsets)
    n = len(chunk.data)
    padded = np.zeros(n + 2, np.uint32)
    padded[1:-1] = np.where(inside, LOWER[chunk.data], 0)
    left = padded[:-2].copy()
    right = padded[2:].copy()
    left[starts] = 0
    right[ends - 1] = 0
    at = np.flatnonzero(inside)
    code = (left[at] << np.uint32(16)) | (padded[1:-1][at] << np.uint32(8)) | right[at]
    buckets = (code * np.uint32(2654435761)) >> np.uint32(16)
    first = np.concatenate([[0], np.cumsum(ends - starts)])[:-1].astype(np.int64)
    return buckets, first, docs, ends - starts


def trigram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, bucket, n): trigram counts per language, summed in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.asarray(batch.column(1).to_pylist(), object)
            for chunk in chunks(batch.column(0)):
                buckets, _, of, lengths = _units(chunk)
                owner = np.repeat(of, lengths) + chunk.first
                for name in set(names[chunk.first:chunk.first + chunk.size]):
                    mine = buckets[(names == name)[owner]]
                    found = np.bincount(mine, minlength=BUCKETS)
                    sums[name] = sums[name] + found if name in sums else found
        for name, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                 pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    small_batches(docs.sparkSession)
    parts = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    ).mapInArrow(released(count), "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages by name and log-likelihoods (bucket x language). The table that reaches
    the driver has at most BUCKETS rows per language; more than MAX_LANGUAGES is an error."""
    counted = trigram_counts(docs, text, lang)
    rows = counted.toPandas()
    names = sorted(rows["lang"].unique().tolist())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"{len(names)} languages; at most {MAX_LANGUAGES} are meant")
    counts = np.zeros((BUCKETS, len(names)))
    index = {name: i for i, name in enumerate(names)}
    counts[rows["bucket"].to_numpy(int), rows["lang"].map(index).to_numpy(int)] = rows["n"]
    counts += SMOOTHING
    return names, np.log(counts / counts.sum(0)).astype(np.float32) if names else counts


def _proportions(like: np.ndarray, first: np.ndarray, of: np.ndarray, size: np.ndarray,
                 allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over the units of each document: its proportions over ``allowed`` languages, and its
    log-likelihood (less the units' maxima, which all language sets share)."""
    theta = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        share = like * theta[of]
        share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
        theta = np.add.reduceat(share, first, axis=0) / size[:, None]
    total = np.log(np.maximum((like * theta[of]).sum(1), 1e-300))
    return theta, np.add.reduceat(total, first)


def mixture(chunk: Chunk, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best proportions of each document of the chunk (all 0 without a unit), and which
    documents have one."""
    found = np.zeros((chunk.size, logs.shape[1]))
    buckets, start, docs, _ = _units(chunk)
    if not len(start):
        return found, np.zeros(chunk.size, bool)
    scores = np.add.reduceat(logs[buckets], start, axis=0).astype(np.float64)
    scores -= scores.max(1, keepdims=True)
    like = np.exp(np.maximum(scores, -600))
    present, first, size = np.unique(docs, return_index=True, return_counts=True)
    of = np.repeat(np.arange(len(present)), size)
    theta, _ = _proportions(like, first, of, size, np.ones((len(present), logs.shape[1])))
    order = np.argsort(-theta, axis=1, kind="stable")
    best = np.full(len(present), -np.inf)
    chosen = np.zeros_like(theta)
    active = np.arange(len(present))
    for k in range(1, logs.shape[1] + 1):
        allowed = np.zeros((len(active), logs.shape[1]))
        np.put_along_axis(allowed, order[active, :k], 1.0, axis=1)
        rows = np.repeat(False, len(present))
        rows[active] = True
        mine = rows[of]
        lens = size[active]
        begin = np.concatenate([[0], np.cumsum(lens)[:-1]])
        fit, total = _proportions(like[mine], begin, np.repeat(np.arange(len(active)), lens),
                                  lens, allowed)
        value = total - (k - 1) * 0.5 * np.log(lens + 1.0)
        better = value > best[active]
        best[active[better]] = value[better]
        chosen[active[better]] = fit[better]
        active = active[better]
        if not len(active):
            break
    found[present] = chosen
    has = np.zeros(chunk.size, bool)
    has[present] = True
    return found, has


def _lettered(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def predict(docs: DataFrame, names: list[str], logs: np.ndarray, text: str = "text",
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row with lang_pred, score (the proportion of that language) and
    mixture (languages of the chosen set with their proportions)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast((names, logs))
    limit = max(1 << 17, CHUNK_BYTES * 4 // max(4, len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, like = model.value
        for batch in batches:
            labels, scores, mixes = [], [], []
            texts = batch.column(batch.num_columns - 1)
            for chunk in chunks(texts, limit):
                theta, has = mixture(chunk, like) if langs else (None, np.zeros(chunk.size, bool))
                plain = np.zeros(chunk.size, np.int64)
                ascii_letters = LETTER[chunk.data] & (chunk.data < 128)
                sums = np.concatenate([[0], np.cumsum(ascii_letters)])
                plain = sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]]
                for i in range(chunk.size):
                    ok = has[i] and (plain[i] or _lettered(texts[chunk.first + i].as_py()))
                    top = int(np.argmax(theta[i])) if ok else 0
                    labels.append(langs[top] if ok else "und")
                    scores.append(min(1.0, float(theta[i][top])) if ok else 0.0)
                    mixes.append([{"lang": langs[j], "share": float(theta[i][j])}
                                  for j in np.flatnonzero(theta[i] > 0)] if ok else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(mixes, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                [*batch.schema.names[:-1], "lang_pred", "score", "mixture"])

    columns = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:-1])
    return columns.mapInArrow(released(run), f"{kept}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    names, logs = learn(docs.where(fold("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return predict(rows, names, logs, keep=("doc_id", "held_out")).select(
        "doc_id", "held_out", "lang_pred", "score", F.to_json("mixture").alias("mixture"))
