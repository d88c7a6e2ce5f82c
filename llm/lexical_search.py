"""Ranked lexical search: blocks of documents times blocks of items, as dense matrix products.

Every text becomes terms, and each (item, document) pair a sum of whole numbers, term weight times document impact. The terms of
the items make a vocabulary; one pass over the documents counts, in tasks, how often each holds these terms, and writes these
counts (a few bytes a term; texts are not shuffled). Document frequencies and total lengths are sums over that table. A second pass multiplies:
a tile of ``DOCS`` documents gets a float64 matrix of impacts over the vocabulary of a tile of ``ITEMS`` items, and BLAS multiplies it
with the items' weights. The vocabulary is taken in blocks of at most ``TERMS`` columns, cut where the largest possible sum of
an item would reach 2^53, so that each product is exact; blocks are added as 64-bit integers. Each task keeps the k best per
item, ties by the smaller id, and Spark ranks what the tasks kept.

Items are tokenized on the driver and broadcast, so their number is bounded: equal texts are one item, and beyond ``WAVE_BYTES`` of
different texts the items are dealt, by a hash of their text, to waves that pass over the documents one after the other.

Edge cases: null texts have no term; documents without terms do not count in N; items without terms, and items no document
shares a term with, have no row; repeated items each get the ranks of their text, repeated documents each take a place; a document
without id comes last among ties and keeps its null id; an empty table gives no rows; texts of any length are read whole, ``PART``
bytes at a time; sums that reach 2^63 are an error. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.texts import released, small_batches, table
from llm.written import drop_written, written

TOP = 10
DOCS = 1024
ITEMS = 256
TERMS = 2048
WAVE_BYTES = 1 << 24
PART = 1 << 20
IMPACT = 1_000_000  # no document's impact of a term reaches it
#: The bytes of a term in UTF-8 (ASCII letters and digits, and all that is not ASCII), and the scoring constants.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
WEIGHT_SCALE, TF_SCALE, SATURATION, MIN_SHARE, LENGTH_SHARE = 1000, 1000, 8, 25, 75
COUNTED = "doc_id long, n long, terms array<int>, tfs array<long>"
FOUND = "item int, doc_id long, score long"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about ``PART`` bytes."""
    data = (text or "").encode().lower()  # of bytes: A to Z only
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + PART) if at + PART < len(data) else None
        upto = gap.start() if gap else len(data)
        yield TERM.findall(data, at, upto)
        at = upto


@dataclass
class Items:
    """Item texts as term counts over a common vocabulary; an item's number is its place."""

    keys: list[str]
    counts: list[Counter]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, texts: list[tuple[str, str | None]]) -> Items:
        keys, counts = [], []
        for key, text in texts:
            found: Counter = Counter()
            for part in terms(text):
                found.update(part)
            keys.append(key)
            counts.append(found)
        return cls(keys, counts, {t: i for i, t in enumerate(sorted(set().union(*counts)))})


def weights(items: Items, df: dict[int, int], n_docs: int) -> np.ndarray:
    """w of each term of the vocabulary; 0 for terms that no document has."""
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df[i] + 1))) if i in df else 0
                     for i in range(len(items.vocabulary))], np.int64)


@dataclass
class Tile:
    """Some items with their own compact vocabulary: per block, the terms of its columns and a column of weights per item."""

    items: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray]]


def tiles(items: Items, w: np.ndarray, size: int = ITEMS, columns: int = TERMS, limit: int = 1 << 53) -> list[Tile]:
    """The items in tiles; within a block no item's weights times ``IMPACT`` sum up to ``limit``."""
    out = []
    most = (limit - 1) // IMPACT
    for at in range(0, len(items.keys), size):
        numbers = np.arange(at, min(at + size, len(items.keys)))
        entries: dict[int, dict[int, int]] = {}
        for place, i in enumerate(numbers):
            total = 0
            for term, count in items.counts[i].items():
                term = items.vocabulary[term]
                if value := int(w[term]) * count:
                    entries.setdefault(term, {})[place] = value
                    total += value
            if total * IMPACT >= 1 << 63:
                raise OverflowError(f"an item's scores may exceed 64 bits: {items.keys[i]}")
        blocks: list[tuple[list[int], list[np.ndarray], np.ndarray]] = []
        for term in sorted(entries):
            column = np.zeros(len(numbers), np.int64)
            for place, value in entries[term].items():
                column[place] = value
            while column.any():
                if not blocks or len(blocks[-1][0]) == columns or (blocks[-1][2] + np.minimum(column, most) > most).any():
                    blocks.append(([], [], np.zeros(len(numbers), np.int64)))
                part = np.minimum(column, most)
                blocks[-1][0].append(term)
                blocks[-1][1].append(part)
                blocks[-1][2][:] += part
                column = column - part
        out.append(Tile(numbers, [(np.array(t, np.int64), np.array(c, np.float64)) for t, c, _ in blocks]))
    return out


def impacts(tfs: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """The impact of each count, given its document's number of terms: 64-bit whole numbers, or larger ones where they do not do."""
    if int(n.max(initial=0)) * n_docs * LENGTH_SHARE >= 1 << 63:
        m = np.array([MIN_SHARE + LENGTH_SHARE * int(x) * n_docs // length for x in n], object)
    else:
        m = MIN_SHARE + LENGTH_SHARE * n * n_docs // max(length, 1)
    return ((TF_SCALE * IMPACT * tfs) // (TF_SCALE * tfs + SATURATION * m)).astype(np.int64)


class Best:
    """The k best documents of each item so far: higher scores first, then smaller ids, no id last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores, self.ids = np.zeros((items, k), np.int64), np.zeros((items, k), np.int64)
        self.blank = np.ones((items, k), bool)  # no id, or no document yet (score 0)

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray, blank: np.ndarray) -> None:
        """A tile: documents by row, ``items`` by column; scores of 0 do not count."""
        worst, last, open_ = self.scores[items, -1], self.ids[items, -1], self.blank[items, -1]
        sooner = np.where(blank[:, None], False, open_ | (ids[:, None] < last))
        row, col = np.nonzero((scores > worst) | ((scores == worst) & (scores > 0) & sooner))
        if not len(row):
            return
        hit = np.unique(col)
        place = np.searchsorted(hit, col)
        own = items[hit]
        old = self.scores[own] > 0
        who = np.concatenate([place, np.nonzero(old)[0]])
        value = np.concatenate([scores[row, col], self.scores[own][old]])
        name = np.concatenate([ids[row], self.ids[own][old]])
        none = np.concatenate([blank[row], self.blank[own][old]])
        order = np.lexsort((name, none, -value, who))
        who, value, name, none = who[order], value[order], name[order], none[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        top = rank < self.k
        at = own[who[top]], rank[top]
        self.scores[own], self.ids[own], self.blank[own] = 0, 0, True
        self.scores[at], self.ids[at], self.blank[at] = value[top], name[top], none[top]


def counted(docs: DataFrame, vocabulary: dict[bytes, int], id_column: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document that has a term: its number of terms, and which of the vocabulary's how often."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, n, held, tfs, ends = [], [], [], [], [0]
            for key, said in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total, found = 0, Counter()
                for part in terms(said.as_py()):
                    total += len(part)
                    found.update(filter(known.__contains__, part))
                if total:
                    ids.append(key)
                    n.append(total)
                    held += [known[t] for t in found]
                    tfs += found.values()
                    ends.append(len(held))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(held, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_column).cast("long"), F.col(text).cast("string"))
    return written(rows.mapInArrow(released(run), COUNTED), "counted")


def scored(held: DataFrame, parts: list[Tile], n_items: int, n_docs: int, length: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): per task, the k best documents of each item."""
    shared = held.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_items, k)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCS):
                batch = whole.slice(at, DOCS)
                blank = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = batch.column(0).fill_null(0).to_numpy()
                sizes = np.asarray(batch.column(2).value_lengths())
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                term = batch.column(2).flatten().to_numpy()
                value = impacts(batch.column(3).flatten().to_numpy(), np.repeat(batch.column(1).to_numpy(), sizes), n_docs, length)
                for tile in shared.value:
                    scores = np.zeros((batch.num_rows, len(tile.items)), np.int64)
                    for columns, weighed in tile.blocks:
                        place = np.full(n_terms, -1)
                        place[columns] = np.arange(len(columns))
                        use = place[term] >= 0
                        dense = np.zeros((batch.num_rows, len(columns)))
                        dense[doc[use], place[term[use]]] = value[use]
                        scores += (dense @ weighed).astype(np.int64)
                    best.add(tile.items, scores, ids, blank)
        item, rank = np.nonzero(best.scores)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array(best.ids[item, rank], pa.int64(), mask=best.blank[item, rank]),
             pa.array(best.scores[item, rank], pa.int64())], ["item", "doc_id", "score"])

    return held.mapInArrow(released(run), FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_column: str = "doc_id", text: str = "text",
           item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_column).cast("long").alias("item_id"), F.sha2(F.coalesce(F.col(item_text), F.lit("")), 256).alias("key"),
                         F.col(item_text).cast("string").alias("said"))
    texts = asked.dropDuplicates(["key"])
    size = texts.agg(F.sum(F.octet_length("said"))).first()[0] or 0
    waves = -(-size // WAVE_BYTES) or 1
    wave = F.pmod(F.xxhash64("key"), F.lit(waves))
    ranked = [_wave(docs, texts.where(wave == i), k, id_column, text) for i in range(waves)]
    ranked = [r for r in ranked if r is not None]
    if not ranked:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = ranked[0]
    for more in ranked[1:]:
        found = found.unionByName(more)
    return asked.select("item_id", "key").join(found, "key").select("item_id", "rank", "doc_id", "score")


def _wave(docs: DataFrame, texts: DataFrame, k: int, id_column: str, text: str) -> DataFrame | None:
    """(key, rank, doc_id, score) of one wave's texts, or None where no score is above 0."""
    spark = docs.sparkSession
    held = Items.of([(r["key"], r["said"]) for r in texts.select("key", "said").collect()])  # about WAVE_BYTES
    if not held.vocabulary:
        return None
    counts = counted(docs, held.vocabulary, id_column, text)
    n_docs, length = counts.agg(F.count("*"), F.sum("n")).first()
    df = {r["term"]: r["n"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("n")).collect()}  # one number a term of the vocabulary
    if not df:
        return None
    parts = tiles(held, weights(held, df, n_docs))
    kept = written(scored(counts, parts, len(held.keys), n_docs, length, len(held.vocabulary), k), "kept")
    drop_written(counts)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame(list(enumerate(held.keys)), "item int, key string")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(names, "item").select(
        "key", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
