"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased. Karp-Rabin hashes of all windows of LEAST words
(shorter items: of their own length) are the seeds: those of the documents that a bitmap of the
benchmark's seeds lets through are joined with the benchmark's. For each document and item
that share seeds, the longest run of matching words whose words are still free on both sides is
marked, again and again, until no run of LEAST words is left. The share of the item's words that are
marked is its coverage; being blind to the order of the tiles, it catches reordered passages too.

The bitmap has 2**MAP_BITS bits whatever the benchmark's size (fuller maps let more through, never
less). Seeds travel as one row per document and hash with all positions, so repeats in a
document or item do not multiply rows; a tiling task holds one document's seeds with one item.

Edge cases: null and empty texts on either side match nothing; repeated rows of the benchmark give a row
each; repeated documents with the same id and text are tiled once, and the result has one row for them. Further columns are ignored. Ties between runs of
one length go to the first in the document, then in the item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.texts import LOWER, Chunk, Rolling, apart, chunks, grams, released, runs, small_batches, table
from llm.toxicity import WORD

LEAST = 5
COVERAGE = 0.5
MAP_BITS = 24


def _windows(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and word position of every window of k words; words per document."""
    lower = LOWER[chunk.data]
    starts, ends, docs = runs(WORD[lower], chunk.offsets)
    size = np.bincount(docs, minlength=chunk.size)
    if not len(starts):
        return np.zeros(0, np.uint64), docs, docs, size
    hashes, at = grams(Rolling(lower).spans(starts, ends), docs, k)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    return hashes, docs[at], at - first[docs[at]], size


def seeds(rows: DataFrame, key: str, text: str, lengths: dict[int, np.ndarray | None]) -> DataFrame:
    """(key, words, k, hash, at): the windows of each length, one row per key and hash with its positions.
    ``lengths`` gives for each k a bitmap that a hash has to be in, or None. Texts with fewer than the
    largest k words use windows of all their words where no bitmap is given."""
    spark = rows.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(lengths)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = max(shared.value)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                for k, bitmap in shared.value.items():
                    hashes, docs, at, size = _windows(chunk, k)
                    if bitmap is not None:
                        bit = hashes >> np.uint64(64 - MAP_BITS)
                        use = (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    else:
                        use = (size[docs] == k) | (k == longest) if len(docs) else np.zeros(0, bool)
                    hashes, docs, at = hashes[use], docs[use], at[use]
                    if not len(docs):
                        continue
                    order = np.lexsort((at, hashes, docs))
                    hashes, docs, at = hashes[order], docs[order], at[order]
                    first = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[chunk.first + docs[first]]), pa.array(size[docs[first]].astype(np.int32)),
                         pa.array(np.full(len(first), k, np.int32)), pa.array(hashes[first].view(np.int64)),
                         pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()),
                                                  pa.array(at.astype(np.int32)))],
                        ["key", "words", "k", "hash", "at"])

    return rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(released(cut), "key long, words int, k int, hash long, at array<int>")


def bitmaps(item_seeds: DataFrame) -> dict[int, np.ndarray]:
    """Per window length a bitmap of the hashes' leading bits. Bytes are put together in Spark, so at most
    2**(MAP_BITS - 3) rows per length (at most LEAST lengths) reach the driver."""
    bit = F.shiftrightunsigned("hash", 64 - MAP_BITS)
    parts = item_seeds.select("k", F.shiftrightunsigned(bit, 3).alias("place"),
                              F.expr(f"shiftleft(1, cast(shiftrightunsigned(hash, {64 - MAP_BITS}) & 7 as int))").alias("bit"))
    found: dict[int, np.ndarray] = {}
    rows = parts.groupBy("k", "place").agg(F.bit_or("bit").alias("bits")).toPandas()
    for k, mine in rows.groupby("k"):
        found[int(k)] = np.zeros(1 << (MAP_BITS - 3), np.uint8)
        found[int(k)][mine["place"].to_numpy(np.int64)] = mine["bits"].to_numpy(np.uint8)
    return found


def tile(doc_at: list[np.ndarray], item_at: list[np.ndarray], k: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from the positions of shared windows: (document word, item word, length) of each tile."""
    p = np.concatenate([np.repeat(d, len(i)) for d, i in zip(doc_at, item_at, strict=True)]).astype(np.int64)
    q = np.concatenate([np.tile(i, len(d)) for d, i in zip(doc_at, item_at, strict=True)]).astype(np.int64)
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    new = np.flatnonzero(np.r_[True, (np.diff(p - q) != 0) | (np.diff(p) != 1)])
    lengths = np.diff(np.append(new, len(p))) + k - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(lengths, p[new], q[new], strict=True)]
    heapq.heapify(heap)
    base = int(p.min())
    doc_used = np.zeros(int(p.max()) - base + k, bool)
    item_used = np.zeros(int(q.max()) + k, bool)
    tiles = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = doc_used[a - base:a - base + n] | item_used[b:b + n]
        if not taken.any():
            doc_used[a - base:a - base + n] = item_used[b:b + n] = True
            tiles.append((a, b, n))
            if item_used.all():
                break
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for begin, end in zip(edges[::2], edges[1::2], strict=True):
            if end - begin >= k:
                heapq.heappush(heap, (-int(end - begin), a + int(begin), b + int(begin)))
    return sorted(tiles)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE,
            least: int = LEAST) -> DataFrame:
    """(doc_id, key, item_id, item_words, covered, coverage, tiles) of each document and item whose coverage
    is at least ``coverage``; ``key`` is a hash of the document's id and text."""
    items = benchmark.select("item_id", F.col(text).cast("string").alias("text")).withColumn(
        "key", F.xxhash64("item_id", "text"))
    rows = docs.select("doc_id", F.col(text).cast("string").alias("text")).withColumn(
        "key", F.xxhash64("doc_id", "text"))
    item_seeds = seeds(items, "key", "text", dict.fromkeys(range(1, least + 1)))
    maps = bitmaps(item_seeds)
    schema = ("doc_id {0}, key long, item_id {1}, item_words int, covered int, coverage double,"
              " tiles array<struct<doc_word:int,item_word:int,words:int>>").format(
        rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
    if not maps:
        return docs.sparkSession.createDataFrame([], schema)
    item_side = item_seeds.select("k", "hash", F.col("key").alias("item"), F.col("words").alias("item_words"),
                                  F.col("at").alias("item_at"))
    shared = seeds(rows, "key", "text", maps).select("k", "hash", "key", F.col("at").alias("doc_at")).join(
        item_side, ["k", "hash"])
    # identical documents share a key and so their seeds: one of each is enough
    pairs = shared.groupBy("key", "item", "item_words", "k", "hash").agg(
        F.first("doc_at").alias("doc_at"), F.first("item_at").alias("item_at")).groupBy(
        "key", "item", "item_words", "k").agg(F.collect_list(F.struct("doc_at", "item_at")).alias("seeds"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tiles = [tile([s["doc_at"] for s in found], [s["item_at"] for s in found], k)
                     for found, k in zip(frame["seeds"], frame["k"], strict=True)]
            covered = [sum(n for _, _, n in t) for t in tiles]
            yield pd.DataFrame({
                "key": frame["key"], "item": frame["item"], "item_words": frame["item_words"], "covered": covered,
                "coverage": np.asarray(covered, float) / frame["item_words"].to_numpy(),
                "tiles": [[{"doc_word": a, "item_word": b, "words": n} for a, b, n in t] for t in tiles]})

    tiled = pairs.mapInPandas(released(run), "key long, item long, item_words int, covered int, coverage double,"
                                   " tiles array<struct<doc_word:int,item_word:int,words:int>>")
    found = tiled.where(F.col("coverage") >= coverage)
    ids = rows.select("key", "doc_id").distinct()
    named = items.select(F.col("key").alias("item"), "item_id")
    return found.join(named, "item").join(ids, "key").select(
        "doc_id", "key", "item_id", "item_words", "covered", "coverage", "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The documents without those that cover an item; columns as they were."""
    docs, back = apart(docs, "doc_id", text)
    hit = matches(docs, benchmark, text, coverage).select("key").distinct()
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", F.col(text).cast("string")))
    return back(keyed.join(hit, keyed["__key"] == hit["key"], "left_anti"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains, in whatever order of passages."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered", "coverage", F.size("tiles").alias("n_tiles"),
                        F.to_json("tiles").alias("tiles"))
