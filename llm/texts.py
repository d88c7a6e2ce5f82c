"""Helpers shared by the operators: document chunks as byte arrays, words, hashes, folds.

A chunk holds whole documents one after the other in one uint8 array, so that numpy works on
some hundred documents at once and memory stays bounded by ``CHUNK_BYTES`` or the longest
single document.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
_SHIPPED: set[str] = set()
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Chunk:
    """Documents ``first`` to ``first + len(offsets) - 1`` of an Arrow batch."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offsets) - 1


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers import this folder, and get batches of at most ``rows`` rows, which
    bounds their memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    packed = Path(tempfile.mkdtemp(prefix="llm-code-")) / f"llm-{context.applicationId}.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(Path(__file__).parent.glob("*.py")):
            out.write(path, f"llm/{path.name}")
    context.addPyFile(str(packed))


def released(run: Callable) -> Callable:
    """``run`` for ``mapInArrow`` or ``mapInPandas``; when a task ends, its worker, which Spark keeps for later tasks,
    gives freed memory back to the system."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return task


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a batch (null counts as empty), in chunks of about ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        upto = min(max(upto, at + 1), len(texts))
        yield Chunk(at, whole[offsets[at]:offsets[upto]], offsets[at:upto + 1] - offsets[at])
        at = upto


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each maximal run of true bytes; runs never cross documents."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes that are not white space."""
    return runs(~SPACES[chunk.data], chunk.offsets)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xFF51AFD7ED558CCD)
    values ^= values >> np.uint64(33)
    values *= np.uint64(0xC4CEB9FE1A85EC53)
    values ^= values >> np.uint64(33)
    return values


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Karp-Rabin prefix sums over bytes: the hash of any span in constant time."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(n), out=self.sums[1:], dtype=np.uint64)
        self.back = powers(n + 1, _BACK)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mixed(raw + (ends - starts).astype(np.uint64))


def grams(hashes: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``k`` consecutive words of one document, and where they start."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _BASE
        out += hashes[j:n + j]
    whole = np.flatnonzero(docs[:n] == docs[k - 1:])
    return mixed(out[whole]), whole


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def apart(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all but the needed columns under names that clash with nothing, and the way back."""
    names = docs.columns
    safe = [n if n in needed else f"__extra_{i}" for i, n in enumerate(names)]
    return docs.toDF(*safe), lambda df: df.select(*safe).toDF(*names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
