"""Exact top-k search by inner product over norm-sorted, SVD-rotated vectors.

Components are whole numbers floor(SCALE * x). All vectors are sorted by descending length in Spark and
packed into blocks; query vectors are packed alike. Every block of queries first meets the block of the
longest vectors, which gives each query a k-th best score. Then it meets the other blocks whose
longest vector could still reach some query's k-th score (Cauchy-Schwarz). Inside a block
the vectors go in slices, longest first: slices too short for all queries end the block; for the rest the leading rotated
coordinates give a partial sum, and the product of the residual lengths bounds what the others can add. Only
pairs whose bound reaches the k-th score are computed, in whole numbers.

The rotation comes from the sum of outer products, of which d * d numbers reach the driver.

Edge cases: vectors that are null, or have a null or non-finite component, and rows without
id take no part; shorter vectors count as filled with 0; every row is a query or candidate of its own, also where rows repeat: a query
leaves out its own row only, and rows with one id give a list each; with fewer candidates than k all are returned; ties go to the
smaller id; an empty table gives no rows; clashing columns are ignored. Sums that do not fit a long are an error. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.texts import released, small_batches, table
from llm.written import written

SCALE = 64
TOP = 20
BLOCK = 4096
QUERY_BLOCK = 1024
SLICE = 1024
PART = 4 * BLOCK
HEAD_ENERGY = 0.9
_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


def whole_vectors(rows: DataFrame, id_column: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v, length, d): the vectors that take part, as packed 64-bit whole numbers; ``row`` tells rows apart once it is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, packed, lengths, sizes = [], [], [], []
            for key, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key is None or not held.is_valid or held.values.null_count:
                    continue
                x = np.asarray(held.values.to_numpy(zero_copy_only=False), np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(x * scale)
                if len(x) and np.abs(x).max() >= 2.0 ** 62:
                    raise OverflowError(f"vector {key} is too long for whole numbers of 64 bits")
                ids.append(key)
                packed.append(x.astype(np.int64).tobytes())
                lengths.append(float(np.sqrt((x * x).sum())))
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(at, at + len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(packed, pa.binary()),
                 pa.array(lengths, pa.float64()), pa.array(sizes, pa.int32())], ["row", "vec_id", "v", "length", "d"])
            at += len(ids)

    small_batches(rows.sparkSession, 4096)
    kept = rows.select(F.col(id_column).cast("long"), F.col(vector).cast("array<double>"))
    return kept.mapInArrow(released(run), "row long, vec_id long, v binary, length double, d int")


def rotation(vectors: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """Orthogonal axes by descending energy, and how many of them hold HEAD_ENERGY of it."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column(0).to_pylist(), d).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(d), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(key: tuple, frame):  # noqa: ANN001, ANN202
        import pandas as pd

        total = sum(np.frombuffer(r, np.float64) for r in frame["row"])
        return pd.DataFrame({"i": [key[0]], "row": [total.tobytes()]})

    rows = vectors.select("v").mapInArrow(released(outer), "i int, row binary").groupBy("i").applyInPandas(add, "i int, row binary")
    gram = np.zeros((d, d))
    for row in rows.collect():  # d rows of d numbers
        gram[row["i"]] = np.frombuffer(row["row"], np.float64)
    energy, axes = np.linalg.eigh(gram)
    energy, axes = np.maximum(energy[::-1], 0), axes[:, ::-1]
    share = np.cumsum(energy) / max(energy.sum(), 1e-300)
    return np.ascontiguousarray(axes), int(min(d, np.searchsorted(share, HEAD_ENERGY) + 1))


def _matrix(packed: list[bytes], d: int) -> np.ndarray:
    out = np.zeros((len(packed), d), np.int64)
    for i, held in enumerate(packed):
        x = np.frombuffer(held, np.int64)
        out[i, :len(x)] = x
    return out


def blocks(vectors: DataFrame, count: int, size: int, d: int, name: str) -> DataFrame:
    """(block, longest, n, rows, ids, data): the vectors by descending length, ``size`` in a block; block 0 has the longest ones."""
    parts = max(1, -(-count // (4 * size)))
    order = (F.desc("length"), "vec_id", "row")
    rows = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, places, ids, held, lengths = TaskContext.get().partitionId() << 20, [], [], [], []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([lengths[0]]), pa.array([len(ids)], pa.int32()),
                 pa.array([np.array(places, np.int64).tobytes()], pa.binary()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                 pa.array([_matrix(held, d).tobytes()], pa.binary())], ["block", "longest", "n", "rows", "ids", "data"])

        for batch in batches:
            for place, key, v, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places.append(place)
                ids.append(key)
                held.append(v)
                lengths.append(length)
                if len(ids) == size:
                    yield close()
                    at, places, ids, held, lengths = at + 1, [], [], [], []
        if ids:
            yield close()

    return written(rows.select("row", "vec_id", "v", "length").mapInArrow(
        released(pack), "block long, longest double, n int, rows binary, ids binary, data binary"), name)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, exact."""
    if not len(q):
        return np.zeros(0, np.int64)
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if most < 2.0 ** 53:
        return np.einsum("ij,ij->i", q.astype(np.float64), c.astype(np.float64)).astype(np.int64)
    if most < 2.0 ** 63:
        return np.einsum("ij,ij->i", q, c)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q, c)], object).astype(np.int64)


def best_of(q_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, c_rows: np.ndarray, c_ids: np.ndarray, c: np.ndarray,
            axes: np.ndarray, head: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best candidates (scores, ids) per query that reach ``floor``; free places have the score _NONE."""
    best, names = np.full((len(q), k), _NONE), np.full((len(q), k), _LAST)
    qr, cr = q.astype(np.float64) @ axes, c.astype(np.float64) @ axes
    q_len, c_len = np.linalg.norm(qr, axis=1), np.linalg.norm(cr, axis=1)
    q_rest, c_rest = np.linalg.norm(qr[:, head:], axis=1), np.linalg.norm(cr[:, head:], axis=1)
    limit = floor.astype(np.float64)
    for at in range(0, len(c), SLICE):
        s = slice(at, at + SLICE)
        slack = 1e-9 * q_len * c_len[s].max(initial=0) + 1e-6
        live = np.flatnonzero(q_len * c_len[s].max(initial=0) + slack >= limit)
        if not len(live):
            break
        bound = qr[live, :head] @ cr[s, :head].T
        bound += q_rest[live, None] * c_rest[None, s]
        row, col = np.nonzero(bound >= (limit[live] - slack[live])[:, None])
        row = live[row]
        other = q_rows[row] != c_rows[at + col]
        row, col = row[other], col[other] + at
        scores = np.concatenate([exact(q[row[i:i + 65536]], c[col[i:i + 65536]]) for i in range(0, len(row), 65536)]
                                or [np.zeros(0, np.int64)])
        use = (scores >= floor[row]) & (scores >= best[row, -1])
        row, col, scores = row[use], col[use], scores[use]
        if not len(row):
            continue
        hit = np.unique(row)
        old = best[hit] != _NONE
        all_row = np.concatenate([row, np.repeat(hit, old.sum(1))])
        all_score = np.concatenate([scores, best[hit][old]])
        all_name = np.concatenate([c_ids[col], names[hit][old]])
        order = np.lexsort((all_name, -all_score, all_row))
        all_row, all_score, all_name = all_row[order], all_score[order], all_name[order]
        first = np.searchsorted(all_row, hit)
        place = np.arange(len(all_row)) - np.repeat(first, np.diff(np.append(first, len(all_row))))
        top = place < k
        best[hit], names[hit] = _NONE, _LAST
        best[all_row[top], place[top]] = all_score[top]
        names[all_row[top], place[top]] = all_name[top]
        full = best[:, -1] != _NONE
        limit[full] = np.maximum(limit[full], best[full, -1])
    return best, names


def search(rows: DataFrame, is_query: Column, k: int = TOP, id_column: str = "vec_id", vector: str = "embedding"
           ) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` holds for, the k other rows of largest inner product."""
    spark = rows.sparkSession
    vectors = written(whole_vectors(rows, id_column, vector), "vectors")
    schema = "query_id long, rank int, vec_id long, score long"
    d, count = vectors.agg(F.max("d"), F.count("*")).first()
    asked = vectors.where(is_query)
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)
    d = max(d, 1)
    shared = spark.sparkContext.broadcast(rotation(vectors, d))
    small_batches(spark, 1)  # a row is a block
    candidates = blocks(vectors, count, BLOCK, d, "candidates")
    queries = blocks(asked, n_asked, QUERY_BLOCK, d, "queries").select(
        F.col("block").alias("q_block"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, head = shared.value
        for batch in batches:
            for q_block, floor, *held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                q_rows, q_ids, q, rows, ids, c = (np.frombuffer(h, np.int64) for h in held)
                q, c = q.reshape(-1, d), c.reshape(-1, d)
                floor = np.full(len(q), _NONE) if floor is None else np.frombuffer(floor, np.int64)
                best, names = best_of(q_rows, q, floor, rows, ids, c, axes, head, k)
                length = np.linalg.norm(q.astype(np.float64), axis=1)
                reach = np.where(best[:, -1] == _NONE, -1.0, best[:, -1] / np.maximum(length, 1e-300))
                found, _ = np.nonzero(best != _NONE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q_block], pa.int64()), pa.array([best[:, -1].tobytes()], pa.binary()),
                     pa.array([float(reach.min())]),
                     *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (
                         q_rows[found], q_ids[found], names[best != _NONE], best[best != _NONE]))],
                    ["q_block", "floor", "reach", "q_row", "query_id", "vec_id", "score"])

    result = "q_block long, floor binary, reach double, q_row array<long>, query_id array<long>, vec_id array<long>, score array<long>"
    payload = ["q_block", "floor", "q_rows", "q_ids", "q_data", "rows", "ids", "data"]
    # A row of its own for the number, as an equality of two constants would become a product of the tables.
    start = queries.withColumns({"floor": F.lit(None).cast("binary"), "block": F.explode(F.array(F.lit(0).cast("long")))}).join(
        candidates.where("block = 0"), "block").select(*payload)
    first = written(start.repartition("q_block").mapInArrow(released(pair), result), "first")
    # Which blocks can still matter is decided on two small tables, a row for each block; only such pairs get their vectors.
    near = first.select("q_block", "reach").join(
        candidates.where("block <> 0").select("block", "longest"), F.col("longest") * (1 + 1e-9) >= F.col("reach")).select("q_block", "block")
    asked_blocks = queries.join(first.select("q_block", "floor"), "q_block")
    pairs = near.join(asked_blocks, "q_block").join(candidates.select("block", "rows", "ids", "data"), "block").select(*payload)
    more = written(pairs.mapInArrow(released(pair), result), "more")
    found = first.unionByName(more).select(F.explode(F.arrays_zip("q_row", "query_id", "vec_id", "score")).alias("x")).select("x.*")
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest inner product of every row whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
