"""Removal of repeated byte strings by distributed prefix doubling on sampled positions.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document with a
smaller id, or before it in the same document. Comparing the suffixes at all positions would need
many times the corpus on disk, so positions are sampled without loss: the seed of a string is its SEED-byte substring of
least hash, so equal strings have equal seeds at equal places, and the starts of one seed
form a segment. Ranks are names of strings: Karp-Rabin hashes, made from the prefix sums at a position and
at a growing offset from it, equal for equal strings wherever they are computed.

Round by round Spark groups positions by rank. A position whose rank at a length is unique drops out; a
position whose whole stretch (all its strings together) occurs earlier is removed whole; the rest is ranked again on longer
strings: SEED bytes, then LENGTH - 7 (starts in cells of 8), then LENGTH. Only cells at the ends of
matches reach the last round, since copies drop out early as whole stretches.

A first pass finds which seeds repeat, as a bitmap of 2**MAP_BITS bits or more, by the number of rows, up to 2**MOST_BITS
(fuller maps let more through, never less). Seeds are least hashes and thus small numbers, so they are mixed for the map. Hot strings are reduced to their first place in each task before any shuffle.

Edge cases: a null text counts as empty; texts under LENGTH bytes lose nothing; a null id comes
after all others; rows equal in id and text count as one place; among equal ids the order is that of a
hash of id and text. Further columns are ignored. Cut texts may begin or end inside a
character: ``kept`` has the bytes, and the text leaves such fragments out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.texts import Chunk, Rolling, apart, chunks, mixed, released, small_batches, table
from llm.written import drop_written, written

LENGTH = 100
SEED = 40
CELL = 8
MAP_BITS = 25
MOST_BITS = 29
RANK_BITS = 26
PIECE = 1 << 23
PLACE_BITS = 24
HELD = 1 << 19
NODE = "rank long, inner long, doc_id long, key long, at int, low short, high short"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value in each window of ``width``."""
    n, span = len(values) - width + 1, 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span:width - span + n])


def segments(chunk: Chunk, rolling: Rolling, length: int = LENGTH, seed: int = SEED
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of each segment, place and rank of its seed, and its document. Places are those in the chunk."""
    found = []
    n, step = len(chunk.data), PIECE if len(chunk.data) > PIECE else max(len(chunk.data), 1)
    for begin in range(0, n, step):  # a document longer than PIECE is cut in overlapping pieces
        end = min(n, begin + step + length - 1)
        if end - begin < length:
            continue
        ranks = (rolling.sums[begin + seed:end + 1] - rolling.sums[begin:end - seed + 1]) * rolling.back[begin:end - seed + 1]
        ranks *= np.uint64(0xFF51AFD7ED558CCD)
        ranks ^= ranks >> np.uint64(32)
        ranks *= np.uint64(0xC4CEB9FE1A85EC53)
        ranks ^= ranks >> np.uint64(29)
        places = ranks >> np.uint64(PLACE_BITS)
        places <<= np.uint64(PLACE_BITS)
        places |= np.arange(len(ranks), dtype=np.uint64)
        best = _least(places, length - seed + 1)
        best &= np.uint64((1 << PLACE_BITS) - 1)
        best = best.astype(np.int64)
        inside = np.ones(len(best), bool)
        edges = chunk.offsets[1:-1]
        edges = edges[(edges > begin) & (edges < end)] - begin
        marks = np.zeros(len(best) + 1, np.int32)
        np.add.at(marks, np.maximum(edges - length + 1, 0), 1)
        np.add.at(marks, np.minimum(edges, len(best)), -1)
        inside = np.cumsum(marks[:-1]) == 0
        starts = np.flatnonzero(inside)
        if not len(starts):
            continue
        seeds = best[starts]
        first = np.flatnonzero(np.r_[True, (np.diff(seeds) != 0) | (np.diff(starts) != 1)])
        last = np.r_[first[1:] - 1, len(starts) - 1]
        found.append((starts[first] + begin, starts[last] + begin, seeds[first] + begin, ranks[seeds[first]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none
    low, high, at, ranks = (np.concatenate(x) for x in zip(*found, strict=True))
    return low, high, at, ranks, np.searchsorted(chunk.offsets, low, "right") - 1


def place_key(text: str = "text") -> Column:
    return F.xxhash64("doc_id", F.col(text).cast("string"))


def _places(docs: DataFrame, text: str) -> DataFrame:
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return docs.select(order.alias("doc_id"), place_key(text).alias("key"), F.col(text).cast("string").alias("text"))


def repeated_seeds(docs: DataFrame, text: str, length: int, seed: int) -> np.ndarray:
    """Bitmap of mixed seed ranks with more than one place. Tasks send each of their ranks once (twice if it
    repeats), packed by range; every range gives its slice of the bitmap."""
    small_batches(docs.sparkSession)
    rows = docs.count()
    map_bits = int(np.clip(np.ceil(np.log2(max(rows, 1) * 64)), MAP_BITS, MOST_BITS))
    bits = int(np.clip(np.ceil(np.log2(max(rows, 1) / 4096 + 1)), 4, map_bits - 9))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                values, times = np.unique(np.concatenate(held), return_counts=True)
                values = np.sort(np.concatenate([values, values[times > 1]]))
                cut = np.searchsorted(values >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                use = np.flatnonzero(np.diff(cut))
                held.clear()
                for part in np.array_split(use, max(1, len(use) // 500)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part, pa.int32()),
                         pa.array([values[cut[i]:cut[i + 1]].tobytes() for i in part], pa.binary())], ["part", "ranks"])

        for batch in batches:
            for chunk in chunks(batch.column(0)):
                held.append(mixed(segments(chunk, Rolling(chunk.data), length, seed)[3]))
                if sum(map(len, held)) > HELD:
                    yield from flush()
        yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            bit = (values[times > 1] >> np.uint64(64 - map_bits)) - (np.uint64(now) << np.uint64(map_bits - bits))
            slice_ = np.zeros(1 << (map_bits - bits), bool)
            slice_[bit.astype(np.int64)] = True
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([np.packbits(slice_, bitorder="little").tobytes()], pa.binary())],
                ["part", "bits"])

        for batch in batches:
            for part, ranks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if part != now:
                    if held:
                        yield close()
                    now, held = part, []
                held.append(np.frombuffer(ranks, np.uint64))
        if held:
            yield close()

    sent = docs.select(F.col(text).cast("string")).mapInArrow(released(send), "part int, ranks binary")
    slices = sent.repartition("part").sortWithinPartitions("part").mapInArrow(released(count), "part int, bits binary")
    out = np.zeros(1 << (map_bits - 3), np.uint8)
    width = 1 << (map_bits - 3 - bits)
    for row in slices.toLocalIterator():  # 2**(MOST_BITS - 3) bytes in all at most
        out[row["part"] * width:(row["part"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def _stretch(rolling: Rolling, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    return rolling.spans(start, end) ^ mixed((at - start).astype(np.uint64))


def first_round(docs: DataFrame, text: str, length: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, removed, the table of both): a node per segment with a repeated seed that is the task's first with its stretch;
    for the others, (key, starts, ends) of what goes."""
    spark = docs.sparkSession
    bitmap = repeated_seeds(docs, text, length, seed)
    map_bits = len(bitmap).bit_length() + 2
    shared = spark.sparkContext.broadcast(bitmap)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held, axis=1)
            held.clear()
            rank, inner, ids, keys, at, low, high = rows
            start = at - high
            order = np.lexsort((start, keys, ids, rank))
            new = np.r_[True, np.diff(rank[order]) != 0] if len(order) else np.zeros(0, bool)
            same = np.r_[False, (np.diff(ids[order]) == 0) & (np.diff(keys[order]) == 0) & (np.diff(start[order]) == 0)]
            keep = new.copy()
            for i in np.flatnonzero(same & ~new):  # rows equal in id and text are one place
                keep[i] = keep[i - 1]
            first, others = order[new], order[~keep]
            for part in np.array_split(first, max(1, len(first) // 50_000)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rank[part]), pa.array(inner[part]), pa.array(ids[part]), pa.array(keys[part]),
                     pa.array(at[part].astype(np.int32)), pa.array(low[part].astype(np.int16)),
                     pa.array(high[part].astype(np.int16)), pa.nulls(len(part), pa.list_(pa.int32())),
                     pa.nulls(len(part), pa.list_(pa.int32()))], names)
            owners, starts, ends = merged(keys[others], start[others], at[others] - low[others] + length)
            cut = np.flatnonzero(np.r_[True, np.diff(owners) != 0]) if len(owners) else np.zeros(0, np.int64)
            bounds = pa.array(np.append(cut, len(owners)), pa.int32())
            blank = [pa.nulls(len(cut), t) for t in (pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*blank, pa.array(owners[cut]), pa.nulls(len(cut), pa.int32()), pa.nulls(len(cut), pa.int16()),
                 pa.nulls(len(cut), pa.int16()),
                 pa.ListArray.from_arrays(bounds, pa.array(starts.astype(np.int32))),
                 pa.ListArray.from_arrays(bounds, pa.array(ends.astype(np.int32)))], names)

        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for chunk in chunks(batch.column(2)):
                rolling = Rolling(chunk.data)
                low, high, at, ranks, of = segments(chunk, rolling, length, seed)
                bit = mixed(ranks) >> np.uint64(64 - map_bits)
                use = (shared.value[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                low, high, at, ranks, of = low[use], high[use], at[use], ranks[use], of[use]
                stretch = _stretch(rolling, low, high + length, at)
                own = chunk.first + of
                held.append(np.stack([stretch.view(np.int64), ranks.view(np.int64), ids[own], keys[own],
                                      at - chunk.offsets[of], at - high, at - low]))
                if sum(x.shape[1] for x in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    names = ["rank", "inner", "doc_id", "key", "at", "low", "high", "starts", "ends"]
    rows = written(_places(docs, text).mapInArrow(released(run), f"{NODE}, starts array<int>, ends array<int>"), "segments")
    return (rows.where("starts is null").drop("starts", "ends"),
            rows.where("starts is not null").select("key", F.explode(F.arrays_zip("starts", "ends")).alias("x")).select(
                "key", F.col("x.starts").alias("start"), F.col("x.ends").alias("end")), rows)


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of the ranges of each owner, as ranges that do not touch."""
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    change = np.r_[True, owner[1:] != owner[:-1]]
    group = np.cumsum(change) - 1
    shift = group.astype(np.int64) << 40
    reach = np.maximum.accumulate(end + shift)
    new = np.r_[True, (start + shift)[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(owner) - 1]
    return owner[first], start[first], reach[last] - shift[last]


def decide(nodes: DataFrame, source: DataFrame, length: int, gone: DataFrame | None = None
           ) -> tuple[DataFrame, DataFrame]:
    """(removed ranges of nodes whose stretch has an earlier place, per document the nodes to rank on longer strings).
    Both are written; the table ``source`` that the nodes are read from is deleted then."""
    order = F.struct("doc_id", "key", (F.col("at") - F.col("high")).alias("start"))
    grouped = written(nodes.groupBy("rank").agg(
        F.min(F.struct(order.alias("place"), "inner", "at", "low", "high")).alias("first"), F.count("*").alias("n")), "ranks")
    shared = nodes.sparkSession.sparkContext.broadcast(_bitmap(grouped.where("n > 1").select(F.col("rank").alias("key")), RANK_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_may_be(batch.column(0).to_numpy(zero_copy_only=False), shared.value)))

    # Few ranks repeat, so most nodes need not be shuffled to find that theirs does not.
    may_repeat = nodes.select("rank", "doc_id", "key", "at", "low", "high").mapInArrow(
        released(run), "rank long, doc_id long, key long, at int, low short, high short")
    late = may_repeat.withColumn("place", order).join(
        grouped.where("n > 1").select("rank", F.col("first.place").alias("earliest")), "rank").where("place <> earliest")
    removed = late.select("key", F.col("place.start").alias("start"), (F.col("at") - F.col("low") + length).alias("end"))
    removed = written(removed if gone is None else removed.unionByName(gone), "removed")
    firsts = grouped.select("first.place.doc_id", "first.place.key", "first.inner", "first.at", "first.low", "first.high")
    again = firsts.groupBy("inner").agg(F.count("*").alias("n")).where("n > 1").select("inner")
    todo = written(firsts.join(again, "inner", "left_semi").groupBy("key").agg(
        F.collect_list(F.struct("at", "low", "high")).alias("nodes")), "todo")
    drop_written(grouped)
    drop_written(source)
    return removed, todo


def _bitmap(keys: DataFrame, bits: int = 24) -> np.ndarray:
    """2**bits bits of the hashes in ``key``, put together in Spark; 256 slices reach the driver."""
    width = bits - 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            part = bit >> np.uint64(width)
            for p in np.unique(part).tolist():
                held.setdefault(p, np.zeros(1 << width, bool))[(bit[part == np.uint64(p)] & np.uint64((1 << width) - 1)).astype(np.int64)] = True
        for p, slice_ in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), pa.array([np.packbits(slice_, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    small_batches(keys.sparkSession, 20_000)
    rows = keys.select(F.shiftrightunsigned("key", 56).alias("part"), "key").repartition("part")
    out = np.zeros(1 << (bits - 5), np.uint32)
    words = 1 << (width - 5)
    for row in rows.mapInArrow(released(run), "part int, bits binary").collect():  # 2**(bits - 3) bytes in all
        out[row["part"] * words:(row["part"] + 1) * words] = np.frombuffer(row["bits"], "<u4")
    return out


def _may_be(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bits = int(len(bitmap)).bit_length() - 1 + 5
    bit = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def texts_of(docs: DataFrame, keys: DataFrame, text: str) -> DataFrame:
    """(doc_id, key, text) of documents whose key may be in ``keys``."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_may_be(batch.column(1).to_numpy(zero_copy_only=False), shared.value)))

    small_batches(docs.sparkSession)
    return _places(docs, text).mapInArrow(released(run), "doc_id long, key long, text string")


def next_round(docs: DataFrame, todo: DataFrame, text: str, length: int, cell: int) -> DataFrame:
    """Nodes for cells of ``cell`` starts, ranked on the strings that all starts of the cell share (inner) and the
    stretch of those of the node (rank)."""
    joined = texts_of(docs, todo, text).join(todo, "key").select("doc_id", "key", "nodes", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists_ = batch.column(2)
            flat = lists_.flatten()
            size = np.diff(np.asarray(lists_.offsets))
            of = np.repeat(np.arange(batch.num_rows), size)
            at, low, high = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
            for chunk in chunks(batch.column(3)):
                rolling = Rolling(chunk.data)
                a, b = np.searchsorted(of, [chunk.first, chunk.first + chunk.size])
                cells = high[a:b] // cell - low[a:b] // cell + 1
                owner = np.repeat(np.arange(a, b), cells)
                number = low[owner] // cell + np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
                first, last = np.maximum(low[owner], number * cell), np.minimum(high[owner], number * cell + cell - 1)
                place = at[owner] + chunk.offsets[of[owner] - chunk.first]
                inner = rolling.spans(place - number * cell, place + length - (number * cell + cell - 1))
                inner ^= mixed(number.astype(np.uint64))
                rank = _stretch(rolling, place - last, place - first + length, place)
                doc = of[owner]
                for lo in range(0, len(owner), 50_000):
                    s = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rank[s].view(np.int64)), pa.array(inner[s].view(np.int64)), pa.array(ids[doc[s]]),
                         pa.array(keys[doc[s]]), pa.array(at[owner[s]].astype(np.int32)),
                         pa.array(first[s].astype(np.int16)), pa.array(last[s].astype(np.int16))],
                        ["rank", "inner", "doc_id", "key", "at", "low", "high"])

    small_batches(docs.sparkSession)
    return written(joined.mapInArrow(released(run), NODE), "nodes")


def removed_ranges(docs: DataFrame, text: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(key, ranges): for documents that lose bytes, the ranges [start, end) that go; they may overlap."""
    nodes, gone, source = first_round(docs, text, length, seed)
    removed, todo = decide(nodes, source, length, gone)
    parts = [removed]
    for cell in (CELL, 1):
        nodes = next_round(docs, todo, text, length, cell)
        drop_written(todo)
        removed, todo = decide(nodes, nodes, length)
        parts.append(removed)
    all_parts = parts[0]
    for part in parts[1:]:
        all_parts = all_parts.unionByName(part)
    ranges = written(all_parts.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "ranges")
    for table_ in (*parts, todo):
        drop_written(table_)
    return ranges


def _cut(docs: DataFrame, ranges: DataFrame, keep: list[str], text: str, finish: Callable, names: str) -> DataFrame:
    """``finish(bytes, ranges)`` of every document next to its ``keep`` columns. Only documents that lose bytes are shuffled."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_bitmap(ranges))
    rows = docs.select(*[F.col(c) for c in keep], place_key(text).alias("__key"), F.col(text).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    fields = [f.strip().split(" ")[0] for f in names.split(",")]
    nothing = np.zeros((0, 2), np.int64)
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.strip().split(" ")[1]] for f in names.split(",")]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            hit = _may_be(batch.column(n).to_numpy(zero_copy_only=False), shared.value)
            held = [finish((t or "").encode(), nothing) if not h else (None,) * len(fields)
                    for t, h in zip(batch.column(n + 1).to_pylist(), hit, strict=True)]
            texts = pa.compute.if_else(pa.array(hit), batch.column(n + 1).fill_null(""), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n + 1], texts, *(pa.array([h[i] for h in held], t) for i, t in enumerate(types))],
                [*keep, "__key", "__text", *fields])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            held = []
            for t, ranges_ in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                spans = np.array([(r["start"], r["end"]) for r in ranges_ or ()], np.int64).reshape(-1, 2)
                _, start, end = merged(np.zeros(len(spans), np.int64), spans[:, 0], spans[:, 1])
                held.append(finish(t.encode(), np.column_stack([start, end])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], *(pa.array([h[i] for h in held], t) for i, t in enumerate(types))], [*keep, *fields])

    small_batches(spark)
    parts = rows.mapInArrow(released(split), f"{kept + ', ' if kept else ''}__key long, __text string, {names}")
    joined = parts.join(ranges.withColumnRenamed("key", "__key"), "__key", "left")
    whole = joined.where("__text is null").select(*keep, *fields)
    loses = joined.where("__text is not null").select(*keep, "__text", "ranges")
    return whole.unionByName(loses.mapInArrow(released(close), f"{kept + ', ' if kept else ''}{names}"))


def without(data: bytes, ranges: np.ndarray) -> bytes:
    """``data`` without the bytes of the ranges, which are in order and apart."""
    at, parts = 0, []
    for start, end in ranges.tolist():
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


def digests(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is kept."""

    def finish(data: bytes, ranges: np.ndarray) -> tuple:
        kept = without(data, ranges)
        return len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()

    return _cut(docs, removed_ranges(docs, text, length), ["doc_id"], text, finish,
                "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_texts(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings cut from their text; all rows and other columns stay."""

    def finish(data: bytes, ranges: np.ndarray) -> tuple:
        return (without(data, ranges).decode("utf-8", "ignore"),)

    docs, back = apart(docs, "doc_id", text)
    keep = [c for c in docs.columns if c != text]
    cut = _cut(docs, removed_ranges(docs, text, length), keep, text, finish, "__cut string")
    return back(cut.withColumnRenamed("__cut", text))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses and keeps."""
    return digests(table(spark, sf_dir, "documents"))
