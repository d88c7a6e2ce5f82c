"""Jaccard join of documents on word shingles by chosen paths.

A document is the set of hashes of its five-word shingles (with fewer words: of all its words).
Equal sets are one text, told by a 128-bit fingerprint. In each run a text chooses the shingles whose hash under
the run and node is below FAN / size, about FAN of them, and joins the node of each; similar
texts tend to choose the same ones. Nodes with more than SMALL texts are split again by shingles chosen
anew, unless their texts are alike already (agreement of minwise sketches), until MAX_DEPTH.
Leaves are compared by brute force, in cells of at most CELL_TEXTS texts or CELL_TOKENS shingles
a side, so that a huge group of near copies spreads over many tasks. The alike nodes of a group are merged to one leaf, leaves with
the same members are compared once, and a pair is counted only in the first of its common leaves.
Before shingles are sent, a leaf of up to SMALL texts is narrowed to the texts that may link in it: as many bits as two parity
bitmaps differ in, so many shingles at least are in one set only, so a pair with too many is no link. No link is lost by that.
The number of runs follows from the target recall at the threshold and FAN.

Only counts and, per cell, a spanning forest of its links leave a task, never all pairs. Classes
are the connected components, found by exchanging smallest labels.

Edge cases: null and blank texts have no shingles, link to nothing and are classes of their own;
null ids take part, and a class's id is its smallest id that is not null; repeated rows are
copies; ties in ids do not matter, since texts are told by their content. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.texts import Chunk, Rolling, apart, chunks, grams, mixed, released, small_batches, table, words
from llm.written import written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
FAN = 2.2
SMALL = 1024
MAX_DEPTH = 6
TIGHT = 0.65
SKETCH = 8
TOLD_BITS = 4
CELL_TEXTS = 1024
CELL_TOKENS = 400_000
MAP_BITS = 24
LEAST_BITS = 64
MOST_BITS = 1 << 14
TASK_ROWS = 20_000
LEAST_TASKS = 24
_SECOND_HASH = np.uint64(0x5851F42D4C957F2D)
_SKETCH_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1) for i in range(SKETCH)]


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = MAX_DEPTH) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall``, when nodes have to be split
    to ``depth``: the shared choices of the pair at each level are about Poisson. They are fewest if one text's set holds the
    other's: a shared shingle has to be below the larger set's limit."""
    shared = FAN * threshold
    missed = 0.0
    for _ in range(depth):
        missed = math.exp(-shared * (1 - missed))
    return math.ceil(math.log(1 - recall) / math.log(missed))


def shingle_sets(chunk: Chunk, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of the chunk."""
    starts, ends, docs = words(chunk)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * chunk.size
    rolling = Rolling(chunk.data)
    hashes = rolling.spans(starts, ends)
    found, at = grams(hashes, docs, k)
    size = np.bincount(docs, minlength=chunk.size)
    first = np.concatenate([[0], np.cumsum(size)])
    bounds = np.searchsorted(docs[at], np.arange(chunk.size + 1))
    for i in np.flatnonzero(np.diff(bounds) > 1):
        found[bounds[i]:bounds[i + 1]].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[bounds[:-1][bounds[:-1] < len(found)]] = True
    found, bounds = found[new], np.concatenate([[0], np.cumsum(new)])[bounds]
    out = []
    for i in range(chunk.size):
        if 0 < size[i] < k:
            short = np.zeros(1, np.uint64)
            for h in hashes[first[i]:first[i + 1]]:
                short = mixed(short * np.uint64(31) + h)
            out.append(short)
        else:
            out.append(found[bounds[i]:bounds[i + 1]])
    return out


def fingerprint(shingles: np.ndarray) -> bytes:
    a = mixed(shingles).sum(dtype=np.uint64)
    b = mixed(shingles ^ _SECOND_HASH).sum(dtype=np.uint64)
    return np.array([a, b + np.uint64(len(shingles))], np.uint64).tobytes()


def chosen(shingles: np.ndarray, node: np.uint64, fan: float = FAN) -> np.ndarray:
    """The child nodes that a set joins below ``node``."""
    values = mixed(shingles ^ mixed(np.array([node], np.uint64)))
    limit = np.uint64(min(fan / len(shingles), 1.0) * (2.0 ** 64 - 2048))
    return mixed(values[values <= limit] + np.uint64(1))


def sketch(shingles: np.ndarray) -> np.ndarray:
    return np.array([mixed(shingles ^ seed).min() & np.uint64(0xFFFF) for seed in _SKETCH_SEEDS], np.int64)


def _map_bits(size: int) -> int:
    return min(max(1 << (size - 1).bit_length(), LEAST_BITS), MOST_BITS)


def parities(shingles: np.ndarray) -> bytes:
    """A bitmap of some 1 to 2 bits a shingle, each bit the parity of the shingles that fall on it."""
    n_bits = _map_bits(len(shingles))
    odd = np.bincount((shingles & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def possible(sizes: np.ndarray, bitmaps: list[bytes], threshold: float) -> np.ndarray:
    """For sets of ascending size, a label each: sets that can be linked, be it over others, share one."""
    apart_share = (1 - threshold) / (1 + threshold)
    upto = np.searchsorted(sizes, sizes / threshold + 1e-6, "right")
    labels = np.arange(len(sizes))
    lengths = np.array([len(b) for b in bitmaps])
    pairs = []
    for width in np.unique(lengths):
        first, end = np.searchsorted(lengths, [width, width + 1])
        folded = np.zeros((int(upto[end - 1]) - first, width // 8), np.uint64)
        for i in range(len(folded)):  # wider bitmaps are folded: the parity of a union of bits is their parities' xor
            folded[i] = np.bitwise_xor.reduce(np.frombuffer(bitmaps[first + i], np.uint64).reshape(-1, width // 8), 0)
        for i in range(first, end):
            others = slice(i + 1, int(upto[i]))
            differ = np.bitwise_count(folded[i + 1 - first:others.stop - first] ^ folded[i - first]).sum(1, dtype=np.int64)
            for j in np.flatnonzero(differ <= apart_share * (sizes[i] + sizes[others]) + 1e-6) + i + 1:
                pairs.append((i, int(j)))
    return _least_labels(labels, np.array(pairs, np.int64).reshape(-1, 2))


def _least_labels(labels: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The smallest label that each place reaches over the pairs."""
    while len(pairs):
        ends = np.minimum(labels[pairs[:, 0]], labels[pairs[:, 1]])
        new = labels.copy()
        np.minimum.at(new, pairs[:, 0], ends)
        np.minimum.at(new, pairs[:, 1], ends)
        new = new[new]
        if (new == labels).all():
            break
        labels = new
    return labels


def packed(shingles: np.ndarray) -> bytes:
    """The low 48 bits of each hash, which tell the shingles of a cell or a split apart as well as 64."""
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(held: bytes) -> np.ndarray:
    out = np.zeros((len(held) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(held, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _lists(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int64), kind))


def _descriptions(sets: list[np.ndarray], roots: list[np.uint64]) -> tuple[list, list, list, list, list]:
    """For each set :func:`fingerprint`, size, :func:`chosen` nodes below all roots, :func:`sketch` and :func:`parities`. The sets of
    a chunk are hashed as one array: a call for each set and hash would cost several times the hashing."""
    sizes = np.array([len(s) for s in sets], np.int64)
    none = np.zeros(0, np.int64)
    ids, nodes, sketches, bits = [None] * len(sets), [none] * len(sets), [none] * len(sets), [None] * len(sets)
    some = np.flatnonzero(sizes)
    if not len(some):
        return ids, sizes.tolist(), nodes, sketches, bits
    flat, n = np.concatenate([sets[i] for i in some]), sizes[some]
    starts = np.cumsum(n) - n
    limits = np.repeat((np.minimum(FAN / n, 1.0) * (2.0 ** 64 - 2048)).astype(np.uint64), n)
    owners = np.repeat(np.arange(len(n)), n)
    picked, owned = [], []
    for root in roots:
        values = mixed(flat ^ mixed(np.array([root], np.uint64)))
        at = np.flatnonzero(values <= limits)
        picked.append(values[at])
        owned.append(owners[at])
    children, owned = mixed(np.concatenate(picked) + np.uint64(1)).view(np.int64), np.concatenate(owned)
    order = np.argsort(owned, kind="stable")
    children, ends = children[order], np.cumsum(np.bincount(owned, minlength=len(n)))
    told = np.stack([np.add.reduceat(mixed(flat), starts),
                     np.add.reduceat(mixed(flat ^ _SECOND_HASH), starts) + n.astype(np.uint64)], 1)
    least = np.stack([np.minimum.reduceat(mixed(flat ^ seed), starts) & np.uint64(0xFFFF) for seed in _SKETCH_SEEDS], 1).astype(np.int64)
    n_bits = np.array([_map_bits(int(k)) for k in n], np.int64)
    upto = np.cumsum(n_bits)
    place = (flat & np.repeat((n_bits - 1).astype(np.uint64), n)).astype(np.int64) + np.repeat(upto - n_bits, n)
    odd = np.packbits((np.bincount(place, minlength=int(upto[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    for k, i in enumerate(some):
        ids[i] = told[k].tobytes()
        nodes[i] = children[ends[k - 1] if k else 0:ends[k]]
        sketches[i] = least[k]
        bits[i] = odd[(upto[k] - n_bits[k]) // 8:upto[k] // 8]
    return ids, sizes.tolist(), nodes, sketches, bits


def described(docs: DataFrame, text: str, turns: int) -> DataFrame:
    """(doc_id, key, text_id, size, nodes, sketch, bits) of each document; text_id is null without words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = [np.uint64(i + 1) for i in range(turns)]
        for batch in batches:
            found = [_descriptions(shingle_sets(chunk), roots) for chunk in chunks(batch.column(2))]
            ids, sizes, nodes, sketches, bits = (list(chain.from_iterable(f[i] for f in found)) for i in range(5))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()),
                 _lists(nodes), _lists(sketches, pa.int32()), pa.array(bits, pa.binary())],
                ["doc_id", "key", "text_id", "size", "nodes", "sketch", "bits"])

    rows = docs.select("doc_id", document_key(text).alias("key"), F.col(text).cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"doc_id {kind}, key long, text_id binary, size int, nodes array<long>, sketch array<int>,"
                                         " bits binary")


def document_key(text: str = "text") -> Column:
    return F.xxhash64("doc_id", F.col(text).cast("string"))


def _bitmap(keys: DataFrame) -> np.ndarray:
    """2**MAP_BITS bits of a hash of ``key``, put together in Spark."""
    bit = F.shiftrightunsigned("key", 64 - MAP_BITS)
    rows = keys.select(F.shiftrightunsigned(bit, 5).alias("place"),
                       F.expr(f"shiftleft(1, cast(shiftrightunsigned(key, {64 - MAP_BITS}) & 31 as int))").alias("bit")
                       ).groupBy("place").agg(F.bit_or("bit").alias("bits")).coalesce(LEAST_TASKS).toPandas()
    out = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    out[rows["place"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int32).view(np.uint32)
    return out


def _sets_of(docs: DataFrame, keys: DataFrame, text: str) -> DataFrame:
    """(key, shingles) of the documents whose key may be among ``keys`` (a bitmap lets few others through)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(_bitmap(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            bit = key.view(np.uint64) >> np.uint64(64 - MAP_BITS)
            use = (shared.value[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
            batch = batch.filter(pa.array(use))
            at = 0
            for chunk in chunks(batch.column(1)):
                sets = [packed(s) for s in shingle_sets(chunk)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, chunk.size), pa.array(sets, pa.binary())], ["key", "shingles"])
                at += chunk.size

    rows = docs.select(document_key(text).alias("key"), F.col(text).cast("string"))
    return rows.mapInArrow(released(run), "key long, shingles binary").join(keys.select("key"), "key", "left_semi"
                                                                  ).dropDuplicates(["key"])


def _few(df: DataFrame, rows: float) -> DataFrame:
    """``df``, which has about so many short rows, in no more tasks than they need: deep levels and links are few, and a task
    and file for each shuffle partition would cost more than their rows."""
    return df.coalesce(max(LEAST_TASKS, math.ceil(rows / TASK_ROWS)))


def _counted(rows: DataFrame) -> DataFrame:
    """Per node: texts, shingles, and a fingerprint of its members."""
    return rows.groupBy("node").agg(
        F.count("*").alias("n"), F.sum("size").alias("tokens"), F.bit_xor(F.xxhash64("key")).alias("members")).where("n > 1")


def _alike(rows: DataFrame) -> DataFrame:
    """(node, group) of nodes whose texts, two by two, agree in their sketches by TIGHT or more on average; the group is the
    anchor's, the member of least hash. Nodes that a group of near copies shares have few anchors among them. Of a bit that is
    set in a share p of the texts, (2p - 1)**2 is on average the chance that two texts have the same value."""
    bits = [F.avg(F.shiftright(F.col("sketch")[i], b).bitwiseAND(1)) for i in range(SKETCH) for b in range(TOLD_BITS)]
    shares = rows.groupBy("node").agg(F.min(F.xxhash64("key")).alias("group"), F.array(*bits).alias("shares"))
    agreed = F.aggregate("shares", F.lit(0.0), lambda total, p: total + (2 * p - 1) * (2 * p - 1)) / len(bits)
    return shares.where(agreed >= TIGHT).select("node", "group")


def _once(met: DataFrame) -> DataFrame:
    """The leaves without those that have the same members as another."""
    first = met.groupBy("n", "members").agg(F.min("node").alias("node")).select("node")
    return met.join(first, "node", "left_semi").select("node", "key", "n", "tokens")


def _once_few(met: DataFrame) -> DataFrame:
    """:func:`_once` of leaves of at most SMALL texts; a text has few leaves, so that a window holds few rows."""
    least = F.min("node").over(Window.partitionBy("n", "members"))
    return met.withColumn("least", least).where("node = least").select("node", "key", "n", "tokens")


def narrowed(met: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The leaves of at most SMALL texts cut into groups of texts that may link, and without those that can link to none: two texts
    that may link stay together wherever they meet. Larger leaves stay as they are."""
    large = met.where(F.col("n") > SMALL)
    rows = met.where(F.col("n") <= SMALL).select("node", "key").join(texts.select("key", "size", "bits"), "key")
    rows = rows.select("node", "size", "key", "bits")
    rows = rows.repartition("node").sortWithinPartitions("node", "size", "key")

    def close(node: int, sizes: list, keys: list, bitmaps: list) -> list[tuple]:
        size, key = np.array(sizes, np.int64), np.array(keys, np.int64)
        labels, out = possible(size, bitmaps, threshold), []
        for label in np.flatnonzero(np.bincount(labels) > 1):
            own = np.flatnonzero(labels == label)
            told = mixed(key[own].view(np.uint64))
            name = mixed(np.array([node], np.int64).view(np.uint64) + told[:1]).view(np.int64)[0]
            members = np.bitwise_xor.reduce(told).view(np.int64)
            out += [(name, k, len(own), size[own].sum(), members) for k in key[own]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sizes, keys, bitmaps = None, [], [], []
        for batch in batches:
            out = []
            for at, size, key, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != node:
                    if len(keys) > 1:
                        out += close(node, sizes, keys, bitmaps)
                    node, sizes, keys, bitmaps = at, [], [], []
                sizes.append(size)
                keys.append(key)
                bitmaps.append(bits)
            yield rows_of(out)
        if len(keys) > 1:
            yield rows_of(close(node, sizes, keys, bitmaps))

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array([f[i] for f in found], np.int64)) for i in range(5)],
                                          ["node", "key", "n", "tokens", "members"])

    small_batches(met.sparkSession)
    few = rows.mapInArrow(released(run), "node long, key long, n long, tokens long, members long")
    return _once_few(few).unionByName(large)


def leaves(docs: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """(node, key, n, tokens): the leaves that texts meet in, the texts told by their key. Of leaves with the same members there is
    one, and the alike nodes of one group are one leaf of all their texts, so a text is in it once however many nodes the group shares."""
    rows = texts.select("key", "size", F.explode("nodes").alias("node"))
    ended: DataFrame | None = None
    wide: DataFrame | None = None
    grouped: DataFrame | None = None
    again = math.inf
    for depth in range(MAX_DEPTH):
        counted = _counted(rows)
        counted = written(counted if math.isinf(again) else _few(counted, again * FAN), "nodes")
        large = counted.where(F.col("n") > SMALL).select("node")
        shared, again = counted.agg(F.coalesce(F.sum("n"), F.lit(0)),
                                    F.coalesce(F.sum(F.when(F.col("n") > SMALL, F.col("n"))), F.lit(0))).first()
        last = depth + 1 == MAX_DEPTH or not again
        if not last:
            sketches = rows.join(large, "node", "left_semi").join(texts.select("key", "sketch"), "key")
            counted = counted.join(written(_few(_alike(sketches), again), "alike"), "node", "left")
        met = written(_few(rows.join(counted, "node"), shared), "met")
        small = met.where(F.col("n") <= SMALL).select("node", "key", "n", "tokens", "members")
        ended = small if ended is None else ended.unionByName(small)
        if last:
            wide = met.where(F.col("n") > SMALL).select("node", "key", "n", "tokens", "members")
            break
        same = met.where((F.col("n") > SMALL) & F.col("group").isNotNull()).select(F.col("group").alias("node"), "key", "size")
        grouped = same if grouped is None else grouped.unionByName(same)
        more = met.where((F.col("n") > SMALL) & F.col("group").isNull())
        more = written(_few(more.groupBy("key").agg(F.collect_list("node").alias("parents")), again), "more")
        if more.isEmpty():
            break
        rows = written(_few(_split(docs, more, text), again * FAN), "split")
    if grouped is not None:
        once = written(grouped.distinct(), "grouped")
        merged = once.join(_counted(once), "node").select("node", "key", "n", "tokens", "members")
        wide = merged if wide is None else wide.unionByName(merged)
    ended = _once_few(ended)
    return written(ended if wide is None else ended.unionByName(_once(wide)), "leaves")


def _split(docs: DataFrame, more: DataFrame, text: str) -> DataFrame:
    """The children of the large nodes: one row per text and child."""
    joined = _sets_of(docs, more, text).join(more, "key").select("key", "parents", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = [], []
            for parents, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = unpacked(held)
                sizes.append(len(s))
                out.append(np.concatenate([chosen(s, np.uint64(p & (1 << 64) - 1)) for p in parents]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), _lists(out)], ["key", "size", "nodes"])

    return joined.mapInArrow(released(run), "key long, size int, nodes array<long>").select("key", "size", F.explode("nodes").alias("node"))


def _meet(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets of whole numbers."""
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in [*a, *b]])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
    number = np.cumsum(first) - 1
    times = np.bincount(number) if len(flat) else np.zeros(0, int)
    use = times[number] > 1
    number, owner = number[use], owner[use]
    names = np.cumsum(times > 1) - 1
    number = names[number]
    total = int(names[-1]) + 1 if len(names) else 0
    out = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, total, 2048):
        lo, hi = np.searchsorted(number, [start, start + 2048])
        grid = np.zeros((len(a) + len(b), 2048), np.float32)
        grid[owner[lo:hi], number[lo:hi] - start] = 1
        out += grid[:len(a)] @ grid[len(a):].T
    return out


def compare(node: int, left: list[tuple], right: list[tuple], same: bool, threshold: float
            ) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Counts of links of the texts on both sides (documents, texts) and a spanning forest of the links. A side
    is a list of (shingles, weight, leaves); pairs that also meet in an earlier leaf are not counted."""
    a, b = [x[0] for x in left], [x[0] for x in right]
    common = _meet(a, b)
    size_a, size_b = np.array([len(s) for s in a])[:, None], np.array([len(s) for s in b])[None, :]
    linked = common.astype(np.float64) >= threshold * (size_a + size_b - common) - 1e-9
    if same:
        np.fill_diagonal(linked, False)
    links = np.argwhere(linked)
    earlier = _meet([x[2][x[2] < node] for x in left], [x[2][x[2] < node] for x in right])
    counted = linked & (earlier == 0)
    weight_a, weight_b = (np.array([x[1] for x in side], np.int64) for side in (left, right))
    n = len(left)
    documents, texts = np.zeros(n + (0 if same else len(right)), np.int64), np.zeros(n + (0 if same else len(right)), np.int64)
    documents[:n] += counted @ weight_b
    texts[:n] += counted.sum(1)
    if not same:
        documents[n:] += counted.T @ weight_a
        texts[n:] += counted.sum(0)
    labels = _least_labels(np.arange(len(documents)), links + np.array([0, 0 if same else n]))
    return documents, texts, [(i, int(t)) for i, t in enumerate(labels) if t != i]


def links(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL
          ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with text_id, counts of links per text_id, forest of links between text_ids)."""
    rows = written(described(docs, text, runs_needed(threshold, recall)), "described")
    texts = written(rows.where("text_id is not null").groupBy("text_id").agg(
        F.min("key").alias("key"), F.count("*").alias("weight"), F.first("size").alias("size"),
        F.first("nodes").alias("nodes"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits")), "texts")
    met = written(narrowed(leaves(docs, texts, text), texts, threshold), "met")
    lists = met.groupBy("key").agg(F.collect_list("node").alias("leaves")).join(texts.select("text_id", "key", "weight"), "key")
    parts = F.greatest(F.ceil(F.col("n") / CELL_TEXTS), F.ceil(F.col("tokens") / CELL_TOKENS)).cast("int")
    dealt = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    cells = dealt.select("node", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select("node", "key", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    members = written(lists, "members")
    sets = _sets_of(docs, members, text).join(members, "key")
    ready = cells.join(sets, "key").select("node", "low", "high", "part", "text_id", "weight", "leaves", "shingles")
    ready = ready.repartition("node", "low", "high").sortWithinPartitions("node", "low", "high", "text_id")

    def close(cell: tuple | None, held: list[tuple]) -> pa.RecordBatch:
        node, low, high = cell
        left = [h for h in held if h[0] == low]
        right = left if low == high else [h for h in held if h[0] == high]
        docs_n, texts_n, forest = compare(node, [h[2:] for h in left], [h[2:] for h in right], low == high, threshold)
        ids = [h[1] for h in (left if low == high else left + right)]
        to = list(ids)
        for i, j in forest:
            to[i] = ids[j]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.binary()), pa.array(docs_n), pa.array(texts_n), pa.array(to, pa.binary())],
            ["text_id", "documents", "texts", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for node, low, high, part, text_id, weight, nodes, shingles in zip(*columns, strict=True):
                if cell != (node, low, high):
                    if len(held) > 1:
                        yield close(cell, held)
                    cell, held = (node, low, high), []
                held.append((part, text_id, unpacked(shingles), weight, np.array(nodes, np.int64)))
        if len(held) > 1:
            yield close(cell, held)

    small_batches(docs.sparkSession, 500)
    found = written(ready.mapInArrow(released(run), "text_id binary, documents long, texts long, other binary"), "compared")
    counts = found.groupBy("text_id").agg(F.sum("documents").alias("documents"), F.sum("texts").alias("texts"))
    forest = found.where("text_id <> other").select("text_id", "other").distinct()
    return rows.join(texts.select("text_id", "weight"), "text_id", "left"), counts, forest


def components(edges: DataFrame) -> DataFrame:
    """(text_id, label): the smallest id of each connected component with links. Each turn hooks labels to
    smaller ones across the links and then shortens the way to them."""
    both = written(edges.unionByName(edges.select(F.col("other").alias("text_id"), F.col("text_id").alias("other"))).distinct(), "edges")
    ends = both.count()
    labels = written(_few(both.groupBy("text_id").agg(F.least(F.min("other"), F.first("text_id")).alias("label")), ends), "labels")
    while True:
        near = both.join(labels.select(F.col("text_id").alias("other"), "label"), "other").groupBy("text_id").agg(
            F.min("label").alias("near"))
        hooked = labels.join(near, "text_id").select("text_id", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("text_id").alias("to"), F.col("label").alias("jump"))
        new = written(_few(hooked.join(jump, "to", "left").select(
            "text_id", F.col("label").alias("old"), F.least("to", F.coalesce("jump", "to")).alias("label")), ends), "labels")
        if not new.where("old <> label").limit(1).count():
            return new.select("text_id", "label")
        labels = new.select("text_id", "label")


def classes(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, key, group, class_id, n_links, n_texts) of every document: its class (null without words) and
    the class's smallest id, and how many other documents (copies included) and other texts link to it."""
    rows, counts, forest = links(docs, text, threshold, recall)
    labelled = rows.join(counts, "text_id", "left").join(components(forest), "text_id", "left")
    group = F.coalesce("label", "text_id")
    least = labelled.where("text_id is not null").groupBy(group.alias("group")).agg(F.min("doc_id").alias("class_id"))
    some = labelled.where("text_id is not null").withColumn("group", group).join(least, "group").select(
        "doc_id", "key", "group", "class_id",
        (F.coalesce("documents", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"))
    none = rows.where("text_id is null").select(
        "doc_id", "key", F.lit(None).cast("binary").alias("group"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(0).cast("long").alias("n_texts"))
    return some.unionByName(none)


def one_each(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class: the one of smallest id, of copies of that id the first by a hash; columns as they
    were. Documents without words stay, each being its own class."""
    docs, back = apart(docs, "doc_id", text)
    found = written(classes(docs, text, threshold), "classes")
    grouped = found.where("n_links > 0")
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "key")
    first = grouped.groupBy("group").agg(F.min(order)["key"].alias("first"))
    gone = grouped.join(first, "group").where("key <> first").select(F.col("key").alias("__key")).distinct()
    kept = docs.withColumn("__key", document_key(text)).join(gone, "__key", "left_anti")
    again = grouped.groupBy("key").count().where("count > 1").select(F.col("key").alias("__key"))  # equal in id and text
    if again.limit(1).count():
        kept = kept.join(again, "__key", "left_anti").unionByName(
            kept.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return back(kept)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return classes(table(spark, sf_dir, "documents")).drop("key", "group")
