"""Joins that keep the meaning of a key's missing value and survive hot keys.

Plain joins leave the strategy to Spark: it broadcasts a side only when its measured size
is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, and the
adaptive planner splits a skewed partition of the left side. Where a group can be large on
both sides, or a side arrives already grouped on the key (the adaptive planner cannot split
that), ``spread_join`` looks for hot keys first and salts them itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.session import write_once

Keys = Sequence[str | tuple[str, str]]

# A key is hot on a side when it holds this many rows and this share of the side, or when left times right rows
# of it exceed PAIRS_PER_TASK. Fewer than 1 / HOT_SHARE keys of a side can hold the share, which bounds the broadcast
# table of hot keys; each is cut into pieces of about ROWS_PER_SPLIT rows and PAIRS_PER_TASK pairs.
HOT_ROWS = 2_000_000
HOT_SHARE = 1e-5
ROWS_PER_SPLIT = 1_000_000
PAIRS_PER_TASK = 10_000_000_000
# Shorter sides are joined as they are.
MIN_ROWS = 1_000_000
# Entries of the heavy-hitter summary: a key with HOT_SHARE of the rows is always among them.
TRACKED = 600_000
# NOT IN: up to so many keys make a Bloom filter of so many bits each.
BLOOM_KEYS = 20_000_000
BLOOM_BITS = 16
_BLOCK = 32_768


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _pairs(on: Keys) -> list[tuple[str, str]]:
    return [(k, k) if isinstance(k, str) else k for k in on]


def _renames(right: DataFrame, keys: set[str], take, prefix: str | None) -> dict[str, str]:
    if take is None:
        take = right.columns if prefix else [c for c in right.columns if c not in keys]
    names = dict(take) if isinstance(take, Mapping) else {c: c for c in take}
    return {c: f"{prefix}{n}" for c, n in names.items()} if prefix else names


def _prepare(left, right, on, take, prefix):
    """Right side cut to its keys (under temporary names) and its renamed columns."""
    pairs = _pairs(on)
    names = _renames(right, {r for _, r in pairs}, take, prefix)
    clash = set(left.columns) & set(names.values())
    if clash:
        raise ValueError(f"columns on both sides, rename or prefix them: {sorted(clash)}")
    keys = [f"_key{i}" for i in range(len(pairs))]
    cut = right.select(
        *[_c(r).alias(k) for (_, r), k in zip(pairs, keys, strict=True)],
        *[_c(c).alias(n) for c, n in names.items()],
    )
    return pairs, keys, cut, list(names.values())


def _equal(a: Column, b: Column, null_safe: bool) -> Column:
    return a.eqNullSafe(b) if null_safe else a == b


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def join(left: DataFrame, right: DataFrame, on: Keys, how: str = "left", *, take=None,
         prefix: str | None = None, null_safe: bool = False) -> DataFrame:
    """Equi-join that adds chosen right columns to the left rows.

    ``on`` holds names, or (left, right) pairs; ``take`` a list of right columns or a
    mapping to new names (default: all but the keys); ``prefix`` is put before each of them
    and, without ``take``, keeps the keys too. ``null_safe`` lets missing match missing.
    Every matching right row gives a row, as in the joins it stands for.
    """
    pairs, keys, cut, names = _prepare(left, right, on, take, prefix)
    condition = _all(_equal(_c(l), _c(k), null_safe)
                     for (l, _), k in zip(pairs, keys, strict=True))
    return left.join(cut, condition, how).select(*map(_c, [*left.columns, *names]))


@dataclass
class _Side:
    """One side's keys, for counting."""

    rows: DataFrame
    columns: list[str]

    def keys(self, names: list[str], types: dict[str, T.DataType] | None = None) -> DataFrame:
        return self.rows.select(*[_c(c).cast(types[n]).alias(n) if types else _c(c).alias(n)
                                  for c, n in zip(self.columns, names, strict=True)])


def _heavy(sides: list[_Side], least: list[int], names: list[str], types: dict[str, T.DataType], tracked: int) -> DataFrame:
    """Hashes of the keys that may hold ``least`` rows of a side: one pass over both, by a mergeable summary of fixed size."""
    hashed = [side.keys(names, types).select(F.xxhash64(*names).alias("_hash"), F.lit(i).alias("_side"))
              for i, side in enumerate(sides)]
    both = reduce(lambda a, b: a.unionByName(b), hashed)
    summaries = both.agg(*[F.expr(f"approx_top_k(_hash, {max(tracked // 6, 1)}, {tracked}) FILTER (WHERE _side = {i})").alias(f"_top{i}")
                           for i in range(len(sides))])
    found = F.flatten(F.array(*[
        F.transform(F.filter(f"_top{i}", _at_least(limit)), lambda entry: entry["item"]) for i, limit in enumerate(least)]))
    return summaries.select(F.explode(F.array_distinct(found)).alias("_hash"))


def _at_least(limit: int) -> Callable[[Column], Column]:
    return lambda entry: entry["count"] >= limit


def _hot_table(left: _Side, right: _Side | None, names: list[str], hot_rows: int, hot_share: float,
               rows_per_split: int, pairs_per_task: int) -> DataFrame | None:
    """Hot keys of either side with the pieces per side, written; none if no key is hot.

    Counting the rows of a scan reads file footers only. One pass over the key columns finds the heavy hitters of both sides; only
    these are then counted exactly. A key without a counted right side has one row there.
    """
    sides = [left] if right is None else [left, right]
    totals = [side.rows.count() for side in sides]
    if max(totals) < min(hot_rows, MIN_ROWS):
        return None
    types = {f.name: f.dataType for f in reduce(lambda a, b: a.union(b), [side.keys(names) for side in sides]).schema.fields}
    # Left times right reaches the limit only if one of them reaches its root.
    root = min(hot_rows, math.isqrt(pairs_per_task) if right is not None else hot_rows)
    least = [max(root, math.ceil(total * hot_share)) for total in totals]
    tracked = min(TRACKED, max(1_000, math.ceil(6 / hot_share)))
    heavy = write_once(_heavy(sides, least, names, types, tracked), "heavy-keys")
    if heavy.isEmpty():
        return None
    counted = []
    for i, side in enumerate(sides):
        # Bounded broadcast: at most 1 / hot_share hashes a side.
        held = side.keys(names, types).withColumn("_hash", F.xxhash64(*names)).join(F.broadcast(heavy), "_hash", "left_semi")
        counted.append(held.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).select(
            *names, F.when(F.lit(i == 0), F.col("_n")).alias("_l"), F.when(F.lit(i == 1), F.col("_n")).alias("_r")))
    exact = reduce(lambda a, b: a.unionByName(b), counted).groupBy(*names).agg(
        F.coalesce(F.max("_l"), F.lit(0)).alias("_l"), F.coalesce(F.max("_r"), F.lit(0 if right else 1)).alias("_r"))

    def alone(n: str, total: int) -> Column:
        hot = F.col(n) >= max(hot_rows, math.ceil(total * hot_share))
        return F.when(hot, F.ceil(F.col(n) / rows_per_split)).otherwise(1).cast("bigint")

    split = exact.withColumns({"_ls": alone("_l", totals[0]), "_rs": alone("_r", totals[-1]) if right else F.lit(1).cast("bigint")})
    # Pieces still missing for the limit on pairs come from the side with the longer pieces.
    pairs = F.col("_l").cast("double") * F.col("_r") / (F.col("_ls") * F.col("_rs"))
    more = F.ceil(pairs / pairs_per_task).cast("bigint")
    longer = F.col("_l") / F.col("_ls") >= F.col("_r") / F.col("_rs")
    hot = split.select(
        *names,
        F.when((more > 1) & longer, F.least("_l", F.col("_ls") * more)).otherwise(F.col("_ls")).cast("int").alias("_left_splits"),
        F.when((more > 1) & ~longer, F.least("_r", F.col("_rs") * more)).otherwise(F.col("_rs")).cast("int").alias("_right_splits"),
    ).where((F.col("_left_splits") > 1) | (F.col("_right_splits") > 1))
    hot = write_once(hot, "hot-keys")
    return None if hot.isEmpty() else hot


def hot_keys(left: DataFrame, right: DataFrame, key: str, *, hot_rows: int = HOT_ROWS, hot_share: float = HOT_SHARE,
             rows_per_split: int = ROWS_PER_SPLIT, pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame | None:
    """Values (``_key``) of a shared key that ``spread_join`` would spread, or none; at most 2 / ``hot_share``."""
    sides = [_Side(df.dropna(subset=[key]), [key]) for df in (left, right)]
    hot = _hot_table(*sides, ["_key"], hot_rows, hot_share, rows_per_split, pairs_per_task)
    return None if hot is None else hot.select("_key")


def spread_join(left: DataFrame, right: DataFrame, on: Keys, how: str = "left", *, take=None,
                prefix: str | None = None, null_safe: bool = False, right_unique: bool = False,
                count_on: DataFrame | None = None, hot_rows: int = HOT_ROWS,
                hot_share: float = HOT_SHARE, rows_per_split: int = ROWS_PER_SPLIT,
                pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """:func:`join` that looks for hot keys first and spreads their rows, exactly.

    Without hot keys this is the plain join. Otherwise a row of a key that is hot on the left
    gets one of the key's salts and the right rows of that key are repeated for each salt; a
    key hot on the right is treated the other way round, and a key hot on both sides gets a
    grid. Rows whose key is missing can match nothing (unless ``null_safe``), so they are
    spread too instead of meeting in one task. ``right_unique`` says that the right side has
    one row per key, which saves counting it and allows ``how="left_anti"``. ``count_on`` is
    a table with the left keys that is cheaper to read than the left side itself, say the
    scan it was made from; it only steers what is salted, never the result.
    """
    if how not in ("left", "inner") and not (how == "left_anti" and right_unique):
        raise ValueError(f"spread_join cannot do {how!r} here")
    pairs, keys, cut, names = _prepare(left, right, on, take, prefix)
    left_keys = [l for l, _ in pairs]
    if not null_safe:
        cut = cut.dropna(subset=keys)
    hot_keys = [f"_hot{k}" for k in keys]
    hot = _hot_table(_Side(left if count_on is None else count_on, left_keys), None if right_unique else _Side(cut, keys),
                     hot_keys, hot_rows, hot_share, rows_per_split, pairs_per_task)
    match = _all(_equal(_c(l), _c(k), null_safe) for l, k in zip(left_keys, keys, strict=True))
    if hot is None:
        joined = left.join(cut, match, how)
        return joined.select(*map(_c, [*left.columns, *([] if how == "left_anti" else names)]))

    def mark(df: DataFrame, columns: list[str]) -> DataFrame:
        # Bounded broadcast: at most 2 / hot_share keys.
        found = df.join(
            F.broadcast(hot),
            _all(_equal(_c(c), _c(h), null_safe) for c, h in zip(columns, hot_keys, strict=True)),
            "left",
        )
        return found.select(
            *map(_c, df.columns),
            F.coalesce("_left_splits", F.lit(1)).alias("_left_splits"),
            F.coalesce("_right_splits", F.lit(1)).alias("_right_splits"),
        )

    def own_salt(df: DataFrame, splits: Column, name: str, lone: Column | None) -> DataFrame:
        # The hot rows are written once with a number: copies of a row get numbers of their
        # own, and a task that runs again finds the same ones.
        hot_rows_ = write_once(df.filter(splits > 1).withColumn(
            "_turn", F.xxhash64(F.monotonically_increasing_id())), "hot-rows")
        dealt = hot_rows_.withColumn(name, F.pmod("_turn", splits).cast("int")).drop("_turn")
        cold = df.filter(splits <= 1)
        salt = F.lit(0)
        if lone is not None:
            tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            row = F.xxhash64(*map(_c, df.columns), F.spark_partition_id())
            salt = F.when(lone, F.pmod(row, F.lit(tasks)).cast("int")).otherwise(salt)
        return cold.withColumn(name, salt).unionByName(dealt)

    def every_salt(splits: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), splits - 1))

    left_splits, right_splits = F.col("_left_splits"), F.col("_right_splits")
    lone = None
    if not null_safe and how != "inner":
        lone = reduce(lambda a, b: a | b, [_c(c).isNull() for c in left_keys])
    salted_left = own_salt(mark(left, left_keys), left_splits, "_left_salt", lone).withColumn(
        "_right_salt", every_salt(right_splits))
    salted_right = own_salt(mark(cut, keys), right_splits, "_salt_r", None).withColumn(
        "_salt_l", every_salt(left_splits)).drop("_left_splits", "_right_splits")
    salted_right = salted_right.withColumn("_matched", F.lit(True))
    salts = (F.col("_left_salt") == F.col("_salt_l")) & (F.col("_right_salt") == F.col("_salt_r"))
    joined = salted_left.join(salted_right, match & salts, how)
    if how == "left_anti":
        return joined.select(*map(_c, left.columns))
    if how == "left":
        # A repeated left row whose salt has no right rows is not an unmatched row: a key
        # that is hot on the right has its matches under the other salts.
        joined = joined.filter(F.col("_matched").isNotNull() | (right_splits == 1))
    return joined.select(*map(_c, [*left.columns, *names]))


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None
           ) -> DataFrame:
    """``left_key NOT IN (SELECT right_key ...)`` without Spark's forced broadcast.

    A missing key on the right leaves no row; a missing key on the left is kept only when
    the right side is empty. One count of the right keys decides that and measures them. Keys below the session's
    broadcast threshold are left to Spark; up to ``BLOOM_KEYS`` keys make a Bloom filter, by which most left rows
    are known to be absent where they lie, and only the rest is joined; more keys are joined with all left rows.
    A session that forbids broadcasts gets the plain join.
    """
    keys = right.select(_c(right_key or left_key).alias("_key"))
    facts = keys.agg(F.count(F.lit(1)).alias("rows"), F.count("_key").alias("known"),
                     F.sum(F.octet_length(F.col("_key").cast("string")) + 16).alias("bytes")).first()
    if facts["rows"] > facts["known"]:
        return left.filter(F.lit(False))
    if not facts["rows"]:
        return left
    usable, keys = left.filter(_c(left_key).isNotNull()), keys.dropna()
    threshold = _broadcast_threshold(left.sparkSession)
    if facts["bytes"] <= threshold:
        return usable.join(keys, _c(left_key) == F.col("_key"), "left_anti")
    same = left.schema[left_key].dataType == keys.schema["_key"].dataType
    maybe = usable
    if threshold > 0 and same and facts["known"] <= BLOOM_KEYS:
        marked = _bloom_marked(usable, left_key, keys, facts["known"])
        maybe = marked.filter("_maybe").drop("_maybe")
    rest = spread_join(maybe, keys.distinct(), [(left_key, "_key")], "left_anti", take=[], right_unique=True, count_on=left)
    return rest if maybe is usable else marked.filter("NOT _maybe").drop("_maybe").unionByName(rest)


def _broadcast_threshold(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes, 0 where broadcasts are off."""
    said = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return 0 if said.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(said)


def _bloom_marked(left: DataFrame, left_key: str, keys: DataFrame, known: int) -> DataFrame:
    """``left`` with ``_maybe``: whether its key may be one of ``keys``.

    The filter is a table of 32,768-bit blocks, built by tasks; its size follows from the number of keys, hence
    the broadcast is bounded by ``BLOOM_BITS`` bits for each of at most ``BLOOM_KEYS`` keys.
    """
    blocks = max(1, -(-known * BLOOM_BITS // _BLOCK))

    def place(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks * _BLOCK))

    bits = keys.select(place(F.col("_key")).alias("_place")).groupBy(
        F.call_function("div", F.col("_place"), F.lit(_BLOCK)).alias("_block")).agg(
        F.bitmap_construct_agg(F.col("_place") % _BLOCK).alias("_bits"))
    # A block as 64-bit words, so that a probe is a shift; bytes are in order in a word, bits from the lowest in a byte.
    words = F.transform(F.sequence(F.lit(0), F.lit(_BLOCK // 64 - 1)),
                        lambda i: F.conv(F.hex(F.substring("_bits", i * 8 + 1, F.lit(8))), 16, -10).cast("bigint"))
    filter_ = write_once(bits.select("_block", words.alias("_words")), "bloom")
    at = place(_c(left_key))
    probed = left.withColumn("_at", at).join(
        F.broadcast(filter_), F.call_function("div", F.col("_at"), F.lit(_BLOCK)) == F.col("_block"), "left")
    bit = F.col("_at") % _BLOCK
    word = F.get("_words", F.call_function("div", bit, F.lit(64)).cast("int"))
    byte = F.call_function("div", bit % 64, F.lit(8))
    hit = F.getbit(word, ((7 - byte) * 8 + bit % 8).cast("int")) == 1
    return probed.withColumn("_maybe", F.coalesce(hit, F.lit(False))).select(*map(_c, left.columns), "_maybe")


def star_join(fact: DataFrame, dimensions: Iterable[tuple[DataFrame, Keys, Mapping[str, str]]]
              ) -> DataFrame:
    """Left-join dimensions or label tables to a fact; missing matches missing.

    Each entry is (table, keys, {column: new name}). Spark broadcasts the ones it knows to
    be small (literal label tables always are) and merges the others.
    """
    for table, on, take in dimensions:
        fact = join(fact, table, on, take=take, null_safe=True)
    return fact


def share_of_group(df: DataFrame, group: str, pick: Column, name: str) -> DataFrame:
    """Give every row of a group the largest value that ``pick`` has in the group.

    An aggregate joined back rather than a window: a window would hold a whole group in one
    task. Missing groups form a group of their own.
    """
    picked = df.groupBy(group).agg(F.max(pick).alias(name))
    return spread_join(df, picked, [group], take=[name], null_safe=True, right_unique=True)
