"""Tables written in buckets of a shared key, so that joining them moves no rows.

The exchange is paid once, when the tables are written. Rows whose key is missing or hot would fill one bucket; they are
written beside the buckets and joined by ``spread_join``, so every bucket stays near its even share. Columns that follow from
a row, the key among them, can be left to a function that adds them once rows lie in their buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.operators.joins import hot_keys, join, spread_join
from canvass.session import CODEC, discard, fresh_path, write_once

Finish = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Bucketed:
    """A table in buckets of ``key``, and its rows of missing or hot keys apart (none if there are none)."""

    key: str
    buckets: int
    even: DataFrame
    apart: DataFrame | None

    def rows(self) -> DataFrame:
        return self.even if self.apart is None else self.even.unionByName(self.apart)


def _as_it_is(rows: DataFrame) -> DataFrame:
    return rows


def _bucketed(df: DataFrame, columns: Sequence[str], finish: Finish, key: str, buckets: int, name: str) -> DataFrame:
    """One file per bucket, sorted by the key, known to the catalog under a name of its own. Only ``columns`` and the
    number of the bucket are moved; ``finish`` adds the rest where the rows arrive."""
    spark = df.sparkSession
    table = f"canvass_{name}_{uuid.uuid4().hex}"
    place = F.pmod(F.hash(F.col(f"`{key}`")), F.lit(buckets))
    dealt = df.select(*_named(columns), place.alias("_bucket")).repartitionById(buckets, F.col("_bucket")).drop("_bucket")
    (finish(dealt).write.bucketBy(buckets, key).sortBy(key)
     .options(path=fresh_path(spark, table), compression=CODEC).format("parquet").saveAsTable(table))
    return spark.table(table)


def _named(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def _apart(df: DataFrame, key: str, hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows with an ordinary key, and the others."""
    missing = F.col(f"`{key}`").isNull()
    if hot is None:
        return df.filter(~missing), df.filter(missing)
    # Bounded broadcast: at most 2 / hot_share keys.
    listed = F.broadcast(hot.select(F.col("_key").alias("_hot")).distinct())
    same = F.col(f"`{key}`") == F.col("_hot")
    return df.filter(~missing).join(listed, same, "left_anti"), df.join(listed, same, "left_semi").unionByName(df.filter(missing))


def bucket_pair(left: DataFrame, right: DataFrame, key: str, buckets: int | None = None, *, finish_left: Finish | None = None,
                finish_right: Finish | None = None, **hot) -> tuple[Bucketed, Bucketed]:
    """Write two tables in the same buckets of the key they share.

    Both sides are split by the same hot keys, those of either side (limits as in ``spread_join``), so buckets meet
    buckets and the rest meets the rest. ``buckets`` defaults to the session's shuffle partitions. Each table is computed
    once: keys are counted and rows dealt out from a written copy, which goes when the buckets are there. A side's finish
    adds columns that follow from a row, which may be the key; neither the copy nor the exchange has them.
    """
    sides = ((left, finish_left or _as_it_is, "left"), (right, finish_right or _as_it_is, "right"))
    kinds = [finish(df).schema[key].dataType for df, finish, _ in sides]
    if kinds[0] != kinds[1]:
        raise ValueError(f"{key} has two types: {kinds[0]}, {kinds[1]}")
    count = buckets or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = [write_once(df, f"{name}-whole") for df, _, name in sides]
    keyed = [finish(copy).select(*_named(dict.fromkeys([*copy.columns, key])))
             for copy, (_, finish, _) in zip(copies, sides, strict=True)]
    found = hot_keys(*keyed, key, **hot)
    made = []
    for df, (own, finish, name) in zip(keyed, sides, strict=True):
        even, rest = _apart(df, key, found)
        rest = write_once(finish(rest.select(*_named(own.columns))), f"{name}-apart")
        made.append(Bucketed(key, count, _bucketed(even, own.columns, finish, key, count, name), None if rest.isEmpty() else rest))
    for copy in copies:
        discard(copy)
    return made[0], made[1]


def linked_join(left: Bucketed, right: Bucketed, how: str = "left", take: Sequence[str] | Mapping[str, str] | None = None,
                **hot) -> DataFrame:
    """``join`` of two tables from :func:`bucket_pair`: bucket with bucket in place, rows set apart by ``spread_join``.

    ``how`` is ``left`` or ``inner``; missing keys match nothing.
    """
    if (left.key, left.buckets) != (right.key, right.buckets):
        raise ValueError("the tables were not written as a pair")
    in_place = join(left.even, right.even, [left.key], how, take=take)
    if left.apart is None:
        return in_place
    others = right.apart if right.apart is not None else right.even.limit(0)
    return in_place.unionByName(spread_join(left.apart, others, [left.key], how, take=take, **hot))
