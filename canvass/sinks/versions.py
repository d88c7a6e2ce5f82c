"""Tables published together as one numbered version, so that a reader never sees half of a set.

``publish`` stages every table in a folder no reader looks at, reads back what was written, and only then adds a
manifest ``_versions/<number>.json``: path, schema, rows and content hash of each table. A version exists when its
manifest does; the manifest is written under another name and renamed, and a number that is taken is never replaced, so
a failed or a concurrent run leaves the earlier versions as they are. On a store whose renames are copies, give each
folder a single publisher.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.session import CODEC

_MANIFESTS = "_versions"
# A 64-bit hash is summed in parts of so many bits: 2^41 rows fit a bigint sum.
_SUMMED_BITS = 22


class VersionTaken(RuntimeError):
    """Another run published a version since this one looked."""


@dataclass(frozen=True)
class Published:
    """One table of a version, as its manifest describes it."""

    path: str
    schema: T.StructType
    rows: int
    content: str

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions, oldest first."""
    system, place = _file_system(spark, f"{folder}/{_MANIFESTS}")
    if not system.exists(place):
        return []
    names = [entry.getPath().getName() for entry in system.listStatus(place)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest_path(folder: str, number: int) -> str:
    return f"{folder}/{_MANIFESTS}/{number:010d}.json"


def read_manifest(spark: SparkSession, folder: str, number: int | None = None) -> dict:
    """The manifest of a version, by default of the newest; without versions it has no tables."""
    if number is None:
        known = numbers(spark, folder)
        if not known:
            return {"version": 0, "note": {}, "tables": {}}
        number = known[-1]
    lines = spark.read.text(_manifest_path(folder, number), wholetext=True).first()
    return json.loads(lines[0])


def add_manifest(spark: SparkSession, folder: str, number: int, content: Mapping) -> None:
    """Make ``content`` version ``number``; an error if that number is taken."""
    system, final = _file_system(spark, _manifest_path(folder, number))
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_MANIFESTS}/.{uuid.uuid4().hex}")
    out = system.create(staged, False)
    out.write(bytearray(json.dumps({"version": number, **content}).encode()))
    out.close()
    if system.exists(final) or not system.rename(staged, final):
        system.delete(staged, False)
        raise VersionTaken(f"version {number} of {folder} was published by another run")


def content_hash(columns: Sequence[str]) -> Column:
    """Aggregate over a table's rows that does not depend on their order, and counts repeated rows."""
    named = [F.col(f"`{c}`") for c in columns]
    wide = [_wide_sum(h).cast("string") for h in (F.xxhash64(*named), F.xxhash64(F.lit(1), *named))]
    return F.concat_ws("/", *[F.coalesce(w, F.lit("0")) for w in wide])


def _wide_sum(number: Column) -> Column:
    """Exact sum of 64-bit numbers as a decimal, from sums that stay bigints over the rows."""
    low = F.lit((1 << _SUMMED_BITS) - 1)
    parts = [F.shiftright(number, 2 * _SUMMED_BITS), F.shiftright(number, _SUMMED_BITS).bitwiseAND(low), number.bitwiseAND(low)]
    total = F.lit(0).cast("decimal(30,0)")
    for part in parts:
        total = (total * F.lit(1 << _SUMMED_BITS).cast("decimal(7,0)") + F.sum(part).cast("decimal(20,0)")).cast("decimal(30,0)")
    return total


def _described(df: DataFrame) -> tuple[int, str]:
    found = df.agg(F.count(F.lit(1)).alias("rows"), content_hash(df.columns).alias("content")).first()
    return found["rows"], found["content"]


def _write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", CODEC).parquet(path)


def stage(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] = _write_parquet) -> Published:
    """Write one table and describe what can be read back."""
    write(df, path)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    back = df.sparkSession.read.schema(schema).parquet(path)
    return Published(path, schema, *_described(back))


def publish(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame] | Callable[[str, dict], None],
            keep: Mapping[str, Published] | None = None, note: Mapping | None = None) -> int:
    """Write all tables as one new version and return its number.

    ``tables`` maps names to frames, or is a function that gets the staging folder and a dict, and puts a
    :class:`Published` under each table's name (for tables made from others of the same version). Tables in ``keep``
    go into the version as an earlier one left them, without being written again; ``note`` is kept in the manifest.
    If anything fails, no version is made.
    """
    number = (numbers(spark, folder) or [0])[-1] + 1
    staging = f"{folder}/data/{number:010d}-{uuid.uuid4().hex}"
    done: dict[str, Published] = dict(keep or {})
    if callable(tables):
        tables(staging, done)
    else:
        for name, df in tables.items():
            done[name] = stage(df, f"{staging}/{name}")
    add_manifest(spark, folder, number, {"note": dict(note or {}), "tables": {
        name: {"path": t.path, "schema": t.schema.jsonValue(), "rows": t.rows, "content": t.content}
        for name, t in done.items()}})
    return number


def published(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, Published]:
    """The tables of a version (by default the newest), to be read or kept in the next."""
    return {name: Published(t["path"], T.StructType.fromJson(t["schema"]), t["rows"], t["content"])
            for name, t in read_manifest(spark, folder, number)["tables"].items()}


def differing(spark: SparkSession, folder: str, number: int | None = None) -> list[str]:
    """Names of tables whose files no longer give the rows that were published."""
    return [name for name, t in published(spark, folder, number).items()
            if _described(t.read(spark)) != (t.rows, t.content)]


def changed(spark: SparkSession, folder: str, older: int, newer: int) -> dict[str, str]:
    """How each table differs between two versions: added, gone, schema, rows or content; equal tables are left out."""
    before, after = published(spark, folder, older), published(spark, folder, newer)
    found = {name: "gone" for name in before.keys() - after.keys()} | {name: "added" for name in after.keys() - before.keys()}
    for name in before.keys() & after.keys():
        for part in ("schema", "rows", "content"):
            if getattr(before[name], part) != getattr(after[name], part):
                found[name] = part
                break
    return found


def retire(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Forget all but the newest ``keep`` versions and delete the tables that only they held; returns how many versions went.

    A version's manifest goes before its tables, so no listed version ever lacks one. Readers of a forgotten version fail.
    """
    known = numbers(spark, folder)
    old, held = known[:-keep] if keep else known, set()
    for number in known[len(old):]:
        held |= {t.path for t in published(spark, folder, number).values()}
    for number in old:
        paths = {t.path for t in published(spark, folder, number).values()} - held
        system, manifest = _file_system(spark, _manifest_path(folder, number))
        system.delete(manifest, False)
        for path in paths:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    return len(old)


def stacked_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each table of the newest version, counted from its files: (table, rows)."""
    counts = [t.read(spark).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
              for name, t in published(spark, folder).items()]
    return reduce(lambda a, b: a.unionByName(b), counts)
