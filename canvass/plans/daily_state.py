"""Daily sums kept as a table, so that a new day costs a day and not the whole history.

The state holds one row per group and day: rows, and for each flag its sum and how often it is unknown. These add
up, so batches merge in any order. A batch either adds to its days or replaces them (late corrections); each one
is a version of ``canvass.sinks.versions`` under a label, and a label that is in already is not counted again, so a
job may be repeated. Reports read the state only.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.sinks.versions import Published, publish, published, read_manifest


@dataclass(frozen=True)
class DailyState:
    """The state in ``folder``, for the sums of ``flags`` per ``by`` and day of ``moment``.

    Missing groups and missing days are groups and days of their own.
    """

    spark: SparkSession
    folder: str
    by: str
    moment: str
    flags: Sequence[str]

    def _sums(self, df: DataFrame, sign: int = 1) -> DataFrame:
        measures = [(sign * F.count(F.lit(1))).cast("bigint").alias("_rows")]
        for flag in self.flags:
            measures += [(sign * F.coalesce(F.sum(flag), F.lit(0))).alias(f"sum_{flag}"),
                         (sign * F.count_if(F.col(flag).isNull())).cast("bigint").alias(f"unknown_{flag}")]
        return df.groupBy(self.by, F.to_date(self.moment).alias("_day")).agg(*measures)

    def labels(self) -> list[str]:
        """Labels of the batches counted so far, oldest first."""
        return read_manifest(self.spark, self.folder)["note"].get("labels", [])

    def _append(self, label: str, tables: dict[str, DataFrame]) -> bool:
        known = self.labels()
        if label in known:
            return False
        batch = read_manifest(self.spark, self.folder)["version"] + 1
        publish(self.spark, self.folder, {f"{kind}-{batch:010d}": df for kind, df in tables.items()},
                keep=published(self.spark, self.folder), note={"labels": [*known, label]})
        return True

    def add(self, label: str, rows: DataFrame) -> bool:
        """Count rows in; false if the label is in already."""
        return self._append(label, {"sums": self._sums(rows)})

    def withdraw(self, label: str, rows: DataFrame) -> bool:
        """Count rows out again that an earlier batch counted in."""
        return self._append(label, {"sums": self._sums(rows, -1)})

    def replace(self, label: str, rows: DataFrame, days: DataFrame | None = None) -> bool:
        """Put ``rows`` in place of all that is counted for their days.

        ``days`` (one column) names the days, also such without rows any more; rows of other days are an error
        of the caller and are left out. By default the days are those of the rows.
        """
        sums = self._sums(rows)
        if days is None:
            named = sums.select("_day").distinct()
        else:
            named = days.toDF("_day").select(F.to_date("_day").alias("_day")).distinct()
            sums = sums.alias("s").join(named.alias("d"), F.col("s._day").eqNullSafe(F.col("d._day")), "left_semi")
        return self._append(label, {"sums": sums, "days": named})

    def _batches(self, kind: str) -> Iterable[tuple[int, Published]]:
        for name, table in published(self.spark, self.folder).items():
            if name.startswith(f"{kind}-"):
                yield int(name.split("-")[1]), table

    def daily(self) -> DataFrame:
        """One row per group and day with what counts now: sums of the day's last replacement and all batches after it."""
        batches = [t.read(self.spark).withColumn("_batch", F.lit(n)) for n, t in self._batches("sums")]
        if not batches:
            raise ValueError(f"no batch is in {self.folder}")
        state = reduce(lambda a, b: a.unionByName(b), batches)
        replaced = [t.read(self.spark).withColumn("_from", F.lit(n)) for n, t in self._batches("days")]
        if replaced:
            last = reduce(lambda a, b: a.unionByName(b), replaced).groupBy(F.col("_day").alias("_replaced")).agg(
                F.max("_from").alias("_from"))
            state = state.join(last, F.col("_day").eqNullSafe(F.col("_replaced")), "left").filter(
                F.col("_batch") >= F.coalesce("_from", F.lit(0)))
        sums = [c for c in state.columns if c == "_rows" or c.startswith(("sum_", "unknown_"))]
        return state.groupBy(self.by, "_day").agg(*[F.sum(c).alias(c) for c in sums]).filter(F.col("_rows") != 0)

    def curve(self, flag: str, day: str = "date", observed: str = "N_aggragated_obs",
              done: str = "number_of_complete_screenings", running: str = "cumulative") -> DataFrame:
        """What ``daily_running`` gives for all rows counted: rows and flag sum per day, and the running sum."""
        counts = self.daily().select(self.by, F.col("_day").alias(day), F.col("_rows").alias(observed),
                                     F.col(f"sum_{flag}").alias(done))
        so_far = Window.partitionBy(self.by).orderBy(F.col(day).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn(running, F.sum(done).over(so_far))

    def stage_counts(self, stages: Sequence[tuple[str, int]], strict: Sequence[str] = (), count: str = "count",
                     stage: str = "visioid") -> DataFrame:
        """What ``stage_counts`` gives for all rows counted; stages in ``strict`` are unknown where a flag is."""
        used = dict.fromkeys(flag for flag, _ in stages)
        totals = self.daily().groupBy(self.by).agg(
            *[F.sum(f"{part}_{flag}").alias(f"{part}_{flag}") for flag in used for part in ("sum", "unknown")])
        rows = [F.struct((F.when(F.col(f"unknown_{flag}") == 0, F.col(f"sum_{flag}")) if flag in strict
                          else F.col(f"sum_{flag}")).alias(count), F.lit(number).alias(stage)) for flag, number in stages]
        return totals.select(self.by, F.inline(F.array(*rows)))

    def compact(self) -> int:
        """Put all batches into one, which reports then read alone; labels stay known."""
        batch = read_manifest(self.spark, self.folder)["version"] + 1
        return publish(self.spark, self.folder, {f"sums-{batch:010d}": self.daily()}, note={"labels": self.labels()})
