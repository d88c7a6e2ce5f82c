"""Survey tables made from the test tables.

The test data has no survey, so orders play dwellings and order lines play cases. The same
derivations stand as SQL in ``oracle.py``; every one covers all rows of its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.sources.scan import FileStore, scan


class TestTables:
    """The parquet tables of one scale factor, as attributes."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, FileStore(spark, folder)

    def __getattr__(self, name: str) -> DataFrame:
        setattr(self, name, scan(self.store, name))
        return self.__dict__[name]


def _pick(index: Column, *values) -> Column:
    """The value at ``index`` (from 0)."""
    return F.element_at(F.array(*[F.lit(v).cast("int") for v in values]),
                        (index + 1).cast("int"))


def _int(column: Column) -> Column:
    return column.cast("int")


def labelled_documents(t: TestTables) -> DataFrame:
    """Documents with their labels; most have none, which gives the missing values."""
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic")


def places(t: TestTables) -> DataFrame:
    """Every order as a dwelling: stand, segment (one of them missing), dwelling number."""
    residents = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return t.orders.join(residents, F.col("o_custkey") == F.col("c_custkey")).select(
        (F.lit(398) + 6 * F.col("n_regionkey")).alias("SDASTAND"),
        F.nullif("c_nationkey", F.lit(7)).alias("SDASEGMT"),
        F.col("o_orderkey").alias("SDASERAL"),
        F.col("o_custkey").alias("k"),
        "o_orderdate",
    )


def case_table(t: TestTables) -> DataFrame:
    """Every order line as a case; its number is the case type."""
    kind, line = F.col("l_linenumber"), t.lineitem
    return line.join(places(t), F.col("l_orderkey") == F.col("SDASERAL")).select(
        (F.col("l_orderkey") * 8 + kind).alias("SCACASE"),
        "SDASTAND", "SDASEGMT", "SDASERAL",
        kind.alias("STAQTYP"),
        F.when(kind > 2, _int(F.col("k") % 3)).alias("SCAFAMNO"),
        F.when(kind > 3, _int(F.col("k") % 4)).alias("SCAPERSN"),
        _int(F.nullif(F.col("l_partkey") % 5, F.lit(4))).alias("STARSPNO"),
        F.col("l_suppkey").alias("AAASESSN"),
        _int(1 + F.col("l_partkey") % 2).alias("STAINTUS"),
        _int(1 + F.col("l_suppkey") % 2).alias("STAPXUSE"),
        _int(1 + (F.col("l_partkey") + F.col("l_suppkey")) % 2).alias("STAPSUSE"),
        F.col("l_shipdate").alias("STAINTDT"),
        _int(F.col("l_quantity")).alias("MAQ300"),
    )


def current_case(t: TestTables) -> DataFrame:
    """One record per case number, but none where a line was sold without discount."""
    sums = t.lineitem.groupBy(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("case_id")
    ).agg(
        F.max("l_shipdate").alias("case_dt"),
        F.sum("l_partkey").alias("p"),
        F.sum("l_suppkey").alias("s"),
        F.min("l_discount").alias("least"),
    )
    return sums.filter(F.col("least") > 0).select(
        "case_id", "case_dt",
        F.nullif(F.col("p") % 76, F.lit(75)).cast("string").alias("question_disp"),
        F.nullif(F.col("s") % 11, F.lit(10)).alias("emp_id"),
        F.concat(F.lit("10.0.0."), F.col("s") % 256).alias("ip_address"),
    )


def participant_table(t: TestTables) -> DataFrame:
    k, d = F.col("k"), F.col("SDASERAL")
    return places(t).select(
        "SDASTAND", "SDASEGMT", "SDASERAL",
        _int(d % 4).alias("SCAPARTN"),
        _int(k % 3).alias("SCAFAMNO"),
        _int(k % 4).alias("SCAPERSN"),
        F.month("o_orderdate").alias("SCQ290A"),
        F.dayofmonth("o_orderdate").alias("SCQ290B"),
        F.year("o_orderdate").alias("SCQ290C"),
        _pick(d % 6, 1, 2, 7, 9, 5, None).alias("SCQ131"),
        _pick(d % 8, 1, 2, 3, 4, 7, 9, 8, None).alias("SCQ270D"),
        _pick(k % 6, 2, 4, 7, 9, 1, None).alias("SCQ260D"),
        _pick(k % 5, 1, 2, 7, 9, None).alias("SCQ220"),
        _pick(d % 3, 1, 2, None).alias("SCQ302"),
        _pick(d % 7, 0, 1, 2, 3, 4, 5, None).alias("SCQCK305"),
        _int(k % 90).alias("SCQ291A"),
        _int(k % 12).alias("SCQ291B"),
        _int(1 + d % 2).alias("SFQ190"),
        _int(k % 7).alias("SCAPRACE"),
        _int(d % 5).alias("SCAMARTL"),
    )


def person_table(t: TestTables) -> DataFrame:
    k, d = F.col("k"), F.col("SDASERAL")
    return places(t).select(
        "SDASTAND", "SDASEGMT", "SDASERAL",
        _int(k % 3).alias("SCAFAMNO"),
        _int(k % 4).alias("SCAPERSN"),
        d.alias("SP_ID"),
        _pick(d % 4, 1, 2, 2, None).alias("RIAPCODE"),
        _pick(k % 6, 0, 1, 2, 3, 4, None).alias("SCQCK305"),
    )


def dwelling_table(t: TestTables) -> DataFrame:
    k, d = F.col("k"), F.col("SDASERAL")
    return places(t).select(
        "SDASTAND", "SDASEGMT", "SDASERAL",
        _int(k % 4).alias("SCAREFPT"),
        _int(1 + k % 6).alias("SCQ090"),
        _pick(d % 5, 1, 2, 7, 9, None).alias("SCQ040"),
        _pick(k % 5, 1, 2, 7, 9, None).alias("SCQ302"),
        _int(1 + d % 6).alias("SCANLIVE"),
        _int(1 + d % 2).alias("SCQ025"),
        _int(1 + k % 2).alias("SCAISPAN"),
        _int(d % 3).alias("SCAWHERE"),
        _int(k % 3).alias("SCARECNT"),
        _pick(d % 9, 1, 2, 3, 4, 5, 7, 9, 6, None).alias("SCQ600"),
        _pick(k % 5, 1, 2, 7, 9, None).alias("SCQ610"),
        _pick(d % 6, 1, 2, 3, 7, 9, None).alias("SCQ620"),
        _pick(k % 6, 1, 2, 3, 7, 9, None).alias("SCQ630"),
        _pick(d % 5, 1, 2, 7, 9, None).alias("SCQ640"),
    )


def history_table(t: TestTables) -> DataFrame:
    """Every event as a visit; one user in four was never worked, some dates are missing."""
    user, event = F.col("user_id"), F.col("event_id")
    return t.events.select(
        user.alias("SCACASE"),
        F.when(event % 10 != 0, F.col("ts")).alias("STACASDT"),
        F.when(user % 4 == 0, F.lit(0)).otherwise(_int(event % 4)).alias("STAEMPID"),
        F.nullif("event_type", F.lit("error")).alias("STAQDISP"),
    )


def appointment_table(t: TestTables) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "purchase", 3).when(
        kind == "signup", 4)
    return t.events.select(
        F.col("user_id").alias("SP_ID"),
        _int(1 + F.col("event_id") % 2).alias("appt_type"),
        status.alias("appt_status"),
    )


class SurveyStore:
    """The survey tables under the names the mappings use."""

    makers = {
        "case": case_table,
        "current_case": current_case,
        "participant": participant_table,
        "person": person_table,
        "dwelling_unit": dwelling_table,
        "case_history": history_table,
        "appointment": appointment_table,
    }

    def __init__(self, tables: TestTables):
        self.tables, self.made = tables, {}

    def table(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.makers[name](self.tables)
        return self.made[name]
