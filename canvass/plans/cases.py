"""The case fact: one row per questionnaire part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass import vocabulary as v
from canvass.functions.dates import epoch_to_zone, to_zone
from canvass.functions.na import cascade
from canvass.operators.joins import join, spread_join
from canvass.operators.keys import place_keys, typed_participant_key, with_keys
from canvass.operators.reshape import stack_same

CASE_ORDER = ("standid", "segmentid", "dwellingid", "familyid", "case_type", "participantid")


def _in_report_zone(current: DataFrame) -> DataFrame:
    """``case_date`` as wall clock of the report's zone, from epoch seconds or a UTC timestamp."""
    kind = current.schema["case_date"].dataType
    moment = F.col("case_date")
    if isinstance(kind, T.NumericType):
        shown = epoch_to_zone(moment, v.REPORT_ZONE)
    elif isinstance(kind, T.TimestampType):
        shown = to_zone(F.convert_timezone(None, F.lit("UTC"), moment.cast("timestamp_ntz")),
                        v.REPORT_ZONE)
    else:
        shown = to_zone(moment.cast("timestamp_ntz"), v.REPORT_ZONE)
    return current.withColumn("case_date", shown)


def with_current_status(cases: DataFrame, current: DataFrame) -> DataFrame:
    """Add date, disposition, interviewer and address of the current case record.

    There is one current record per case, so a plain join does.
    """
    return join(cases, _in_report_zone(current), ["caseid"], take={
        "case_date": "curr_case_date",
        "case_disposition": "case_disposition",
        "employee_id": "employee_id",
        "case_ip_address": "case_ip_address",
    })


def with_case_keys(cases: DataFrame, participant: str = "participantid") -> DataFrame:
    return with_keys(cases, place_keys("standid", "segmentid", "dwellingid", "familyid",
                                       "personid", participant))


def case_fact(cases: DataFrame, current: DataFrame) -> DataFrame:
    """Cases with their current status and all place keys.

    Not sorted: row order means nothing to a distributed table. ``arrange`` with
    ``CASE_ORDER`` sorts it for reading.
    """
    return with_case_keys(with_current_status(cases, current))


def propagate_participant(cases: DataFrame, one_per_dwelling: bool = False, **spread) -> DataFrame:
    """Give screener rows the participant id found by the relationship part of the dwelling.

    A screener row appears once per relationship row of its dwelling. With
    ``one_per_dwelling`` only the smallest participant id of the dwelling is used. Adds
    ``participantid_x`` (own), ``participantid_y`` (from the relationship part) and
    ``participantid2`` (reconciled). Rows of no known type are left out.
    """
    kind = F.col("case_type")
    found = cases.filter(kind == v.RELATIONSHIP).select(
        "dwelling_key", F.col("participantid").alias("participantid_y"))
    if one_per_dwelling:
        found = found.groupBy("dwelling_key").agg(
            F.min("participantid_y").alias("participantid_y"))
    # Pasted keys are never missing, so a plain equality joins them.
    own = cases.withColumnRenamed("participantid", "participantid_x")
    screeners = spread_join(own.filter(kind == v.SCREENER), found, ["dwelling_key"],
                            take=["participantid_y"], **spread)
    x, y = F.col("participantid_x"), F.col("participantid_y")
    # Screener rows only, so the rules for other types reduce to copies below.
    reconciled = cascade(
        (x.isNull() & y.isNull(), None),
        ((x > 0) & y.isNull(), x),
        (x.isNull() & (y > 0), y),
        (x == y, x),
        (x > 0, x),
        ((x == 0) & (y > 0), y),
        otherwise=v.ID_NOT_COVERED,
    )
    screeners = screeners.withColumn("participantid2", reconciled)
    others = own.filter(kind >= v.RELATIONSHIP).withColumns(
        {"participantid_y": x, "participantid2": x})
    return stack_same(screeners, others)


def with_star_key(cases: DataFrame) -> DataFrame:
    """Key under which a case of known ``dwelling_key`` meets the participant table."""
    return cases.withColumn("participant_key2", typed_participant_key(
        cases, "participantid2", "case_type", place="dwelling_key"))


def participant_details(participants: DataFrame) -> DataFrame:
    """The participant dimension, keyed to meet the screener cases."""
    return participants.withColumn(
        "participant_key2", typed_participant_key(participants, "participantid", v.SCREENER))
