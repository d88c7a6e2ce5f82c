"""Frequencies an analyst compares with the printed production report and with sentinels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.operators.frequency import frequency, masked
from canvass.operators.reshape import stack_same

# The lines that are compared, in the order of the printed report.
DASHBOARD_LINES = (
    "released_dwelling", "available_released_dwelling", "vaccant_and_not_dwellings",
    "vaccant_dwellings", "not_dwellings", "fi_assigned_screener", "total_pending_screener",
    "screener_not_worked", "completed_screener", "completed_screener_with_sp_neighbor",
    "completed_screener_with_sp", "completed_screener_without_SP_neighbor",
    "screener_nonresponse", "screener_nonresponse_available_dwellings", "completed_screener4cat",
)
REPORT_LINES = (
    "isdu", "isreleaseddu", "isvreleaseddu", "is_screen_pending", "is_screen_pending_no_worked",
    "is_screen_pending_in_progress", "interm_refusal", "vaccantNDU5", "scompleted6",
    "scompleted6a", "scompleted6b", "scompleted6c", "scompleted6d", "snonresponse7",
    "sp_pending", "sp_Q_completed", "sp_F_nonresponse", "Families_ID", "family_q_pending",
    "family_q_completed",
)
PERSON_LINES = ("SPIDED",)
SHOWN_WITHOUT_MISSING = ("vaccantNDU5",)
APPOINTMENT_LINES = ("appt_exam_pend", "broken_appt", "MEC_examined")


def stand_frequencies(df: DataFrame, stand: int, lines: Sequence[str],
                      stand_column: str = "standid") -> DataFrame:
    """Frequency tables of flags at one stand; a row of unknown stand counts as missing."""
    rows = masked(df, F.col(stand_column) == stand, lines)
    known = [c for c in lines if c in SHOWN_WITHOUT_MISSING]
    tables = [frequency(rows, [c for c in lines if c not in known], few_levels=True)]
    if known:
        tables.append(frequency(rows, known, report_missing=False, few_levels=True))
    return stack_same(*tables)


def sentinel_frequencies(fact: DataFrame, slicer: DataFrame) -> DataFrame:
    """Frequencies that show participant ids no rule covered and values without a label."""
    return stack_same(frequency(fact, "participantid2"), frequency(slicer, "valuelabel"))
