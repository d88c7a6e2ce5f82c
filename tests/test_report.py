"""Person, family and appointment lines of the daily report."""

from datetime import datetime

import pytest

from canvass.plans import report

CASE = ("SCACASE bigint, SDASTAND int, SDASEGMT int, SDASERAL int, STAQTYP int, SCAFAMNO int, "
        "SCAPERSN int, STAINTDT timestamp_ntz")
CURRENT = "case_id bigint, question_disp string, emp_id int"
PERSON = ("SDASTAND int, SDASEGMT int, SDASERAL int, SCAFAMNO int, SCAPERSN int, SP_ID bigint, "
          "RIAPCODE int, SCQCK305 int")


@pytest.fixture(scope="module")
def lines(spark):
    at = datetime(2021, 2, 3, 14, 5, 6)
    cases = spark.createDataFrame([
        (1, 398, 1, 1, 4, 1, 1, at), (2, 398, 1, 1, 4, 1, 2, at), (3, 398, 1, 1, 4, 1, 3, at),
        (4, 398, 1, 1, 3, 1, 1, at), (5, 398, 1, 1, 3, 1, None, at), (6, 398, 1, 1, 3, 1, 2, None),
        (7, 398, 1, 1, 3, 1, 4, at),
    ], CASE)
    current = spark.createDataFrame(
        [(1, "14", 1), (2, "52", 1), (3, None, 1), (4, "14", 1), (5, "2", 1), (6, None, 1),
         (7, "14", 1)], CURRENT)
    persons = spark.createDataFrame(
        [(398, 1, 1, 1, 1, 11, 2, 1), (398, 1, 1, 1, 2, 12, 2, 4), (398, 1, 1, 1, 3, 13, 1, 2),
         (398, 1, 1, 1, 4, 14, 2, None)], PERSON)
    flagged = report.person_and_family_flags(report.report_cases(cases, current), persons)
    return {r.SCACASE: r for r in flagged.collect()}


def test_a_missing_disposition_is_pending(lines):
    assert [lines[i].sp_pending for i in (1, 2, 3, 4)] == [0, 0, 1, None]
    assert [lines[i].sp_pendinga for i in (1, 2, 3, 4)] == [0, 0, 1, None]
    assert [lines[i].family_q_pending for i in (1, 4, 5, 6)] == [None, 0, 1, 1]


def test_completion_needs_selection(lines):
    assert [lines[i].sp_Q_completed for i in (1, 2, 3)] == [1, 0, None]
    assert [lines[i].sp_F_nonresponse for i in (1, 2, 3)] == [0, 1, None]


def test_family_lines(lines):
    # 5 has no person (unknown selection counts), 6 has no disposition, 7 an unknown selection.
    assert [lines[i].family_q_completed for i in (4, 5, 6, 7)] == [1, 0, None, 1]
    assert [lines[i].Families_ID for i in (1, 4)] == [0, 1]
    assert [lines[i].Desampled_Families for i in (4, 5, 6, 7)] == [1, 0, 1, 0]
    assert [lines[i].ct_famlies for i in (1, 4, 5)] == [0, 0, 1]


def test_date_and_time(lines):
    assert (str(lines[1].date), lines[1].time) == ("2021-02-03", "14:05:06")
    assert (lines[6].date, lines[6].time) == (None, None)


def test_selected_persons(spark):
    df = spark.createDataFrame([(2, 1), (2, 0), (2, None), (1, 1), (None, 1)],
                               "RIAPCODE int, SCQCK305 int")
    got = [r.SPIDED for r in report.selected_person_flag(df).collect()]
    assert got == [1, 0, 0, None, None]


def test_appointments(spark):
    persons = spark.createDataFrame(
        [(1, 2, 1), (2, 2, 4), (3, 2, 2), (4, 1, 1)], "SP_ID bigint, RIAPCODE int, SCQCK305 int")
    visits = spark.createDataFrame(
        [(1, 1, 1), (1, 1, 3), (1, 2, 2), (2, 1, 2), (4, 1, 1)],
        "SP_ID bigint, appt_type int, appt_status int")
    got = sorted([(r.SP_ID, r.appt_status, r.appt_exam_pend, r.broken_appt, r.MEC_examined)
                  for r in report.appointment_flags(persons, visits).collect()], key=str)
    assert got == [
        (1, 1, 1, 0, 0), (1, 3, 0, 1, 0), (2, 2, 0, 0, 1),
        (3, None, 0, 0, 0),   # unselected: known to be no even without an appointment
        (4, 1, 0, 0, 0),
    ]
    lone = persons.filter("SP_ID = 2")
    none = report.appointment_flags(lone, visits.filter("appt_type > 5")).first()
    assert (none.appt_exam_pend, none.broken_appt, none.MEC_examined) == (None, 0, 0)


def test_history_joins_back(spark):
    cases = spark.createDataFrame([(1,), (2,)], "SCACASE bigint")
    history = spark.createDataFrame(
        [(1, datetime(2021, 1, 2, 3, 4, 5), 0, "1"), (1, datetime(2021, 1, 3), 9, "11")],
        "SCACASE bigint, STACASDT timestamp_ntz, STAEMPID int, STAQDISP string")
    got = {r.SCACASE: r for r in report.cases_with_history(cases, history).collect()}
    assert (got[1].STAQDISP, got[1].EMPID, got[1].time) == ("11", 9, "00:00:00")
    assert got[2].STAQDISP is None
