"""Screener flags: every disposition by every case type, against nested rules written out."""

import itertools

import pytest
from pyspark.sql import functions as F

from canvass import vocabulary as v
from canvass.plans.screener import report_screener_flags, screener_flags

CODES = [str(i) for i in range(76)] + [None]
GRID = list(itertools.product([1, 2, 4, None], CODES, [0, 5, None]))


@pytest.fixture(scope="module")
def flags(spark):
    df = spark.createDataFrame(GRID, "case_type int, case_disposition string, employee_id int")
    return [r.asDict() for r in screener_flags(df).collect()]


def test_membership_flags_never_depend_on_unknown_dispositions(flags):
    for r in flags:
        released = r["case_disposition"] in v.RELEASED
        if r["case_type"] is None:
            assert r["released_dwelling"] == (None if released else 0)
        else:
            assert r["released_dwelling"] == int(r["case_type"] == 1 and released)


def test_assignment_is_unknown_only_for_released_cases_without_interviewer(flags):
    for r in flags:
        if r["case_type"] is None:
            continue
        if r["released_dwelling"] == 0:
            assert r["fi_assigned_screener"] == 0
        elif r["employee_id"] is None:
            assert r["fi_assigned_screener"] is None
        else:
            assert r["fi_assigned_screener"] == int(r["employee_id"] > 0)


@pytest.mark.parametrize("flag, base, codes", [
    ("vaccant_and_not_dwellings", "released_dwelling", v.VACANT_OR_NOT_DWELLING),
    ("vaccant_dwellings", "vaccant_and_not_dwellings", v.VACANT),
    ("not_dwellings", "vaccant_and_not_dwellings", v.NOT_DWELLING),
    ("screener_not_worked", "total_pending_screener", v.NOT_WORKED),
    ("screener_in_progress", "total_pending_screener", v.IN_PROGRESS),
    ("interm_refusal", "total_pending_screener", v.REFUSAL),
    ("completed_screener", "fi_assigned_screener", v.COMPLETED),
    ("complected_screener_without_SP", "completed_screener", v.WITHOUT_SP),
    ("completed_screener_without_SP_neighbor", "completed_screener", v.WITHOUT_SP_NEIGHBOR),
    ("completed_screener_with_sp", "completed_screener", v.WITH_SP),
    ("completed_screener_with_sp_neighbor", "completed_screener", v.WITH_SP_NEIGHBOR),
    ("screener_nonresponse", "released_dwelling", v.NONRESPONSE),
    ("screener_nonresponse_available_dwellings", "available_released_dwelling", v.NONRESPONSE),
])
def test_shares_split_their_base(flags, flag, base, codes):
    for r in flags:
        if r["case_type"] == 1 and r[base] == 1:
            assert r[flag] == int(r["case_disposition"] in codes)
        else:
            assert r[flag] is None


def test_pending_are_the_released_that_are_not_done(flags):
    pending = {r["case_disposition"] for r in flags if r["total_pending_screener"] == 1}
    assert pending == {"1", "2", "3", "22", "70", "71", "72", "73", "74"}


def test_codes_outside_the_released_list_are_out_of_scope(flags):
    for r in flags:
        if r["case_disposition"] in ("33", "51"):
            assert r["vaccant_and_not_dwellings"] is None and r["screener_nonresponse"] is None


def test_pending_category(flags):
    for r in flags:
        code, expected = r["case_disposition"], None
        if r["total_pending_screener"] == 1:
            expected = {"1": 1, "2": 2, "3": 2, "22": 3}.get(code)
            if expected is None and r["fi_assigned_screener"] == 1:
                expected = 4
        assert r["screener_pending3cat"] == expected


def test_completed_category_sums_to_its_dummies(flags):
    order = {"12": 1, "11": 2, "13": 3, "10": 4}
    for r in flags:
        expected = order[r["case_disposition"]] if r["completed_screener"] == 1 else None
        assert r["completed_screener4cat"] == expected


def test_report_counts_completion_among_released(spark):
    data = [(1, "11", None), (1, "11", 0), (1, "2", 3), (1, "15", 3), (4, "11", 3)]
    df = spark.createDataFrame(data, "STAQTYP int, question_disp string, emp_id int")
    got = report_screener_flags(df).select(
        "scompleted6", "scompleted6c", "is_screen_assigned", "is_screen_pending_in_progress",
        "interview_appointment").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, None, None, 0), (1, 1, 0, None, 0), (0, None, 1, 1, 0), (None, None, 1, None, 1),
        (None, None, 0, None, 0)]


def test_levels_stay_few_projections(spark):
    df = spark.createDataFrame(GRID, "case_type int, case_disposition string, employee_id int")
    counted = screener_flags(df).agg(F.sum("completed_screener4cat"))
    plan = counted._sc._jvm.PythonSQLUtils.explainString(counted._jdf.queryExecution(), "simple")
    assert plan.count("Project") <= 6 and len(plan) < 20_000
