"""Progress flags of the screener part, in the naming of the dashboard and of the daily report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass import vocabulary as v
from canvass.operators.flags import binary, category, in_codes, share, with_flags


def screener_flags(cases: DataFrame) -> DataFrame:
    """All screener flags of the dashboard (columns ``case_type``, ``case_disposition``,
    ``employee_id``).

    In-progress screeners are a share of the pending ones, and the fourth pending category
    holds assigned pending cases that fit none of the three: both as the labels say.
    """
    screener = F.col("case_type") == v.SCREENER

    def disposition(codes):
        return in_codes("case_disposition", codes)

    def among(flag):
        return screener & (F.col(flag) == 1)

    released, available = among("released_dwelling"), among("available_released_dwelling")
    pending, vacant = among("total_pending_screener"), among("vaccant_and_not_dwellings")
    assigned, completed = among("fi_assigned_screener"), among("completed_screener")

    def none_of(*flags):
        test = F.col(flags[0]) == 0
        for flag in flags[1:]:
            test = test & (F.col(flag) == 0)
        return test

    work = ("screener_not_worked", "screener_in_progress", "interm_refusal")
    outcomes = ("completed_screener_without_SP_neighbor", "completed_screener_with_sp",
                "completed_screener_with_sp_neighbor", "complected_screener_without_SP")
    return with_flags(
        cases,
        [
            binary("released_dwelling", screener & disposition(v.RELEASED)),
            binary("available_released_dwelling", screener & disposition(v.AVAILABLE)),
        ],
        [
            share("vaccant_and_not_dwellings", released, disposition(v.VACANT_OR_NOT_DWELLING)),
            binary("fi_assigned_screener", released & (F.col("employee_id") > 0)),
            share("total_pending_screener", released, ~disposition(v.SCREENER_DONE)),
            share("screener_nonresponse", released, disposition(v.NONRESPONSE)),
            share("screener_nonresponse_available_dwellings", available,
                  disposition(v.NONRESPONSE)),
        ],
        [
            share("vaccant_dwellings", released & vacant, disposition(v.VACANT)),
            share("not_dwellings", released & vacant, disposition(v.NOT_DWELLING)),
            share("screener_not_worked", pending, disposition(v.NOT_WORKED)),
            share("screener_in_progress", pending, disposition(v.IN_PROGRESS)),
            share("interm_refusal", pending, disposition(v.REFUSAL)),
            share("completed_screener", assigned, disposition(v.COMPLETED)),
        ],
        [
            category("screener_pending3cat", [
                *[(F.col(flag) == 1, i) for i, flag in enumerate(work, 1)],
                ((F.col("fi_assigned_screener") == 1) & none_of(*work), 4),
            ]),
            share("complected_screener_without_SP", completed, disposition(v.WITHOUT_SP)),
            share("completed_screener_without_SP_neighbor", completed,
                  disposition(v.WITHOUT_SP_NEIGHBOR)),
            share("completed_screener_with_sp", completed, disposition(v.WITH_SP)),
            share("completed_screener_with_sp_neighbor", completed,
                  disposition(v.WITH_SP_NEIGHBOR)),
        ],
        [
            category("completed_screener4cat", [
                *[(F.col(flag) == 1, i) for i, flag in enumerate(outcomes, 1)],
                (none_of(*outcomes), 5),
            ]),
        ],
    )


def report_screener_flags(cases: DataFrame) -> DataFrame:
    """The screener lines of the daily report (columns ``STAQTYP``, ``question_disp``,
    ``emp_id``). Completion is counted among released dwellings here, not assigned ones.
    """
    screener = F.col("STAQTYP") == v.SCREENER

    def disposition(codes):
        return in_codes("question_disp", codes)

    def among(flag):
        return screener & (F.col(flag) == 1)

    released, pending = among("isreleaseddu"), among("is_screen_pending")
    completed = among("scompleted6")
    return with_flags(
        cases,
        [
            binary("isdu", screener),
            binary("isreleaseddu", screener & disposition(v.RELEASED)),
            binary("isvreleaseddu", screener & disposition(v.AVAILABLE)),
            binary("is_screen_assigned", screener & (F.col("emp_id") > 0)),
            binary("interview_appointment", screener & disposition(v.INTERVIEW_APPOINTMENT)),
        ],
        [
            share("is_screen_pending", released, ~disposition(v.SCREENER_DONE)),
            share("vaccantNDU5", released, disposition(v.VACANT_OR_NOT_DWELLING)),
            share("scompleted6", released, disposition(v.COMPLETED)),
            share("snonresponse7", among("isvreleaseddu"), disposition(v.NONRESPONSE)),
        ],
        [
            share("is_screen_pending_no_worked", pending, disposition(v.NOT_WORKED)),
            share("is_screen_pending_in_progress", pending, disposition(v.IN_PROGRESS)),
            share("interm_refusal", pending, disposition(v.REFUSAL)),
            share("scompleted6a", completed, disposition(v.WITHOUT_SP)),
            share("scompleted6b", completed, disposition(v.WITHOUT_SP_NEIGHBOR)),
            share("scompleted6c", completed, disposition(v.WITH_SP)),
            share("scompleted6d", completed, disposition(v.WITH_SP_NEIGHBOR)),
        ],
    )
