"""The daily production report: cases, sampled persons, families and exam appointments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass import vocabulary as v
from canvass.functions.dates import clock, day
from canvass.operators.dedup import prefer_worked
from canvass.operators.flags import Flag, binary, in_codes, share, with_flags
from canvass.operators.joins import join
from canvass.operators.keys import place_keys, with_keys
from canvass.operators.summary import code_totals
from canvass.plans.screener import report_screener_flags
from canvass.session import discard, write_once
from canvass.sinks.writers import write_csv, write_csv2, write_table
from canvass.sources.mappings import REPORT_CASE

# The joins here meet one row per key on one side at least, so no key multiplies; a key with many
# rows on the left is split by the adaptive planner.
PLACE = ("SDASTAND", "SDASEGMT", "SDASERAL")
# The health table of each question, as the report's files are called.
HEALTH_FILES = {"gen_health": "SCQ600", "meds": "SCQ610", "qmeds": "SCQ620", "dia": "SCQ630",
                "htn": "SCQ640"}
PLACED = ("ri7_sam_case_k", "sc3_sam_part_k", "sc2_DU_k")  # files with segment and dwelling keys
PERSON_KEY = ("SDASTAND", "SDASEGMT", "SDASERAL", "SCAFAMNO", "SCAPERSN")


def with_date_and_time(df: DataFrame, moment: str, date: str = "date", time: str = "time"
                       ) -> DataFrame:
    return df.withColumns({date: day(F.col(moment)), time: clock(F.col(moment))})


def report_cases(cases: DataFrame, current: DataFrame) -> DataFrame:
    """Cases with all current-case columns, place keys and screener lines."""
    joined = join(cases, current, [("SCACASE", "case_id")], take=current.columns)
    keyed = with_keys(joined, place_keys("SDASTAND", "SDASEGMT", "SDASERAL"))
    return report_screener_flags(keyed)


def selected_person_flag(persons: DataFrame) -> DataFrame:
    """Whether a person of the household was selected."""
    return with_flags(persons, [
        share("SPIDED", F.col("RIAPCODE") == v.IN_HOUSEHOLD, in_codes("SCQCK305", v.SELECTED)),
    ])


def person_and_family_flags(cases: DataFrame, persons: DataFrame) -> DataFrame:
    """Interview lines of sampled persons and families, from report cases and persons.

    A missing disposition counts as pending, since only listed codes close a questionnaire.
    Key columns of the person table repeat those of the case and are not carried twice.
    """
    def disposition(codes):
        return in_codes("question_disp", codes)

    person, family = F.col("STAQTYP") == v.PERSON, F.col("STAQTYP") == v.FAMILY
    selected = in_codes("SCQCK305", v.SELECTED)
    pending = [
        share("sp_pending", person, ~disposition(v.QUESTIONNAIRE_CLOSED)),
        share("sp_pendinga", person, ~disposition(v.QUESTIONNAIRE_CLOSED)),
        share("family_q_pending", family, ~disposition(v.QUESTIONNAIRE_CLOSED)),
        binary("Families_ID", family),
    ]
    joined = join(cases, persons, PERSON_KEY)
    joined = with_date_and_time(joined, "STAINTDT")
    # An unknown disposition is neither completed nor not, unlike in the pending lines.
    open_or_selected = in_codes("SCQCK305", (*v.SELECTED, None))
    completed = F.col("question_disp").isin(*v.QUESTIONNAIRE_COMPLETED)
    return with_flags(
        joined,
        pending + [
            share("sp_Q_completed", person & selected, disposition(v.QUESTIONNAIRE_COMPLETED)),
            share("sp_F_nonresponse", person & selected, disposition(v.NONRESPONSE)),
            binary("Desampled_Families", family & selected),
            share("family_q_completed", family & open_or_selected, completed),
        ],
        [Flag("ct_famlies", F.col("Families_ID") - F.col("Desampled_Families"))],
    )


def appointment_flags(persons: DataFrame, appointments: DataFrame) -> DataFrame:
    """Persons with their exam appointments (a row per appointment) and what became of them."""
    exams = appointments.filter(F.col("appt_type") == v.EXAM_APPOINTMENT)
    joined = join(persons, exams, ["SP_ID"])
    sampled = (F.col("RIAPCODE") == v.IN_HOUSEHOLD) & in_codes("SCQCK305", v.SELECTED)
    status = F.col("appt_status")
    return with_flags(joined, [
        binary("appt_exam_pend", (status == v.APPOINTMENT_PENDING) & sampled),
        binary("broken_appt", in_codes("appt_status", v.APPOINTMENT_BROKEN) & sampled),
        binary("MEC_examined", in_codes("appt_status", (v.APPOINTMENT_EXAMINED,)) & sampled),
    ])


def deduplicated_history(history: DataFrame) -> DataFrame:
    """One record per case of the history, a worked one if there is one, with date and time."""
    first = prefer_worked(history, "SCACASE", "STACASDT", "STAEMPID", "STAQDISP")
    return with_date_and_time(first, "date", "date1", "time")


def cases_with_history(cases: DataFrame, history: DataFrame) -> DataFrame:
    """Cases with their deduplicated history record."""
    return join(cases, deduplicated_history(history), ["SCACASE"])


def with_place_keys(df: DataFrame) -> DataFrame:
    """Dwellings or participants of the report with their segment and dwelling keys."""
    return with_keys(df, place_keys(*PLACE))


def export_report(cases: DataFrame, persons: DataFrame, history: DataFrame,
                  participants: DataFrame, dwellings: DataFrame, folder: str) -> dict[str, str]:
    """Write the report's tables to folders under ``folder``; returns where each went.

    ``cases`` are those with person and family flags, ``persons`` those with appointments,
    ``history`` the cases with their history record. Row names follow the key columns; place
    keys are pasted as rows are written. ``history`` is computed once for its two tables.
    """
    keys = ["SCACASE"]
    history = write_once(history, "case-history")
    plans = {
        "ri7": (write_csv2, cases, keys),
        "ri1a": (write_csv2, persons, ["SP_ID"]),
        "ri7_sam_case1_k": (write_csv2, history.select(*[f.source for f in REPORT_CASE.fields]).withColumn("SCACASE", F.col("SCACASE").cast("string")), keys),
        "ri7_sam_case_k": (write_csv, history, keys),
        "sc3_sam_part_k": (write_table, participants, [*PLACE, "SCAPARTN"]),
        "sc2_DU_k": (write_table, dwellings, list(PLACE)),
    }
    asked = {q: v.HEALTH_QUESTIONS[q] for q in HEALTH_FILES.values()}
    for name, question in HEALTH_FILES.items():
        totals = code_totals(dwellings, "SDASTAND", {question: asked[question]})
        plans[name] = (write_csv2, totals, ["Stand", "value"])
    plans["healthq"] = (write_csv2, code_totals(dwellings, "SDASTAND", asked), ["var", "Stand", "value"])
    paths = {name: f"{folder}/{name}" for name in plans}
    for name, (write, df, order) in plans.items():
        write(df, paths[name], row_names=order, finish=with_place_keys if name in PLACED else None)
    discard(history)
    return paths
