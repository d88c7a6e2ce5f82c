"""Column mappings of the survey tables."""

from __future__ import annotations

from canvass.sources.scan import TableMap

# Source column codes and the names the reports use for them.
CASE = TableMap.renamed("case", {
    "SCACASE": "caseid",
    "SDASTAND": "standid",
    "SDASEGMT": "segmentid",
    "SDASERAL": "dwellingid",
    "STAQTYP": "case_type",
    "SCAFAMNO": "familyid",
    "SCAPERSN": "personid",
    "STARSPNO": "participantid",
    "AAASESSN": "mec_session_id",
    "STAINTUS": "interpreter_used",
    "STAPXUSE": "proxy_used",
    "STAPSUSE": "spanish_interview",
    "STAINTDT": "case_date",
    "MAQ300": "case_where_completed",
})

CURRENT_CASE = TableMap.renamed("current_case", {
    "case_id": "caseid",
    "case_dt": "case_date",
    "question_disp": "case_disposition",
    "emp_id": "employee_id",
    "ip_address": "case_ip_address",
})

PARTICIPANT = TableMap.renamed("participant", {
    "SDASTAND": "standid",
    "SDASEGMT": "segmentid",
    "SDASERAL": "dwellingid",
    "SCAPARTN": "participantid",
    "SCAFAMNO": "familyid",
    "SCAPERSN": "personid",
    "SCQ290A": "participant_dob_month",
    "SCQ290B": "participant_dob_day",
    "SCQ290C": "participant_dob_year",
    "SCQ131": "participant_gender",
    "SCQ270D": "participant_race",
    "SCQ260D": "participant_ethnicity",
    "SCQ220": "participant_active_mil",
    "SCQ302": "participant_pregnant",
    "SCQCK305": "participant_selected_as_SP",
    "SCQ291A": "participant_age_interview_years",
    "SCQ291B": "participant_age_interview_months",
    "SFQ190": "participant_has_spouse_in_home",
})

# The daily report reads the same tables under their source names.
REPORT_CASE = TableMap.kept(
    "case", "SCACASE", "SDASTAND", "SDASEGMT", "SDASERAL", "STAQTYP", "SCAFAMNO", "SCAPERSN",
    "STARSPNO", "STAINTUS", "STAPXUSE", "STAPSUSE", "STAINTDT", "MAQ300",
)
REPORT_PARTICIPANT = TableMap.kept(
    "participant", "SDASTAND", "SDASEGMT", "SDASERAL", "SCAPARTN", "SCAFAMNO", "SCAPERSN",
    "SCQ290A", "SCQ290B", "SCQ290C", "SCQ131", "SCQ270D", "SCQ260D", "SCQ302", "SCQCK305",
    "SCQ291A", "SCQ291B", "SFQ190", "SCAPRACE", "SCAMARTL",
)
DWELLING_UNIT = TableMap.kept(
    "dwelling_unit", "SDASTAND", "SDASEGMT", "SDASERAL", "SCAREFPT", "SCQ090", "SCQ040",
    "SCQ302", "SCANLIVE", "SCQ025", "SCAISPAN", "SCAWHERE", "SCARECNT", "SCQ600", "SCQ610",
    "SCQ620", "SCQ630", "SCQ640",
)
CASE_HISTORY = TableMap.kept("case_history", "SCACASE", "STACASDT", "STAEMPID", "STAQDISP")
