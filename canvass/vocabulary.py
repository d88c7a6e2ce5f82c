"""Code lists, labels and thresholds of the survey.

All of these are fixed values: a report is only comparable with earlier ones if they stay.
"""

# Disposition codes of a case.
RELEASED = ("1", "2", "3", "10", "11", "12", "13", "22", "30", "31", "32", "50", "52", "53",
            "54", "55", "56", "70", "71", "72", "73", "74")
AVAILABLE = ("2", "3", "10", "11", "12", "13", "22", "30", "50", "52", "53", "54", "55", "56",
             "70", "71", "72", "73", "74")
COMPLETED = ("10", "11", "12", "13")
VACANT_OR_NOT_DWELLING = ("30", "31", "32", "33")
VACANT = ("31",)
NOT_DWELLING = ("30", "32", "33")
NONRESPONSE = ("50", "51", "52", "53", "54", "55", "56")
SCREENER_DONE = COMPLETED + VACANT_OR_NOT_DWELLING + NONRESPONSE
NOT_WORKED = ("0", "1")
IN_PROGRESS = ("2", "3")
REFUSAL = ("22",)
QUESTIONNAIRE_CLOSED = ("14",) + NONRESPONSE + ("70",)
QUESTIONNAIRE_COMPLETED = ("14",)
WITHOUT_SP = ("10",)
WITH_SP = ("11",)
WITHOUT_SP_NEIGHBOR = ("12",)
WITH_SP_NEIGHBOR = ("13",)
INTERVIEW_APPOINTMENT = ("15",)
SCREENED = ("10", "11")

# Case types, person codes, selection codes, appointment codes.
SCREENER, RELATIONSHIP, FAMILY, PERSON = 1, 2, 3, 4
IN_HOUSEHOLD = 2
SELECTED = (1, 4)
EXAM_APPOINTMENT = 1
APPOINTMENT_PENDING, APPOINTMENT_EXAMINED = 1, 2
APPOINTMENT_BROKEN = (3, 4)

# Sentinel of a participant id that no rule covers.
ID_NOT_COVERED = 9876

# Stands.
TRIAL_STAND = 500
VACANT_THRESHOLD = 0.2
ACTIVE_ABOVE, ACTIVE_BELOW = 420, 800
REPORT_ZONE = "EST5EDT"

ACTIVE_STAND_LABELS = ((1, "Active"), (2, "Inactive"))
GENDER_LABELS = ((1, "1. Male"), (2, "2. Female"), (7, "3. Refused"), (9, "4. Don't Know"))
RACE_LABELS = ((1, "1. White"), (2, "2. Black"), (3, "3. Other"), (4, "4. Asian"),
               (7, "5. Refused"), (9, "6. Don't Know"))
PENDING_LABELS = (
    (1, "Screener Not Worked"),
    (2, "Screener in Progress"),
    (3, "interm Screening refusal"),
    (4, "contact dashboard manager about recoding error"),
    (None, "contact dashboard manager about missing data"),
)
COMPLETED_LABELS = (
    (1, "completed screener without SP neighbor"),
    (2, "completed screener with sp"),
    (3, "completed screener with sp neighbor"),
    (4, "completed screener without SP"),
    (5, "contact dashboard manager about recoding error"),
    (None, "contact dashboard manager about missing data"),
)

MISSING_LABEL = "Contact the dashboard manager there is  missing data"
RECODE_ERROR_LABEL = "Contact the dashboard manager there is a recode error"
SLICER_LABELS = {
    "participant_selected_as_SP": {
        0: "Inconclusive SP",
        1: "Selected as SP",
        2: "Not selected as SP",
        3: "Originally selected, no longer selected",
        4: "Appointment made, not yet uploaded",
    },
    "participant_gender": {1: "Male", 2: "Female", 7: "Refused", 9: "Don't know"},
    "participant_race": {1: "White", 2: "Black", 3: "Other", 4: "Asian", 7: "Refused",
                         9: "Don't know"},
    "participant_ethnicity": {2: "Latino", 4: "Not Latino", 7: "Refused", 9: "Don't know"},
    "participant_active_mil": {1: "Active military", 2: "Not active military", 7: "Refused",
                               9: "Don't know"},
}

DWELLING_VARIABLE_LABELS = {
    "SDASTAND": "MEC location ID/City",
    "SDASEGMT": "Neighborhood within the city",
    "SDASERAL": "Dwelling structure within the Neighborhood",
    "SCAREFPT": "ID of the screening informant",
    "SCQ090": "No. of people in the houshold",
    "SCQ040": "Dwelling biult after 4/1/1989",
    "SCQ302": "Screening infromant pregnant",
    "SCANLIVE": "No. of people in the houshold",
    "SCQ025": "Dwelling is a mobile home",
    "SCAISPAN": "Completed in Spanish",
    "SCAWHERE": "UNKNOWN",
    "SCARECNT": "No. of times the questionaire was entered",
    "SCQ600": " Self-Reported General health of screening informant",
    "SCQ610": "Self-reported medications currently taking",
    "SCQ620": "Self-reported No. of meds screening informant",
    "SCQ630": "Self-reported diabetes status",
    "SCQ640": "Self-reported high blood pressure",
}
YES_NO_BUILT = {1: "YES", 2: "NO", 7: "REFUSED", 9: "DON'KNOW"}
YES_NO = {1: "YES", 2: "NO", 7: "REFUSED", 9: "DON'T KNOW"}
DWELLING_VALUE_LABELS = {
    "SCQ040": YES_NO_BUILT,
    "SCQ302": YES_NO_BUILT,
    "SCAISPAN": {1: "Conducted in Spanish", 2: "Not conducted in Spanish"},
    "SCQ600": {1: "Excellent", 2: "Very good", 3: "Good", 4: "Fair", 5: "Poor", 7: "REFUSED",
               9: "DON'T KNOW"},
    "SCQ610": YES_NO,
    "SCQ620": {1: "1 to 2", 2: "3 to 5", 3: "6 or more", 7: "REFUSED", 9: "DON'T KNOW"},
    "SCQ630": {1: "YES", 2: "NO", 3: "BORDERLINE OR PREDIABETES", 7: "REFUSED",
               9: "DON'T KNOW"},
    "SCQ640": YES_NO,
}
HEALTH_QUESTIONS = {
    "SCQ600": "Self- reported general health status",
    "SCQ610": "Taking medication",
    "SCQ620": "No. of Meds being taken",
    "SCQ630": "Self-reported diabetes",
    "SCQ640": "self-reported high blood pressure",
}

# Screener stages of the flow chart and their numbers.
STAGES = (
    ("released_dwelling", 3),
    ("fi_assigned_screener", 4),
    ("total_pending_screener", 5),
    ("vaccant_and_not_dwellings", 6),
    ("completed_screener", 7),
    ("screener_nonresponse", 8),
)
STAGES_STRICT = ("released_dwelling", "fi_assigned_screener")
FIRST_STAGE, LAST_STAGE = 1, 9
