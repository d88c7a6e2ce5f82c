"""The dashboard: fact, dimensions, stage counts and their export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass import vocabulary as v
from canvass.operators.bucketed import Bucketed, Finish, bucket_pair, linked_join
from canvass.operators.joins import join, spread_join, star_join
from canvass.operators.keys import place_keys
from canvass.operators.summary import (
    code_totals,
    daily_running,
    stage_counts,
    stage_grid,
    stage_list,
)
from canvass.plans.cases import (
    participant_details,
    propagate_participant,
    with_case_keys,
    with_current_status,
    with_star_key,
)
from canvass.plans.dimensions import (
    demographics_slicer,
    label_tables,
    numbered_participants,
    stand_dimension,
)
from canvass.plans.screener import screener_flags
from canvass.session import write_once
from canvass.sinks.versions import Published, publish, stage
from canvass.sinks.writers import write_star

_PASTED = tuple(place_keys("standid", "segmentid", "dwellingid", "familyid", "personid", "participantid"))


def fact_rows(cases: DataFrame, current: DataFrame, **spread) -> DataFrame:
    """The fact's rows as its joins leave them: reconciled participant and current status.

    Participants are propagated before the current status is joined. The two are
    independent, and this way the dwelling join reads only the case table. The place keys are
    left to :func:`finished_fact`, since their texts would be most of what is shuffled; the dwelling
    key alone is needed before, by the rows that meet on it.
    """
    propagated = propagate_participant(with_case_keys(cases), **spread)
    return with_current_status(propagated.drop(*[k for k in _PASTED if k not in cases.columns]), current)


def finished_fact(rows: DataFrame) -> DataFrame:
    """The fact of rows from :func:`fact_rows`: place keys, flags and star key, all of which follow from a row."""
    added = [k for k in _PASTED if k not in rows.columns]
    at = rows.columns.index("participantid_y")
    whole = with_case_keys(rows, participant="participantid_x").select(
        *[F.col(f"`{c}`") for c in [*rows.columns[:at], *added, *rows.columns[at:]]])
    return with_star_key(screener_flags(whole))


def dashboard_fact(cases: DataFrame, current: DataFrame, **spread) -> DataFrame:
    """The finished fact: keys, reconciled participant, current status, flags, star key."""
    return finished_fact(fact_rows(cases, current, **spread))


def screener_stages(fact: DataFrame) -> DataFrame:
    """Counts of the six screener stages per stand.

    Released and assigned counts are missing for a stand with an undecidable case; the
    others skip such cases.
    """
    return stage_counts(fact, "standid", v.STAGES, v.STAGES_STRICT)


def screener_stage_grid(fact: DataFrame) -> DataFrame:
    """Stage counts with a row for each step of the flow chart, counted or not."""
    return stage_grid(fact, "standid", v.STAGES, v.FIRST_STAGE, v.LAST_STAGE, v.STAGES_STRICT)


def completion_curve(fact: DataFrame) -> DataFrame:
    """Completed screeners per stand and day, and so far."""
    return daily_running(fact, "standid", "case_date", "completed_screener")


def health_answers(dwellings: DataFrame) -> DataFrame:
    """Totals of the health questions by stand and answer."""
    return code_totals(dwellings, "SDASTAND", v.HEALTH_QUESTIONS)


LINKED_TRAITS = ("participant_gender", "participant_race")


def labelled_star(fact: DataFrame, participants: DataFrame) -> DataFrame:
    """Fact with participant, stand and label columns joined on, as the dashboard links them.

    The fact is read several times, so hand in a written one.
    """
    details = participant_details(participants)
    return _with_labels(spread_join(fact, details, ["participant_key2"], take=LINKED_TRAITS), fact)


def bucket_star(fact: DataFrame, participants: DataFrame, buckets: int | None = None, finish: Finish | None = None,
                **hot) -> tuple[Bucketed, Bucketed]:
    """Fact and participants written in buckets of their shared key, for links that move no rows.

    ``finish`` makes the fact of the rows handed in, as :func:`finished_fact` does of those of :func:`fact_rows`: then only
    these are moved."""
    return bucket_pair(fact, participants, "participant_key2", buckets, finish_left=finish, finish_right=participant_details, **hot)


def linked_star(fact: Bucketed, details: Bucketed) -> DataFrame:
    """:func:`labelled_star` of tables from :func:`bucket_star`, without an exchange of either."""
    return _with_labels(linked_join(fact, details, take=LINKED_TRAITS), fact.rows())


def _with_labels(linked: DataFrame, fact: DataFrame) -> DataFrame:
    labels = label_tables(fact.sparkSession)
    # Written, so that Spark knows how small it is and need not shuffle the fact for it.
    stands = write_once(stand_dimension(fact), "stands")
    return star_join(linked, [
        (stands, ["standid"],
         {"vacannt_threshhold": "vacannt_threshhold", "active_stand": "active_stand"}),
        (labels["active_stand_label"], [("active_stand", "active_stand_status")],
         {"active_stand_label": "active_stand_label"}),
        (labels["gender_labels"], [("participant_gender", "value")],
         {"description": "gender"}),
        (labels["race_labels"], [("participant_race", "value")], {"description": "race"}),
        (labels["screener_pending3cat_labels"], [("screener_pending3cat", "value")],
         {"screener_pending3cat_description": "pending"}),
        (labels["completed_screener4cat"], [("completed_screener4cat", "value")],
         {"completed_screener4cat_description": "completed"}),
    ])


def screened_cases(cases: DataFrame, current: DataFrame, participants: DataFrame, **spread
                   ) -> DataFrame:
    """Screened dwellings with the relationship case and the participant they lead to.

    Columns of the joined tables carry the prefixes ``v_``, ``sc2_`` and ``sp_``.
    """
    place = ["SDASTAND", "SDASEGMT", "SDASERAL"]
    screened = current.filter(F.col("STAQDISP").isin(*v.SCREENED))
    screeners = cases.filter(F.col("STAQTYP") == v.SCREENER)
    found = join(screeners, screened, ["SCACASE"], "inner", prefix="v_")
    related = spread_join(found, cases.filter(F.col("STAQTYP") == v.RELATIONSHIP), place,
                          prefix="sc2_", count_on=screeners, **spread)
    # The participant key is computed first, so the last join stays an equi-join.
    wanted = F.when(F.col("STARSPNO") > 0, F.col("STARSPNO")).otherwise(F.col("sc2_STARSPNO"))
    return join(related.withColumn("_participant", wanted), participants,
                [*place, ("_participant", "SCAPARTN")], prefix="sp_").drop("_participant")


def dashboard_tables(fact: DataFrame, participants: DataFrame, participant_order: list[str]
                     ) -> dict[str, DataFrame]:
    """Every table the dashboard imports beside the fact, from a written fact."""
    spark = fact.sparkSession
    numbered = numbered_participants(participants, participant_order)
    return {
        "participant_details": participant_details(numbered),
        "stand_demensions": stand_dimension(fact),
        "participant_demographics_slicer": demographics_slicer(numbered),
        **label_tables(spark),
        "visio_screener_process": screener_stages(fact),
        "visio_screener_process_inbetween": stage_list(spark, v.FIRST_STAGE, v.LAST_STAGE),
        "completed_screeening_forcast": completion_curve(fact),
    }


def export_dashboard(cases: DataFrame, current: DataFrame, participants: DataFrame,
                     participant_order: list[str], folder: str, fmt: str = "parquet", **spread
                     ) -> dict[str, str]:
    """Write the whole star to ``folder`` and return the path of each table.

    The fact is computed once; the other tables are made from what was written.
    """
    fact = dashboard_fact(cases, current, **spread)
    if fmt == "parquet":
        paths = write_star({"case_fact": fact}, folder)
        fact = cases.sparkSession.read.schema(fact.schema).parquet(paths["case_fact"])
    else:
        fact = write_once(fact, "case-fact")
        paths = write_star({"case_fact": fact}, folder, fmt)
    return paths | write_star(dashboard_tables(fact, participants, participant_order), folder, fmt)


def publish_dashboard(cases: DataFrame, current: DataFrame, participants: DataFrame,
                      participant_order: list[str], folder: str, **spread) -> int:
    """Write the whole star as one new version of ``folder`` and return its number.

    Readers keep the version before until every table of this one is written and read back.
    """
    spark = cases.sparkSession

    def tables(staging: str, done: dict[str, Published]) -> None:
        done["case_fact"] = stage(dashboard_fact(cases, current, **spread), f"{staging}/case_fact")
        fact = done["case_fact"].read(spark)
        for name, df in dashboard_tables(fact, participants, participant_order).items():
            done[name] = stage(df, f"{staging}/{name}")

    return publish(spark, folder, tables)
