"""Registered queries: each runs library operators over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass import vocabulary as v
from canvass.functions.dates import clock, day, epoch_to_zone, to_zone
from canvass.functions.na import is_in, n_distinct, not_in
from canvass.operators import joins, ordering, reshape, summary
from canvass.operators.codebook import codebook as describe_columns
from canvass.operators.dedup import earliest_per_key as first_records
from canvass.operators.flags import binary, in_codes, share, with_flags
from canvass.operators.frequency import frequency, labelled_frequency
from canvass.operators.keys import key_of, place_keys, typed_participant_key, with_keys
from canvass.operators.labels import (
    cast_labelled,
    code_labels,
    decode,
    label_variables,
    value_labels,
    variable_labels,
)
from canvass.plans import cases as case_plans
from canvass.plans import checks, dashboard, dimensions, report
from canvass.plans.daily_state import DailyState
from canvass.session import configure, fresh_path, write_once
from canvass.sinks import versions, writers
from canvass.sources import mappings, splits
from canvass.sources.scan import TableMap, footer_scan, min_max, scan
from proofs.survey import SurveyStore, TestTables, labelled_documents

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


class Inputs:
    """The test tables (``t``) and the survey tables made from them (``s``)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.t = TestTables(spark, folder)
        self.store = SurveyStore(self.t)

    def survey(self, mapping: TableMap | str) -> DataFrame:
        return scan(self.store, mapping)

    @property
    def documents(self) -> DataFrame:
        return labelled_documents(self.t)

    @property
    def cases(self) -> DataFrame:
        return self.survey(mappings.CASE)

    @property
    def current(self) -> DataFrame:
        return self.survey(mappings.CURRENT_CASE)

    @property
    def participants(self) -> DataFrame:
        return self.survey(mappings.PARTICIPANT)

    @property
    def fact(self) -> DataFrame:
        return dashboard.dashboard_fact(self.cases, self.current)

    @property
    def report_cases(self) -> DataFrame:
        return report.report_cases(self.survey(mappings.REPORT_CASE), self.survey("current_case"))

    @property
    def person_report(self) -> DataFrame:
        return report.person_and_family_flags(self.report_cases, self.survey("person"))


def query(function: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    _QUERIES[function.__name__] = lambda spark, folder: function(Inputs(spark, folder))
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Sources and projections


@query
def scan_rename(i: Inputs) -> DataFrame:
    return scan(i.t.store, TableMap.renamed("orders", {
        "o_orderkey": "caseid", "o_custkey": "dwellingid", "o_orderstatus": "case_disposition",
        "o_orderdate": "case_date"}))


@query
def scan_kept(i: Inputs) -> DataFrame:
    return scan(i.t.store, TableMap.kept("customer", "c_custkey", "c_nationkey"))


@query
def scan_full(i: Inputs) -> DataFrame:
    return scan(i.t.store, "nation")


@query
def scan_filter(i: Inputs) -> DataFrame:
    wanted = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    return scan(i.t.store, "orders", wanted)


@query
def minmax_probe(i: Inputs) -> DataFrame:
    probes = {"orders": "o_custkey", "lineitem": "l_suppkey", "customer": "c_custkey",
              "part": "p_partkey"}
    return reshape.stack_same(*[
        min_max(scan(i.t.store, table), column).withColumn("probe", F.lit(table))
        for table, column in probes.items()
    ])


@query
def surrogate_keys(i: Inputs) -> DataFrame:
    keyed = with_keys(i.cases, place_keys("standid", "segmentid", "dwellingid", "familyid",
                                          "personid", "participantid"))
    return keyed.select(
        "caseid", "segment_key", "dwelling_key", "family_key", "person_key", "participant_key",
        typed_participant_key(keyed, "participantid", "case_type").alias("typed_key"),
        typed_participant_key(keyed, "participantid", 1).alias("screener_key"))


# Filters and membership


@query
def filter_subset(i: Inputs) -> DataFrame:
    return i.documents.filter(F.col("quality") == 1)


@query
def filter_compound(i: Inputs) -> DataFrame:
    found = F.col("participantid") > 0
    kind = F.col("case_type")
    return i.cases.filter(((kind == 1) & found) | ((kind == 2) & found))


@query
def membership_flags(i: Inputs) -> DataFrame:
    quality = F.col("quality")
    return i.documents.select("doc_id", is_in(quality, [1, 4]).alias("listed"),
                              not_in(quality, [1, 4]).alias("unlisted"))


@query
def membership_null(i: Inputs) -> DataFrame:
    quality = F.col("quality")
    return i.documents.select(
        "doc_id", is_in(quality, [1, 4, None]).alias("listed_or_missing"),
        is_in(quality.cast("string"), ["1", "4", "NA"]).alias("text_na_is_no_missing"))


# Flags


@query
def binary_flag(i: Inputs) -> DataFrame:
    rated, long = F.col("quality") == 1, F.col("n_chars") > 500
    return with_flags(i.documents, [binary("good", rated), binary("good_and_long", rated & long)])


@query
def tristate_flag(i: Inputs) -> DataFrame:
    status = F.concat("l_returnflag", "l_linestatus")
    lines = i.t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                F.nullif(status, F.lit("NF")).alias("disposition"))
    first = F.col("l_linenumber") == 1
    return with_flags(lines, [
        share("returned", first, in_codes("disposition", ["RF", "RO"])),
        share("open", first, ~in_codes("disposition", ["AF", "RF"])),
    ])


@query
def flag_chain(i: Inputs) -> DataFrame:
    return i.fact


@query
def dummies_to_category(i: Inputs) -> DataFrame:
    return i.fact.groupBy(
        "screener_not_worked", "screener_in_progress", "interm_refusal", "fi_assigned_screener",
        "screener_pending3cat", "complected_screener_without_SP",
        "completed_screener_without_SP_neighbor", "completed_screener_with_sp",
        "completed_screener_with_sp_neighbor", "completed_screener4cat",
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def screener_report(i: Inputs) -> DataFrame:
    return i.report_cases


@query
def person_family_report(i: Inputs) -> DataFrame:
    return i.person_report


@query
def selected_persons(i: Inputs) -> DataFrame:
    return report.selected_person_flag(i.survey("person"))


@query
def flag_arithmetic(i: Inputs) -> DataFrame:
    return i.person_report.groupBy("SDASTAND", "STAQTYP").agg(
        F.sum("Families_ID").alias("families"),
        F.sum("Desampled_Families").alias("desampled"),
        F.sum("ct_famlies").alias("counted"))


# Joins


@query
def left_join_enrich(i: Inputs) -> DataFrame:
    return case_plans.with_current_status(i.cases, i.current)


@query
def left_join_multikey(i: Inputs) -> DataFrame:
    return joins.join(i.survey(mappings.REPORT_CASE), i.survey("person"), report.PERSON_KEY)


@query
def left_join_filtered(i: Inputs) -> DataFrame:
    exams = i.survey("appointment").filter(F.col("appt_type") == v.EXAM_APPOINTMENT)
    return joins.join(i.survey("person"), exams, ["SP_ID"], prefix="appt_",
                      take={"SP_ID": "person", "appt_status": "status"})


@query
def screened_case_join(i: Inputs) -> DataFrame:
    current = i.survey("current_case").select(F.col("case_id").alias("SCACASE"),
                                              F.col("question_disp").alias("STAQDISP"))
    return dashboard.screened_cases(i.survey(mappings.REPORT_CASE), current,
                                    i.survey(mappings.REPORT_PARTICIPANT))


@query
def anti_not_in(i: Inputs) -> DataFrame:
    left = i.t.documents.select(F.nullif("doc_id", F.lit(3)).alias("doc_id"), "lang")
    right = i.t.labels.select("doc_id")
    holed = i.t.labels.select(F.nullif("doc_id", F.lit(i.t.labels.agg(F.max("doc_id")).scalar())
                                       ).alias("doc_id"))
    empty = right.filter(F.col("doc_id") < 0)
    forms = {"plain": right, "missing_right": holed, "empty_right": empty}
    return reshape.stack_same(*[
        joins.not_in(left, table, "doc_id").withColumn("form", F.lit(form))
        for form, table in forms.items()
    ])


@query
def propagate_id(i: Inputs) -> DataFrame:
    return case_plans.propagate_participant(case_plans.with_case_keys(i.cases))


@query
def propagate_id_first(i: Inputs) -> DataFrame:
    keyed = case_plans.with_case_keys(i.cases)
    return case_plans.propagate_participant(keyed, one_per_dwelling=True)


_STAR_COLUMNS = ("caseid", "participant_key2", "standid", "case_type", "participantid2", "vacannt_threshhold",
                 "active_stand", "active_stand_label", "gender", "race", "pending", "completed")


@query
def star_join(i: Inputs) -> DataFrame:
    return dashboard.labelled_star(write_once(i.fact, "case-fact"), i.participants).select(*_STAR_COLUMNS)


@query
def star_buckets(i: Inputs) -> DataFrame:
    """The labelled star through tables in buckets of the participant key; its link has no exchange."""
    rows = dashboard.fact_rows(i.cases, i.current)
    fact, details = dashboard.bucket_star(rows, i.participants, finish=dashboard.finished_fact)
    return dashboard.linked_star(fact, details).select(*_STAR_COLUMNS)


@query
def case_fact(i: Inputs) -> DataFrame:
    return case_plans.case_fact(i.cases, i.current)


@query
def group_broadcast(i: Inputs) -> DataFrame:
    keyed = case_plans.with_case_keys(i.cases)
    pick = F.when(F.col("case_type") == v.RELATIONSHIP, F.col("participantid"))
    return joins.share_of_group(keyed, "dwelling_key", pick, "participantid2").select(
        "caseid", "case_type", "dwelling_key", "participantid", "participantid2")


# Aggregates


@query
def sum_na_poison(i: Inputs) -> DataFrame:
    return summary.group_sums(i.documents, ["source"], strict={"n_good": "quality",
                                                               "chars": "n_chars"})


@query
def sum_na_rm(i: Inputs) -> DataFrame:
    return summary.group_sums(i.documents, ["source", "quality"], present={"n_toxic": "toxic"})


@query
def count_by_two_keys(i: Inputs) -> DataFrame:
    return summary.count_known(i.documents, ["lang", "quality"], "quality")


@query
def health_questions(i: Inputs) -> DataFrame:
    return dashboard.health_answers(i.survey(mappings.DWELLING_UNIT))


@query
def earliest_per_key(i: Inputs) -> DataFrame:
    worked = i.survey(mappings.CASE_HISTORY).filter(F.col("STAEMPID") > 0)
    return first_records(worked, "SCACASE", "STACASDT", "STAEMPID", "STAQDISP")


@query
def dedup_prefer_worked(i: Inputs) -> DataFrame:
    return report.deduplicated_history(i.survey(mappings.CASE_HISTORY))


@query
def cases_with_history(i: Inputs) -> DataFrame:
    return report.cases_with_history(i.survey(mappings.REPORT_CASE),
                                     i.survey(mappings.CASE_HISTORY))


@query
def n_distinct_null(i: Inputs) -> DataFrame:
    return i.documents.agg(*[n_distinct(F.col(c)).alias(c) for c in ("quality", "source", "doc_id")])


@query
def dim_distinct(i: Inputs) -> DataFrame:
    return i.documents.select("lang", "quality").distinct()


@query
def dim_threshold(i: Inputs) -> DataFrame:
    return dimensions.stand_dimension(i.cases)


@query
def freq_table(i: Inputs) -> DataFrame:
    return frequency(i.documents, ["quality", "lang", "source"])


@query
def freq_no_na(i: Inputs) -> DataFrame:
    return frequency(i.documents, "quality", report_missing=False)


@query
def freq_numeric(i: Inputs) -> DataFrame:
    codes = i.t.orders.select(
        F.substring("o_orderpriority", 1, 1).try_cast("double").alias("priority"),
        F.col("o_orderstatus").try_cast("double").alias("never_a_number"), "o_custkey")
    return frequency(codes, codes.columns)


@query
def freq_masked(i: Inputs) -> DataFrame:
    return checks.stand_frequencies(i.fact, 3, checks.DASHBOARD_LINES, stand_column="segmentid")


@query
def stand_check(i: Inputs) -> DataFrame:
    flagged = i.person_report
    visits = report.appointment_flags(i.survey("person"), i.survey("appointment"))
    return reshape.stack_same(
        checks.stand_frequencies(flagged, 398, checks.REPORT_LINES, "SDASTAND"),
        checks.stand_frequencies(report.selected_person_flag(i.survey("person")), 398,
                                 checks.PERSON_LINES, "SDASTAND"),
        checks.stand_frequencies(visits, 398, checks.APPOINTMENT_LINES, "SDASTAND"))


@query
def sentinel_check(i: Inputs) -> DataFrame:
    propagated = case_plans.propagate_participant(case_plans.with_case_keys(i.cases))
    slicer = dimensions.demographics_slicer(
        dimensions.numbered_participants(i.participants, ["dwellingid"]))
    return checks.sentinel_frequencies(propagated, slicer)


@query
def freq_which(i: Inputs) -> DataFrame:
    rows = i.fact.filter(F.col("segmentid") == 3)
    return frequency(rows, ["released_dwelling", "available_released_dwelling"], few_levels=True)


@query
def daily_cumulative(i: Inputs) -> DataFrame:
    return dashboard.completion_curve(i.fact)


@query
def stage_funnel(i: Inputs) -> DataFrame:
    return dashboard.screener_stages(i.fact)


@query
def stage_sequence(i: Inputs) -> DataFrame:
    return dashboard.screener_stage_grid(i.fact)


@query
def codebook(i: Inputs) -> DataFrame:
    labelled = label_variables(i.t.orders, {"o_custkey": "Dwelling", "o_orderstatus": "Status"})
    return describe_columns(labelled)


# Order and shape


@query
def row_id(i: Inputs) -> DataFrame:
    return ordering.with_row_names(i.t.customer, ["c_custkey"], "slicer_ID")


@query
def sort_nulls_last(i: Inputs) -> DataFrame:
    return ordering.with_row_number(i.documents, ["quality", "toxic", "lang", "doc_id"], "position")


@query
def union_all(i: Inputs) -> DataFrame:
    suppliers = i.t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit(1).alias("kind"))
    customers = i.t.customer.select(F.lit(2).alias("kind"), F.col("c_nationkey").alias("nation"))
    return reshape.stack_same(suppliers, customers, suppliers)


@query
def union_fill(i: Inputs) -> DataFrame:
    return reshape.stack_fill(i.t.supplier, i.t.customer)


@query
def unpivot_slicer(i: Inputs) -> DataFrame:
    return reshape.melt(i.documents, ["doc_id"], ["quality", "toxic", "lang"])


@query
def gather_distinct(i: Inputs) -> DataFrame:
    return reshape.gather_distinct(i.documents, ["quality", "toxic", "source"])


# Labels


@query
def slicer_labels(i: Inputs) -> DataFrame:
    return dimensions.demographics_slicer(
        dimensions.numbered_participants(i.participants, ["dwellingid"]))


@query
def label_lookup(i: Inputs) -> DataFrame:
    ratings = code_labels(i.spark, [(0, "poor"), (None, "not rated")])
    return decode(i.documents, "quality", ratings, "rating")


@query
def labelled_freq(i: Inputs) -> DataFrame:
    coded = ["SCQ600", "SCQ610", "SCQ620", "SCQ630", "SCQ640", "SCQ040", "SCQ302", "SCAISPAN"]
    dwellings = label_variables(i.survey(mappings.DWELLING_UNIT), v.DWELLING_VARIABLE_LABELS)
    cut = cast_labelled(dwellings.select(*coded), "SCQ600", "bigint")
    return labelled_frequency(cut, coded, variable_labels(cut),
                              value_labels(i.spark, v.DWELLING_VALUE_LABELS), few_levels=True)


@query
def appointment_report(i: Inputs) -> DataFrame:
    return report.appointment_flags(i.survey("person"), i.survey("appointment"))


@query
def datetime_parts(i: Inputs) -> DataFrame:
    seconds = F.lit(1_700_000_000) + F.col("event_id") * 3600
    return i.t.events.select(
        "event_id", day(F.col("ts")).alias("date"), clock(F.col("ts")).alias("time"),
        to_zone(F.col("ts"), v.REPORT_ZONE).alias("local"),
        epoch_to_zone(seconds, v.REPORT_ZONE).alias("epoch_local"))


# Sinks: written, then read back


def _read_back(i: Inputs, df: DataFrame, path: str, **options) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    reader = i.spark.read.options(**{"header": True, "quote": '"', "escape": '"',
                                     "enforceSchema": False} | options)
    return reader.schema(fields).csv(path)


@query
def sink_csv_roundtrip(i: Inputs) -> DataFrame:
    path, df = fresh_path(i.spark, "csv"), i.documents
    writers.write_csv(df, path)
    return _read_back(i, df, path, nullValue="")


@query
def sink_csv_na_roundtrip(i: Inputs) -> DataFrame:
    path, df = fresh_path(i.spark, "csv-na"), i.documents
    writers.write_csv(df, path, missing="NA", row_names=["doc_id"])
    named = df.select(F.lit("").alias("row_name"), "*")
    return _read_back(i, named, path, nullValue="NA", enforceSchema=True)


@query
def sink_csv2_roundtrip(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, "csv2")
    df = i.t.customer.withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(7)))
    writers.write_csv2(df, path, row_names=["c_custkey"])
    texts = df.select(F.lit("").alias("row_name"), "*").withColumn("c_acctbal", F.lit(""))
    return _read_back(i, texts, path, sep=";", nullValue="NA", enforceSchema=True)


@query
def sink_table_roundtrip(i: Inputs) -> DataFrame:
    path = fresh_path(i.spark, "table")
    df = i.t.supplier.withColumn("s_nationkey", F.nullif("s_nationkey", F.lit(7)))
    writers.write_table(df, path)
    return _read_back(i, df, path, sep=" ", nullValue="NA")


def _read_shifted(i: Inputs, df: DataFrame, folder: str) -> DataFrame:
    """Rows of a space-separated export whose header has no cell for the row names."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fields = ["row_name string", *[f"`{c}` {kinds[c]}" for c in writers.read_header(i.spark, folder)]]
    return i.spark.read.options(quote='"', escape='"', sep=" ", nullValue="NA", pathGlobFilter="part-[0-9]*").schema(
        ", ".join(fields)).csv(folder)


@query
def sink_table_names_roundtrip(i: Inputs) -> DataFrame:
    """Row names in ``write.table`` form, read back by the shifted header."""
    path = fresh_path(i.spark, "table-names")
    df = i.t.supplier.withColumn("s_nationkey", F.nullif("s_nationkey", F.lit(7)))
    writers.write_table(df, path, row_names=["s_suppkey"])
    return _read_shifted(i, df, path)


@query
def report_export(i: Inputs) -> DataFrame:
    """Health tables of the exported report, and how many rows its other tables have."""
    paths = report.export_report(
        i.person_report, report.appointment_flags(i.survey("person"), i.survey("appointment")),
        report.cases_with_history(i.survey(mappings.REPORT_CASE), i.survey(mappings.CASE_HISTORY)),
        i.survey(mappings.REPORT_PARTICIPANT), i.survey(mappings.DWELLING_UNIT),
        fresh_path(i.spark, "report"))
    found = []
    for name, path in paths.items():
        sep = {"ri7_sam_case_k": ",", "sc3_sam_part_k": " ", "sc2_DU_k": " "}.get(name, ";")
        if name == "ri7_sam_case1_k":  # by value in a query of its own
            continue
        if sep == " ":
            rows = i.spark.read.options(quote='"', escape='"', sep=sep, pathGlobFilter="part-[0-9]*").csv(path)
        else:
            rows = i.spark.read.options(header=True, quote='"', escape='"', sep=sep, nullValue="NA").csv(path)
        if name in (*report.HEALTH_FILES, "healthq"):
            found.append(rows.select(F.lit(name).alias("table"), "Stand", "value", "x", "var"))
        else:
            found.append(rows.agg(F.count(F.lit(1)).cast("string").alias("x")).select(
                F.lit(name).alias("table"), F.lit(None).cast("string").alias("Stand"),
                F.lit(None).cast("string").alias("value"), "x", F.lit(None).cast("string").alias("var")))
    return reshape.stack_same(*found)


def _report_paths(i: Inputs) -> dict[str, str]:
    return report.export_report(
        i.person_report, report.appointment_flags(i.survey("person"), i.survey("appointment")),
        report.cases_with_history(i.survey(mappings.REPORT_CASE), i.survey(mappings.CASE_HISTORY)),
        i.survey(mappings.REPORT_PARTICIPANT), i.survey(mappings.DWELLING_UNIT),
        fresh_path(i.spark, "report-content"))


@query
def report_content_cases(i: Inputs) -> DataFrame:
    """The exported cases, read back by value."""
    cases = i.survey(mappings.REPORT_CASE)
    named = cases.select(F.lit("").alias("row_name"), F.col("SCACASE").cast("string").alias("SCACASE"), *cases.columns[1:])
    return _read_back(i, named, _report_paths(i)["ri7_sam_case1_k"], sep=";", nullValue="NA", enforceSchema=True).drop("row_name")


@query
def report_content_dwellings(i: Inputs) -> DataFrame:
    """Places and answers of the exported dwellings, read back by value and the shifted header."""
    units = i.survey(mappings.DWELLING_UNIT)
    return _read_shifted(i, report.with_place_keys(units), _report_paths(i)["sc2_DU_k"]).select(
        "SDASTAND", "SDASEGMT", "SCAISPAN", "SCQ040", "SCQ302", "SCQ600", "SCQ610", "SCQ620", "SCQ630", "SCQ640")


def _star_table(i: Inputs, name: str) -> DataFrame:
    paths = dashboard.export_dashboard(i.cases, i.current, i.participants, ["dwellingid"], fresh_path(i.spark, "star-tables"))
    return i.spark.read.parquet(paths[name])


@query
def star_content_fact(i: Inputs) -> DataFrame:
    """The exported fact, read back by value."""
    return _star_table(i, "case_fact")


@query
def star_content_stands(i: Inputs) -> DataFrame:
    """The exported stand dimension, read back by value."""
    return _star_table(i, "stand_demensions")


@query
def star_content_curve(i: Inputs) -> DataFrame:
    """The exported completion curve, read back by value."""
    return _star_table(i, "completed_screeening_forcast")


def _published_star(i: Inputs) -> str:
    """A folder whose newest version is the star; a version before it holds the stands only."""
    folder = fresh_path(i.spark, "published")
    versions.publish(i.spark, folder, {"stand_demensions": dimensions.stand_dimension(i.cases)})
    dashboard.publish_dashboard(i.cases, i.current, i.participants, ["dwellingid"], folder)
    return folder


@query
def publish_manifest(i: Inputs) -> DataFrame:
    """Rows of each published table, counted from the files of the newest version."""
    return versions.stacked_counts(i.spark, _published_star(i))


@query
def publish_fact(i: Inputs) -> DataFrame:
    """The fact of the newest published version, by value."""
    return versions.published(i.spark, _published_star(i))["case_fact"].read(i.spark)


@query
def publish_slicer(i: Inputs) -> DataFrame:
    """The published slicer linked to the participants of the same version, by value."""
    tables = versions.published(i.spark, _published_star(i))
    slicer, people = (tables[n].read(i.spark) for n in ("participant_demographics_slicer", "participant_details"))
    return slicer.join(people.select("slicer_ID", "participant_key2"), "slicer_ID").select(
        "participant_key2", "variable", F.col("value").cast("string").alias("value"), "valuelabel")


@query
def split_scan(i: Inputs) -> DataFrame:
    """Line items read in parts of equal depth; every row is in one part."""
    parts = splits.equal_depth(i.t.lineitem, "l_suppkey", 8, "l_orderkey")
    part = F.coalesce(*[F.when(F.expr(p), F.lit(n)) for n, p in enumerate(parts)])
    met = sum((F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in parts), F.lit(0))
    return i.t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", met.alias("parts"),
                               part.isNotNull().alias("placed"))


def _state_in_batches(i: Inputs) -> DailyState:
    """The fact's daily state from batches: a wrong first load, its correction, late rows, a repeated and a withdrawn batch."""
    fact = write_once(i.fact, "case-fact")
    state = DailyState(i.spark, fresh_path(i.spark, "daily-state"), "standid", "case_date",
                       list(dict.fromkeys([*(flag for flag, _ in v.STAGES), "completed_screener"])))
    early = F.coalesce(F.col("case_date") < F.lit("1995-01-01"), F.lit(False))
    odd = F.col("caseid") % 2 == 1
    state.add("first load", fact.filter(early).withColumn("completed_screener", F.lit(1)))
    state.add("late, odd", fact.filter(~early & odd))
    state.replace("corrected", fact.filter(early))
    state.add("late, even", fact.filter(~early & ~odd))
    state.add("late, even", fact.filter(~early & ~odd))  # a repeated job
    state.add("by mistake", fact.filter(odd))
    state.withdraw("taken back", fact.filter(odd))
    return state


@query
def daily_state_curve(i: Inputs) -> DataFrame:
    """The completion curve from a state that got its days in batches."""
    return _state_in_batches(i).curve("completed_screener")


@query
def daily_state_stages(i: Inputs) -> DataFrame:
    """Stage counts from the same state after its batches are made one."""
    state = _state_in_batches(i)
    state.compact()
    return state.stage_counts(v.STAGES, v.STAGES_STRICT)


@query
def minmax_footers(i: Inputs) -> DataFrame:
    return min_max(footer_scan(i.spark, f"{i.t.store.folder}/lineitem.parquet"), "l_suppkey")


@query
def number_text(i: Inputs) -> DataFrame:
    """Tiny, huge, negative and whole numbers as key text and through both text sinks."""
    price, line = F.col("l_extendedprice"), F.col("l_linenumber")
    numbers = i.t.lineitem.select("l_orderkey", "l_linenumber", F.when(line == 1, price * 1e15)
                                  .when(line == 2, price / 1e20).when(line == 3, -price * 1e-8)
                                  .when(line == 4, F.floor(price).cast("double"))
                                  .when(line == 5, price * 1e30).otherwise(price).alias("number"))
    keyed = numbers.withColumn("key", key_of(numbers, ["l_linenumber", "number"]))
    found = []
    for form, write, options in (("csv", writers.write_csv, {"nullValue": ""}),
                                 ("csv2", writers.write_csv2, {"sep": ";", "nullValue": "NA"})):
        path = fresh_path(i.spark, form)
        write(keyed, path)
        texts = keyed.withColumn("number", F.lit(""))
        found.append(_read_back(i, texts, path, **options).withColumn("form", F.lit(form)))
    return reshape.stack_same(*found)


@query
def slicer_links(i: Inputs) -> DataFrame:
    """Exported slicer joined to the exported participants: the traits agree row by row."""
    paths = dashboard.export_dashboard(i.cases, i.current, i.participants, ["dwellingid"],
                                       fresh_path(i.spark, "star-links"), "csv")

    def table(name: str) -> DataFrame:
        return i.spark.read.options(header=True, quote='"', escape='"').csv(paths[name])

    slicer, people = table("participant_demographics_slicer"), table("participant_details")
    traits = list(v.SLICER_LABELS)
    own = F.create_map(*[x for t in traits for x in (F.lit(t), F.col(t))])
    linked = slicer.join(people, "slicer_ID")
    return linked.filter(F.col("value").eqNullSafe(own[F.col("variable")])).select(
        "participant_key2", "variable", "value", "valuelabel")


@query
def star_export_content(i: Inputs) -> DataFrame:
    """Stage counts of the exported star, read back by value."""
    paths = dashboard.export_dashboard(i.cases, i.current, i.participants, ["dwellingid"],
                                       fresh_path(i.spark, "star-content"))
    return i.spark.read.parquet(paths["visio_screener_process"])


@query
def freq_large_integers(i: Inputs) -> DataFrame:
    """Levels beyond the whole numbers a double can hold, of both signs."""
    base = F.col("l_linenumber").cast("long")
    sign = F.when(F.col("l_returnflag") == "N", F.lit(-1)).otherwise(F.lit(1))
    return frequency(i.t.lineitem.select(
        (sign * (F.lit(99999999999999990) + base)).alias("large")), "large")


@query
def star_export(i: Inputs) -> DataFrame:
    paths = dashboard.export_dashboard(i.cases, i.current, i.participants, ["dwellingid"],
                                       fresh_path(i.spark, "star"))
    counts = [
        i.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("table", F.lit(name)) for name, path in paths.items()
    ]
    return reshape.stack_same(*counts)
