"""Filters on studies: each gives the UIDs of the studies that pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s

UID = "study_instance_uid"
RADIOPHARM_FIELDS = ("dose", "injection_time", "radiopharmaceutical")
PRESENT = ("weight", "dose", "injection_time", "acquisition_time", "radiopharmaceutical", "patient_sex", "patient_age")
HIGH_SERIES = 20


def range_filter(rep: DataFrame, uptake: tuple = (None, None), dose: tuple = (None, None), keep: bool = False) -> DataFrame:
    """Representatives whose uptake delay and dose lie within the bounds, given as text; a maximum compares the value rounded to its places. ``keep`` gives all columns."""
    for c, (low, high) in (("delay_minutes", uptake), ("dose_per_kg", dose)):
        if low is not None:
            rep = rep.filter(F.col(c) >= float(low))
        if high is not None:
            places = s.decimal_places(high)
            rep = rep.filter((F.bround(c, places) if places else F.col(c)) <= float(high))
    return rep if keep else rep.select(UID)


def present(field: str) -> Column:
    """Whether a representative has the field."""
    return {
        "weight": s.number("patient_weight").isNotNull(),
        "dose": s.number("injected_activity").isNotNull(),
        "injection_time": s.filled("injection_time"),
        "acquisition_time": s.filled("acquisition_time"),
        "radiopharmaceutical": s.is_radiopharm() & s.has_radiopharm(),
        "patient_sex": s.filled("patient_sex"),
        "patient_age": s.filled("patient_age") | s.filled("patient_birth_date"),
    }[field]


def radiopharm_studies(series: DataFrame) -> DataFrame:
    return series.filter(s.is_radiopharm() & s.filled(UID)).select(UID).distinct()


def missing_filter(rep: DataFrame, series: DataFrame, field: str) -> DataFrame:
    """Studies whose representative lacks the field; some fields are only asked of studies with a tracer modality."""
    found = rep.filter(~present(field)).select(UID)
    if field not in RADIOPHARM_FIELDS:
        return found
    return rep.filter(~present(field) & F.col("tracer_study")).select(UID) if "tracer_study" in rep.columns else found.join(radiopharm_studies(series), UID, "left_semi")


def _issues(rows: DataFrame, issues: dict[str, Column]) -> DataFrame:
    """issue, study_instance_uid for each issue that holds, all from one pass."""
    pairs = F.array(*(F.struct(F.lit(k).alias("issue"), F.coalesce(c, F.lit(False)).alias("holds")) for k, c in issues.items()))
    return rows.select(UID, F.inline(pairs)).filter("holds").select("issue", UID)


def missing_issues(rep: DataFrame, series: DataFrame) -> DataFrame:
    """What ``missing_filter`` finds for every field."""
    rows = rep if "tracer_study" in rep.columns else rep.join(radiopharm_studies(series).withColumn("tracer_study", F.lit(True)), UID, "left")
    asked = lambda field: F.coalesce("tracer_study", F.lit(False)) if field in RADIOPHARM_FIELDS else F.lit(True)
    return _issues(rows, {k: ~present(k) & asked(k) for k in PRESENT})


def timing_issues(rep: DataFrame) -> DataFrame:
    """What ``timing_filter`` finds for every issue."""
    status = s.delay_status(signed="delay_signed")
    return _issues(rep, {k: status == k for k in ("missing", "parse_fail", "negative", "too_long", "ok")} | {"study_time_conflict": s.time_conflict()})


def dose_issues(rep: DataFrame) -> DataFrame:
    """What ``dose_issue_filter`` finds for every issue."""
    rows = rep.filter(s.is_radiopharm()).crossJoin(F.broadcast(dose_spread(rep)))  # one row by construction
    weight, activity, dose = s.weight_best(), s.number("injected_activity"), s.dose_plausibility()
    far = (F.col("dose_sd") > 0) & (F.abs(dose - F.col("dose_mean")) > 3 * F.col("dose_sd"))
    return _issues(rows, {"missing_activity": weight.isNotNull() & activity.isNull(), "missing_weight": activity.isNotNull() & weight.isNull(), "unit_mismatch": (dose < 0.1) | (dose > 50), "outlier": far})


def composition_issues(series: DataFrame) -> DataFrame:
    """What ``composition_filter`` finds for every issue."""
    return _issues(composition(series), {k: composition_is(k) for k in ("missing_ct", "missing_pt", "high_series")})


def timing_filter(rep: DataFrame, issue: str) -> DataFrame:
    return rep.filter(s.time_conflict() if issue == "study_time_conflict" else s.delay_status(signed="delay_signed") == issue).select(UID)


def dose_spread(rep: DataFrame) -> DataFrame:
    """Mean and sample deviation over representatives of tracer modalities, one row."""
    return rep.filter(s.is_radiopharm()).agg(F.avg(s.dose_plausibility()).alias("dose_mean"), F.stddev_samp(s.dose_plausibility()).alias("dose_sd"))


def dose_issue_filter(rep: DataFrame, issue: str) -> DataFrame:
    rows = rep.filter(s.is_radiopharm())
    weight, activity, dose = s.weight_best(), s.number("injected_activity"), s.dose_plausibility()
    if issue == "missing_activity":
        return rows.filter(weight.isNotNull() & activity.isNull()).select(UID)
    if issue == "missing_weight":
        return rows.filter(activity.isNotNull() & weight.isNull()).select(UID)
    if issue == "unit_mismatch":
        return rows.filter((dose < 0.1) | (dose > 50)).select(UID)
    if issue != "outlier":
        raise ValueError(f"unknown dose issue: {issue}")
    rows = rows.withColumn("__dose", dose).crossJoin(F.broadcast(dose_spread(rep)))  # one row by construction
    return rows.filter((F.col("dose_sd") > 0) & (F.abs(F.col("__dose") - F.col("dose_mean")) > 3 * F.col("dose_sd"))).select(UID)


def majority_csa(rep: DataFrame) -> DataFrame:
    """The most frequent vendor header hash, the smallest of equal ones; no row when there is none."""
    counted = rep.filter(s.filled("csa_series_header_hash")).groupBy("csa_series_header_hash").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "csa_series_header_hash").limit(1).select(F.col("csa_series_header_hash").alias("majority"))


def _own_points() -> Column:
    """The points that a representative has by itself, 0 to 4."""
    status = s.delay_status(signed="delay_signed")
    points = [s.number("patient_weight").isNotNull(), s.number("injected_activity").isNotNull(), status.isin("ok", "too_long"), (status == "ok") & ~s.time_conflict()]
    return sum((p.cast("int") for p in points[1:]), points[0].cast("int"))


def _has_majority() -> Column:
    return F.coalesce(F.col("csa_series_header_hash") == F.col("majority"), F.lit(False)).cast("int")


def with_qa_score(rep: DataFrame) -> DataFrame:
    """qa_score 0 to 5: weight, activity, a delay that can be told, a plausible one without conflict, the common vendor hash."""
    top = majority_csa(rep).agg(F.max("majority").alias("majority"))  # one row, null when there is none
    return rep.crossJoin(F.broadcast(top)).withColumn("qa_score", _own_points() + _has_majority()).drop("majority")


def qa_score_counts(rep: DataFrame) -> DataFrame:
    """score, n: as ``with_qa_score`` gives them, from one pass over the representatives counted by own points and vendor hash."""
    counted = rep.groupBy(_own_points().alias("own"), "csa_series_header_hash").agg(F.count("*").alias("n"))
    hashes = counted.filter(s.filled("csa_series_header_hash")).groupBy("csa_series_header_hash").agg(F.sum("n").alias("n"))
    top = hashes.orderBy(F.desc("n"), "csa_series_header_hash").limit(1).agg(F.max("csa_series_header_hash").alias("majority"))  # one row
    return counted.crossJoin(F.broadcast(top)).groupBy((F.col("own") + _has_majority()).alias("score")).agg(F.sum("n").alias("n"))


def qa_score_filter(rep: DataFrame, score: int) -> DataFrame:
    return with_qa_score(rep).filter(F.col("qa_score") == score).select(UID)


def composition(series: DataFrame) -> DataFrame:
    """Per study: whether it has PT and CT, and how many series."""
    known = series.filter(s.filled(UID))
    return known.groupBy(UID).agg(F.bool_or(F.coalesce(F.col("modality") == "PT", F.lit(False))).alias("has_pt"), F.bool_or(F.coalesce(F.col("modality") == "CT", F.lit(False))).alias("has_ct"), F.count("*").alias("series_count"))


def composition_is(issue: str, high: int = HIGH_SERIES) -> Column:
    return {"missing_ct": F.col("has_pt") & ~F.col("has_ct"), "missing_pt": F.col("has_ct") & ~F.col("has_pt"), "high_series": F.col("series_count") > high}[issue]


def composition_filter(series: DataFrame, issue: str, high: int = HIGH_SERIES) -> DataFrame:
    return composition(series).filter(composition_is(issue, high)).select(UID)


def filter_combine(*found: DataFrame) -> DataFrame:
    """Studies that pass all filters."""
    return reduce(lambda a, b: a.join(b, UID, "left_semi"), found)


def select_studies(studies: DataFrame, found: DataFrame) -> DataFrame:
    return studies.join(found, UID, "left_semi")


def export_modality_filter(series: DataFrame, modalities: list[str]) -> DataFrame:
    return series.filter(F.col("modality").isin(*modalities)) if modalities else series
