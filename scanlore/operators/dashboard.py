"""Quality figures over representatives; each is one grouped aggregation.

``rep`` is ``representative.enriched``; ``series`` the deduplicated table that
was not pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..scratch import save
from . import filters
from .places import medians

SUMMARY = ("patient_id", "patient_name", "patient_birth_date", "patient_sex", "patient_age", "patient_weight", "patient_size", "study_date", "study_time")
TRIAL = ("ctp_collection", "ctp_subject_id", "ctp_private_flag_raw", "ctp_private_flag_int")
UPTAKE_IDEAL, UPTAKE_WITHIN = 60, (45, 75)
DOSE_IDEAL, DOSE_WITHIN = 3.0, (2.5, 3.5)


def summary_stats(df: DataFrame, value: str, within: tuple[float, float] | None = None) -> DataFrame:
    """n, mean, median, sd (null for one value), min, max and, with bounds, how many lie within."""
    v = F.col("value")
    more = [F.count_if(v.between(*within)).alias("within")] if within else []
    rows = save(df.select(F.col(value).alias("value")).filter("value IS NOT NULL"), "figures")
    middle = medians(rows, [], ["value"]).agg(F.round(F.max("value"), 6).alias("median"))  # one row, null without values
    found = rows.agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.min(v), 6).alias("min"), F.round(F.max(v), 6).alias("max"), *more)
    return found.crossJoin(F.broadcast(middle)).select("n", "mean", "median", *[c for c in found.columns if c not in ("n", "mean")])


def _with_medians(rows: DataFrame, found: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    """``found``, one row for each ``key``, with the medians of columns of ``rows`` under other names."""
    middle = medians(rows, [key], list(values))
    middle = middle.select(F.col(key).alias("__key"), *(F.round(c, 6).alias(name) for c, name in values.items()))
    return found.join(middle, F.col(key) == F.col("__key"), "left").drop("__key")


def uptake_stats(rep: DataFrame) -> DataFrame:
    return summary_stats(rep, "delay_minutes", UPTAKE_WITHIN)


def dose_stats(rep: DataFrame) -> DataFrame:
    return summary_stats(rep, "dose_dashboard", DOSE_WITHIN)


def scan_duration(rep: DataFrame) -> DataFrame:
    """Acquisition minus series time in minutes, as far as it lies within eight hours."""
    minutes = (s.time_seconds("acquisition_time") - s.time_seconds("series_time")) / 60
    return summary_stats(rep.withColumn("minutes", minutes).filter(F.col("minutes").between(0, 480)), "minutes")


def _group_summary(rep: DataFrame, key: str, name: str) -> DataFrame:
    injected = s.first_filled("injection_date", "study_date").isNotNull() & s.filled("injection_time")
    acquired = s.filled("acquisition_time") & s.first_filled("acquisition_date", "study_date").isNotNull()
    lacks = {"missing_weight": F.col("weight_best").isNull() | s.number("injected_activity").isNull(), "missing_injection": ~(injected & acquired), "missing_acquisition": ~acquired}
    rows = save(rep.select(F.coalesce(F.nullif(key, F.lit("")), F.lit("Unknown")).alias(name), "delay_minutes", "dose_dashboard", *(c.alias(k) for k, c in lacks.items())), "figures")
    found = rows.groupBy(name).agg(
        F.count("*").alias("n"),
        F.round(F.avg("delay_minutes"), 6).alias("uptake_mean"),
        F.count_if(F.col("delay_minutes").between(*UPTAKE_WITHIN)).alias("uptake_within"),
        F.round(F.avg("dose_dashboard"), 6).alias("dose_mean"),
        F.count_if(F.col("dose_dashboard").between(*DOSE_WITHIN)).alias("dose_within"),
        *(F.count_if(F.col(k)).alias(k) for k in lacks),
    )
    return _with_medians(rows, found, name, {"delay_minutes": "uptake_median", "dose_dashboard": "dose_median"})


def modality_summary(rep: DataFrame) -> DataFrame:
    return _group_summary(rep, "modality", "modality")


def radiopharm_summary(rep: DataFrame) -> DataFrame:
    return _group_summary(rep.filter("radiopharm"), "radiopharmaceutical", "radiopharmaceutical")


def ct_dose_summary(rep: DataFrame) -> DataFrame:
    some = rep.filter("ctdivol IS NOT NULL OR dlp IS NOT NULL")
    rows = save(some.select(F.coalesce(F.nullif("modality", F.lit("")), F.lit("Unknown")).alias("modality"), "ctdivol", "dlp"), "figures")
    found = rows.groupBy("modality").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(f"{c}_mean") for c in ("ctdivol", "dlp")))
    return _with_medians(rows, found, "modality", {"ctdivol": "ctdivol_median", "dlp": "dlp_median"})


def category_counts(df: DataFrame, key: str | Column, name: str, top: int | None = None) -> DataFrame:
    counted = df.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count("*").alias("n"))
    return counted if top is None else counted.orderBy(F.desc("n"), name).limit(top)


def tracer_top10(rep: DataFrame) -> DataFrame:
    return category_counts(rep.filter(s.has_radiopharm()), "radiopharmaceutical", "radiopharmaceutical", 10)


def manufacturer_top10(rep: DataFrame) -> DataFrame:
    return category_counts(rep.filter(s.filled("manufacturer")), "manufacturer", "manufacturer", 10)


def study_summary(series: DataFrame) -> DataFrame:
    """Per study the largest value of each demographic column; rows without study are a row."""
    return series.groupBy("study_instance_uid").agg(*(F.max(c).alias(c) for c in SUMMARY))


def study_dates(series: DataFrame) -> DataFrame:
    counted = category_counts(study_summary(series).filter(s.filled("study_date")), "study_date", "study_date")
    return counted.orderBy(F.desc("study_date")).limit(10)


def study_hours(series: DataFrame) -> DataFrame:
    return category_counts(study_summary(series).withColumn("hour", s.time_hms("study_time")["h"]).filter("hour IS NOT NULL"), "hour", "hour")


def _metrics(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Counts as rows (metric, n), from one pass."""
    one = df.agg(*(c.cast("long").alias(k) for k, c in metrics.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("n")) for k in metrics))))


def demographics(series: DataFrame) -> DataFrame:
    """metric, n over studies; those flagged by a trial are counted where the table has the trial's columns."""
    age, sex = s.age_years_digits("patient_age"), F.coalesce(F.nullif("patient_sex", F.lit("")), F.lit("Unknown"))
    studies = study_summary(series)
    bands = {"age 0-17": age <= 17, "age 18-39": age.between(18, 39), "age 40-59": age.between(40, 59), "age 60-79": age.between(60, 79), "age 80+": age >= 80}
    lacking = {"missing weight": s.number("patient_weight").isNull(), "missing height": s.number("patient_size").isNull(), "missing birth date": ~s.filled("patient_birth_date")}
    fixed = _metrics(studies, {k: F.count_if(c) for k, c in (bands | lacking).items()})
    counted = fixed.unionByName(category_counts(studies, F.concat(F.lit("sex "), sex), "metric"))
    if not any(c in series.columns for c in TRIAL):
        return counted
    return counted.unionByName(ctp_flagged(series).select(F.lit("ctp flagged").alias("metric"), F.col("ctp_flagged").alias("n")))


def ctp_flagged(series: DataFrame) -> DataFrame:
    """Studies that carry any of the trial columns."""
    flags = [s.filled(F.col(c).cast("string")) for c in TRIAL if c in series.columns]
    flagged = flags[0] if flags else F.lit(False)
    for f in flags[1:]:
        flagged = flagged | f
    return series.groupBy("study_instance_uid").agg(F.bool_or(flagged).alias("flagged")).agg(F.count_if("flagged").alias("ctp_flagged"))


def missingness(rep: DataFrame, series: DataFrame) -> DataFrame:
    sums = modality_summary(rep)
    return _metrics(sums, {k: F.sum(k) for k in ("missing_weight", "missing_injection", "missing_acquisition")}).unionByName(demographics(series).filter("metric LIKE 'missing %'"))


def repeat_rate(series: DataFrame) -> DataFrame:
    counts = series.filter(s.filled("study_instance_uid")).groupBy("study_instance_uid").agg(F.count("*").alias("k"))
    return _metrics(counts, {"studies": F.count("*"), "repeats": F.count_if(F.col("k") > 1)})


def dashboard_totals(series: DataFrame) -> DataFrame:
    return _metrics(series, {"series": F.count("*"), "studies": F.count_distinct("study_instance_uid")})


FIELDS = ("weight", "dose", "injection_time", "acquisition_time", "radiopharmaceutical", "patient_sex", "patient_age")


def completeness(rep: DataFrame, series: DataFrame) -> DataFrame:
    """field, have, total: weight, sex and age from the whole study, the rest from its representative."""
    tracer = F.max(F.when(s.is_radiopharm() & s.filled("study_instance_uid"), True)).alias("tracer_study")
    wanted = ("patient_weight", "patient_sex", "patient_age", "patient_birth_date")
    studies = series.groupBy("study_instance_uid").agg(*(F.max(c).alias(f"study_{c}") for c in wanted), tracer)
    rows = rep.drop("study_patient_weight", "tracer_study").join(studies, "study_instance_uid", "left")
    own = rows["radiopharm"]
    have = {
        "weight": s.number("study_patient_weight").isNotNull(),
        "dose": own & s.number("injected_activity").isNotNull(),
        "injection_time": own & s.filled("injection_time"),
        "acquisition_time": s.filled("acquisition_time"),
        "radiopharmaceutical": own & s.has_radiopharm(),
        "patient_sex": s.filled("study_patient_sex"),
        "patient_age": s.filled("study_patient_age") | s.filled("study_patient_birth_date"),
    }
    one = rows.agg(*(F.count_if(c).alias(k) for k, c in have.items()), F.count("*").alias("every"), F.count("tracer_study").alias("tracers"))
    total = {k: "tracers" if k in filters.RADIOPHARM_FIELDS else "every" for k in FIELDS}
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("have"), F.col(total[k]).alias("total")) for k in FIELDS))))


def timing_integrity(rep: DataFrame) -> DataFrame:
    statuses = ("missing", "parse_fail", "negative", "too_long", "ok")
    return _metrics(rep, {k: F.count_if(F.col("status") == k) for k in statuses} | {"study_time_conflict": F.count_if("conflict")})


def dose_plausibility(rep: DataFrame) -> DataFrame:
    """metric, value over tracer modalities: total, mean, sd, outliers and what is missing or in another unit."""
    rows = rep.filter("radiopharm").crossJoin(F.broadcast(filters.dose_spread(rep)))  # one row by construction
    dose, activity = F.col("dose_plausible"), s.number("injected_activity")
    metrics = {
        "total": F.count("*"),
        "mean": F.round(F.max("dose_mean"), 6),
        "sd": F.round(F.max("dose_sd"), 6),
        "outliers": F.count_if((F.col("dose_sd") > 0) & (F.abs(dose - F.col("dose_mean")) > 3 * F.col("dose_sd"))),
        "unit_mismatch": F.count_if((dose < 0.1) | (dose > 50)),
        "weight_without_activity": F.count_if(F.col("weight_best").isNotNull() & activity.isNull()),
        "activity_without_weight": F.count_if(F.col("weight_best").isNull() & activity.isNotNull()),
    }
    one = rows.agg(*(c.cast("double").alias(k) for k, c in metrics.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics))))


def qa_score_distribution(rep: DataFrame) -> DataFrame:
    """score, n for 0 to 5, zeros too."""
    counted = filters.qa_score_counts(rep)
    scores = rep.sparkSession.range(6).select(F.col("id").cast("int").alias("score"))
    return scores.join(counted, "score", "left").na.fill(0, ["n"])


def study_composition(series: DataFrame) -> DataFrame:
    return _metrics(filters.composition(series), {k: F.count_if(filters.composition_is(k)) for k in ("missing_ct", "missing_pt", "high_series")})


def scanner_landscape(rep: DataFrame) -> DataFrame:
    keys = {"manufacturer": "manufacturer", "model": "manufacturer_model_name", "software": "software_version"}
    return rep.groupBy(*(F.coalesce(F.nullif(c, F.lit("")), F.lit("Unknown")).alias(k) for k, c in keys.items())).agg(F.count("*").alias("n"), F.count_distinct("csa_series_header_hash").alias("unique_csa"))


def protocol_radiopharm(rep: DataFrame) -> DataFrame:
    """Per tracer: rows, different vendor hashes, the most frequent one (smallest of equal) and its count."""
    counted = rep.filter(s.has_radiopharm()).groupBy("radiopharmaceutical", "csa_series_header_hash").agg(F.count("*").alias("k"))
    some = F.col("csa_series_header_hash").isNotNull()
    best = F.min(F.when(some, F.struct((-F.col("k")).alias("less"), F.col("csa_series_header_hash").alias("hash"))))
    out = counted.groupBy("radiopharmaceutical").agg(F.sum("k").alias("n"), F.count("csa_series_header_hash").alias("unique_csa"), best.alias("best"))
    return out.select("radiopharmaceutical", "n", "unique_csa", F.col("best.hash").alias("top_csa"), F.coalesce(-F.col("best.less"), F.lit(0)).alias("top_count"))


def derived_objects(rep: DataFrame) -> DataFrame:
    maker = F.lower("manufacturer")
    return _metrics(rep, {"SEG": F.count_if(F.col("modality") == "SEG"), "RTSTRUCT": F.count_if(F.col("modality") == "RTSTRUCT"), "highdicom": F.count_if(F.contains(maker, F.lit("highdicom"))), "qiicr": F.count_if(F.contains(maker, F.lit("qiicr")))})


SIGNATURE = ("study_instance_uid", "modality", "series_description", "series_time", "number_of_slices", "manufacturer_model_name")


def duplicate_check(series: DataFrame) -> DataFrame:
    """How many image UIDs, and how many signatures of a series, occur more than once."""
    uids = series.filter(s.filled("sop_instance_uid")).groupBy("sop_instance_uid").count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("sop_instance_uid").alias("metric"), "n")
    return uids.unionByName(series.groupBy(*SIGNATURE).count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("signature").alias("metric"), "n"))


def histogram(df: DataFrame, value: str, width: float, most: int, low: float = 0.0) -> DataFrame:
    """bin, lower_edge, n from ``low`` to the largest value, zeros too; none when there is no value."""
    v = F.col(value).cast("double")
    top = df.agg(F.max(v).alias("top")).filter("top IS NOT NULL").select(F.when(F.col("top") > low, F.col("top")).otherwise(low + 1.0).alias("top"))
    bins = F.greatest(F.lit(1), F.least(F.ceil((F.col("top") - low) / width), F.lit(most))).cast("int")
    shape = top.withColumn("bins", bins).withColumn("step", (F.col("top") - low) / F.col("bins"))
    placed = df.filter(v.isNotNull()).select(v.alias("v")).crossJoin(F.broadcast(shape)).filter(F.col("v").between(F.lit(low), F.col("top")))  # one row by construction
    counted = placed.groupBy(F.least(F.floor((F.col("v") - low) / F.col("step")), F.col("bins") - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = shape.select("step", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.round(low + F.col("bin") * F.col("step"), 6).alias("lower_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def uptake_histogram(rep: DataFrame) -> DataFrame:
    return histogram(rep, "delay_minutes", 5, 60)


def dose_histogram(rep: DataFrame) -> DataFrame:
    return histogram(rep, "dose_dashboard", 0.1, 80)
