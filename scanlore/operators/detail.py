"""Study detail over all studies at once; one study is a filter on the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from . import private_tags
from .representative import best_series_per_study_modality

SUMMED = ("patient_id", "patient_name", "patient_birth_date", "patient_sex", "patient_age", "patient_weight", "patient_size", "study_date", "study_time", "study_description", "study_id", "accession_number")


def study_summary_detail(series: DataFrame) -> DataFrame:
    """Per study the largest value of each patient and study column."""
    return series.groupBy("study_instance_uid").agg(*(F.max(c).alias(c) for c in SUMMED if c in series.columns))


def study_detail(series: DataFrame) -> DataFrame:
    """Best series of each modality with what is derived from them and from the study."""
    rows = best_series_per_study_modality(series)
    info = series.groupBy("study_instance_uid").agg(F.max("patient_weight").alias("study_patient_weight"), F.max("patient_size").alias("study_patient_size"), F.max("study_date").alias("info_date"), F.max("study_time").alias("info_time"))
    joined = rows.join(info, "study_instance_uid")
    times = ("injection_date", "injection_time", "acquisition_date", "acquisition_time", "info_date")
    joined = joined.withColumn("delay", s.delay_nonneg(*times))
    at_scan = s.activity_at_scan(minutes=F.col("delay"))
    return joined.select(
        "study_instance_uid",
        "series_instance_uid",
        "file_path",
        "modality",
        F.nullif("delay", F.lit(0.0)).alias("delay_minutes"),
        s.activity_per_kg_raw().alias("activity_per_kg"),
        at_scan.alias("activity_at_scan"),
        s.decay_percent(at_scan=at_scan).alias("decay_percent"),
        s.bmi("study_patient_weight", "study_patient_size").alias("bmi"),
        s.height_cm("study_patient_size").alias("height_cm"),
        s.likely_next_day("info_time", "acquisition_time").alias("next_day"),
    )


def with_tag_summaries(detail: DataFrame, tags: DataFrame) -> DataFrame:
    """Creators of each series (name and count) beside its row."""
    counts = private_tags.private_creator_counts(tags, detail)
    listed = counts.groupBy("series_instance_uid").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "creator"))).alias("creators"))
    return detail.join(listed, "series_instance_uid", "left")


def series_lookup(series: DataFrame, uid: str) -> DataFrame:
    return series.filter(F.col("series_instance_uid") == uid).limit(1)
