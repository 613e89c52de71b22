"""One best series per study, by the rule of the ingest and by the rule of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s


def with_study_weight(rows: DataFrame) -> DataFrame:
    """Largest weight of the study among the rows; a row without study has none."""
    most = F.max(s.number("patient_weight")).over(Window.partitionBy("study_instance_uid"))
    return rows.withColumn("study_patient_weight", F.when(F.col("study_instance_uid").isNotNull(), most))


def size_order() -> list[Column]:
    return [F.coalesce("number_of_slices", F.lit(0)).desc(), F.col("series_time").asc_nulls_last(), F.col("series_number").asc_nulls_last(), F.col("file_path").asc()]


def best_row(df: DataFrame, *keys: str) -> DataFrame:
    """The row with most slices in each group; equal ones by time, number and path."""
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*size_order())))
    return ranked.filter("__rn = 1").drop("__rn")


def best_row_per_series(series: DataFrame, within: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """The best row of each series; rows without a series are one more group. ``within`` names columns that all rows of a
    series agree on: rows that lie by these already are not shuffled, and the lone group's row is found on its own.
    ``unique`` says that no series has more rows than one, as behind ``dedup_series``: then only the lone group is reduced."""
    if not within:
        return best_row(series, "series_instance_uid")
    kept = _with_one_lone(series)
    return kept if unique else best_row(kept, *within, "series_instance_uid")


def _with_one_lone(series: DataFrame) -> DataFrame:
    """All rows with a series and the best one of those without."""
    place = F.struct(-F.coalesce("number_of_slices", F.lit(0)), F.col("series_time").isNull(), "series_time", F.col("series_number").isNull(), "series_number", "file_path")
    lone = series.filter("series_instance_uid IS NULL").agg(F.min_by("file_path", place).alias("__lone"))  # one row
    kept = F.col("series_instance_uid").isNotNull() | (F.col("file_path") == F.col("__lone"))
    return series.crossJoin(F.broadcast(lone)).filter(kept).drop("__lone")


def best_series_per_study_modality(series: DataFrame) -> DataFrame:
    return best_row(series, "study_instance_uid", "modality")


def _score(dose: str, delay: str, modality: Column) -> Column:
    return F.when(F.col(dose).isNotNull(), 3).otherwise(0) + F.when(F.col(delay).isNotNull(), 2).otherwise(0) + modality.cast("int")


def _first_by_score(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("study_instance_uid").orderBy(F.desc("score"), "file_path")
    return scored.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def representative_ingest(series: DataFrame) -> DataFrame:
    """Scored on the signed delay, the ingest dose and the exact modality."""
    known = with_study_weight(series.filter(s.filled("study_instance_uid"))).filter(s.filled("series_instance_uid"))
    scored = known.withColumn("delay_minutes", s.delay_signed()).withColumn("dose_per_kg", s.dose_ingest())
    return _first_by_score(scored.withColumn("score", _score("dose_per_kg", "delay_minutes", s.is_radiopharm_exact())))


def representative_query(series: DataFrame, within: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """Scored on the positive delay, the listing dose and the modality in any case, over the best row of each series.

    tracer_study: whether any series of the study is of a tracer modality.
    """
    tracer = F.bool_or(F.coalesce(s.is_radiopharm(), F.lit(False))).over(Window.partitionBy("study_instance_uid"))
    whole = with_study_weight(series).withColumn("tracer_study", tracer)
    known = best_row_per_series(whole, within, unique).filter(s.filled("study_instance_uid"))
    scored = known.withColumn("delay_signed", s.delay_signed()).withColumn("dose_per_kg", s.dose_listing())
    scored = scored.withColumn("delay_minutes", F.when(F.col("delay_signed") > 0, F.col("delay_signed")))
    return _first_by_score(scored.withColumn("score", _score("dose_per_kg", "delay_minutes", s.is_radiopharm())))


def enriched(series: DataFrame, within: tuple[str, ...] = (), unique: bool = False) -> DataFrame:
    """Representatives with all that the dashboard and the filters ask of a row."""
    rep = representative_query(series, within, unique)
    return rep.select(
        "*",
        s.delay_status(signed="delay_signed").alias("status"),
        s.weight_best().alias("weight_best"),
        s.dose_plausibility().alias("dose_plausible"),
        s.dose_dashboard().alias("dose_dashboard"),
        s.is_radiopharm().alias("radiopharm"),
        s.time_conflict().alias("conflict"),
    )


def series_per_study(series: DataFrame) -> DataFrame:
    return series.groupBy("study_instance_uid").agg(F.count("*").alias("series_count"))
