"""Deduplication, upkeep of the two tables and reports about an ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _own_key(within: tuple[str, ...]) -> list:
    """What tells series apart: the UID, else the path."""
    return [*within, F.col("series_instance_uid"), F.when(F.col("series_instance_uid").isNull(), F.col("file_path"))]


def dedup_series(files: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One file per series UID, the one with the smallest path; files without UID all stay.

    Spark limits each series to its first row before the shuffle as well as
    behind it, so one with very many files leaves each task as one row, and
    columns that are not asked for are not read. Of rows that repeat a path the
    one with the fewest slices stays, so reruns agree. ``within`` names columns that
    all files of a series agree on: rows that lie by these already are not shuffled.
    """
    ties = [c for c in ("number_of_slices",) if c in files.columns]
    order = Window.partitionBy(*_own_key(within)).orderBy("file_path", *ties)
    return files.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def files_of_kept_paths(files: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """All rows with the path that ``dedup_series`` keeps; the files of a path have to agree on the series."""
    order = Window.partitionBy(*_own_key(within)).orderBy("file_path")
    return files.withColumn("__rank", F.rank().over(order)).filter("__rank = 1").drop("__rank")


TAG_KEY = ("series_instance_uid", "group_hex", "element_hex", "creator", "value_hash")


def dedup_tags(tags: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per series, tag, creator and value; rows without a series are all kept. Only columns that are asked for are
    carried; ``within`` as for ``dedup_series``."""
    lone = F.col("series_instance_uid").isNull()
    order = Window.partitionBy(*_own_key(within), *TAG_KEY[1:]).orderBy("file_path")
    return tags.withColumn("__rn", F.row_number().over(order)).filter((F.col("__rn") == 1) | lone).drop("__rn")


def tags_of_kept_files(tags: DataFrame, kept: DataFrame) -> DataFrame:
    return tags.join(kept.select("file_path"), "file_path", "left_semi")


def skip_existing_paths(files: DataFrame, existing: DataFrame) -> DataFrame:
    return files.join(existing.select("file_path"), "file_path", "left_anti")


def new_series(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append: the deduplicated files whose series is not stored yet."""
    stored = existing.select("series_instance_uid").filter("series_instance_uid IS NOT NULL").distinct()
    return dedup_series(files).join(stored, "series_instance_uid", "left_anti").select(*files.columns)


def new_studies(files: DataFrame, existing: DataFrame) -> DataFrame:
    stored = existing.select("study_instance_uid").filter("study_instance_uid IS NOT NULL").distinct()
    return files.select("study_instance_uid").filter("study_instance_uid IS NOT NULL").distinct().join(stored, "study_instance_uid", "left_anti")


def with_scan(files: DataFrame, by_subfolder: bool = True) -> DataFrame:
    """scan_id: the first folder of the path, '.' for files at the root or when subfolders are not told apart."""
    top = F.when(F.instr("file_path", "/") > 0, F.split("file_path", "/")[0]).otherwise(".")
    return files.withColumn("scan_id", top if by_subfolder else F.lit("."))


def ingest_report(files: DataFrame, existing: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """Per scan: files stored, duplicates, unreadable ones, studies that are new and studies known before."""
    kept = dedup_series(files).select("file_path").withColumn("first", F.lit(True))
    stored = existing.select("series_instance_uid").filter("series_instance_uid IS NOT NULL").distinct().withColumn("stored", F.lit(True))
    known = existing.select("study_instance_uid").filter("study_instance_uid IS NOT NULL").distinct().withColumn("known", F.lit(True))
    marked = with_scan(files).select("scan_id", "file_path", "series_instance_uid", "study_instance_uid").join(kept, "file_path", "left").join(stored, "series_instance_uid", "left").join(known, "study_instance_uid", "left")
    fresh = F.coalesce("first", F.lit(False)) & F.col("stored").isNull()
    report = marked.groupBy("scan_id").agg(
        F.count_if(fresh).alias("processed"),
        F.count_if(~fresh).alias("duplicates"),
        F.count_distinct(F.when(F.col("known").isNull(), F.col("study_instance_uid"))).alias("new_studies"),
        F.count_distinct(F.when(F.col("known"), F.col("study_instance_uid"))).alias("known_studies"),
    )
    if invalid is None:
        return report.withColumn("invalid", F.lit(0).cast("long"))
    bad = with_scan(invalid).groupBy("scan_id").agg(F.count("*").alias("invalid"))
    return report.join(bad, "scan_id", "full").na.fill(0)


def prune(series: DataFrame, representatives: DataFrame) -> DataFrame:
    """Representatives with the flag; everything when there are none."""
    if representatives.isEmpty():
        return series.withColumn("representative_flag", F.lit(0))
    return series.join(representatives.select("series_instance_uid"), "series_instance_uid", "left_semi").withColumn("representative_flag", F.lit(1))


def prune_report(series: DataFrame, representatives: DataFrame) -> DataFrame:
    flagged = series.select("series_instance_uid").join(representatives.select("series_instance_uid").withColumn("rep", F.lit(1)), "series_instance_uid", "left")
    return flagged.agg(F.count("*").alias("stored"), F.count("rep").alias("kept"), F.count_if(F.col("rep").isNull()).alias("dropped"))


def prune_tags(tags: DataFrame, representatives: DataFrame, keep_unknown: bool = False) -> DataFrame:
    """Tags of representatives; ``keep_unknown`` keeps those without a series too."""
    kept = tags.join(representatives.select("series_instance_uid"), "series_instance_uid", "left_semi").select(*tags.columns)
    return kept.unionByName(tags.filter("series_instance_uid IS NULL")) if keep_unknown else kept


def dropped_tags(tags: DataFrame, representatives: DataFrame) -> DataFrame:
    return tags.join(representatives.select("series_instance_uid"), "series_instance_uid", "left_anti").select(*tags.columns)


def delete_study(series: DataFrame, tags: DataFrame, study: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables without the study, and how many series went."""
    gone = F.col("study_instance_uid").eqNullSafe(F.lit(study))
    left = series.filter(~gone)
    return left, tags.join(series.filter(gone).select("file_path"), "file_path", "left_anti").select(*tags.columns), series.agg(F.count_if(gone).alias("deleted"))
