"""Export of studies as ordered columns, with derived values, text forms and repeats left blank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats as f
from ..functions import scalars as s
from ..sources import study_files
from .filters import export_modality_filter
from .representative import best_series_per_study_modality

# Sections and their columns in order.
SECTIONS = {
    "patient": ["patient_name", "patient_id", "patient_birth_date", "patient_sex", "patient_age", "patient_weight", "patient_size", "bmi"],
    "study": ["study_instance_uid", "study_date", "study_time", "study_description", "study_id", "accession_number", "referring_physician_name"],
    "series": ["series_instance_uid", "series_number", "series_date", "series_time", "series_description", "protocol_name", "modality", "body_part_examined"],
    "manufacturer": ["manufacturer", "manufacturer_model_name", "station_name", "software_version", "device_serial_number", "institution_name", "institution_address"],
    "acquisition": ["acquisition_date", "acquisition_time", "patient_position", "scanning_sequence", "sequence_variant", "scan_options", "acquisition_type", "slice_thickness", "reconstruction_diameter", "reconstruction_algorithm", "convolution_kernel", "filter_type", "spiral_pitch_factor", "ctdivol", "dlp", "kvp", "exposure_time", "exposure", "tube_current"],
    "nuclear": ["radiopharmaceutical", "injected_activity", "injection_time", "injection_date", "half_life", "decay_correction", "radiopharmaceutical_volume", "radionuclide_total_dose", "uptake_delay", "dose_per_kg"],
    "image": ["image_type", "pixel_spacing", "image_orientation_patient", "slice_location", "number_of_frames", "frame_time", "number_of_slices"],
    "ctp": ["ctp_collection", "ctp_subject_id", "ctp_private_flag_raw", "ctp_private_flag_int"],
    "file": ["id", "file_path", "created_at"],
}
# What is exported when nothing is chosen.
DEFAULTS = [
    "patient_name", "patient_id", "patient_birth_date", "patient_weight", "patient_size", "study_date",
    "study_time", "series_number", "series_description", "modality", "acquisition_date", "acquisition_time",
    "radiopharmaceutical", "injected_activity", "injection_time", "injection_date",
]
# Columns whose heading is made of another name.
LABEL_NAMES = {
    "patient_size": "patient_height",
    "study_instance_uid": "study_uid",
    "referring_physician_name": "referring_physician",
    "series_instance_uid": "series_uid",
    "series_description": "description",
    "body_part_examined": "body_part",
    "manufacturer_model_name": "model",
    "institution_name": "institution",
    "id": "export_row_id",
    "created_at": "export_created_at",
}
ORDER = [x for names in SECTIONS.values() for x in names]
GROUP_FIELDS = SECTIONS["patient"] + SECTIONS["study"]
DERIVED = ("uptake_delay", "dose_per_kg", "bmi")
DATES = ("patient_birth_date", "study_date", "series_date", "acquisition_date", "injection_date")
#: Whether rows have to lie by all columns of a join, or may by some.
BY_SOME = "spark.sql.requireAllClusterKeysForCoPartition"
TIMES = ("study_time", "series_time", "acquisition_time", "injection_time")


def selected(requested: list[str] | None = None) -> list[str]:
    """Requested columns in the fixed order, else the defaults."""
    wanted = [x for x in ORDER if x in (requested or ())]
    return wanted or DEFAULTS


def labels(fields: list[str]) -> list[str]:
    """Headings of columns."""
    return [LABEL_NAMES.get(x, x).replace("_", " ").title() for x in fields]


def export_rows(series: DataFrame, modalities: list[str] | None = None) -> DataFrame:
    """Best series of each study and modality with the study's weight and size beside them and their place in the study."""
    rows = best_series_per_study_modality(export_modality_filter(series, modalities or []).filter("study_instance_uid IS NOT NULL"))
    info = series.groupBy("study_instance_uid").agg(F.max("patient_weight").alias("study_patient_weight"), F.max("patient_size").alias("study_patient_size"), F.max("study_date").alias("info_date"))
    place = F.row_number().over(_study_order())
    return rows.join(info, "study_instance_uid").withColumn("place", place)


def _study_order():
    return Window.partitionBy("study_instance_uid").orderBy(F.col("series_number").asc_nulls_first(), F.col("series_time").asc_nulls_first(), F.col("series_instance_uid").asc_nulls_first(), "file_path")


def export_derived(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Add the derived numbers among ``fields``."""
    delay = s.delay_nonneg("injection_date", "injection_time", "acquisition_date", "acquisition_time", "info_date")
    size = s.number(s.first_nonzero("patient_size", "study_patient_size"))
    made = {"uptake_delay": F.nullif(delay, F.lit(0.0)), "dose_per_kg": s.dose_dashboard(), "bmi": F.when(size > 0, s.weight_best() / (size * size))}
    return rows.withColumns({k: made[k] for k in DERIVED if k in fields})


def _present(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def export_numeric(series: DataFrame, requested: list[str], modalities: list[str] | None = None) -> DataFrame:
    """Values as they are; study and place say where a row stands."""
    fields = selected(requested)
    rows = export_derived(export_rows(series, modalities), fields)
    return rows.select(F.col("study_instance_uid").alias("study"), "place", *(_present(rows, x).alias(x) for x in fields))


def format_value(name: str, c: Column) -> Column:
    if name == "patient_name":
        text = f.format_patient_name(c)
    elif name in DATES:
        text = f.format_date(c)
    elif name in TIMES:
        text = f.format_time(c)
    elif name in ("injected_activity", "radionuclide_total_dose"):
        text = f.format_activity(c)
    elif name == "uptake_delay":
        text = f.format_delay(c)
    elif name == "dose_per_kg":
        text = f.format_dose_per_kg(c)
    elif name == "bmi":
        text = f.exact_number(c, 1)
    elif name in f.NUMERIC_FORMATS:
        text = f.format_with_unit(name, c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit(""))


def export_text(series: DataFrame, requested: list[str] | None = None, modalities: list[str] | None = None) -> DataFrame:
    """Every value in display form, null as empty text."""
    fields = selected(requested)
    plain = export_numeric(series, fields, modalities)
    return plain.select("study", "place", *(format_value(x, F.col(x)).alias(x) for x in fields))


def blank_repeats(text: DataFrame) -> DataFrame:
    """Patient and study values equal to those of the study's first row are left blank in later rows."""
    first = Window.partitionBy("study").orderBy("place")
    own = [x for x in GROUP_FIELDS if x in text.columns]
    return text.withColumns({x: F.when((F.col("place") > 1) & F.col(x).eqNullSafe(F.first(x).over(first)), F.lit("")).otherwise(F.col(x)) for x in own})


def sectioned(text: DataFrame) -> DataFrame:
    """Per study a row of patient and study values (place 0), then its rows without them."""
    own = [x for x in GROUP_FIELDS if x in text.columns]
    rest = [x for x in text.columns if x not in ("study", "place", *own)]
    if not own:
        return text
    head = text.filter("place = 1").withColumn("place", F.lit(0)).withColumns({x: F.lit("") for x in rest})
    return head.unionByName(text.withColumns({x: F.lit("") for x in own}))


def study_export_info(series: DataFrame) -> DataFrame:
    return series.groupBy("study_instance_uid").agg(*(F.max(c).alias(c) for c in ("patient_weight", "patient_size", "study_date", "study_time", "patient_name")))


def write_csv(text: DataFrame, path: str) -> None:
    """One folder for each study, header from the column names."""
    fields = [x for x in text.columns if x not in ("study", "place")]
    named = reduce(lambda d, x: d.withColumnRenamed(*x), zip(fields, labels(fields), strict=True), text)
    named.repartition("study").sortWithinPartitions("study", "place").drop("place").write.partitionBy("study").option("header", True).csv(path)


def write_study_files(text: DataFrame, path: str, mode: str = "append") -> None:
    """One CSV file for each study, many to a task; ``text`` may be ``sectioned``."""
    study_files.write_studies(text, labels([x for x in text.columns if x not in ("study", "place")]), path, mode)


def json_dump(series: DataFrame, tags: DataFrame, path: str, within: tuple[str, ...] = ()) -> None:
    """All columns with the private tags of each file nested, as compressed lines. ``within`` names columns that all files of
    a series agree on: rows that lie by these already on both sides are not shuffled."""
    spark, key = series.sparkSession, [*within, "file_path"]
    nested = tags.groupBy(*key).agg(F.collect_list(F.struct(*(c for c in tags.columns if c not in key))).alias("private_tags"))
    before = spark.conf.get(BY_SOME)
    spark.conf.set(BY_SOME, not within)
    try:
        series.join(nested, key, "left").write.option("compression", "gzip").json(path)
    finally:
        spark.conf.set(BY_SOME, before)
