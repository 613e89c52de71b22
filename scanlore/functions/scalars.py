"""Column functions: values, times, uptake delays, doses and derived quantities.

All are expressions on columns, so they stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modalities that image a radioactive tracer.
RADIOPHARM = ("PT", "PET", "NM", "SPECT", "NM/CT", "PET/CT", "SPECT/CT")
UNITS_LIMIT = 1e6
TOO_LONG_MINUTES = 240


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c) -> Column:
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def filled(c) -> Column:
    """Neither null nor empty."""
    return F.coalesce(_c(c) != "", F.lit(False))


def first_filled(*cs) -> Column:
    return F.coalesce(*(F.when(_c(c) != "", _c(c)) for c in cs))


def first_nonzero(*cs) -> Column:
    """The first number that is neither null nor zero, else the last."""
    *head, last = map(_c, cs)
    return F.coalesce(*(F.when(c != 0, c) for c in head), last)


def safe_text(c) -> Column:
    return F.nullif(strip(c), F.lit(""))


def parse_double(c) -> Column:
    """Text as a number the way Python reads it; NaN from stored numbers counts as missing."""
    text = strip(_c(c).cast("string"))
    number = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    named = r"^(?i)[+-]?(inf|infinity)$"
    value = F.when(text.rlike(number), F.replace(text, F.lit("_"), F.lit("")).try_cast("double")).when(text.rlike(named), F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def number(c) -> Column:
    """A stored number; NaN counts as missing."""
    c = _c(c).cast("double")
    return F.when(~F.isnan(c), c)


def parse_int(c) -> Column:
    text = strip(_c(c).cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def time_hms(c) -> Column:
    """Hours, minutes and seconds as a struct; null where there are not six digits before a point. No range check."""
    text = F.substring_index(strip(c), ".", 1)
    part = lambda at: F.substring(text, at, 2).try_cast("int")
    return F.when(text.rlike(r"^\d{6}"), F.struct(part(1).alias("h"), part(3).alias("m"), part(5).alias("s")))


def time_seconds(c) -> Column:
    """Seconds since midnight with their fraction."""
    hms, fraction = time_hms(c), F.regexp_extract(strip(c), r"^[^.]*\.(\d+)", 1)
    return hms["h"] * 3600 + hms["m"] * 60 + hms["s"] + F.coalesce(F.concat(F.lit("0."), F.nullif(fraction, F.lit(""))).try_cast("double"), F.lit(0.0))


def moment(date, time) -> Column:
    """Date and time as a timestamp without zone; null where there is no such moment."""
    d, t = strip(date), F.substring_index(strip(time), ".", 1)
    part = lambda text, at, n=2: F.substring(text, at, n).try_cast("int")
    second = F.when((F.length(t) >= 6) & (part(t, 5) <= 59), part(t, 5).cast("decimal(8,6)"))
    return F.try_make_timestamp_ntz(part(d, 1, 4), part(d, 5), F.when(F.length(d) >= 8, part(d, 7)), part(t, 1), part(t, 3), second)


def _moments(injection_date, injection_time, acquisition_date, acquisition_time, study_date):
    return moment(first_filled(injection_date, study_date), injection_time), moment(first_filled(acquisition_date, study_date), acquisition_time)


TIMES = ("injection_date", "injection_time", "acquisition_date", "acquisition_time", "study_date")


def delay_signed(*columns) -> Column:
    """Minutes from injection to acquisition; each date falls back to the study's."""
    injected, acquired = _moments(*(columns or TIMES))
    return F.timestamp_diff("SECOND", injected, acquired) / F.lit(60.0)


def delay_nonneg(*columns) -> Column:
    d = delay_signed(*columns)
    return F.when(d >= 0, d)


def delay_positive(*columns) -> Column:
    d = delay_signed(*columns)
    return F.when(d > 0, d)


def delay_status(*columns, signed=None) -> Column:
    """How the delay can be told; ``signed`` is a column that holds it already."""
    injection_date, injection_time, acquisition_date, acquisition_time, study_date = columns or TIMES
    there = filled(injection_time) & filled(acquisition_time) & (filled(injection_date) | filled(study_date)) & (filled(acquisition_date) | filled(study_date))
    d = delay_signed(*columns) if signed is None else _c(signed)
    return F.when(~there, "missing").when(d.isNull(), "parse_fail").when(d < 0, "negative").when(d > TOO_LONG_MINUTES, "too_long").otherwise("ok")


def weight_best(weight="patient_weight", study_weight="study_patient_weight", size="patient_size") -> Column:
    """Own weight, else the study's, else a size that can only be kilograms."""
    w, s, h = number(weight), number(study_weight), number(size)
    return F.coalesce(F.when(w > 0, w), F.when(s > 0, s), F.when((h > 10) & (h <= 500), h))


def activity_mbq(activity="injected_activity") -> Column:
    a = number(activity)
    return F.when(a > UNITS_LIMIT, a / UNITS_LIMIT).otherwise(a)


def dose_ingest(activity="injected_activity", weight="patient_weight", study_weight="study_patient_weight") -> Column:
    w, s = number(weight), number(study_weight)
    used = F.when(w > 0, w).otherwise(s)
    return F.when(used > 0, activity_mbq(activity) / used)


def dose_listing(activity="injected_activity", study_weight="study_patient_weight") -> Column:
    """Activity by study weight; the unit is judged on the quotient."""
    w = number(study_weight)
    q = F.when(w > 0, number(activity) / w)
    x = F.when(q > UNITS_LIMIT, q / UNITS_LIMIT).otherwise(q)
    return F.when((x > 0) & (x < 100), x)


def dose_plausibility(activity="injected_activity", **weights) -> Column:
    return activity_mbq(activity) / weight_best(**weights)


def dose_dashboard(activity="injected_activity", **weights) -> Column:
    x = dose_plausibility(activity, **weights)
    return F.when((x > 0) & (x < 100), x)


def activity_per_kg_raw(activity="injected_activity", study_weight="study_patient_weight") -> Column:
    w = number(study_weight)
    return F.when(w > 0, number(activity) / w)


def activity_at_scan(activity="injected_activity", half_life="half_life", minutes=None) -> Column:
    """Activity left after the delay, in becquerels; nothing where an input is missing or zero."""
    a, t = _c(activity), _c(half_life)
    d = delay_nonneg() if minutes is None else _c(minutes)
    start = F.when(a < UNITS_LIMIT, a * UNITS_LIMIT).otherwise(a)
    return F.when((a != 0) & (t != 0) & (d != 0), start * F.exp(-F.log(F.lit(2.0)) / t * d * 60))


def decay_percent(activity="injected_activity", at_scan=None) -> Column:
    a = _c(activity)
    start = F.when(a < UNITS_LIMIT, a * UNITS_LIMIT).otherwise(a)
    return (1 - (activity_at_scan(activity) if at_scan is None else _c(at_scan)) / start) * 100


def bmi(weight="patient_weight", size="patient_size") -> Column:
    w, h = number(weight), number(size)
    return F.when((w > 0) & (h > 0), w / (h * h))


def height_cm(size="patient_size") -> Column:
    return number(size) * 100


def likely_next_day(study_time="study_time", acquisition_time="acquisition_time") -> Column:
    return F.coalesce((time_hms(study_time)["h"] >= 22) & (time_hms(acquisition_time)["h"] <= 6), F.lit(False))


def time_conflict(study_time="study_time", series_time="series_time", minutes: float = 120) -> Column:
    return F.coalesce(F.abs(time_seconds(series_time) - time_seconds(study_time)) / 60 > minutes, F.lit(False))


def is_radiopharm(modality="modality") -> Column:
    return F.coalesce(F.upper(F.trim(_c(modality))).isin(*RADIOPHARM), F.lit(False))


def is_radiopharm_exact(modality="modality") -> Column:
    return F.coalesce(_c(modality).isin(*RADIOPHARM), F.lit(False))


def has_radiopharm(tracer="radiopharmaceutical") -> Column:
    return filled(tracer)


def age_years_digits(age="patient_age") -> Column:
    return F.regexp_replace(_c(age), r"[^0-9]", "").try_cast("int")


def _day(date) -> Column:
    d = strip(date)
    made = F.try_make_timestamp_ntz(F.substring(d, 1, 4).try_cast("int"), F.substring(d, 5, 2).try_cast("int"), F.substring(d, 7, 2).try_cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(8,6)"))
    return F.when(d.rlike(r"^\d{8}"), made.cast("date"))


def age_at_study(birth="patient_birth_date", study="study_date") -> Column:
    return F.datediff(_day(study), _day(birth)) / F.lit(365.25)


def epoch_days(date="study_date") -> Column:
    return F.unix_date(_day(date))


def decimal_places(text: str | None) -> int:
    """Places a filter value is given with."""
    text = (text or "").strip()
    return len(text.split(".", 1)[1]) if "." in text else 0
