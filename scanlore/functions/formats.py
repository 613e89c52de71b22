"""Column functions that make display text.

Numbers are rounded the way Python prints them, from the exact binary value and
half to even, which no built-in does; that one step is an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import UNITS_LIMIT, _c, filled, parse_double, strip

# Unit and decimals of exported numbers.
NUMERIC_FORMATS = {
    "patient_weight": ("kg", 2),
    "patient_size": ("m", 2),
    "slice_thickness": ("mm", 2),
    "reconstruction_diameter": ("mm", 2),
    "spiral_pitch_factor": (None, 3),
    "ctdivol": ("mGy", 2),
    "dlp": ("mGy*cm", 2),
    "kvp": ("kVp", 1),
    "exposure_time": ("ms", 2),
    "tube_current": ("mA", 2),
    "frame_time": ("ms", 2),
    "radiopharmaceutical_volume": ("ml", 2),
    "radionuclide_total_dose": ("MBq", 2),
    "half_life": ("s", 2),
}


@F.pandas_udf(StringType())
def _exact(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for values, places in batches:
        yield pd.Series([None if pd.isna(v) else f"{v:.{int(p)}f}" for v, p in zip(values, places, strict=True)], dtype=object)


def exact_number(c, places: int) -> Column:
    return _exact(_c(c).cast("double"), F.lit(places))


def format_date(c="study_date") -> Column:
    """YYYYMMDD as DD/MM/YYYY; shorter text as it is."""
    d = _c(c)
    return F.when(F.length(d) >= 8, F.concat_ws("/", F.substring(d, 7, 2), F.substring(d, 5, 2), F.substring(d, 1, 4))).otherwise(d)


def format_time(c="study_time") -> Column:
    """HHMMSS as HH:MM:SS with the first digit of a fraction."""
    t = strip(c)
    fraction = F.substring(F.regexp_extract(t, r"\.(.*)$", 1), 1, 1)
    clock = F.concat_ws(":", F.substring(t, 1, 2), F.substring(t, 3, 2), F.substring(t, 5, 2))
    return F.when(F.length(t) < 6, t).when((F.length(t) > 6) & (fraction != ""), F.concat(clock, F.lit("."), fraction)).otherwise(clock)


def format_private_timestamp(c) -> Column:
    """Six known forms of dates and times in display form; other text as it is, blank text null."""
    v = strip(c)
    american = F.coalesce(F.try_to_timestamp(v, F.lit("M/d/yyyy h:mm:ss a")), F.try_to_timestamp(v, F.lit("M/d/yyyy H:mm:ss")))
    iso = F.regexp_replace(F.substring(v, 1, 19), "T", " ")
    return (
        F.when(v == "", F.lit(None))
        .when(v.rlike(r"^\d{8}$"), format_date(v))
        .when(v.rlike(r"^\d{14}(\.\d+)?$"), F.concat_ws(" ", format_date(F.substring(v, 1, 8)), format_time(F.substring(v, 9, 1000))))
        .when(v.rlike(r"^\d{6}(\.\d+)?$"), format_time(v))
        .when(v.rlike(r"^\d{2}:\d{2}:\d{2}(\.\d+)?$"), F.substring(v, 1, 10))
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d+)?$"), F.when(F.try_to_timestamp(iso).isNotNull(), iso).otherwise(v))
        .when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}(\s*[AP]M)?$"), F.coalesce(F.date_format(american, "yyyy-MM-dd HH:mm:ss"), v))
        .otherwise(v)
    )


def format_delay(minutes) -> Column:
    m = _c(minutes)
    rest = F.concat(F.lit(" ("), exact_number(m, 0), F.lit(" min)"))
    return F.when(m < 60, F.concat(exact_number(m, 1), F.lit(" minutes"))).when(m < 1440, F.concat(exact_number(m / 60, 1), F.lit(" hours"), rest)).otherwise(F.concat(exact_number(m / 1440, 1), F.lit(" days"), rest))


def format_patient_name(c="patient_name") -> Column:
    """Parts between carets joined by spaces; of an anonymous name the first two."""
    text = strip(c)
    parts = F.filter(F.split(text, r"\^"), lambda x: x != "")
    anonymous = (F.size(parts) >= 2) & (F.lower(F.get(parts, 0)) == "anonymous")
    shown = F.when(anonymous, F.slice(parts, 1, 2)).otherwise(parts)
    return F.coalesce(F.when(F.size(parts) > 0, F.array_join(shown, " ")).otherwise(text), F.lit(""))


def format_with_unit(name: str, c=None) -> Column:
    unit, places = NUMERIC_FORMATS[name]
    number = exact_number(parse_double(name if c is None else c), places)
    return F.coalesce(F.concat(number, F.lit(f" {unit}")) if unit else number, F.lit(""))


def format_activity(c="injected_activity", unit=None) -> Column:
    a = parse_double(c)
    mbq = F.concat(exact_number(F.when(a > UNITS_LIMIT, a / UNITS_LIMIT).otherwise(a), 2), F.lit(" MBq"))
    if unit is None:
        return F.coalesce(mbq, F.lit(""))
    named = strip(_c(unit))
    return F.coalesce(F.when(filled(named), F.concat_ws(" ", exact_number(a, 2), named)).otherwise(mbq), F.lit(""))


def format_dose_per_kg(c) -> Column:
    return F.coalesce(F.concat(exact_number(c, 2), F.lit(" MBq/kg")), F.lit(""))
