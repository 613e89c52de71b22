"""Edge rows of the column functions; expected values are worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from scanlore.functions import formats as f
from scanlore.functions import scalars as s


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text,want", [("1.5", 1.5), (" 1_000 ", 1000.0), ("1.0d", None), ("12f", None), ("0x1p3", None), ("", None), (None, None), ("-2e3", -2000.0), (".5", 0.5), ("5.", 5.0), ("inf", float("inf")), ("nan", None), ("1__0", None)])
def test_parse_double(spark, text, want):
    assert one(spark, s.parse_double("t"), t=text) == want


@pytest.mark.parametrize("text,want", [("3", 3), ("3.0", None), (" 7 ", 7), ("x", None)])
def test_parse_int(spark, text, want):
    assert one(spark, s.parse_int("t"), t=text) == want


@pytest.mark.parametrize("date,time,want", [
    ("20240115", "101500", datetime.datetime(2024, 1, 15, 10, 15)),
    ("20240115", "101559.9", datetime.datetime(2024, 1, 15, 10, 15, 59)),
    ("20240115", "101560", None), ("20240230", "101500", None), ("20240115", "991500", None),
    ("20240115", "0915", None), ("20240115", "09150", None), ("2024011", "101500", None), ("20240115", "bad", None), (None, "101500", None),
])
def test_moment(spark, date, time, want):
    assert one(spark, s.moment("d", "t"), d=date, t=time) == want


@pytest.mark.parametrize("inj,acq,signed,status", [
    (("20240115", "100000"), ("20240115", "110000"), 60.0, "ok"),
    ((None, "235000"), ("20240116", "001000"), 20.0, "ok"),
    (("20240115", "100000"), ("20240115", "093000"), -30.0, "negative"),
    (("20240115", "000000"), ("20240115", "040001"), 240 + 1 / 60, "too_long"),
    (("20240115", "bad"), ("20240115", "093000"), None, "parse_fail"),
    (("20240115", ""), ("20240115", "093000"), None, "missing"),
])
def test_delays(spark, inj, acq, signed, status):
    row = dict(injection_date=inj[0], injection_time=inj[1], acquisition_date=acq[0], acquisition_time=acq[1], study_date="20240115")
    assert one(spark, s.delay_status(), **row) == status
    found = one(spark, s.delay_signed(), **row)
    assert found == signed or abs(found - signed) < 1e-9
    assert (one(spark, s.delay_nonneg(), **row) is None) == (signed is None or signed < 0)
    assert (one(spark, s.delay_positive(), **row) is None) == (signed is None or signed <= 0)


def test_doses_differ_by_where_they_judge_the_unit(spark):
    row = dict(injected_activity=5e7, patient_weight=float("nan"), study_patient_weight=80.0, patient_size=1.7)
    assert one(spark, s.dose_ingest(), **row) == 0.625
    assert one(spark, s.dose_listing(), **row) is None
    assert one(spark, s.dose_plausibility(), **row) == 0.625
    assert one(spark, s.activity_per_kg_raw(), **row) == 625000
    assert one(spark, s.weight_best(), **(row | {"study_patient_weight": 0.0, "patient_size": 72.0})) == 72
    assert one(spark, s.dose_dashboard(), **(row | {"injected_activity": 9000.0, "study_patient_weight": 80.0})) is None


def test_decay(spark):
    row = dict(injected_activity=300.0, half_life=6586.0, d=6586 / 60)
    assert abs(one(spark, s.activity_at_scan(minutes=F.col("d")), **row) - 1.5e8) < 1
    assert abs(one(spark, s.decay_percent(at_scan=s.activity_at_scan(minutes=F.col("d"))), **row) - 50) < 1e-6
    assert one(spark, s.activity_at_scan(minutes=F.col("d")), **(row | {"d": 0.0})) is None


def test_small_ones(spark):
    assert one(spark, s.age_years_digits("a"), a="003M") == 3
    assert one(spark, s.time_conflict("a", "b"), a="080000", b="100001") is True
    assert one(spark, s.time_conflict("a", "b"), a="080000", b="bad") is False
    assert one(spark, s.likely_next_day("a", "b"), a="2230", b="050000") is False
    assert one(spark, s.likely_next_day("a", "b"), a="223000", b="050000") is True
    assert one(spark, s.is_radiopharm("m"), m=" pt ") is True
    assert one(spark, s.is_radiopharm_exact("m"), m="pt") is False
    assert one(spark, s.time_seconds("t"), t="000010.25") == 10.25
    assert one(spark, s.epoch_days("d"), d="19700102") == 1
    assert abs(one(spark, s.age_at_study("b", "d"), b="20000101", d="20200101") - 7305 / 365.25) < 1e-9
    assert one(spark, s.first_nonzero("a", "b"), a=0.0, b=2.0) == 2
    assert s.decimal_places("90.50") == 2 and s.decimal_places("90") == 0


@pytest.mark.parametrize("name,value,want", [
    ("format_date", "20240115", "15/01/2024"), ("format_date", "2024", "2024"),
    ("format_time", "101500.25", "10:15:00.2"), ("format_time", "101500", "10:15:00"), ("format_time", "1015", "1015"),
    ("format_patient_name", "Anonymous^00012^^^", "Anonymous 00012"), ("format_patient_name", "Doe^Jo^M", "Doe Jo M"), ("format_patient_name", None, ""),
    ("format_private_timestamp", "20240115101500.5", "15/01/2024 10:15:00.5"), ("format_private_timestamp", "20240115", "15/01/2024"),
    ("format_private_timestamp", "2024-01-15T10:15:00.12", "2024-01-15 10:15:00"), ("format_private_timestamp", "1/5/2024 3:04:05 PM", "2024-01-05 15:04:05"), ("format_private_timestamp", "other", "other"),
])
def test_text(spark, name, value, want):
    assert one(spark, getattr(f, name)("x"), x=value) == want


@pytest.mark.parametrize("value,places,want", [(0.125, 2, "0.12"), (2.675, 2, "2.67"), (2.5, 0, "2"), (1e22, 1, "10000000000000000000000.0")])
def test_numbers_print_as_their_exact_value(spark, value, places, want):
    assert one(spark, f.exact_number("x", places), x=value) == want


def test_units(spark):
    assert one(spark, f.format_activity("x"), x=3.7e8) == "370.00 MBq"
    assert one(spark, f.format_with_unit("kvp", F.col("x")), x=120.0) == "120.0 kVp"
    assert one(spark, f.format_delay("x"), x=90.0) == "1.5 hours (90 min)"
    assert one(spark, f.format_delay("x"), x=1500.0) == "1.0 days (1500 min)"
