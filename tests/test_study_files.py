"""Sectioned CSV files: the form byte by byte, one file for each study, and nothing left by what failed."""

import csv
import io
import os

import pytest
from pyspark.sql import functions as F

from scanlore.operators import export
from scanlore.sources import study_files

KINDS = "study string, place int, patient_id string, series_number string, modality string"
ROWS = [("1.2/3", 1, "P, \"one\"", "1", "PT"), ("1.2/3", 2, "P, \"one\"", "2", "CT"), ("1.9", 1, "Ä", "1", "line\nbreak"), ("1.10", 1, "", "", "")]


def found(path):
    return {name: open(os.path.join(at, name), "rb").read() for at, _, names in os.walk(path) for name in names if name.endswith(".csv")}


def plain(rows):
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue().encode()


def test_form_of_a_study(spark, tmp_path):
    header = export.labels(["patient_id", "series_number", "modality"])
    text = spark.createDataFrame(ROWS, KINDS).repartition(3)
    export.write_study_files(text, f"file://{tmp_path}/plain")
    assert found(f"{tmp_path}/plain") == {
        "1.2_3.csv": plain([header, ["P, \"one\"", "1", "PT"], ["P, \"one\"", "2", "CT"]]),
        "1.9.csv": plain([header, ["Ä", "1", "line\nbreak"]]),
        "1.10.csv": plain([header, ["", "", ""]]),
    }
    export.write_study_files(export.sectioned(text), f"{tmp_path}/sections")
    assert found(f"{tmp_path}/sections")["1.2_3.csv"] == plain([header, ["P, \"one\"", "", ""], [], ["", "1", "PT"], ["", "2", "CT"]])
    assert not os.path.exists(f"{tmp_path}/sections/{study_files.STAGING}")


def test_overwrite_and_append(spark, tmp_path):
    text = spark.createDataFrame(ROWS, KINDS)
    export.write_study_files(text, str(tmp_path / "x"))
    export.write_study_files(text.filter("study = '1.9'"), str(tmp_path / "x"), "overwrite")
    assert list(found(tmp_path / "x")) == ["1.9.csv"]
    export.write_study_files(text.filter("study = '1.10'"), str(tmp_path / "x"))
    assert sorted(found(tmp_path / "x")) == ["1.10.csv", "1.9.csv"]
    export.write_study_files(text.limit(0), str(tmp_path / "x"), "overwrite")
    assert found(tmp_path / "x") == {}


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    text = spark.createDataFrame(ROWS, KINDS)
    bad = text.withColumn("modality", F.when(F.col("study") == "1.9", F.raise_error(F.lit("on purpose"))).otherwise(F.col("modality")))
    with pytest.raises(Exception, match="on purpose"):
        export.write_study_files(bad, str(tmp_path / "x"))
    assert found(tmp_path / "x") == {} and not os.path.exists(tmp_path / "x" / study_files.STAGING)


def test_what_an_attempt_left_goes_with_the_commit(tmp_path):
    writer = study_files._Writer({"path": str(tmp_path / "x"), "header": '["A"]'}, ["study_file", "place", "a"], False)
    rows = [{"study_file": "s.csv", "place": 1, "a": "1"}]
    writer.write(iter(rows))  # an attempt whose message never came
    writer.commit([writer.write(iter(rows)), None, writer.write(iter([]))])
    assert found(tmp_path / "x") == {"s.csv": b"A\r\n1\r\n"} and len(os.listdir(tmp_path / "x")) == 1
