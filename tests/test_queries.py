"""Queries against their SQL, and what must hold of the operators on any input."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from scanlore import catalog
from scanlore.operators import dashboard, export, filters, representative, store, studies

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{t}')")
    return con


@pytest.mark.parametrize("name", ["dedup_series", "representative_ingest", "study_list", "filter_combine", "modality_summary", "completeness", "dose_histogram", "pipeline_provenance", "study_detail", "export_grouped", "csa_elements", "stream_ingest"])
def test_against_sql(spark, other, name):
    rows = catalog.QUERIES[name](spark, SF)
    want = other.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(rows.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in rows.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    assert sum(r.n for r in __spark_entry__.entry(spark).collect()) == catalog.rep(spark, SF).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_invariants(spark):
    own = catalog.series(spark, SF).cache()
    rep = representative.enriched(own).cache()
    assert rep.count() == rep.select("study_instance_uid").distinct().count()
    assert store.dedup_series(own).count() == own.count()
    for column, hist in (("delay_minutes", dashboard.uptake_histogram(rep)), ("dose_dashboard", dashboard.dose_histogram(rep))):
        assert hist.agg(F.sum("n")).first()[0] == rep.filter(F.col(column).isNotNull()).count()
    both = filters.filter_combine(filters.qa_score_filter(rep, 4), filters.timing_filter(rep, "ok"))
    assert set(both.collect()) == set(filters.qa_score_filter(rep, 4).collect()) & set(filters.timing_filter(rep, "ok").collect())


def test_null_keys_and_ties(spark):
    pick = random.Random(1)
    base = catalog.series(spark, SF)
    rows = [r.asDict() for r in base.limit(40).collect()]
    for i, r in enumerate(rows):
        r["file_path"] = f"p{pick.random()}"
        r["series_instance_uid"] = None if i % 3 == 0 else f"s{i % 5}"
        r["study_instance_uid"] = None if i % 4 == 0 else f"u{i % 2}"
    table = spark.createDataFrame(rows, base.schema)
    kept = store.dedup_series(table).collect()
    assert sum(r.series_instance_uid is None for r in kept) == sum(r["series_instance_uid"] is None for r in rows)
    first = {}
    for r in sorted(rows, key=lambda r: r["file_path"]):
        first.setdefault(r["series_instance_uid"], r["file_path"])
    assert all(r.file_path == first[r.series_instance_uid] for r in kept if r.series_instance_uid)
    assert {r.study_instance_uid for r in representative.representative_query(table).collect()} <= {"u0", "u1"}


def test_match_score(spark):
    rows = [("1", "Doe Jane", "P1", "PT", "study", "ACME", None), ("2", "", None, "pt", None, None, None), ("3", "abcdefgx", None, None, None, None, None), ("4", None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "study_instance_uid string, patient_name string, patient_id string, modality string, study_description string, manufacturer string, radiopharmaceutical string")
    score = lambda term: {r.study_instance_uid: (round(r.match_score, 6), r.match_field) for r in studies.match_score(table, term).collect()}
    assert score(" PT ")["1"] == (1.0, "modality") and score("pt")["4"] == (0.5, None)
    assert score("jane")["1"] == (0.95, "patient_name")
    assert score("abcdefgh")["3"] == (0.875, "patient_name")
    assert score("pt scan")["2"] == (0.9, "modality")


def test_export_sections(spark):
    text = spark.createDataFrame([("u", 1, "N", "a"), ("u", 2, "N", "b"), ("u", 3, "M", "c")], "study string, place int, patient_id string, modality string")
    assert [r.patient_id for r in export.blank_repeats(text).orderBy("place").collect()] == ["N", "", "M"]
    assert [(r.place, r.patient_id, r.modality) for r in export.sectioned(text).orderBy("place").collect()] == [(0, "N", ""), (1, "", "a"), (2, "", "b"), (3, "", "c")]
    assert export.selected(["modality", "patient_id", "nonsense"]) == ["patient_id", "modality"] and export.selected([]) == export.DEFAULTS
    assert len(export.ORDER) == 73
