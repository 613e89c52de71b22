"""Ingest over several batches, exports to files, archives, vendor headers and scratch tables."""

import io
import json
import os
import zipfile

from scanlore import scratch
from scanlore.operators import dashboard, detail, export, filters, store
from scanlore.sources import archives, headers, vendor
from scanlore.streaming import ingest


def _header(study, series, number):
    uid = [(headers.TAGS["series_instance_uid"], "UI", series)] if series else []
    return headers.write_header([(headers.TAGS["study_instance_uid"], "UI", study), *uid, (headers.TAGS["series_number"], "IS", number)])


def test_batches_are_appended_once(spark, tmp_path):
    parts = [
        [("b.dcm", "1", "1.1"), ("c.dcm", "1", "1.1"), ("x.dcm", "1", None)],
        [("a.dcm", "1", "1.1"), ("d.dcm", "2", "2.1"), ("x.dcm", "1", None), ("._d.dcm", "9", "9.9")],
        [("e.dcm", "2", "2.1"), ("f.dcm", "3", "3.1"), ("y.dcm", "3", None)],
        [("d.dcm", "2", "2.1"), ("y.dcm", "3", None)],
    ]
    schema = "path string, content binary"
    for part in parts:
        rows = [(p, _header(u, s, 1)) for p, u, s in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest.ingest_stream(source, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    found = sorted(r.file_path for r in spark.read.parquet(f"{tmp_path}/out").collect())
    # the first that came gives 1.1 its file, though a.dcm has the smaller path; files without a series are told by their path
    assert found == ["b.dcm", "d.dcm", "f.dcm", "x.dcm", "y.dcm"]
    ingest.append_new(spark.createDataFrame([("b.dcm", _header("1", "1.1", 1)), ("x.dcm", _header("1", None, 1))], schema), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_files_in_folders(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in/sub")
    for name, series in (("one.dcm", "1.1"), ("sub/two.dcm", "1.2"), ("sub/three.txt", "1.3")):
        with open(f"{tmp_path}/in/{name}", "wb") as out:
            out.write(_header("1", series, 1))
    ingest.stream_ingest(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert sorted(r.series_instance_uid for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1.1", "1.2"]


def test_report_counts_unreadable_files(spark):
    kinds = "file_path string, series_instance_uid string, study_instance_uid string"
    files = spark.createDataFrame([("s/a", "1", "u"), ("s/b", "1", "u"), ("t/c", "2", "v")], kinds)
    invalid = spark.createDataFrame([("s/z", "not a header"), ("w/q", "not a header")], "file_path string, error string")
    report = {r.scan_id: (r.processed, r.duplicates, r.new_studies, r.known_studies, r.invalid) for r in store.ingest_report(files, files.limit(0), invalid).collect()}
    assert report == {"s": (1, 1, 1, 0, 1), "t": (1, 0, 1, 0, 0), "w": (0, 0, 0, 0, 1)}


def test_archives_leave_in_batches(spark, monkeypatch):
    monkeypatch.setattr(archives, "BATCH_BYTES", 100)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for i in range(40):
            out.writestr(f"d/{i}.dcm", b"x" * i)
        out.writestr("d/._1.dcm", b"junk")
        out.writestr("__MACOSX/2.dcm", b"junk")
        out.writestr("readme.txt", b"text")
    table = spark.createDataFrame([("a.zip", packed.getvalue()), ("bad.zip", b"PK not"), ("none.zip", None)], "path string, content binary")
    found = {(r.archive, r.member): len(r.content) for r in archives.expand_archive(table).collect()}
    assert found == {("a.zip", f"d/{i}.dcm"): i for i in range(40)}


def test_exports_to_files(spark, tmp_path):
    text = spark.createDataFrame([("u1", 1, "N", "1.70 m", "d"), ("u1", 2, "", "", 'e "x", y'), ("u2", 1, "M", "", "")], "study string, place int, patient_id string, patient_size string, series_description string")
    export.write_csv(text, f"{tmp_path}/csv")
    read = spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/csv")
    assert set(read.columns) == {"Patient Id", "Patient Height", "Description", "study"}
    assert read.filter("study = 'u1'").count() == 2
    assert export.labels(["series_instance_uid", "created_at", "modality"]) == ["Series Uid", "Export Created At", "Modality"]

    series = spark.createDataFrame([("f1", "s1", "PT"), ("f2", "s2", "CT")], "file_path string, series_instance_uid string, modality string")
    tags = spark.createDataFrame([("f1", "0013", "1010"), ("f1", "0013", "1013")], "file_path string, group_hex string, element_hex string")
    export.json_dump(series, tags, f"{tmp_path}/json")
    lines = [json.loads(x) for name in os.listdir(f"{tmp_path}/json") if name.endswith(".json") for x in open(f"{tmp_path}/json/{name}")]
    assert {x["file_path"]: len(x.get("private_tags", [])) for x in lines} == {"f1": 2, "f2": 0}
    assert [r.file_path for r in detail.series_lookup(series, "s2").collect()] == ["f2"] and detail.series_lookup(series, "s3").count() == 0


def test_vendor_header_as_json(spark):
    raw = {"a": vendor.write_csa([("One", "LO", ["x", "y"]), ("Two", "IS", [])], True), "b": vendor.write_csa([("One", "LO", ["z"])], False), "c": None}
    payloads = spark.createDataFrame(list(raw.items()), "file_path string, value_bytes binary")
    found = {r.file_path: json.loads(r.elements) for r in vendor.csa_json(vendor.csa_elements(payloads), payloads).collect()}
    assert {k: (v["format"], v["element_count"]) for k, v in found.items()} == {"a": ("CSA2", 2), "b": ("CSA1", 1)}
    assert found["a"]["elements"]["One"] == {"vr": "LO", "vm": 2, "values": ["x", "y"]}


def test_issues_agree_with_the_filters(spark):
    kinds = "study_instance_uid string, modality string"
    series = spark.createDataFrame([("u1", "PT"), ("u2", "CT"), ("u2", "PT"), ("u3", "CT"), (None, "CT")], kinds)
    found = {}
    for r in filters.composition_issues(series).collect():
        found.setdefault(r.issue, set()).add(r.study_instance_uid)
    for issue in ("missing_ct", "missing_pt", "high_series"):
        assert found.get(issue, set()) == {r.study_instance_uid for r in filters.composition_filter(series, issue).collect()}


def test_trial_studies_are_counted(spark):
    kinds = "study_instance_uid string, ctp_collection string, " + ", ".join(f"{c} {'double' if c in ('patient_weight', 'patient_size') else 'string'}" for c in dashboard.SUMMARY)
    nothing = [None] * len(dashboard.SUMMARY)
    rows = [("u1", "C", *nothing), ("u1", None, *nothing), ("u2", "", *nothing), ("u3", None, *nothing)]
    counted = {r.metric: r.n for r in dashboard.demographics(spark.createDataFrame(rows, kinds)).collect()}
    assert counted["ctp flagged"] == 1


def test_scratch_tables_go(spark):
    table = scratch.save(spark.range(5), "five")
    kept = scratch.save(spark.range(5), "kept", keep=True)
    with scratch.Scratch(spark) as tmp:
        inner = tmp.save(spark.range(3), "three")
        assert inner.count() == 3
        paths = list(tmp.paths)
    assert not any(os.path.exists(p.removeprefix("file://")) for p in paths)
    assert table.count() == 5
    files = [p.removeprefix("file://") for p in table.inputFiles()]
    scratch.release(spark)
    assert files and not any(map(os.path.exists, files))
    assert kept.count() == 5
