"""Headers, vendor headers, archives, tables and the stream, on files the tests write."""

import json
import struct
import zipfile

from pyspark.sql import functions as F

from scanlore.operators import private_tags, store
from scanlore.sources import archives, databank, headers, vendor
from scanlore.streaming import ingest


def header(n=1, explicit=True, **more):
    elements = [(0x0020000D, "UI", f"1.2.{n}"), (0x0020000E, "UI", f"1.2.{n}.1"), (0x00101030, "DS", " 70.5 "), (0x00080060, "CS", "PT"), (0x00080008, "CS", "A\\B"), (0x00280008, "IS", "12"), (0x00540016, "SQ", [[(0x00180031, "LO", "FDG"), (0x00181074, "DS", "3.5e8")]])]
    elements += [(0x00130010, "LO", "CTP"), (0x00131010, "LO", "TRIAL"), (0x00131015, "UN", struct.pack("<I", 258)), (0x00990010, "LO", "SD"), (0x00991001, "OB", bytes(range(200, 255)) * 6), (0x00991102, "LO", "a\\b")]
    elements += more.get("extra", [])
    return headers.write_header(elements, explicit)


def test_headers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    good = header() + struct.pack("<HH", 0x7FE0, 0x10) + b"OW\0\0" + struct.pack("<I", 4) + b"pix!"
    (tmp_path / "a.dcm").write_bytes(good)
    (tmp_path / "sub" / "b.dcm").write_bytes(header(2, False))
    (tmp_path / "cut.dcm").write_bytes(header()[:-3])
    (tmp_path / "no.dcm").write_bytes(b"hello")
    (tmp_path / "._x.dcm").write_bytes(b"junk")
    (tmp_path / "Z.DCM").write_bytes(header())
    found = headers.scan_files(spark, str(tmp_path))
    named = found.withColumn("path", headers.relative_path(F.col("path"), str(tmp_path)))
    elements = headers.parse_headers(named).cache()
    assert {r.file_path for r in headers.invalid_files(elements).collect()} == {"cut.dcm", "no.dcm"}
    rows = {r.file_path: r for r in headers.wide_projection(elements).collect()}
    assert set(rows) == {"a.dcm", "sub/b.dcm"}
    for r in rows.values():
        assert (r.patient_weight, r.modality, r.radiopharmaceutical, r.injected_activity, r.number_of_slices) == (70.5, "PT", "FDG", 3.5e8, 12)
    assert rows["a.dcm"].image_type == "A\\B" and rows["sub/b.dcm"].study_instance_uid == "1.2.2"
    ctp = {r.file_path: r for r in private_tags.ctp_columns(elements).collect()}
    assert (ctp["a.dcm"].ctp_collection, int(ctp["a.dcm"].ctp_private_flag_int)) == ("TRIAL", 258)
    files = headers.wide_projection(elements).withColumn("manufacturer", F.lit("ACME"))
    tags = {(r.file_path, r.group_hex, r.element_hex): r for r in private_tags.tag_rows(elements, files).collect()}
    assert tags["a.dcm", "0013", "1010"].classification == "pipeline_provenance"
    big = tags["a.dcm", "0099", "1001"]
    assert big.creator == "SD" and big.value_hex.endswith("...(len=330)") and big.value_len == 330
    assert tags["a.dcm", "0099", "1102"].creator == "Unknown" and tags["a.dcm", "0099", "1102"].value_text == "a, b"
    prints = private_tags.payload_fingerprint(private_tags.tag_rows(elements, files))
    assert prints.count() == 2


def test_nested_and_open_sequences():
    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + struct.pack("<HH", 0x18, 0x31) + b"LO" + struct.pack("<H", 4) + b"FDG " + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    data = headers.write_header([]) + struct.pack("<HH", 0x54, 0x16) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF) + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0) + struct.pack("<HH", 0x54, 0x1102) + b"CS" + struct.pack("<H", 4) + b"NONE"
    rows = headers.read_header(data)
    assert [(r[1], r[6]) for r in rows[1:]] == [("00540016[0]", ["FDG"]), ("", ["NONE"])]


def test_printable(spark):
    rows = [(b"a" * 89 + b"\x01" * 11,), (b"a" * 90 + b"\x01" * 10,), (b"abc\0\x01\x01",), (b"",)]
    found = [r[0] for r in spark.createDataFrame(rows, "b binary").select(private_tags.printable_ascii(F.col("b"))).collect()]
    assert found == [False, True, True, False]


def test_last_creator_wins(spark):
    rows = [("f", 0, "", 0x99, 0x10, "LO", None, ["ONE"]), ("f", 1, "", 0x99, 0x1001, "LO", None, ["x"]), ("f", 2, "/s[0]", 0x99, 0x10, "LO", None, ["TWO"]), ("f", 3, "", 0x99, 0x1101, "LO", None, ["y"])]
    table = spark.createDataFrame(rows, "file_path string, ordinal int, seq_path string, group int, element int, vr string, value_bytes binary, value_text array<string>")
    assert {(r.element, r.creator) for r in private_tags.creator_resolve(table).collect()} == {(0x1001, "TWO"), (0x1101, "Unknown")}


def test_empty_creators_name_nothing(spark):
    """The reference skips empty creators, at the top and nested, so an earlier name holds."""
    rows = [("f", 0, "", 0x99, 0x10, "LO", None, ["ACME"]), ("f", 1, "/s[0]", 0x99, 0x10, "LO", None, ["  "]), ("f", 2, "", 0x99, 0x10, "LO", None, None), ("f", 3, "", 0x99, 0x1001, "LO", None, ["x"]), ("f", 4, "", 0x99, 0x11, "LO", None, [""]), ("f", 5, "", 0x99, 0x1101, "LO", None, ["y"])]
    table = spark.createDataFrame(rows, "file_path string, ordinal int, seq_path string, group int, element int, vr string, value_bytes binary, value_text array<string>")
    assert {(r.element, r.creator) for r in private_tags.creator_resolve(table).collect()} == {(0x1001, "ACME"), (0x1101, "Unknown")}


def test_classes(spark):
    cases = [("CTP", None, None, "pipeline_provenance"), ("Varian", None, None, "rt_provenance"), ("SIEMENS CSA HEADER", None, None, "vendor_semantic"), ("x", "Siemens", None, "vendor_raw"), ("SD", None, None, "vendor_semantic"), ("IMAGE", None, None, "vendor_raw"), ("x", "CANON", None, "vendor_raw"), ("x", None, "t", "vendor_raw"), ("x", None, None, "unknown_binary")]
    table = spark.createDataFrame(cases, "c string, m string, t string, want string")
    kind = private_tags.tag_classify(F.col("c"), F.col("m"), F.col("t"), F.lit(None).cast("double"))
    assert table.filter(kind != F.col("want")).count() == 0


def test_vendor_headers(spark):
    elements = [("Name", "LO", ["a", "b"]), ("Empty", "IS", []), ("Name", "LO", ["last"])]
    good, old = vendor.write_csa(elements), vendor.write_csa(elements, False)
    past = vendor.write_csa([("Cut", "LO", ["value"])])[:-6]
    table = spark.createDataFrame([("new", good), ("old", old), ("past", past), ("none", None), ("junk", b"xy")], "file_path string, value_bytes binary")
    found = vendor.csa_elements(table)
    rows = {(r.file_path, r.name): r.value for r in found.collect()}
    assert rows == {(f, n): v for f in ("new", "old") for n, v in (("Name", "last"), ("Empty", None))} | {("past", "Cut"): None}
    text = {r.file_path: json.loads(r.elements) for r in vendor.csa_json(found).collect()}
    assert text["new"]["Name"]["values"] == ["last"]
    assert vendor.csa_hash(table).filter("csa_hash IS NULL").count() == 1


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/e/a.dcm", header())
        z.writestr("__MACOSX/d/._a.dcm", b"junk")
        z.writestr("note.txt", b"n")
    (tmp_path / "bad.zip").write_bytes(b"no")
    found = archives.expand_archive(headers.scan_files(spark, str(tmp_path), pattern="*.zip"))
    assert [r.member for r in found.collect()] == ["d/e/a.dcm"]


def test_databank(spark, tmp_path):
    rows = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "file_path string, w double")
    databank.write_databank(rows, rows.select("file_path"), str(tmp_path / "bank"))
    databank.write_databank(rows.withColumn("more", F.lit(1)), rows.select("file_path"), str(tmp_path / "bank"))
    series, tags = databank.read_databank(spark, str(tmp_path / "bank"))
    assert series.count() == 4 and series.filter("w IS NULL").count() == 2 and "more" in series.columns and tags.count() == 4
    assert databank.schema_evolve(rows, rows.withColumn("x", F.lit(1))).filter("x IS NULL").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.dcm").write_bytes(header(n))
        (tmp_path / "in" / f"copy{n}.dcm").write_bytes(header(n))
    go = lambda: ingest.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    go()
    (tmp_path / "in" / "late.dcm").write_bytes(header(9))
    (tmp_path / "in" / "again.dcm").write_bytes(header(1))
    go()
    stored = {r.series_instance_uid for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    batch = store.dedup_series(headers.wide_projection(headers.parse_headers(headers.scan_files(spark, str(tmp_path / "in")))))
    assert stored == {r.series_instance_uid for r in batch.collect()}
