"""What is listed, made and nested where it is read or written."""

import io
import json
import os
import zipfile

import pytest

from scanlore import catalog
from scanlore.sources import headers, ranges, vendor

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("folders", [10_000, 3, 1])
def test_many_files_are_listed_by_tasks(tmp_path, monkeypatch, folders):
    monkeypatch.setattr(headers, "LISTED", 20)
    monkeypatch.setattr(headers, "FOLDERS", folders)
    head = headers.write_header([(0x00080060, "CS", "PT")])
    for i in range(60):
        path = tmp_path / "in" / ("." if i < 3 else "large" if i < 40 else f"s{i % 5}/_t{i % 2}") / f"{i}.dcm"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(head)
    for junk in ("large/._1.dcm", "__MACOSX/1.dcm", "large/1.txt"):
        (tmp_path / "in" / junk).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / junk).write_bytes(b"")
    for root in (f"{tmp_path}/in", f"file://{tmp_path}/in/"):
        reader = headers._HeaderReader({"roots": json.dumps([root]), "tasks": "6"}, ["modality"], False)
        parts = reader.partitions()
        # the driver keeps folders, not files
        assert all(isinstance(x, headers._Folders) for x in parts) and 6 <= len(parts) <= 12
        found = [row for x in parts for b in reader.read(x) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        want = [path for path, _ in ranges.listed(root, "*.dcm")]
        assert sorted(found) == [(path, "PT", None) for path in want] and len(want) == 60


@needs_tables
def test_headers_are_made_where_they_are_written(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a table of all headers")

    monkeypatch.setattr(catalog, "header_files", none)
    root = catalog._archives_on_disk(spark, SF)
    names = []
    for path, size in ranges.listed(root, "*.zip"):
        data, close = ranges.opened(path, size)
        names += zipfile.ZipFile(io.BytesIO(data.take(0, size))).namelist()
        close()
    files = catalog.inputs.files(spark, SF).select("file_path")
    # rows that repeat a path are members each, and one file
    assert sorted(names) == sorted(r.file_path for r in files.collect())
    assert sum(1 for _ in ranges.listed(catalog._loose_files(spark, SF), "*.dcm")) == files.distinct().count()


def test_vendor_documents_are_nested_where_they_are_read(spark):
    rows = [("a", vendor.write_csa([("B", "LO", ["x", "y"]), ("A", "", []), ("B", "IS", ["1"])])), ("b", vendor.write_csa([("N", "LO", ["é"])], False)), ("none", b""), ("null", None)]
    payloads = spark.createDataFrame([(p, bytearray(v) if v is not None else None) for p, v in rows], "file_path string, value_bytes binary")
    found = vendor.csa_documents(payloads)
    want = vendor.csa_json(vendor.csa_elements(payloads), payloads).join(vendor.csa_hash(payloads), "file_path")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 2
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    # payloads that share a path are two
    assert vendor.csa_documents(payloads.unionAll(payloads)).count() == 4


@needs_tables
def test_many_rows_of_files_are_dealt_to_many_tasks(spark, monkeypatch):
    few = catalog.inputs.files(spark, SF)
    monkeypatch.setattr(catalog.inputs, "TASK_ROWS", 500)
    many = catalog.inputs.files(spark, SF)
    assert many.rdd.getNumPartitions() == 12  # of 6,000 rows; small partitions are not joined again
    assert sorted(r.file_path for r in many.select("file_path").collect()) == sorted(r.file_path for r in few.select("file_path").collect())


@needs_tables
def test_series_that_are_unique_are_not_sorted_for_their_best_row(spark):
    from scanlore.operators import representative

    own = catalog.series(spark, SF)
    plain, unique = (representative.representative_query(own, catalog.WITHIN, x) for x in (False, True))
    sorts = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("row_number()")
    assert sorts(unique) < sorts(plain)
    assert sorted(map(repr, unique.collect())) == sorted(map(repr, plain.collect()))
