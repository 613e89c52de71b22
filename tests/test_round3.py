"""What queries shuffle and write: once by study, not again for each step."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from scanlore import catalog
from scanlore.operators import export, filters, representative, store
from scanlore.sources import databank

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def exchanges(rows) -> int:
    """Exchanges by hash in the plan, where only few rows are broadcast."""
    return rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture
def small_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


#: Those of the input's joins: parts, customers, studies, two sides each.
JOINS = 6


@needs_tables
def test_tags_are_deduplicated_where_their_files_lie(small_broadcast):
    assert exchanges(catalog.dedup_tags(small_broadcast, SF)) <= JOINS


@needs_tables
def test_representatives_are_dealt_by_study_once(small_broadcast):
    rep = catalog.rep(small_broadcast, SF)
    # the lone group of rows without series is found in a pass of its own, over few rows
    assert exchanges(rep) <= 2 * JOINS
    assert exchanges(filters.missing_issues(rep, catalog.series(small_broadcast, SF))) <= 2 * JOINS


def test_best_row_within_equals_best_row(spark):
    rows = [(f"p{i}", f"u{i % 4}", None if i % 5 == 0 else f"u{i % 4}.{i % 3}", i * 7 % 6 or None, None if i % 6 == 0 else f"{i % 3}", i % 2) for i in range(60)]
    table = spark.createDataFrame(rows, "file_path string, study_instance_uid string, series_instance_uid string, number_of_slices int, series_time string, series_number int")
    found = lambda df: sorted(map(repr, df.select(*table.columns).collect()))
    assert found(representative.best_row_per_series(table, ("study_instance_uid",))) == found(representative.best_row_per_series(table))
    assert found(store.dedup_series(table, ("study_instance_uid",))) == found(store.dedup_series(table))


def test_tags_of_repeated_paths_and_of_no_series(spark):
    tags = spark.createDataFrame([("s", "b", "x"), ("s", "a", "x"), ("s", "a", "y"), (None, "c", "x"), (None, "c", "x")], "series_instance_uid string, file_path string, value_hash string")
    tags = tags.select("*", F.lit("0013").alias("group_hex"), F.lit("1010").alias("element_hex"), F.lit("CTP").alias("creator"))
    kept = sorted((r.series_instance_uid or "", r.file_path, r.value_hash) for r in store.dedup_tags(tags).collect())
    assert kept == [("", "c", "x"), ("", "c", "x"), ("s", "a", "x"), ("s", "a", "y")]


def test_json_is_compressed(spark, tmp_path):
    series = spark.createDataFrame([("a", "s")], "file_path string, series_instance_uid string")
    tags = spark.createDataFrame([("a", "0013")], "file_path string, group_hex string")
    export.json_dump(series, tags, f"{tmp_path}/out")
    assert glob.glob(f"{tmp_path}/out/*.json.gz") and not glob.glob(f"{tmp_path}/out/*.json")
    assert [r.private_tags[0].group_hex for r in spark.read.json(f"{tmp_path}/out").collect()] == ["0013"]


def test_bank_deals_files_before_their_tags(spark, tmp_path):
    bank = databank.Bank(spark, f"{tmp_path}/bank", f"bank_{os.getpid()}_r3", lots=4, buckets=4, within=("study_instance_uid",))
    rows = spark.createDataFrame([(f"p{i}", f"u{i % 9}", f"u{i % 9}.{i % 2}") for i in range(60)], "file_path string, study_instance_uid string, series_instance_uid string")
    asked = []

    def tags_of(new):
        asked.append(new.rdd.getNumPartitions())
        return new.select("*", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("value_text"))

    for _ in range(2):
        bank.append(rows, tags_of)
    assert asked[0] == 16 and bank.read(databank.SERIES).count() == 18 and bank.read(databank.TAGS).count() == 36
    for kind in ("SERIES", "TAGS"):
        spark.sql(f"DROP TABLE {bank.table(getattr(databank, kind))}")


def test_content_in_memory_is_read_like_ranges_and_private_elements_alone():
    from scanlore.sources import headers
    from scanlore.sources.ranges import Ranges

    elements = [(0x00100020, "LO", "P"), (0x00190010, "LO", "ACME"), (0x00191001, "UN", b"ab"), (0x00540016, "SQ", [[(0x00190010, "LO", "NEST")]])]
    for explicit in (True, False):
        data = headers.write_header(elements, explicit)
        by_range = Ranges(lambda at, n, data=data: data[at : at + n], len(data))
        rows = headers.read_header(data)
        assert rows == headers.read_header(by_range)
        assert headers.read_header(data, private=True) == [r for r in rows if r[2] % 2] and len(rows) > 3
