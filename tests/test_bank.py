"""The laid out databank: appends that leave the stored side where it lies, deletes and prunes that rewrite lots only."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from scanlore import scratch
from scanlore.sources import databank

KINDS = "file_path string, series_instance_uid string, study_instance_uid string, patient_weight double"
TAG = "file_path string, series_instance_uid string, study_instance_uid string, group_hex string"


@pytest.fixture
def bank(spark, tmp_path):
    made = databank.Bank(spark, f"file://{tmp_path}/bank", "t_" + uuid.uuid4().hex, lots=4, buckets=8)
    yield made
    for kind in (databank.SERIES, databank.TAGS):
        spark.sql(f"DROP TABLE IF EXISTS {made.table(kind)}")


def rows(spark, n=20):
    given = [(f"f{i:02}", f"s{i // 2}", f"u{i // 6}", float("nan") if i % 3 == 0 else 1.0) for i in range(n)] + [("lone", None, None, 2.0)]
    files = spark.createDataFrame(given, KINDS)
    return files, files.select("file_path", "series_instance_uid", "study_instance_uid", F.explode(F.array(F.lit("0013"), F.lit("0029"))).alias("group_hex"))


def paths(bank, kind=databank.SERIES):
    return sorted(r.file_path for r in bank.read(kind).collect())


def test_append_twice_and_reopen(spark, bank):
    files, tags = rows(spark)
    bank.append(files.filter("file_path < 'f07'"), tags)
    bank.append(files, tags)
    bank.append(files, tags)
    want = [f"f{i:02}" for i in range(0, 20, 2)] + ["lone"]
    assert paths(bank) == want
    assert paths(bank, databank.TAGS) == sorted(want * 2)
    assert bank.read(databank.SERIES).filter("isnan(patient_weight)").count() == 0
    again = databank.Bank(spark, bank.path, "t_" + uuid.uuid4().hex, 4, 8)
    again.append(files.withColumn("more", F.lit(1)).unionByName(spark.createDataFrame([("z", "s99", "u9", 1.0, 7)], KINDS + ", more int")))
    assert paths(again) == [*want, "z"] and again.read(databank.SERIES).filter("more = 7").count() == 1
    spark.sql(f"DROP TABLE {again.table(databank.SERIES)}")


def test_the_stored_side_is_not_shuffled(spark, bank):
    files, _ = rows(spark)
    bank.append(files)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bank.new_rows(databank.SERIES, bank._laid(files))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    stored = plan[plan.index("Bucketed: true") - 2000 :]
    assert "Exchange" not in stored.split("FileScan")[-1]


def test_delete_rewrites_one_lot(spark, bank, tmp_path):
    files, tags = rows(spark)
    bank.append(files, tags)

    def times():
        return {d: max(os.path.getmtime(os.path.join(x, f)) for x, _, fs in os.walk(f"{tmp_path}/bank/series/{d}") for f in fs if f.endswith(".parquet")) for d in os.listdir(f"{tmp_path}/bank/series") if d.startswith("study_lot")}

    before = times()
    assert bank.delete_study("u1") == 3
    after = times()
    (lot,) = spark.range(1).select(bank.lot(F.lit("u1"))).first()
    assert {d for d in before if before[d] != after.get(d)} == {f"study_lot={lot}"}
    assert not {"f06", "f08", "f10"} & set(paths(bank)) and "f00" in paths(bank)
    assert not {"f06", "f08", "f10"} & set(paths(bank, databank.TAGS))
    assert bank.delete_study("nothing") == 0 and bank.delete_study(None) == 1
    for u in ("u0", "u2", "u3"):
        bank.delete_study(u)
    assert paths(bank) == [] and paths(bank, databank.TAGS) == []
    bank.append(files, tags)
    assert len(paths(bank)) == 11


def test_prune_writes_back(spark, bank):
    files, tags = rows(spark)
    bank.append(files, tags)
    bank.prune(files.limit(0))
    assert {r.representative_flag for r in bank.read(databank.SERIES).collect()} == {0} and len(paths(bank)) == 11
    bank.prune(files.filter("file_path IN ('f00', 'f12', 'lone')"))
    assert paths(bank) == ["f00", "f12", "lone"]
    assert {r.representative_flag for r in bank.read(databank.SERIES).collect()} == {1}
    assert paths(bank, databank.TAGS) == sorted(["f00", "f12", "lone"] * 2)


def test_upkeep_leaves_no_copies(spark, tmp_path, monkeypatch):
    """each step left a copy of what it wrote, and rewrote lots through a shuffle."""
    name, plans = "bank_" + uuid.uuid4().hex, []
    rows = spark.range(400).selectExpr("concat('f', id) file_path", "concat('s', id) series_instance_uid", "concat('u', id % 40) study_instance_uid")
    bank, before, write = databank.Bank(spark, f"file://{tmp_path}/bank", name, 2, 3), list(scratch._written), databank.Bank._write

    def watched(self, kind, left, overwrite):
        plans.append((overwrite, left._jdf.queryExecution().executedPlan().toString()))
        write(self, kind, left, overwrite)

    monkeypatch.setattr(databank.Bank, "_write", watched)
    try:
        bank.append(rows, lambda new: new.selectExpr("*", "'0009' group_hex"))
        assert bank.delete_study("u7") == 10 and bank.delete_study("u7") == 0
        bank.prune(bank.read(databank.SERIES).filter("series_instance_uid LIKE '%1'").drop(databank.KEY, databank.LOT))
        assert bank.read(databank.SERIES).filter("representative_flag = 1").count() == bank.read(databank.TAGS).count() == 40
        again = [p for overwrite, p in plans if overwrite]
        # keys alone are shuffled, to the buckets in which rows lie
        assert len(again) > 4 and max(p.count("Exchange hashpartitioning") for p in again) == 1
        assert scratch._written == before
        bank.prune(bank.read(databank.SERIES).limit(0).drop(databank.KEY, databank.LOT))
        assert bank.read(databank.SERIES).filter("representative_flag = 0").count() == bank.read(databank.TAGS).count() == 40
    finally:
        for kind in (databank.SERIES, databank.TAGS):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{kind}")
