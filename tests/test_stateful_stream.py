"""The stream's keyed state: series over several batches, a stored table before it, replays and restarts."""

import os
import shutil

from pyspark.sql import functions as F

from scanlore.streaming import ingest

KINDS = "file_path string, series_instance_uid string, number_of_slices int, weight double"


def put(spark, path, rows):
    spark.createDataFrame([(*r, i, None) for i, r in enumerate(rows)], KINDS).coalesce(1).write.mode("append").parquet(path)


def test_a_series_comes_in_three_batches(spark, tmp_path):
    source, out, log, old = (f"{tmp_path}/{x}" for x in ("in", "out", "log", "old"))
    put(spark, old, [("m.dcm", "9"), ("n.dcm", None)])
    go = lambda: ingest.stream_table(spark, source, KINDS, out, log, spark.readStream.schema(KINDS).parquet(old)).awaitTermination()
    put(spark, source, [("b.dcm", "1"), ("c.dcm", "1"), ("a.dcm", "9"), ("n.dcm", None)])
    go()
    found = lambda: sorted((r.file_path, r.series_instance_uid) for r in spark.read.parquet(out).collect())
    assert found() == [("b.dcm", "1")]
    put(spark, source, [("a.dcm", "1"), ("d.dcm", "2"), ("o.dcm", None)])
    go()
    assert found() == [("b.dcm", "1"), ("d.dcm", "2"), ("o.dcm", None)]
    # what was stored before is in the state; the table itself is not read again
    shutil.rmtree(old)
    os.makedirs(old)
    put(spark, source, [("z.dcm", "1"), ("y.dcm", "2"), ("x.dcm", "9"), ("o.dcm", None), ("e.dcm", "3")])
    go()
    assert found() == [("b.dcm", "1"), ("d.dcm", "2"), ("e.dcm", "3"), ("o.dcm", None)]
    go()  # nothing new
    assert len(found()) == 4
    assert {r.weight for r in spark.read.parquet(out).collect()} == {None}


def test_a_batch_that_fails_after_writing_is_replaced(spark, tmp_path, monkeypatch):
    source, out, log = (f"{tmp_path}/{x}" for x in ("in", "out", "log"))
    put(spark, source, [("a.dcm", "1"), ("b.dcm", "2")])
    ingest.stream_table(spark, source, KINDS, out, log).awaitTermination()
    # as if the driver had been lost between the write and the commit
    os.remove(f"{log}/commits/0")
    for name in os.listdir(f"{log}/commits"):
        if "0" in name:
            os.remove(f"{log}/commits/{name}")
    put(spark, source, [("c.dcm", "1"), ("d.dcm", "3")])
    ingest.stream_table(spark, source, KINDS, out, log).awaitTermination()
    assert sorted(r.file_path for r in spark.read.parquet(out).collect()) == ["a.dcm", "b.dcm", "d.dcm"]


def test_append_without_a_stream_sees_what_a_stream_wrote(spark, tmp_path):
    source, out, log = (f"{tmp_path}/{x}" for x in ("in", "out", "log"))
    put(spark, source, [("a.dcm", "1")])
    ingest.stream_table(spark, source, KINDS, out, log).awaitTermination()
    rows = spark.createDataFrame([("b.dcm", "1", 1, 1.0), ("c.dcm", "2", 1, 1.0), ("a.dcm", None, 1, 1.0)], KINDS)
    for _ in range(2):
        ingest.append_rows(rows, out)
    assert sorted(r.file_path for r in spark.read.parquet(out).collect()) == ["a.dcm", "c.dcm"]


def test_the_session_keeps_its_own_state_store(spark, tmp_path):
    before = spark.conf.get(ingest.PROVIDER)
    put(spark, f"{tmp_path}/in", [("a.dcm", "1")])
    ingest.stream_table(spark, f"{tmp_path}/in", KINDS, f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert spark.conf.get(ingest.PROVIDER) == before
    assert spark.read.parquet(f"{tmp_path}/out").filter(F.col(ingest.BATCH).isNotNull()).count() == 1


def test_the_state_store_is_set_for_the_stream_alone(spark, tmp_path):
    """a batch leaves its changes alone in the checkpoint."""
    from scanlore.streaming import ingest

    before = [spark.conf.get(k, None) for k in (ingest.PROVIDER, ingest.CHANGES)]
    spark.createDataFrame([("f1", "s1"), ("f2", "s1")], "file_path string, series_instance_uid string").write.parquet(f"{tmp_path}/in")
    ingest.stream_table(spark, f"{tmp_path}/in", "file_path string, series_instance_uid string", f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    assert [r.file_path for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["f1"]
    assert [spark.conf.get(k, None) for k in (ingest.PROVIDER, ingest.CHANGES)] == before
    assert list((tmp_path / "log" / "state").rglob("*.changelog"))
