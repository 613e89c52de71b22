"""Jobs that write much do it by studies, and leave their results alone."""

import os

import pytest
from pyspark.sql import functions as F

from scanlore import catalog, scratch
from scanlore.operators import export
from scanlore.plans import inputs
from scanlore.sources import ranges

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_ranges_of_studies_cover_all_rows_once(spark):
    for whole in (1, 64):
        found = inputs.study_ranges(spark, SF, 1000, whole)
        assert len(found) > 3 and all(end is None or (end + 1) % whole == 0 for _, end in found)
        parts = [inputs.files(spark, SF, x).select("file_path", "series_number") for x in found]
        assert _rows(parts[0].unionAll(parts[1])) != _rows(parts[0]) and sum(p.count() for p in parts) == 6000
        assert sorted(x for p in parts for x in _rows(p)) == _rows(inputs.files(spark, SF).select("file_path", "series_number"))
        assert max(p.count() for p in parts) < 3000


def test_a_round_leaves_nothing_but_its_rows(spark):
    before = list(scratch._written)

    def make(i):
        return scratch.save(spark.range(i, i + 3), "own").repartition(2, "id")

    found = scratch.in_rounds(spark, "whole", [lambda i=i: make(i) for i in (0, 3, 6)])
    assert sorted(r.id for r in found.collect()) == list(range(9))
    (path,) = [x for x in scratch._written if x not in before]
    folder = ranges.file_system(path.rpartition("/")[0])[1]
    assert not [x for x in os.listdir(folder) if x.startswith("own-") and f"{path.rpartition('/')[0]}/{x}" not in before]
    assert spark.conf.get(scratch.CLEANUP) == "false"


def test_loose_files_lie_there_by_studies(spark, monkeypatch):
    """all files lay on the disk together."""
    want, most, make = _rows(catalog.scan_headers(spark, SF)), [], catalog._loose_files

    def watched(*given):
        root = make(*given)
        most.append(sum(1 for _ in ranges.listed(root.rpartition("/")[0], "*.dcm")))
        return root

    scratch.release(spark)
    monkeypatch.setattr(catalog, "_loose_files", watched)
    monkeypatch.setattr(catalog, "LOOSE_FILES", 1500)
    assert _rows(catalog.scan_headers(spark, SF)) == want
    assert len(most) == 4 and max(most) < 2500


@pytest.mark.parametrize("name, most", [("scan_archives", "ARCHIVED_FILES"), ("json_dump", "DUMPED_FILES")])
def test_archives_and_dumps_lie_there_by_studies(spark, monkeypatch, name, most):
    """F7, F8: all archives, or all lines, lay on the disk together."""
    query, rounds = catalog.QUERIES[name], []
    want = _rows(query(spark, SF))
    monkeypatch.setattr(catalog, most, 2000)
    monkeypatch.setattr(catalog, "ARCHIVE_STUDIES", catalog.ARCHIVE_STUDIES if most == "DUMPED_FILES" else 64)
    monkeypatch.setattr(catalog, "in_rounds", lambda s, n, made: scratch.in_rounds(s, n, [lambda x=x: (rounds.append(x), x())[1] for x in made]))
    found = query(spark, SF)
    if name == "json_dump":
        assert _rows(found) == want
    else:  # archives are other ones
        assert sorted(tuple(r)[1:] for r in found.collect() if r.series_instance_uid) == sorted(tuple(r)[1:] for r in query(spark, SF).collect() if r.series_instance_uid)
        assert found.count() == len(want)
    assert len(rounds) >= 3


def test_tags_are_nested_where_series_lie(spark, tmp_path, monkeypatch):
    """F8: six rows for each file were shuffled by path."""
    key = F.concat(F.lit("u"), F.col("id") % 5).alias("study_instance_uid")
    rows = spark.range(50).select(key, F.concat(F.lit("f"), F.col("id")).alias("file_path")).repartition(3, "study_instance_uid")
    tags = rows.withColumn("creator", F.explode(F.sequence(F.lit(0), F.lit(1))))
    plans, join = [], type(rows).join
    monkeypatch.setattr(type(rows), "join", lambda *x, **y: plans.append(join(*x, **y)) or plans[-1])
    with monkeypatch.context() as m:
        m.setattr(type(rows.write), "json", lambda self, path: plans.append(plans[-1]._jdf.queryExecution().executedPlan().toString()))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            export.json_dump(rows, tags, "", ("study_instance_uid",))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[-1].count("Exchange hashpartitioning") == 2  # those that were asked for
    export.json_dump(rows, tags, f"{tmp_path}/json", ("study_instance_uid",))
    assert spark.read.json(f"{tmp_path}/json").filter("size(private_tags) = 2").count() == 50
    assert spark.conf.get(export.BY_SOME) == "true"


def test_archives_are_packed_many_to_a_task(spark, monkeypatch):
    """each study was a call into Python of its own, and headers and archives were written first."""
    import io
    import zipfile

    before = list(scratch._written)
    monkeypatch.setattr(catalog, "PACKED_BYTES", 10_000)
    found = catalog.archive_files(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    names = [(r.path, x) for r in found.collect() for x in zipfile.ZipFile(io.BytesIO(r.content)).namelist()]
    files = inputs.files(spark, SF).select("study_instance_uid", "file_path").collect()
    want = [(f"{r.study_instance_uid}.zip", x) for r in files for x in (r.file_path.replace("/", "_"), f"__MACOSX/._{r.file_path}")]
    assert sorted(names) == sorted(want) and found.count() == len({r.study_instance_uid for r in files})
    assert scratch._written == before
