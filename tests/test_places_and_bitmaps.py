"""Global places, medians without group buffers, filters as bitmaps, and the search score by distinct values."""

import random
import statistics
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scanlore.operators import bitmaps, filters, places, studies


def test_places_with_ties_and_nulls(spark):
    random.seed(1)
    rows = [(random.choice([None, 1, 2, 3]), i) for i in range(200)]
    table = spark.createDataFrame(rows, "a int, b int").repartition(7)
    found = places.placed(table, [F.desc_nulls_last("a"), F.col("b")]).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.a, r.b) for r in sorted(found, key=lambda r: r.place)] == want
    assert sorted(r.place for r in found) == list(range(1, 201))
    assert places.placed(table.limit(0), [F.col("b")]).collect() == []
    assert "Python" not in places.placed(table, [F.col("b")])._jdf.queryExecution().toString()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_medians(spark, keys):
    random.seed(2)
    rows = [(random.choice(["a", "b", None]), random.choice([None, float("nan"), 1.0, 2.5, random.random()]), random.randint(0, 3)) for _ in range(400)] + [("one", 7.0, 1), ("two", 1.0, 1), ("two", 2.0, 2), ("none", None, 1)]
    table = spark.createDataFrame(rows, "k string, v double, w int").repartition(5)
    found = {r[0] if keys else None: (r.v, r.w) for r in places.medians(table, keys, ["v", "w"]).collect()}
    groups = {r[0] for r in rows} if keys else {None}
    for g in groups:
        own = [r for r in rows if not keys or r[0] == g]
        v = [r[1] for r in own if r[1] is not None and r[1] == r[1]]
        assert found[g] == (statistics.median(v) if v else None, statistics.median(r[2] for r in own))
    assert places.medians(table.limit(0), keys, ["v"]).collect() == ([] if keys else [(None,)])


def _tables(spark):
    random.seed(3)
    rows = []
    for i in range(300):
        for j in range(random.randint(1, 3)):
            m = random.choice(["PT", "CT", "MR", "PT"])
            rows.append((f"u{i:04}", f"u{i:04}.{j}", f"f{i}.{j}", m, random.choice([70.0, None]), random.choice([300.0, None, 9000.0]), random.choice(["20200101", None]), random.choice(["080000", "120000", "bad", None]), random.choice(["090000", "100500", None]), random.choice(["h1", "h2", None])))
    kinds = "study_instance_uid string, series_instance_uid string, file_path string, modality string, patient_weight double, injected_activity double, study_date string, injection_time string, acquisition_time string, csa_series_header_hash string"
    series = spark.createDataFrame(rows, kinds)
    for c, t in {"patient_size": "double", "injection_date": "string", "acquisition_date": "string", "series_time": "string", "study_time": "string", "series_number": "int", "number_of_slices": "int", "radiopharmaceutical": "string", "patient_sex": "string", "patient_age": "string", "patient_birth_date": "string"}.items():
        series = series.withColumn(c, F.lit(None).cast(t))
    return series.cache()


def test_bitmaps_agree_with_the_filters(spark):
    from scanlore.operators import representative

    series = _tables(spark)
    rep = representative.enriched(series).cache()
    index = bitmaps.FilterIndex.build(representative.representative_query(series), series)
    uids = lambda df: {r[0] for r in df.collect()}
    for k in filters.PRESENT:
        assert uids(index.select(missing=k)) == uids(filters.missing_filter(rep, series, k)), k
    for k in ("missing", "parse_fail", "negative", "too_long", "ok", "study_time_conflict"):
        assert uids(index.select(timing=k)) == uids(filters.timing_filter(rep, k)), k
    for k in ("missing_activity", "missing_weight", "unit_mismatch", "outlier"):
        assert uids(index.select(dose_issue=k)) == uids(filters.dose_issue_filter(rep, k)), k
    for k in range(6):
        assert uids(index.select(qa_score=str(k))) == uids(filters.qa_score_filter(rep, k)), k
    for k in ("missing_ct", "missing_pt", "high_series"):
        assert uids(index.select(composition=k)) == uids(filters.composition_filter(series, k)), k
    both = uids(index.select(uptake=("30", None), timing=["ok", "missing"], composition="missing_ct"))
    assert both == uids(filters.range_filter(rep, ("30", None))) & (uids(filters.timing_filter(rep, "ok")) | uids(filters.timing_filter(rep, "missing"))) & uids(filters.composition_filter(series, "missing_ct"))
    assert uids(index.select(timing="nothing")) == set()
    assert uids(index.select()) == uids(series.select("study_instance_uid").distinct())
    counts = {(r.filter, r.value): r.n for r in index.counts().collect()}
    assert counts["timing", "ok"] == len(uids(filters.timing_filter(rep, "ok")))


def test_bitmaps_over_several_stretches(spark):
    numbered = spark.range(70_000).select(F.format_string("u%06d", "id").alias("study_instance_uid"), F.col("id").alias("number"))
    held = numbered.select("number", F.lit("f").alias("filter"), F.when(F.col("number") % 3 == 0, "a").otherwise("b").alias("value")).unionByName(numbered.filter("number % 7 = 0").select("number", F.lit("g").alias("filter"), F.lit("c").alias("value")))
    bits = held.groupBy("filter", "value", F.bitmap_bucket_number("number").alias("stretch")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    index = bitmaps.FilterIndex(numbered, bits)
    assert {r[0] for r in index.select(f="a", g="c").collect()} == {f"u{i:06}" for i in range(0, 70_000, 21)}
    assert index.select(f=["a", "b"]).count() == 70_000


def _plain(row, term):
    low, score, field = term.strip().lower(), 0.0, None
    for c in studies.FUZZY:
        value = (row[c] or "").lower()
        if not value:
            continue
        kind = 1.0 if value == low else 0.95 if low in value else 0.9 if value in low else None
        best = kind if kind is not None else SequenceMatcher(None, value, low).ratio()
        if kind == 1.0 or (kind is not None and field is None) or (kind is None and best > score and best >= 0.7):
            field = c
        score = max(score, best)
    return score or 0.5, field


def test_match_score_against_plain_python(spark):
    random.seed(4)
    words = ["economy", "econ", "economic plated", "ecnoomy", "autonomy", "taxonomy", "x", None, "", "PT", "Economy Brass", "yeconom", "zzz", "e"]
    rows = [(f"u{i}", *(random.choice(words) for _ in studies.FUZZY)) for i in range(200)] + [("null", *[None] * len(studies.FUZZY))]
    table = spark.createDataFrame(rows, "study_instance_uid string, " + ", ".join(f"{c} string" for c in studies.FUZZY))
    for term in (" Economy ", "pt", "autonomie"):
        found = {r.study_instance_uid: (r.match_score, r.match_field) for r in studies.match_score(table, term).collect()}
        for r in table.collect():
            score, field = _plain(r, term)
            assert found[r.study_instance_uid][1] == field and abs(found[r.study_instance_uid][0] - score) < 1e-9, (term, r)


def test_few_values_reach_python(spark):
    rows = [(f"u{i}", f"name {i % 50}", f"P{i}", "PT", "Study", "ACME", "economy brass") for i in range(500)]
    table = spark.createDataFrame(rows, "study_instance_uid string, " + ", ".join(f"{c} string" for c in studies.FUZZY))
    low = "economy"
    sent = table.select(F.explode(F.array(*map(F.lower, studies.FUZZY))).alias("value")).distinct().filter(~F.contains("value", F.lit(low)) & (studies.similarity_bound(F.col("value"), low) + 0.001 >= 0.7))
    assert sent.count() == 0
    for a, b in (("ecnoomy", low), ("my econo", low), ("aaa", "aab"), ("", "x")):
        (bound,) = spark.createDataFrame([(a,)], "v string").select(studies.similarity_bound(F.col("v"), b)).first()
        assert bound >= SequenceMatcher(None, a, b).ratio() - 1e-12
