"""Studies with very many series are those with more than ``filters.HIGH_SERIES``."""

from scanlore.operators import dashboard, filters


def test_high_series(spark):
    rows = [(f"u{n}", m) for n in (5, 20, 21) for m in ["PT", "CT"] + ["PT"] * (n - 2)] + [(None, "PT")] * 30
    series = spark.createDataFrame(rows, "study_instance_uid string, modality string")
    found = {r.metric: r.n for r in dashboard.study_composition(series).collect()}
    assert found == {"missing_ct": 0, "missing_pt": 0, "high_series": 1}
    assert [r.study_instance_uid for r in filters.composition_filter(series, "high_series").collect()] == ["u21"]
