"""The pipeline's stages one after the other, against what each has to do."""

import os

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from scanlore.llm import minhash  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        came, left = before.collect(), after.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        ids = {r.doc_id for r in left}
        assert ids <= {r.doc_id for r in came}
        if name == "toxicity":
            gone = {r.doc_id for r in came} - ids
            assert len(gone) < 0.3 * len(came) and len(toxic & gone) >= 0.6 * len(toxic & {r.doc_id for r in came})
        if name == "exact dedup":
            lower = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
            assert len({lower(r.text) for r in came}) == len(left) == len({lower(r.text) for r in left})
        if name == "near dedup":
            sets = {r.doc_id: minhash.shingles(r.text.encode()) for r in came}
            assert all(minhash._overlap(sets[a], sets[b]) < 0.8 for a in ids for b in ids if a < b)
            assert all(any(minhash._overlap(sets[a], sets[b]) >= 0.8 for b in sets if b != a) for a in set(sets) - ids)
        if name == "mixing":
            assert len(left) >= len(ids)
        before = after
    assert before.filter("size(ids) > 0").count() == before.count()
