"""Rows that repeat their id, with the same text or another, through the stages that return documents."""

from collections import Counter

from pyspark.sql import functions as F

from scanlore.llm import exact, minhash, mixing

DOCS = "doc_id long, text string, source string, extra map<string,int>"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, {"n": 1}) for i, t, s in rows], DOCS).repartition(5)


def test_exact_dedup_keeps_one_row(spark):
    rows = [(1, "Same", "a")] * 30 + [(1, "same", "b")] * 3 + [(2, "same", "a"), (2, "two", "a"), (3, "three", "a")] + [(4, "four", "a")] * 2 + [(None, "lost", "a")] * 4 + [(5, None, "a"), (5, "", "a")]
    docs = _docs(spark, rows)
    left = exact.exact_dedup(docs)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "").lower()) for r in left.collect()) == [("1", "same"), ("2", "two"), ("3", "three"), ("4", "four"), ("5", ""), ("None", "lost")]


def test_near_dedup_keeps_one_row(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base, "end"])
    far = " ".join(f"v{i}" for i in range(100))
    rows = [(1, " ".join(base), "a")] * 20 + [(1, near, "a")] * 2 + [(2, near, "a"), (1, far, "a"), (9, far, "a")] + [(3, "alone here", "a")] * 3 + [(None, "lost one", "a")] * 2 + [(None, "never lost here", "a"), (7, "never lost here", "a")]
    docs = _docs(spark, rows)
    left = minhash.near_dedup(docs)
    assert left.columns == docs.columns
    found = sorted((str(r.doc_id), r.text.split()[0]) for r in left.collect())
    assert found == [("1", "v0"), ("1", "w0"), ("3", "alone"), ("7", "never"), ("None", "lost")]


def test_mixing_takes_what_it_says(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(60)] + [(5, "one two three", "s0")] * 50 + [(5, "one two three", "s1")] * 7 + [(None, "x y", None)] * 9
    docs = _docs(spark, rows)
    want = mixing.takes(docs).groupBy("id", "tie", "name").agg(F.sum("taken").alias("n")).collect()
    copies = mixing.mix_documents(docs)
    assert copies.columns == docs.columns
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    got = copies.groupBy(F.col("doc_id").alias("id"), F.md5("text").alias("tie"), name.alias("name")).agg(F.sum(mixing.words("text")).alias("n")).collect()
    assert Counter({(r.id, r.tie, r.name): r.n for r in want}) == Counter({(r.id, r.tie, r.name): r.n for r in got})
