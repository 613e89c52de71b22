"""The sample of labelled texts keeps its bound when ids repeat."""

from scanlore.llm import text_model


def test_sample_is_bounded(spark):
    rows = [(i, f"t{i}") for i in range(60)] + [(7, "t7")] * 30 + [(7, f"other {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(7, 1), (7, 0)], "doc_id long, toxic int")
    nothing = text_model.held_out_by(1, 1)
    sample = text_model.labelled(docs, marks, "toxic", nothing)
    assert len(sample) == 61
    assert len([t for t, _ in sample if t == b"t7" or t.startswith(b"other")]) == 2
    assert len(text_model.labelled(docs, marks, "toxic", nothing, rows=20)) <= 20
    assert sample == text_model.labelled(docs.orderBy("text"), marks, "toxic", nothing)
