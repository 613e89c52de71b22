"""Where a classifier learns."""

import os

import numpy as np
from pyspark.sql import functions as F

from scanlore.llm import text_model


def test_a_sample_is_learned_from_in_a_task(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    nothing = lambda key: F.lit(False)
    size = lambda x: np.array([len(x), *x], np.int32)
    want = [(x.tolist(), y) for x, y in text_model.labelled(docs, marks, "toxic", nothing, prepare=size)]
    fit = lambda sample: {"pid": os.getpid(), "sample": [(x.tolist(), y) for x, y in sample]}
    found = text_model.learned(docs, marks, "toxic", nothing, "doc_id", "text", size, fit)
    assert found["sample"] == want and len(want) == 40
    assert found["pid"] != os.getpid()
    assert text_model.learned(docs.limit(0), marks, "toxic", nothing, "doc_id", "text", size, fit)["sample"] == []
