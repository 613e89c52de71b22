"""Study list, facets and search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import scalars as s
from .representative import best_series_per_study_modality

MAXED = ("patient_id", "patient_name", "study_date", "study_time", "study_description")
LISTED = ("modality", "manufacturer", "radiopharmaceutical")
SEARCHED = ("patient_name", "patient_id", "modality", "study_description", "manufacturer", "radiopharmaceutical", "study_id", "accession_number")
FUZZY = ("patient_name", "patient_id", "modality", "study_description", "manufacturer", "radiopharmaceutical")


def group_studies(rows: DataFrame) -> DataFrame:
    """One row per study over its best series of each modality; the lists are arrays."""
    return rows.groupBy("study_instance_uid").agg(*(F.max(c).alias(c) for c in MAXED), *(F.sort_array(F.collect_set(c)).alias(c) for c in LISTED), F.count("*").alias("series_count"))


def with_text_lists(studies: DataFrame) -> DataFrame:
    return studies.withColumns({c: F.when(F.size(c) > 0, F.array_join(c, ",")) for c in LISTED})


def study_list(series: DataFrame) -> DataFrame:
    return group_studies(best_series_per_study_modality(series))


def newest_order() -> list[Column]:
    return [F.desc_nulls_last("study_date"), F.desc_nulls_last("study_time"), F.col("study_instance_uid").asc()]


def newest_first(studies: DataFrame) -> DataFrame:
    return studies.orderBy(*newest_order())


def facet_values(series: DataFrame) -> DataFrame:
    """facet, value: what can be chosen; all facets in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in LISTED))
    return series.select(F.inline(pairs)).filter(s.filled("value")).distinct()


def facet_filter(studies: DataFrame, **chosen: list[str]) -> DataFrame:
    """Studies with any of the chosen values in every facet named."""
    for facet, values in chosen.items():
        if values:
            studies = studies.filter(F.arrays_overlap(facet, F.array(*map(F.lit, values))))
    return studies


def text_match(term: str) -> Column:
    low = F.lower(F.lit(term.strip()))
    found = F.lit(False)
    for c in SEARCHED:
        found = found | F.coalesce(F.contains(F.lower(c), low), F.lit(False))
    return found


def text_search(series: DataFrame, term: str) -> DataFrame:
    """The study list over those best series that hold the term in one of their texts."""
    return group_studies(best_series_per_study_modality(series).filter(text_match(term)))


@F.pandas_udf(DoubleType())
def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two texts that do not contain each other."""
    from difflib import SequenceMatcher

    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype=float)


def similarity_bound(value: Column, term: str) -> Column:
    """No ratio is larger: twice the letters that a text shares with the term, whatever their order, over both lengths."""
    shared = F.lit(0)
    for letter in sorted(set(term)):
        shared = shared + F.least(F.length(value) - F.length(F.replace(value, F.lit(letter), F.lit(""))), F.lit(term.count(letter)))
    return 2.0 * shared / (F.length(value) + len(term))


def scored_fields(studies: DataFrame, term: str) -> DataFrame:
    """study, place (of the field), exact (equal, inside, around or null) and best of each filled field.

    Values that neither hold the term nor are held are compared in Python once
    for each distinct value, and only where their bound can name the field or
    raise the study's score.
    """
    low = term.strip().lower()
    fields = F.array(*(F.struct(F.lit(i).alias("place"), F.lower(c).alias("value")) for i, c in enumerate(FUZZY)))
    value = F.col("value")
    kind = F.when(value == low, 3).when(F.contains(value, F.lit(low)), 2).when(F.contains(F.lit(low), value), 1)
    worth = F.get(F.array(F.lit(0.9), F.lit(0.95), F.lit(1.0)), kind - 1)
    rows = studies.select("study_instance_uid", F.inline(fields)).filter(s.filled("value")).withColumn("kind", kind).withColumn("best", worth)
    exact = rows.groupBy("study_instance_uid").agg(F.coalesce(F.max("best"), F.lit(0.0)).alias("exact"))
    bound = similarity_bound(value, low)
    # a thousandth is allowed for rounding
    open_ = rows.filter("kind IS NULL").join(exact, "study_instance_uid").filter((bound + 0.001 >= 0.7) | (bound + 0.001 > F.col("exact")))
    ratios = open_.select("value").distinct().withColumn("ratio", similarity("value", F.lit(low)))
    return rows.join(exact, "study_instance_uid").join(ratios, "value", "left").withColumn("best", F.coalesce("best", "ratio", F.lit(0.0))).select("study_instance_uid", "place", "kind", "best")


def match_score(studies: DataFrame, term: str) -> DataFrame:
    """match_score and match_field of a found study, the fields taken in order.

    Equality scores 1, the term inside the value 0.95, the value inside the
    term 0.9, else the similarity. An equal field is always named, a containing
    one only if none is yet, a similar one if it raises the score to 0.7 or more.
    """
    field = F.struct("place", "kind", "best")
    fields = scored_fields(studies, term).groupBy("study_instance_uid").agg(F.sort_array(F.collect_list(field)).alias("fields"))  # six at most
    names = F.array(*map(F.lit, FUZZY))

    def one(state: Column, x: Column) -> Column:
        named = F.get(names, x["place"])
        takes = (x["kind"] == 3) | (x["kind"].isNotNull() & state["field"].isNull()) | (x["kind"].isNull() & (x["best"] > state["score"]) & (x["best"] >= 0.7))
        return F.struct(F.greatest(state["score"], x["best"]).alias("score"), F.when(takes, named).otherwise(state["field"]).alias("field"))

    start = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("field"))
    folded = fields.select("study_instance_uid", F.aggregate("fields", start, one).alias("__folded"))
    found = studies.join(folded, "study_instance_uid", "left")
    score = F.col("__folded.score")
    return found.withColumn("match_score", F.when(score > 0, score).otherwise(0.5)).withColumn("match_field", F.col("__folded.field")).drop("__folded")


def best_match_first(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("match_score"), F.desc_nulls_last("study_date"), F.desc_nulls_last("study_time"), "study_instance_uid")
