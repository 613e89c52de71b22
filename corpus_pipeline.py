"""A cleaning pipeline over ``documents``: each stage reads what the one before it wrote.

Every stage but the last returns the columns of its input, whatever further
columns it has and however they are named. Null texts count as empty, null ids
are ids of their own, texts of any length are read whole, repeated rows are
judged each, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanlore.llm import bpe, exact, minhash, mixing, toxicity
from scanlore.llm.common import save, table
from scanlore.llm.queries import vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; empty ones are scored as texts without words, and without labels of both kinds all get the share of toxic labels."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays, a null id last; of rows that repeat it one does. Empty and null texts are equal."""
    return exact.exact_dedup(docs, keep="min")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id, a null id last; texts of fewer than five words have no near ones."""
    return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; texts without words once, if their source is taken at all. Null sources are one source."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids; empty and null texts have none."""
    return bpe.encode(docs, *vocabulary())


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_exact), ("near dedup", drop_near), ("mixing", mix_sources), ("byte bpe", encode)]

#: Toxicity and near dedup are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
