"""Operator 7: exact dedup by a 128-bit content hash, with bytes compared inside groups.

Texts are equal when identical after lower-casing A-Z only; null counts as
empty, so all empty and null texts are one group. Of equal rows one id stays
(``keep="max"`` or ``"min"``); rows that repeat an id count in ``group_size``
and are all marked as kept, of which ``exact_dedup`` returns one. A null id
never stays before another; a group with null ids only keeps null. Empty tables give empty results; extra columns are ignored.

Hashes are grouped first, without texts. Only texts whose hash several rows
have are shuffled, by hash and text, after combining equal ones in each task,
so a text that a third of all rows share leaves each task as one row; a hash
with two different texts is found there, and its rows alone are told apart by
text. What is known of a hash goes back to its rows by a broadcast where such
hashes were counted and are few; else the most frequent ones are broadcast and
the others joined.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import matched, reduced, save


def normalised(text: str | Column) -> Column:
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max", hashed=None) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256."""
    hashed = hashed or (lambda t: F.unhex(F.md5(t)))
    pick = F.max if keep == "max" else F.min
    rows = docs.select(F.col(key).alias("id"), normalised(text).alias("norm")).withColumn("h", hashed(F.col("norm")))
    keyed = save(rows.select("id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-keys")
    groups = save(keyed.groupBy("h").agg(F.count("*").alias("group_size"), pick("id").alias("keep_id")).filter("group_size > 1"), "exact-groups")

    # bytes are compared where a hash repeats
    texts = matched(rows, groups.select("h", "group_size"), "h", "group_size", "left_semi").groupBy("h", "norm").agg(F.count("*").alias("n"))
    collided = save(texts.groupBy("h").agg(F.count("*").alias("n_texts")).filter("n_texts > 1").select("h"), "exact-collided")
    if collided.isEmpty():
        found = matched(keyed, groups, "h", "group_size", "left")
    else:
        again = rows.join(collided, "h", "left_semi")
        exact = again.groupBy("h", "norm").agg(F.count("*").alias("group_size"), pick("id").alias("keep_id"))
        both = again.join(exact, ["h", "norm"]).select("id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", "keep_id")
        found = matched(keyed.join(collided, "h", "left_anti"), groups.join(collided, "h", "left_anti"), "h", "group_size", "left").select(*both.columns).unionByName(both)
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    found = found.select("id", keep_id.alias("keep_id"), size.alias("group_size"), "sha")
    return found.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    Of a group's rows under the id that stays, one does. A group of null ids
    only keeps one row too.
    """
    groups = exact_groups(docs, key, text, keep).filter("group_size > 1")
    named = groups.groupBy(F.col(key).alias("id"), F.unhex("text_sha256").alias("mark")).agg(F.first("kept").alias("stays"), F.count("*").alias("n"))
    named = save(named.filter("NOT stays OR n > 1").drop("n"), "exact-dropped")
    return reduced(docs, named, key, F.unhex(F.sha2(normalised(docs[text]), 256)))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
