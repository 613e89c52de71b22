r"""Operator 13: source divergence audit by a sparse merge for every pair of groups.

Terms are matches of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` with A-Z lowered. A
language keeps the terms that at least ``min_docs`` of its documents hold. A
group is a language and a source; each of its kept terms is priced

    1 + floor(10^9 * (count + 5) / (N + 5 V))

with N the group's count of kept terms and V how many the language keeps. The
part ``pair`` gives for each other source of the language the sum of absolute
differences of price over all kept terms, the part ``term`` the terms that a
group prices highest over its language.

Documents are counted where they are read; (language, source, term) is summed
there before it is shuffled. Kept terms get dense ids in their order. A group's
ids and counts are sorted arrays, cut in slices of ``SLICE`` ids, and groups go
to pair tasks in tiles of ``TILE``: a task co-groups two tiles of one slice and
merges each unordered pair once, by a galloping intersection; shared terms,
those of one side and those of neither are priced there for both directions. So
no task holds more than two tiles of a slice, whatever the number of terms.

Null texts, languages and sources count as empty; a group without terms is a
group, and a language that keeps none has pairs of value 0. Repeated rows count
each time; ids are not read. Very long texts are taken apart in pieces; the set
of their distinct terms is held once. Empty tables give empty results; extra
columns are ignored. Arithmetic is exact up to 9 * 10^15 counts of a language.
"""

from __future__ import annotations

from collections import _count_elements  # the counting loop of Counter, on plain dicts
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, light, map_batches, save
from .mixing import running
from .wordscan import TERMS, words

MIN_DOCS = 30
TOP_TERMS = 50
SCALE, PRIOR = 1_000_000_000, 5
#: Ids in a slice, and groups in a tile.
SLICE, TILE = 4096, 8
#: Counts a task holds before it passes them on, and rows it passes on at a time.
HELD, ROWS = 400_000, 50_000
#: Keys that look for their stretch together.
GALLOP = 256


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (that hold it); every group has a row for the empty term too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[dict, dict]] = {}
        held = 0
        for batch in batches:
            for group, data in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2), strict=True):
                counts, holding = groups.get(group) or groups.setdefault(group, ({b"": 0}, {b"": 0}))
                before, distinct = len(counts), set()
                for found in words(data.as_py(), TERMS):
                    _count_elements(counts, found)
                    distinct.update(found)
                _count_elements(holding, distinct)
                held += len(counts) - before
                if held > HELD:
                    yield from _passed_on(groups)
                    held = 0
        yield from _passed_on(groups)

    def utf8(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    source_rows = docs.select(utf8(lang).alias("lang"), utf8(source).alias("source"), utf8(text).cast("binary").alias("t"))
    found = map_batches(source_rows, run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _passed_on(groups: dict) -> Iterator[pa.RecordBatch]:
    names, kinds = ["lang", "source", "term", "n", "docs"], [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    columns: list[list] = [[] for _ in names]
    while groups:
        (lang, source), (counts, holding) = groups.popitem()
        columns[0] += [lang] * len(counts)
        columns[1] += [source] * len(counts)
        columns[2] += counts
        columns[3] += counts.values()
        columns[4] += map(holding.__getitem__, counts)
        if len(columns[0]) >= ROWS or not groups:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=names)
            columns = [[] for _ in names]


def price(count: Column, total: Column) -> Column:
    """Exact in decimals; ``total`` is N + 5 V."""
    scaled = F.lit(SCALE).cast("decimal(18,0)") * (count + PRIOR).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, total.cast("decimal(20,0)"))


def prices(counts: np.ndarray, total: int) -> np.ndarray:
    """The same by long division, three digits at a time, so that nothing leaves 64 bits."""
    rest, found = counts.astype(np.int64) + PRIOR, np.zeros(len(counts), np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, total)
        found = found * 1000 + digits
    return found + 1


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places in sorted ``many`` of the values of sorted ``few``, -1 where it has none; steps double until a stretch holds a run of keys."""
    found, low = np.full(len(few), -1, np.int64), 0
    for start in range(0, len(few), GALLOP):
        keys = few[start : start + GALLOP]
        low += int(np.searchsorted(many[low : low + 1], keys[0]))
        high, step = low, 1
        while high < len(many) and many[high] < keys[-1]:
            high, step = high + step, step * 2
        stretch = many[low : high + 1]
        if not len(stretch):
            break
        at = np.minimum(np.searchsorted(stretch, keys), len(stretch) - 1)
        found[start : start + GALLOP] = np.where(stretch[at] == keys, low + at, -1)
        low += int(at[-1])
    return found


def difference(a: tuple, b: tuple, width: int) -> int:
    """Sum of absolute differences of price over the ``width`` terms of a slice; a side is (ids, prices, price of an absent term)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids, p, p0), (others, q, q0) = a, b
    at = gallop(ids, others)
    shared = at >= 0
    q_shared = q[at[shared]]
    both = np.abs(p[shared] - q_shared).sum()
    one = np.abs(p[~shared] - q0).sum() + np.abs(q - p0).sum() - np.abs(q_shared - p0).sum()
    neither = (width - len(ids) - len(others) + len(q_shared)) * abs(p0 - q0)
    return int(both + one + neither)


def _merged(left: pa.Table, right: pa.Table) -> pa.Table:
    """All pairs of two tiles in one slice, each once."""

    def sides(table: pa.Table) -> list[tuple]:
        found = []
        for r in table.select(["source", "place", "total", "absent"]).to_pylist():
            ids, counts = (table.column(c)[len(found)].values.to_numpy() for c in ("ids", "counts"))
            found.append((r["source"], r["place"], (ids, prices(counts, r["total"]) if len(ids) else counts, r["absent"])))
        return found

    rows = []
    if left.num_rows and right.num_rows:
        lang, width = left.column("lang")[0].as_py(), left.column("width")[0].as_py()
        others = sides(right)
        rows = [(lang, x, y, difference(a, b, width)) for x, i, a in sides(left) for y, j, b in others if i < j]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "a", "b", "value"])


def pair_values(entries: DataFrame, groups: DataFrame, tmp: Scratch) -> DataFrame:
    """lang, source, item, value for every ordered pair of a language's sources.

    ``entries``: lang, source, id (dense in its language), n. ``groups``: lang,
    source, place (dense in its language), sources, v, total (N + 5 V).
    """
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / SLICE))
    absent = F.when(F.col("v") > 0, price(F.lit(0).cast("long"), F.col("total"))).otherwise(0).cast("long")
    width = F.greatest(F.lit(0).cast("long"), F.least(F.lit(SLICE).cast("long"), F.col("v") - F.col("slice") * SLICE))
    base = groups.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    base = base.select("lang", "source", "slice", "place", "sources", "total", absent.alias("absent"), width.alias("width"))
    held = entries.groupBy("lang", "source", F.floor(F.col("id") / SLICE).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("held"))  # SLICE of them at most
    arrays = base.join(held, ["lang", "source", "slice"], "left").withColumns({"ids": F.coalesce("held.id", F.array().cast("array<long>")), "counts": F.coalesce("held.n", F.array().cast("array<long>"))})
    arrays = tmp.save(arrays.drop("held"), "divergence-arrays")
    own, tiles = F.floor(F.col("place") / TILE), F.floor((F.col("sources") - 1) / TILE)
    left = arrays.withColumns({"i": own, "j": F.explode(F.sequence(own, tiles))})
    right = arrays.withColumns({"j": own, "i": F.explode(F.sequence(F.lit(0).cast("long"), own))})
    keys = ["lang", "slice", "i", "j"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_merged, "lang string, a string, b string, value long")
    once = tmp.save(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergence-pairs")
    return once.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(once.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def _dense(rows: DataFrame, column: str, name: str, tmp: Scratch) -> DataFrame:
    """Rows with their place among those of their language, in the order of ``column``."""
    ranked = running(rows.withColumn("one", F.lit(1).cast("long")), [F.col("lang"), F.col(column)], {"at": "one"}, tmp)
    first = ranked.groupBy("lang").agg(F.min("at").alias("first"), F.count("*").alias("of_lang"))
    return ranked.join(light(first, "lang"), "lang").withColumn(name, F.col("at") - F.col("first")).drop("one", "at", "first")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    with Scratch(docs.sparkSession) as tmp:
        counts = tmp.save(term_counts(docs, text, lang, source), "term-counts")
        kept = counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_all"))
        kept = tmp.save(kept.filter(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
        kept = tmp.save(_dense(kept, "term", "id", tmp).drop("of_lang"), "kept-ids")
        entries = counts.filter("term <> ''").join(light(kept, "lang", "term"), ["lang", "term"])
        entries = tmp.save(entries.select("lang", "source", "id", "n", "of_all"), "term-entries")

        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_all").alias("lang_n"))
        sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = _dense(counts.filter("term = ''").select("lang", "source"), "source", "place", tmp).withColumnRenamed("of_lang", "sources")
        groups = groups.join(sums, ["lang", "source"], "left").join(light(tmp.save(langs, "languages"), "lang"), "lang", "left").na.fill(0, ["v", "lang_n", "group_n"])
        groups = tmp.save(groups.select("lang", "source", "place", "sources", "v", (F.col("group_n") + PRIOR * F.col("v")).alias("total"), (F.col("lang_n") + PRIOR * F.col("v")).alias("lang_total")), "groups")

        pairs = pair_values(entries.select("lang", "source", "id", "n"), groups, tmp)
        by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pairs.withColumn("rank", F.row_number().over(by_value))

        gap = entries.join(light(groups, "lang", "source"), ["lang", "source"]).select("lang", "source", "id", (price(F.col("n"), F.col("total")) - price(F.col("of_all"), F.col("lang_total"))).alias("value"))
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "id")  # ids are in the order of the terms
        terms = gap.filter("value > 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        terms = terms.join(kept.select("lang", "id", F.col("term").alias("item")), ["lang", "id"])
        both = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for x, part in ((pairs, "pair"), (terms, "term"))]
        return save(both[0].unionByName(both[1]), "divergence")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
h AS (SELECT lang, unnest(list_distinct(terms)) AS term FROM d),
k AS (SELECT lang, term FROM h GROUP BY ALL HAVING count(*) >= 30),
e AS (SELECT lang, source, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM e SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(n) AS lang_n FROM l GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(sum(c.n), 0) AS group_n FROM g LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.group_n + 5 * s.v) AS p
  FROM s JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
o AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
t AS (SELECT p.lang, p.source, p.term AS item, p.p - (1 + (1000000000::HUGEINT * (l.n + 5)) // (v.lang_n + 5 * v.v)) AS value FROM p JOIN l USING (lang, term) JOIN v USING (lang) WHERE p.n > 0),
r AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM o LEFT JOIN f USING (lang, source, item) UNION ALL SELECT lang, source, 'term', item, value FROM t WHERE value > 0)
SELECT lang, source, part, item, cast(value AS bigint) AS value, cast(rank AS integer) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
