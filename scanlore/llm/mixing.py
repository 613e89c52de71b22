"""Operator 3: mixing sources to target weights.

Every row gets a hash-random key, the MD5 of its id and text. Within each source
the rows are sorted by it in ranges; sums of the ranges and running sums inside
them give each row's place in its source, counted in words. A source whose
target is ``e`` times its size and ``r`` words gives every row ``e`` times and
once more those rows whose middle lies before ``r``, so that what is taken ends
within half a row of the target.

Rows alike in source, id and text are one row with a count up to the end, so
one that a third of all rows repeat is neither shuffled nor sorted copy by
copy; they are interchangeable, and the first of them are taken once more. Null
texts and texts without words have size 0 and are never cut. Null sources form
one source, the last. Sources without words have target 0. Empty tables give
empty results; extra columns are kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, save, small

WEIGHTS = (3, 1, 2)


def words(text: str | Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+``, counted as the places where such a run begins."""
    text = F.col(text) if isinstance(text, str) else text
    spaced = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(spaced, F.lit(" [^ ]")).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], tmp: Scratch) -> DataFrame:
    """``rows`` with sums of columns over the rows before each in the given order.

    Sorted in ranges; the ranges' sums are added up on their own, so no task
    has more than a range. Rows that are alike in order share a range.
    """
    sorted_ = tmp.save(rows.repartitionByRange(*order).withColumn("lot", F.spark_partition_id()), "ranges")
    lots = sorted_.groupBy("lot").agg(*(F.sum(c).alias(f"{name}_lot") for name, c in sums.items()))
    earlier = Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    lots = lots.select("lot", *(F.coalesce(F.sum(f"{name}_lot").over(earlier), F.lit(0)).alias(f"{name}_lot") for name in sums))
    within = Window.partitionBy("lot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = sorted_.withColumns({name: F.coalesce(F.sum(c).over(within), F.lit(0)) for name, c in sums.items()}).join(F.broadcast(lots), "lot")
    return tmp.save(found.select(*rows.columns, *((F.col(name) + F.col(f"{name}_lot")).alias(name) for name in sums)), "running")


def source_targets(sizes: DataFrame, tmp: Scratch, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets of ``sizes`` (source, source_rows, source_size), one row for each source.

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all sizes. A target over ``most`` times its source stops
    there and the excess is shared again among the others. Sources stop in the
    order of size to weight, so sums of the sizes before one and of the weights
    from it on tell whether it does.
    """
    ranked = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"place": "one"}, tmp)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    weighed = ranked.withColumn("weight", weight).withColumn("full", most * F.col("source_size"))
    before = running(weighed, [F.col("full") / F.col("weight"), F.col("source").desc_nulls_first()], {"full_before": "full", "weight_before": "weight"}, tmp)
    total, heavy = before.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    stops = F.col("weight") * (F.lit(share * total) - F.col("full_before")) > F.col("full").cast("double") * (F.lit(heavy) - F.col("weight_before"))
    fixed, free = before.agg(F.coalesce(F.sum(F.when(stops, F.col("full"))), F.lit(0)), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(1))).first()
    target = F.when(stops, F.col("full").cast("double")).otherwise(F.col("weight") * F.lit(share * total - fixed) / F.lit(float(free)))
    return before.select("source", "source_rows", "source_size", target.alias("target"))


def _named(source: str | Column) -> Column:
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("="), (F.col(source) if isinstance(source, str) else source).cast("string")), F.lit(""))


def _tie(text: str | Column) -> Column:
    return F.coalesce(F.md5(text), F.lit(""))


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **shares) -> DataFrame:
    """One row for rows alike: id, tie (MD5 of the text), name (of the source), n (rows), size, source_size, target, epochs, more (how many of them are taken once more)."""
    sized = docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), words(text).alias("size"), _tie(text).alias("tie"))
    sized = sized.groupBy("id", "source", "size", "tie").agg(F.count("*").alias("n"))
    with Scratch(docs.sparkSession) as tmp:
        sized = tmp.save(sized.withColumn("place", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("tie")))), "mix-sizes")
        sizes = sized.groupBy("source").agg(F.sum("n").alias("source_rows"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
        targets = tmp.save(source_targets(tmp.save(sizes, "mix-sources"), tmp, **shares), "mix-targets")

        # ranges of the key: its first 32 bits, cut evenly; as many ranges as each has rows, so that neither
        # the sums over a source's ranges nor the rows in a range grow faster than the root of the source
        ranges = F.ceil(F.sqrt("source_rows"))
        part = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / 4294967296.0 * ranges).cast("long")
        targets = targets.withColumn("name", _named("source"))
        named = sized.withColumn("name", _named("source")).drop("source")
        placed = tmp.save(named.join(small(targets.drop("source"), targets.count()), "name").withColumn("part", part).drop("source_rows"), "mix-ranges")
        parts = placed.groupBy("name", "part").agg(F.sum(F.col("size") * F.col("n")).alias("part_size"))
        earlier = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.select("name", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("earlier"))
        order = Window.partitionBy("name", "part").orderBy("place", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
        within = placed.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0)))
        begun = within.join(parts, ["name", "part"])
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        rest = F.col("target") - F.col("epochs") * F.col("source_size") - F.col("earlier") - F.col("within")
        # of n rows alike the i-th has its middle at (i + 1/2) sizes
        more = F.when(F.col("size") > 0, F.least(F.col("n"), F.greatest(F.lit(0), F.floor(rest / F.col("size") + 0.5)))).otherwise(0).cast("long")
        return save(begun.withColumn("epochs", epochs).withColumn("more", more).select("id", "tie", "name", "n", "size", "source_size", "target", "epochs", "more"), "mix-takes")


def _copies(rows: DataFrame, n: str, nth: str) -> DataFrame:
    """Each row ``n`` times, numbered by ``nth`` from 1; many copies of one row are made by several tasks."""
    lot = 1 << 16
    lots = rows.filter(F.col(n) > 0).withColumn("lot_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / lot).cast("long"))))
    many = lots.filter(F.col(n) > lot)
    spread = lots.filter(F.col(n) <= lot).unionByName(many.repartition("id", "tie", "lot_"))
    last = F.least(F.col(n), (F.col("lot_") + 1) * lot)
    return spread.withColumn(nth, F.explode(F.sequence(F.col("lot_") * lot + 1, last))).drop("lot_")


def takes(docs: DataFrame, **kwargs) -> DataFrame:
    """One row per row of ``docs``: id, tie, name, size, source_size, target, taken (words)."""
    taken = F.col("size") * (F.col("epochs") + (F.col("nth") <= F.col("more")).cast("long"))
    return _copies(grouped(docs, **kwargs), "n", "nth").select("id", "tie", "name", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **kwargs) -> DataFrame:
    return takes(docs, **kwargs).select(F.col("id").alias(kwargs.get("key", "doc_id")), "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **kwargs) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it; texts without words once if their source is taken at all."""
    chosen = grouped(docs, key=key, text=text, source=source, **kwargs)
    times = F.when(F.col("size") > 0, F.col("n") * F.col("epochs") + F.col("more")).otherwise(F.when(F.col("target") > 0, F.col("n")).otherwise(0))
    of_id, of_tie, of_name, n, all_times, own, at, lot, nth = fresh(docs, "of_id", "of_tie", "of_name", "n_alike", "times", "own_times", "at", "lot", "nth")
    chosen = chosen.select(F.col("id").alias(of_id), F.col("tie").alias(of_tie), F.col("name").alias(of_name), F.col("n").alias(n), times.cast("long").alias(all_times))
    same = docs[key].eqNullSafe(chosen[of_id]) & (_tie(docs[text]) == chosen[of_tie]) & (_named(docs[source]) == chosen[of_name])
    once = docs.join(chosen.filter(F.col(n) == 1), same).withColumn(own, F.col(all_times))
    many = chosen.filter(F.col(n) > 1)
    n_many = many.count()
    if n_many:
        spread = save(docs.join(small(many, n_many), same).withColumn(at, F.monotonically_increasing_id()).withColumn(lot, F.shiftright(F.col(at), 33)), "mix-repeated")
        dealt = _dealt(spread, [of_id, of_tie, of_name], n, all_times, own, at, lot)
        once = once.unionByName(dealt.select(*once.columns))
    copies = once.filter(F.col(own) > 0).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(own))))
    return copies.select(*(F.col(f"`{c}`") for c in docs.columns))


def _dealt(rows: DataFrame, alike: list[str], n: str, times: str, own: str, at: str, lot: str) -> DataFrame:
    """Rows alike with their own number of copies: the times of all, evenly; what is left over goes to the first of them.

    Rows are numbered inside each task's share and the shares one after the
    other, so that no task numbers all copies of one row.
    """
    keys = [*alike, lot]
    *of_lot, earlier = fresh(rows, *(f"lot_{c}" for c in keys), "earlier")
    before = Window.partitionBy(*alike).orderBy(lot).rowsBetween(Window.unboundedPreceding, -1)
    lots = rows.groupBy(*keys).agg(F.count("*").alias(earlier))
    lots = lots.select(*(F.col(c).alias(x) for c, x in zip(keys, of_lot, strict=True)), F.coalesce(F.sum(earlier).over(before), F.lit(0)).alias(earlier))
    of = rows[keys[0]].eqNullSafe(lots[of_lot[0]])
    for c, x in zip(keys[1:], of_lot[1:], strict=True):
        of = of & (rows[c] == lots[x])
    place = F.col(earlier) + F.row_number().over(Window.partitionBy(*alike, lot).orderBy(at))
    each = F.floor(F.col(times) / F.col(n))
    return rows.join(lots, of).withColumn(own, (each + (place <= F.col(times) - each * F.col(n)).cast("long")).cast("long"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(md5(text), '') AS tie, md5(coalesce(cast(doc_id AS varchar), '') || ':' || coalesce(md5(text), '')) AS place FROM documents),
s AS (SELECT source, cast(sum(size) AS bigint) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (SELECT *, cast(sum(2 * source_size) OVER r AS bigint) AS full_before, cast(sum(weight) OVER (ORDER BY 2.0 * source_size / weight DESC, source ROWS UNBOUNDED PRECEDING) AS bigint) AS weight_after,
  cast(sum(source_size) OVER () AS bigint) AS total FROM s WINDOW r AS (ORDER BY 2.0 * source_size / weight, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, 1.5 * total - coalesce(full_before, 0) AS rest, weight * (1.5 * total - coalesce(full_before, 0)) > 2.0 * source_size * weight_after AS is_full FROM o),
f AS (SELECT coalesce(sum(2 * source_size) FILTER (WHERE is_full), 0) AS fixed, coalesce(sum(weight) FILTER (WHERE NOT is_full), 1) AS free, max(total) AS total FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cast(2 * source_size AS double) ELSE weight * cast(1.5 * f.total - fixed AS double) / cast(free AS double) END AS target FROM l CROSS JOIN f),
p AS (SELECT d.*, t.source_size, t.target, coalesce(cast(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bigint), 0) AS before,
  CASE WHEN t.source_size > 0 THEN cast(floor(t.target / t.source_size) AS bigint) ELSE 0 END AS epochs FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, cast(size AS bigint) AS size, source_size, target,
  cast(size * (epochs + CASE WHEN size > 0 AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS bigint) AS taken
FROM p
"""
