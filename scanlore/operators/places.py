"""Places in a global order, and medians of all groups, by range sort and sums of the ranges.

Rows are sorted in ranges that tasks hold one at a time; the ranges' own sums
are added up on their own (one row for each range), so no task sees more than a
range and no buffer grows with a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import save


def before(rows: DataFrame, order: list[Column], n: Column, name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``n`` over all rows before each in the given order. Rows alike in order share a range; their sums differ."""
    weighed = save(rows.withColumn("__n", n.cast("long")).repartitionByRange(*order).withColumn("__lot", F.spark_partition_id()), "ranges")
    lots = weighed.groupBy("__lot").agg(F.sum("__n").alias("__lot_n"))
    earlier = Window.orderBy("__lot").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    lots = lots.select("__lot", F.coalesce(F.sum("__lot_n").over(earlier), F.lit(0)).alias("__lots_before"))
    within = Window.partitionBy("__lot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = weighed.withColumn("__within", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(F.broadcast(lots), "__lot")
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("__within") + F.col("__lots_before")).alias(name))


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place in the given order, from 1."""
    return before(rows, order, F.lit(1), "__before").withColumn(name, F.col("__before") + 1).drop("__before")


def medians(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row for each group of ``keys`` with the exact median of each value, null and NaN left out; all groups and values in one pass.

    Equal values are counted first; then the two middle ones of each group are
    those whose counts cover its middle places. Groups without any value have no
    row. Without keys there is always one row, of nulls where there are no values.
    """
    pairs = F.array(*(F.struct(F.lit(i).alias("__which"), F.col(c).cast("double").alias("__value")) for i, c in enumerate(values)))
    long = rows.select(*keys, F.inline(pairs)).filter(F.col("__value").isNotNull() & ~F.isnan("__value"))
    counted = long.groupBy(*keys, "__which", "__value").agg(F.count("*").alias("__times"))
    group = [*keys, "__which"]
    at = save(before(counted, [*(F.col(k) for k in group), F.col("__value")], F.col("__times"), "__at"), "medians")
    whole = at.groupBy(*(F.col(k).alias(f"__of_{k}") for k in group)).agg(F.min("__at").alias("__start"), F.sum("__times").alias("__size"))
    met = at.join(whole, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in group])

    def middle(place: Column) -> Column:
        covers = (F.col("__at") <= F.col("__start") + place) & (F.col("__start") + place < F.col("__at") + F.col("__times"))
        return F.max(F.when(covers, F.col("__value")))

    low, high = middle(F.floor((F.col("__size") - 1) / 2)), middle(F.floor(F.col("__size") / 2))
    each = met.groupBy(*group).agg(((low + high) / 2).alias("__median"))
    return each.groupBy(*keys).agg(*(F.max(F.when(F.col("__which") == i, F.col("__median"))).alias(c) for i, c in enumerate(values)))
