"""Filters as bitmaps: every value of every filter from one pass over the studies, combined by bit operations.

A study has a dense number; a bitmap covers 32,768 numbers, so a value of a
filter is one small row for each stretch of studies that it holds in. Choosing
values means joining bitmaps of a stretch by OR, choosing filters by AND; the
studies themselves are read only to name the numbers that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..scratch import save
from . import filters
from .places import placed

UID = filters.UID
#: Bytes of bitmaps that may be broadcast when their number has been counted.
BITMAP_BYTES, BROADCAST_BYTES = 4096, 64 << 20


def study_flags(rep: DataFrame, series: DataFrame) -> DataFrame:
    """One row for each study: its representative's figures and ``values``, the (filter, value) pairs that hold.

    Each table is read once; the spread of doses and the most frequent vendor
    hash, one row each, come from what was written of that pass.
    """
    own = rep.filter(s.filled(UID)).select(
        UID, "delay_minutes", "dose_per_kg", "csa_series_header_hash", s.dose_plausibility().alias("dose"), filters._own_points().alias("own"),
        F.array_compact(F.array(*(F.when(~filters.present(k), F.lit(k)) for k in filters.PRESENT))).alias("missing"),
        s.delay_status(signed="delay_signed").alias("status"), s.time_conflict().alias("conflict"), s.is_radiopharm().alias("tracer"),
        (s.weight_best().isNotNull() & s.number("injected_activity").isNull()).alias("missing_activity"), (s.number("injected_activity").isNotNull() & s.weight_best().isNull()).alias("missing_weight"),
    )
    made = series.filter(s.filled(UID)).groupBy(UID).agg(
        F.bool_or(F.coalesce(F.col("modality") == "PT", F.lit(False))).alias("has_pt"), F.bool_or(F.coalesce(F.col("modality") == "CT", F.lit(False))).alias("has_ct"),
        F.count("*").alias("series_count"), F.bool_or(s.is_radiopharm()).alias("tracer_study"),
    )
    flat = save(made.join(own, UID, "left").withColumn("has_rep", F.col("own").isNotNull()), "study-flags")
    tracers = flat.filter("tracer")
    spread = tracers.agg(F.avg("dose").alias("dose_mean"), F.stddev_samp("dose").alias("dose_sd"))
    top = filters.majority_csa(flat).agg(F.max("majority").alias("majority"))
    rows = flat.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(top))  # one row each

    def holds(name: str, conditions: dict[str, Column]) -> list[Column]:
        return [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(name).alias("filter"), F.lit(k).alias("value"))) for k, c in conditions.items()]

    far = (F.col("dose_sd") > 0) & (F.abs(F.col("dose") - F.col("dose_mean")) > 3 * F.col("dose_sd"))
    doses = {"missing_activity": F.col("missing_activity"), "missing_weight": F.col("missing_weight"), "unit_mismatch": (F.col("dose") < 0.1) | (F.col("dose") > 50), "outlier": far}
    asked = lambda k: F.col("tracer_study") if k in filters.RADIOPHARM_FIELDS else F.lit(True)
    score = F.col("own") + filters._has_majority()
    values = [
        *holds("missing", {k: F.array_contains("missing", k) & asked(k) for k in filters.PRESENT}),
        *holds("timing", {k: F.col("status") == k for k in ("missing", "parse_fail", "negative", "too_long", "ok")} | {"study_time_conflict": F.col("conflict")}),
        *holds("dose_issue", {k: F.col("tracer") & c for k, c in doses.items()}),
        *holds("qa_score", {str(i): score == i for i in range(6)}),
        *holds("composition", {k: filters.composition_is(k) for k in ("missing_ct", "missing_pt", "high_series")}),
    ]
    return rows.select(UID, "has_rep", "delay_minutes", "dose_per_kg", F.array_compact(F.array(*values)).alias("values"))


class FilterIndex:
    """Bitmaps of all filter values over the studies; built once, asked often."""

    def __init__(self, studies: DataFrame, bitmaps: DataFrame):
        #: study, number, figures; filter, value, stretch, bits.
        self.studies, self.bitmaps = studies, bitmaps

    @classmethod
    def build(cls, rep: DataFrame, series: DataFrame) -> FilterIndex:
        numbered = save(placed(study_flags(rep, series), [F.col(UID)], "number").withColumn("number", F.col("number") - 1), "studies")
        held = numbered.select("number", F.inline("values"))
        bits = held.groupBy("filter", "value", F.bitmap_bucket_number("number").alias("stretch")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
        return cls(numbered.drop("values"), save(bits, "bitmaps"))

    def counts(self) -> DataFrame:
        """filter, value, n: how many studies each value has, read off the bitmaps."""
        return self.bitmaps.groupBy("filter", "value").agg(F.sum(F.bitmap_count("bits")).alias("n"))

    def chosen(self, **wanted: str | list[str]) -> DataFrame:
        """stretch, bits of the studies with any of the wanted values in every filter named."""
        lists = {k: [v] if isinstance(v, str) else list(v) for k, v in wanted.items()}
        named = [F.lit(False)] + [(F.col("filter") == k) & F.col("value").isin(v) for k, v in lists.items()]
        held = self.bitmaps.filter(_any(named))
        each = held.groupBy("stretch", "filter").agg(F.bitmap_or_agg("bits").alias("bits"))
        return each.groupBy("stretch").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("met")).filter(F.col("met") == len(lists)).drop("met")

    def select(self, uptake: tuple = (None, None), dose: tuple = (None, None), **wanted: str | list[str]) -> DataFrame:
        """The UIDs of the studies that pass all filters; the ranges are asked of the studies that are left."""
        rows = self.studies
        if any(x is not None for x in (*uptake, *dose)):
            rows = filters.range_filter(rows.filter("has_rep"), uptake, dose, keep=True)
        if wanted:
            bits = save(self.chosen(**wanted), "chosen")
            if bits.count() * BITMAP_BYTES <= BROADCAST_BYTES:
                bits = F.broadcast(bits)
            at = F.bitmap_bit_position("number")
            byte = F.ascii(F.decode(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
            rows = rows.join(bits, F.bitmap_bucket_number("number") == F.col("stretch")).filter(F.getbit(byte, (at % 8).cast("int")) == 1)
        return rows.select(UID)


def _any(conditions: list[Column]) -> Column:
    found = conditions[0]
    for c in conditions[1:]:
        found = found | c
    return found
