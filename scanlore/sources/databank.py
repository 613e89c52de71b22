"""A databank: a folder with the ``series`` and ``private_tag`` tables as Parquet, plain or laid out for upkeep (``Bank``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..scratch import Scratch, delete, make_folder, shuffles_let_go

SERIES, TAGS = "series", "private_tag"


def _clean(df: DataFrame) -> DataFrame:
    """Stored numbers are never NaN."""
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")})


def write_databank(series: DataFrame, tags: DataFrame, path: str, mode: str = "append") -> None:
    _clean(series).withColumn("created_at", F.current_timestamp()).write.mode(mode).parquet(f"{path}/{SERIES}")
    _clean(tags).withColumn("created_at", F.current_timestamp()).write.mode(mode).parquet(f"{path}/{TAGS}")


def read_databank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.option("mergeSchema", True).parquet(f"{path}/{t}") for t in (SERIES, TAGS))


def schema_evolve(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that either lacks are null."""
    return stored.unionByName(new, allowMissingColumns=True)


LOTS, BUCKETS = 16, 16
LOT, KEY = "study_lot", "series_key"


class Bank:
    """A databank whose tables lie in lots by study and, inside them, in buckets by series.

    Rows are appended by a join that reads the stored side where it lies, without
    shuffling it; a study is deleted by rewriting its lot, and pruning rewrites
    lots too, one after the other, each as a dynamic overwrite that leaves the
    others alone. What is rewritten stays in its buckets and is not shuffled, and
    what is written or shuffled on the way is gone at the end. Rows
    without a study are a lot's rows as well; files without a series are keyed by
    their path.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "bank", lots: int = LOTS, buckets: int = BUCKETS, within: tuple[str, ...] = ()):
        self.spark, self.path, self.name, self.lots, self.buckets, self.within = spark, path, name, lots, buckets, within

    def table(self, kind: str) -> str:
        return f"{self.name}_{kind}"

    def read(self, kind: str) -> DataFrame:
        return self.spark.table(self.table(kind))

    def lot(self, study: Column) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(study, F.lit(""))), F.lit(self.lots)).cast("int")

    def _laid(self, rows: DataFrame) -> DataFrame:
        key = F.coalesce(F.col("series_instance_uid"), F.col("file_path"))
        return _clean(rows).withColumns({KEY: key, LOT: self.lot(F.col("study_instance_uid"))})

    def open(self, kind: str, like: DataFrame) -> None:
        """The table over what lies in the folder; made if there is none, with the columns of ``like`` added where it lacks them."""
        columns = [(c, t) for c, t in like.dtypes if c not in (KEY, LOT)]
        if not self.spark.catalog.tableExists(self.table(kind)):
            make_folder(self.spark, f"{self.path}/{kind}")
            names = ", ".join(f"`{c}` {t}" for c, t in columns)
            self.spark.sql(
                f"CREATE TABLE {self.table(kind)} ({names}, {KEY} string, {LOT} int) USING parquet PARTITIONED BY ({LOT}) "
                f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS OPTIONS (compression 'zstd') LOCATION '{self.path}/{kind}'"
            )
            self.spark.sql(f"ALTER TABLE {self.table(kind)} RECOVER PARTITIONS")
        known = {c.lower() for c in self.read(kind).columns}
        more = ", ".join(f"`{c}` {t}" for c, t in columns if c.lower() not in known)
        if more:
            self.spark.sql(f"ALTER TABLE {self.table(kind)} ADD COLUMNS ({more})")

    def new_rows(self, kind: str, rows: DataFrame) -> DataFrame:
        """Those of laid rows whose series is not stored."""
        return rows.join(self.read(kind).select(KEY).distinct(), KEY, "left_anti")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Every bucket of a lot in one task, so a lot gets as many files as it has buckets and no task holds more than its share of both."""
        return rows.repartition(self.lots * self.buckets, LOT, F.pmod(F.hash(KEY), F.lit(self.buckets)))

    def _write(self, kind: str, rows: DataFrame, overwrite: bool) -> None:
        """Rows that are dealt already."""
        whole = self.read(kind).columns
        shown = rows.select(*(F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast(dict(self.read(kind).dtypes)[c]).alias(c) for c in whole))
        mode, before = "spark.sql.sources.partitionOverwriteMode", self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set(mode, "dynamic")
        try:
            shown.write.insertInto(self.table(kind), overwrite=overwrite)
        finally:
            self.spark.conf.set(mode, before)

    def append(self, series: DataFrame, tags: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Store the first file of each series that is new, and the tags of these files: picked out of a table by path, or
        made by a function of the new files, which are then dealt before they become so many more rows."""
        laid = self._laid(series)
        self.open(SERIES, laid)
        with shuffles_let_go(self.spark), Scratch(self.spark) as own:
            new = own.save(self.new_rows(SERIES, store.dedup_series(laid, self.within)), "new-series")
            if tags is not None:
                if callable(tags):
                    kept = self._laid(tags(self._dealt(new).select(*series.columns)))
                else:
                    kept = self._dealt(self._laid(tags.join(new.select("file_path"), "file_path", "left_semi")))
                self.open(TAGS, kept)
                self._write(TAGS, kept, False)
            self._write(SERIES, self._dealt(new), False)

    def _replace(self, kind: str, left: DataFrame, lot: int) -> None:
        """``left``, rows of a lot that lie in its buckets, is all that stays of it. A dynamic overwrite replaces a lot when all is
        written, so it may read what it replaces."""
        if not left.isEmpty():
            self._write(kind, left, True)
        else:  # an overwrite does not reach lots without rows
            self.spark.sql(f"ALTER TABLE {self.table(kind)} DROP IF EXISTS PARTITION ({LOT} = {lot})")
            delete(self.spark, f"{self.path}/{kind}/{LOT}={lot}")
        self.spark.catalog.refreshTable(self.table(kind))

    def delete_study(self, study: str | None) -> int:
        """Remove a study; how many series went. Only its lot is read and written."""
        (lot,) = self.spark.range(1).select(self.lot(F.lit(study).cast("string"))).first()
        gone = F.col("study_instance_uid").eqNullSafe(F.lit(study).cast("string"))
        count = self.read(SERIES).filter((F.col(LOT) == lot) & gone).count()
        if count:
            for kind in (TAGS, SERIES) if self.spark.catalog.tableExists(self.table(TAGS)) else (SERIES,):
                self._replace(kind, self.read(kind).filter((F.col(LOT) == lot) & ~gone), lot)
        return count

    def prune(self, representatives: DataFrame) -> None:
        """Keep the representatives, flagged, and their tags; with none, all series stay with the flag down."""
        with shuffles_let_go(self.spark), Scratch(self.spark) as own:
            keys = own.save(self._laid(representatives.select("series_instance_uid", "file_path", "study_instance_uid")).select(KEY).distinct(), "kept-keys")
            none = keys.isEmpty()
            self.open(SERIES, self.read(SERIES).limit(0).withColumn("representative_flag", F.lit(0)))
            for kind in (TAGS, SERIES) if self.spark.catalog.tableExists(self.table(TAGS)) else (SERIES,):
                lots = [r[LOT] for r in self.read(kind).select(LOT).distinct().collect()]
                for lot in [] if none and kind == TAGS else sorted(lots):
                    rows = self.read(kind).filter(F.col(LOT) == lot)
                    # the hint leaves rows in their buckets; keys are dealt to these
                    left = rows if none else rows.join(keys.hint("shuffle_hash"), KEY, "left_semi")
                    self._replace(kind, left.withColumn("representative_flag", F.lit(0 if none else 1)) if kind == SERIES else left, lot)
