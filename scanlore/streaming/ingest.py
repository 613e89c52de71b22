"""Repeated ingest: new header files are read, deduplicated and appended as they arrive.

The stream keeps one entry for each series in a keyed state store: when its
first batch came and which file gave it its row. A table that was there before
is a second source of the stream, which enters that state once, with the first
batch. So a batch costs what its own files cost, however large the stored table
is, and all of it is column functions over the state of a streaming aggregation.
Files without a series are told by their path. Of two batches the one that came
first gives a series its file, whatever the paths; inside a batch the smallest
path does. A file that is written anew with another series counts for that
series.

Every batch writes the partition of its own number and replaces it when it is
run again, so a replay or a restart adds nothing; the time of a batch is that of
its first run.
"""

from __future__ import annotations

import hashlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import store
from ..sources import headers

FILES = "path string, modificationTime timestamp, length long, content binary"
BATCH = "ingest_batch"
#: A state store that does not hold all keys in memory, and where a session names it.
PROVIDER, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A batch leaves its changes in the checkpoint, not all that the store has written for it.
CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def stream_series(spark: SparkSession, root: str, pattern: str = "*.dcm") -> DataFrame:
    """The stream of header files below a folder; its checkpoint remembers what was read."""
    return spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table so far; before the first batch it has no rows."""
    try:
        return spark.read.parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return like.limit(0)


def read_series(found: DataFrame) -> DataFrame:
    """Series rows of (path, content); unreadable files are left out."""
    return headers.parse_wide(headers.junk_path_filter(found)).filter("error IS NULL").drop("error")


def append_new(batch: DataFrame, path: str) -> None:
    """Append the series of files that are at hand and not stored yet, without a stream: the stored keys are read for it."""
    append_rows(read_series(batch), path)


def append_rows(series: DataFrame, path: str) -> None:
    """The same for rows that are series already. Files that are stored are passed over by their path, which also holds for those without a series."""
    stored = _stored(series.sparkSession, path, series)
    new = store.new_series(store.skip_existing_paths(series, stored), stored)
    if BATCH in stored.columns:
        new.withColumn(BATCH, F.lit("appended")).write.mode("append").partitionBy(BATCH).parquet(path)
    else:
        new.write.mode("append").parquet(path)


def _key(rows: DataFrame):
    return F.coalesce(F.concat(F.lit("series:"), "series_instance_uid"), F.concat(F.lit("file:"), "file_path")).alias("key")


def new_in_stream(series: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows of a stream of series that neither an earlier batch has nor ``stored``, a stream over the table that was there before; in update mode."""
    row = F.struct(*(F.col(f"`{c}`") for c in series.columns))
    slices = F.col("number_of_slices") if "number_of_slices" in series.columns else F.lit(None).cast("int")
    keyed = series.select(_key(series), F.current_timestamp().alias("at"), "file_path", slices.alias("slices"), row.alias("row"))
    if stored is not None:
        first = F.timestamp_seconds(F.lit(0))  # before every batch
        known = stored.select(_key(stored), first.alias("at"), "file_path", F.lit(None).cast(slices_type(series)).alias("slices"), F.lit(None).cast(dict(keyed.dtypes)["row"]).alias("row"))
        keyed = keyed.unionByName(known)
    order = F.struct("at", "file_path", "slices")
    found = keyed.groupBy("key").agg(F.min(order).alias("first"), F.max("at").alias("last"), F.min_by("row", order).alias("row"))
    return found.filter(F.col("first.at") == F.col("last")).filter("row IS NOT NULL").select("row.*")


def slices_type(series: DataFrame) -> str:
    return dict(series.dtypes).get("number_of_slices", "int")


def ingest_rows(series: DataFrame, path: str, checkpoint: str, stored: DataFrame | None = None) -> StreamingQuery:
    """Read what has come of a stream of series since the checkpoint, batch by batch, append what is new, and stop. ``stored``: a stream over the table that was there before."""
    spark = series.sparkSession
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={run}-{number}")

    own = {PROVIDER: STORE, CHANGES: "true"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        return new_in_stream(series, stored).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest_stream(found: DataFrame, path: str, checkpoint: str, stored: DataFrame | None = None) -> StreamingQuery:
    """The same for a stream of (path, content)."""
    return ingest_rows(read_series(found), path, checkpoint, stored)


def stream_ingest(spark: SparkSession, root: str, path: str, checkpoint: str, stored: DataFrame | None = None) -> StreamingQuery:
    """Read all header files that are below ``root``."""
    return ingest_stream(stream_series(spark, root), path, checkpoint, stored)


def stream_table(spark: SparkSession, source: str, schema, path: str, checkpoint: str, stored: DataFrame | None = None) -> StreamingQuery:
    """The same over a folder of Parquet files that hold series rows."""
    return ingest_rows(spark.readStream.schema(schema).parquet(source), path, checkpoint, stored)
