"""The scratch folder that driver and executors share, and what is written to it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made here for local sessions that name none, by application.
_own: dict[str, str] = {}
#: What was written and not deleted yet.
_written: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a fresh local one only in a local session where it is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-scratch-")
        named = _own[context.applicationId]
    return qualified(spark, named.rstrip("/"))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme: one without belongs to Hadoop's default file system, and Python has to read it there too."""
    if "://" in path:
        return path
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return re.sub("^([A-Za-z][A-Za-z0-9+.-]*):/(?!/)", r"\1:///", found)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name, on the list of those that ``release`` deletes."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def make_folder(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)


def release(spark: SparkSession) -> None:
    """Delete what was written so far; to be called when the results that read it have been written."""
    while _written:
        delete(spark, _written.pop())


class Scratch:
    """Tables of one computation: written to the shared folder and read again, which cuts the lineage and survives lost executors.

    As a context it deletes them at its end, so nothing that is returned from
    there may read them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)
            if path in _written:
                _written.remove(path)
        self.paths = []


def save(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write and read again; ``release`` deletes it unless it is to be kept."""
    own = Scratch(df.sparkSession)
    found = own.save(df, name)
    if keep:
        _written.remove(own.paths[0])
    return found


#: Removes what a query has shuffled when it has ended, instead of when the driver's memory happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    if before is None:  # a Spark without it
        yield
        return
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def in_rounds(spark: SparkSession, name: str, rounds: Iterable[Callable[[], DataFrame]]) -> DataFrame:
    """The rows of all rounds, written one round after the other; what a round has written for itself and shuffled goes with it."""
    path, schema = scratch_path(spark, name), None
    for make in rounds:
        before = len(_written)
        with shuffles_let_go(spark):
            found = make()
            schema = found.schema
            found.write.mode("append").parquet(path)
        while len(_written) > before:
            delete(spark, _written.pop())
    return spark.read.schema(schema).parquet(path)
