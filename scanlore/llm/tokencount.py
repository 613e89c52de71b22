"""Operator 9: token counts by a separator scan over flat, unindexed token files.

Texts are encoded and written one after the other as fixed-width little-endian
ids, each ended by the end-of-document id; nothing in the files says where a
document begins. The scan cuts files into blocks, finds the ends in each with
one vectorised comparison, and stitches documents that cross blocks: a running
maximum of the last end before each block tells where its first document began.

The writer returns a manifest (file, ordinal, id), which is kept by Spark; a
file of a task that was lost is not in it and is left out. Null and empty texts
have 0 tokens. Tokens after the last end of a file are a document without an
end. Repeated rows are written as often as they come; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import Vocabulary, encoder
from .common import map_batches, save, scratch_path, slices, utf8

#: A file is closed when it holds so many bytes.
FILE_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20


def width_of(vocabulary_size: int) -> int:
    return 2 if vocabulary_size < 1 << 16 else 4


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the texts below ``folder``, which driver and executors share; returns the manifest (file, ordinal, id)."""
    source = docs.select(F.col(key).alias("id"), utf8(text).alias("utf8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        enc = encoder(path, pattern)
        kind = np.dtype(f"<u{width_of(max(enc.vocabulary.size, end + 1))}")
        out, name, ordinal, written = None, "", 0, 0
        try:
            for batch in batches:
                for start, stop in slices(batch.column(1)):
                    if out is None or written >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, ordinal, written = f"{uuid.uuid4().hex}.tokens", 0, 0
                        out = store.open_output_stream(f"{root}/{name}")
                    found = [np.append(x, end).astype(kind) for x in enc.encode_all([x.as_py() for x in batch.column(1)[start:stop]])]
                    data = np.concatenate(found).tobytes()
                    out.write(data)
                    written += len(data)
                    places = np.arange(ordinal, ordinal + len(found))
                    ordinal += len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(places, pa.int64()), batch.column(0)[start:stop]], names=["file", "ordinal", "id"])
        finally:
            if out is not None:
                out.close()

    return save(map_batches(source, run, f"file string, ordinal long, id {source.dtypes[0][1]}"), "manifest")


def scan_token_files(spark: SparkSession, folder: str, end: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, n_tokens of every document in the files of ``folder``."""
    block_bytes -= block_bytes % width
    # only the list of files comes from Spark; tasks read byte ranges of them, so a file may have any length
    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("path", "length")
    number = F.explode(F.sequence(F.lit(0).cast("long"), (F.ceil(F.col("length") / block_bytes) - 1).cast("long")))
    blocks = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.floor(F.col("length") / width).alias("size"), number.alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, source = None, None
        for batch in batches:
            first, last, inner = [], [], []
            for path, number in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if path != name:
                    if source is not None:
                        source.close()
                    store, place = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                    name, source = path, store.open_input_file(place)
                raw = source.read_at(min(block_bytes, source.size() - number * block_bytes), number * block_bytes)
                ids = np.frombuffer(raw, f"<u{width}", len(raw) // width)
                ends = np.flatnonzero(ids == end) + number * (block_bytes // width)
                first.append(int(ends[0]) if len(ends) else None)
                last.append(int(ends[-1]) if len(ends) else None)
                inner.append(np.diff(ends) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64()))], names=["file", "size", "block", "first", "last", "inner"])
        if source is not None:
            source.close()

    dealt = blocks.repartition("path", F.floor(F.col("block") / 64))
    found = map_batches(dealt, run, "file string, size long, block long, first long, last long, inner array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.when(F.col("first").isNull(), 0).otherwise(F.size("inner") + 1)
    placed = found.withColumn("earlier", F.coalesce(F.sum(ends).over(before), F.lit(0))).withColumn("begun", F.coalesce(F.max("last").over(before), F.lit(-1)) + 1)
    final = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    opened = F.greatest(F.col("begun"), F.coalesce(F.col("last") + 1, F.lit(0)))
    closed = F.when(F.col("first").isNull(), F.array().cast("array<long>")).otherwise(F.concat(F.array(F.col("first") - F.col("begun")), "inner"))
    rest = F.when(final & (F.col("size") > opened), F.array(F.col("size") - opened)).otherwise(F.array().cast("array<long>"))
    counted = placed.withColumn("closed", closed).withColumn("rest", rest)
    return counted.select("file", "earlier", F.posexplode(F.concat("closed", "rest")).alias("place", "n_tokens")).select("file", (F.col("earlier") + F.col("place")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, path: str, pattern: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write token files for ``docs`` and count each document's tokens by scanning them: key, n_tokens, file, ordinal.

    The files are on the list of what ``release`` deletes.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    manifest = write_token_files(docs, folder, path, pattern, end, key, text)
    if manifest.isEmpty():
        return manifest.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_tokens"), "file", "ordinal")
    width = width_of(max(Vocabulary.load(path).size, end + 1))
    counts = scan_token_files(spark, folder, end, width)
    return manifest.join(counts, ["file", "ordinal"]).select(F.col("id").alias(key), "n_tokens", "file", "ordinal")
