"""What several operators share: batches for Python, memos of bounded size, column names and hashing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, release, save, scratch_dir, scratch_path  # noqa: F401

#: Rows that may be broadcast when their count has been taken first (8 to 16 bytes each, and texts within BROADCAST_BYTES).
BROADCAST_ROWS = 1_000_000
#: Bytes that may be broadcast when they have been summed first, and what a row takes besides its texts.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 64
#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in df.dtypes)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on an Arrow batch, so that texts do not reach a worker by tens of megabytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in small batches; a worker gives back what Arrow still holds at the end of a task."""
    small_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)


def slices(texts: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text, or of lists of ids, one row at least."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        size = 0 if not x.is_valid else 4 * len(x) if isinstance(x, pa.ListScalar) else len(x.as_buffer())
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if len(texts):
        yield start, len(texts)


def _texts(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("string", "binary")]


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted rows are within the bound, and the bytes of text columns, if there are any, too; beyond it Spark shuffles."""
    if rows > bound:
        return df
    texts = _texts(df)
    return light(df, *texts) if texts else F.broadcast(df)


def light(df: DataFrame, *texts: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the rows with the bytes of their text columns were summed and are within ``most``; reads ``df``, a written table, once more."""
    held = df.agg(F.sum(_bytes(texts))).first()[0] or 0
    return F.broadcast(df) if held <= most else df


def _bytes(texts: Iterable[str]) -> Column:
    each = F.lit(ROW_BYTES)
    for c in texts:
        each = each + F.coalesce(F.octet_length(f"`{c}`"), F.lit(0))
    return each.cast("long")


def matched(rows: DataFrame, groups: DataFrame, key: str | list[str], n: str, how: str, most: int = BROADCAST_ROWS, *held: Column) -> DataFrame:
    """``rows`` joined to ``groups`` (one row for each key, column ``n``: how many rows have it).

    Groups are broadcast when there are ``most`` at most and their bytes are
    within BROADCAST_BYTES; ``held`` gives the bytes of columns that are not
    text. Else the largest are, as many as are within both bounds and hold more
    than an even share of the rows, and their rows leave the join that shuffles.
    """
    size = _bytes(_texts(groups))
    for each in held:
        size = size + each
    count, total, whole = groups.agg(F.count("*"), F.sum(n), F.sum(size)).first()
    if count <= most and (whole or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), key, how)
    # fewer and larger ones, until they are within the bound; none at all when the largest are not
    for share in (most >> i for i in range(0, most.bit_length() - 1, 4)):
        hot = groups.filter(F.col(n) > F.lit(total // share))
        if (hot.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
            break
    else:
        return rows.join(groups, key, how)
    keys = [key] if isinstance(key, str) else key
    apart = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups, keys, how)
    return apart.unionByName(rows.join(F.broadcast(hot), keys, "inner" if how == "left" else how))


def reduced(docs: DataFrame, named: DataFrame, key: str, mark: Column) -> DataFrame:
    """``docs`` without the rows that ``named`` (id, mark, stays) says go, and with one row of each that repeats and stays.

    A row is named by its id and ``mark``, a hash of its text. Of rows alike in
    both the one with the smallest hash of all its columns stays; they are
    reduced in each task first, so one that a third of all rows repeat leaves
    each task once.
    """
    of_id, of_mark, whole = fresh(docs, "of_id", "of_mark", "whole")
    named = named.select(F.col("id").alias(of_id), F.col("mark").alias(of_mark), "stays")
    same = docs[key].eqNullSafe(named[of_id]) & (mark == named[of_mark])
    gone, many = named.filter("NOT stays").drop("stays"), named.filter("stays").drop("stays")
    n_gone, n_many = gone.count(), many.count()
    if not n_many:
        return docs.join(small(gone, n_gone), same, "left_anti")
    single = docs.join(small(named.drop("stays"), n_gone + n_many), same, "left_anti")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    copies = docs.join(small(many, n_many), same, "left_semi")
    one = copies.groupBy(docs[key].alias(of_id), mark.alias(of_mark)).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(whole))
    return single.unionByName(one.select(f"{whole}.*"))


def utf8(column: str | Column) -> Column:
    """Text as bytes; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / 9007199254740992.0)


#: Bytes an entry of a memo takes besides its key's and value's own content: the objects' heads and the places in the table.
ENTRY_BYTES = 200
#: Keys over this are not kept.
KEY_BYTES = 256


class Memo(dict):
    """A dict of bytes keys that computes missing values, keeps short keys and starts anew when it holds ``limit`` bytes."""

    def __init__(self, compute, limit: int, size=lambda value: 0):
        super().__init__()
        self.compute, self.limit, self.size, self.held = compute, limit, size, 0

    def __missing__(self, key):
        value = self.compute(key)
        if isinstance(key, bytes) and len(key) > KEY_BYTES:
            return value
        cost = ENTRY_BYTES + (len(key) if isinstance(key, bytes) else 0) + self.size(value)
        if self.held + cost > self.limit:
            self.clear()
            self.held = 0
        self.held += cost
        self[key] = value
        return value


_kept: dict[tuple, object] = {}


def kept_by_worker(name: tuple, make: Callable[[], object]) -> object:
    """What a worker process keeps from one task to the next; the tables of the operator that ran there before are dropped."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]
