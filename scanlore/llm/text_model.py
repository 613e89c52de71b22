"""Word ids for the two text classifiers, and the bounded sample they learn from."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches, slices, utf8
from .wordscan import pieces

#: Labelled rows a classifier learns from at most: those with the smallest hashes.
SAMPLE_ROWS = 6000
#: Bytes of whole text that the sample may hold, and that one of its texts may.
SAMPLE_BYTES, SAMPLE_TEXT_BYTES = 48 << 20, 1 << 20
#: Bytes of chunks that a worker keeps with their words.
MEMO_BYTES = 48 << 20
#: Words looked at together.
BLOCK = 1 << 16

#: Bytes of texts whose words are told together, and of a word whose hash is taken with those of others.
WORDS_BYTES, SHORT = 1 << 18, 64

_letters = regex.compile(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]+").findall
_spaced = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)


def _kinds() -> np.ndarray:
    """By code point: 0 for white space, 1 for letters, marks and digits, 2 for all else."""
    every, found = "".join(map(chr, range(0x110000))), np.full(0x110000, 2, np.uint8)
    for kind, pattern in enumerate((r"\s+", r"[\p{L}\p{M}\p{N}]+")):
        for m in regex.finditer(pattern, every):
            found[m.start() : m.end()] = kind
    return found


def _crc_table() -> np.ndarray:
    found = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        found = np.where(found & np.uint32(1), found >> np.uint32(1) ^ np.uint32(0xEDB88320), found >> np.uint32(1))
    return found


def _crcs(data: np.ndarray, first: np.ndarray, size: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``zlib.crc32`` of many pieces of ``data``, byte by byte for all that are that long; long ones singly."""
    capped = np.minimum(size, SHORT + 1)
    order = np.argsort((SHORT + 1 - capped).astype(np.uint8), kind="stable")
    over = len(size) - np.cumsum(np.bincount(capped, minlength=SHORT + 2))  # how many are longer than 0, 1, 2 bytes and so on
    long = int(over[SHORT])
    at, crc = first[order[long:]], np.full(len(size) - long, 0xFFFFFFFF, np.uint32)
    for i in range(SHORT):
        n = int(over[i]) - long
        if not n:
            break
        crc[:n] = table[(crc[:n] ^ data[at[:n] + i]) & np.uint32(255)] ^ crc[:n] >> np.uint32(8)
    found = np.empty(len(size), np.uint32)
    found[order[long:]] = ~crc
    for i in order[:long]:
        found[i] = zlib.crc32(data[first[i] : first[i] + size[i]])
    return found


class Words:
    """Ids of words from hashes, of many texts at a time: a word is a run of letters, marks and digits, or of what else is no white space.

    Each word costs the same whether it was seen before or not, so what a
    worker does grows with the texts and not with their vocabulary.
    """

    def __init__(self, buckets: int):
        self.buckets, self.kinds, self.table = buckets, _kinds(), _crc_table()

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in texts]
        owners, parts, held = [], [], 0
        for i, text in enumerate(texts):
            for _, part in pieces(text.translate(_spaced), WORDS_BYTES):
                owners.append(i)
                parts.append(part.decode("utf-8", "replace").lower())
                held += len(part)
                if held >= WORDS_BYTES:
                    self._add(found, owners, parts)
                    owners, parts, held = [], [], 0
        if parts:
            self._add(found, owners, parts)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in found]

    def _add(self, found: list[list[np.ndarray]], owners: list[int], parts: list[str]) -> None:
        whole = f" {' '.join(parts)} "
        data = np.frombuffer(whole.encode(), np.uint8)
        kind = self.kinds[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        edges = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        runs = np.flatnonzero(kind[edges[:-1]])
        first, last = edges[runs], edges[runs + 1]
        ends = np.searchsorted(first, np.cumsum([len(x) + 1 for x in parts]))
        if len(data) != len(kind):
            place = np.flatnonzero(data & 0xC0 != 0x80)  # where each character begins
            first, last = place[first], place[last]
        ids = (_crcs(data, first, last - first, self.table) % np.uint32(self.buckets)).astype(np.int32)
        for owner, x in zip(owners, np.split(ids, ends[:-1]), strict=True):
            found[owner].append(x)


def _sample(docs: DataFrame, labels: DataFrame, label: str, held_out, key: str, text: str, rows: int) -> DataFrame:
    """o, y, t: a sample of labelled whole texts, as many of each label as the bound allows; rows held out are never in it.

    The bound is ``rows``, half of which may be of either label, and
    SAMPLE_BYTES of their texts in all; texts over SAMPLE_TEXT_BYTES are not
    taken. Where an id repeats, one of its texts, the one with the smallest
    hash, counts once for each of its labels; null labels are left out.
    """
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("id"), F.col(label).alias("y")).distinct()
    best = [chosen.filter(F.col("y") == y).orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(rows // 2) for y in (0, 1)]
    picked = F.broadcast(best[0].unionByName(best[1]))
    fine = docs.select(F.col(key).alias("id"), utf8(text).alias("t")).filter(F.octet_length("t") <= SAMPLE_TEXT_BYTES)
    # an id may repeat in any number of rows: its texts are reduced in the tasks, before anything is collected
    least = fine.join(picked, "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("least"))
    return least.select(F.xxhash64("id").alias("o"), "y", F.col("least.t").alias("t"))


def _within_bytes(tmp: Scratch, sample: DataFrame) -> DataFrame:
    """The first rows of a sample, by hash and label, as many as hold SAMPLE_BYTES."""
    single = tmp.save(sample, "sample")
    sizes = single.select("o", "y", F.octet_length("t").alias("n")).orderBy("o", "y").collect()  # three numbers for each row
    ends = np.cumsum([r["n"] for r in sizes])
    last = int(np.searchsorted(ends, SAMPLE_BYTES, side="right"))
    if last == len(sizes):
        return single
    o, y = sizes[last]["o"], sizes[last]["y"]
    return single.filter((F.col("o") < o) | ((F.col("o") == o) & (F.col("y") < y)))


def _pairs(found: list[tuple]) -> list[tuple]:
    """Texts, or what was made of them, with labels in an order that reruns agree on."""
    return [(x, y) for _, y, x in sorted(found, key=lambda r: (r[0], r[1], bytes(r[2])))]


def _array(data: bytes, whole: bool) -> np.ndarray:
    return np.frombuffer(data, np.int32 if whole else np.float64)


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out, key: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, prepare: Callable[[bytes], np.ndarray] | None = None) -> list[tuple]:
    """The sample of ``_sample`` at the driver, as pairs of text and label.

    ``prepare`` is applied in the tasks to each text; its array (of int32 or
    double) is returned in the text's place.
    """
    with Scratch(docs.sparkSession) as tmp:
        single = _within_bytes(tmp, _sample(docs, labels, label, held_out, key, text, rows))
        if prepare is None:
            return _pairs([(r["o"], int(r["y"]), bytes(r["t"])) for r in single.collect()])
        return _pairs([(r["o"], int(r["y"]), _array(r["x"], r["whole"])) for r in _prepared(single, prepare).collect()])


def learned(docs: DataFrame, labels: DataFrame, label: str, held_out, key: str, text: str, prepare: Callable[[bytes], np.ndarray], fit: Callable[[list[tuple]], dict]) -> dict:
    """``fit`` of what ``labelled`` gives, in one task: the sample is bounded, and the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(o, y, _array(x, whole)) for b in batches for o, y, x, whole in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(_pairs(found)))], pa.binary())], names=["model"])

    with Scratch(docs.sparkSession) as tmp:
        single = _within_bytes(tmp, _sample(docs, labels, label, held_out, key, text, SAMPLE_ROWS))
        made = map_batches(_prepared(single, prepare).repartition(1), run, "model binary").first()
    return fit([]) if made is None else pickle.loads(made["model"])


def _prepared(single: DataFrame, prepare: Callable[[bytes], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.asarray(prepare(x.as_py())) for x in batch.column(2)]
            whole = [x.dtype.kind == "i" for x in found]
            data = [x.astype(np.int32 if w else np.float64).tobytes() for x, w in zip(found, whole, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(data, pa.binary()), pa.array(whole, pa.bool_())], names=["o", "y", "x", "whole"])

    return map_batches(single.select("o", F.col("y").cast("int"), "t"), run, "o long, y int, x binary, whole boolean")


def held_out_by(divisor: int, remainder: int):
    return lambda key: F.crc32(key.cast("string")) % divisor == remainder


def scored(docs: DataFrame, model, score, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Apply ``score(model, list of texts) -> float array`` to every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(key).alias("id"), F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), utf8(text).alias("utf8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(2)):
                found = score(sent.value, [x.as_py() for x in batch.column(2)[start:stop]])
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found.astype(np.float64)), pa.array((found >= 0.5).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return map_batches(source, run, f"id {source.dtypes[0][1]}, held_out boolean, score double, predicted int").withColumnRenamed("id", key)


def adam(params: dict[str, np.ndarray], grads: dict[str, np.ndarray], state: dict, rate: float, decay: float = 0.0) -> None:
    state["t"] = t = state.get("t", 0) + 1
    for k, g in grads.items():
        m, v = state.setdefault(k, (np.zeros_like(g), np.zeros_like(g)))
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        params[k] -= rate * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * params[k])
