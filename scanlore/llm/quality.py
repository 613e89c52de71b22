"""Operator 4: quality by random-indexing word vectors and a small network.

Every hashed word has a sparse random index vector; a word's vector is the sum
of the index vectors of the words up to two places before and after it, over
all texts of the corpus. A document is the mean and the spread of its words'
vectors, weighted against very common words, with the same of how often
neighbours are alike. A two-layer numpy network reads that; its logits are
divided by a temperature fitted on texts it was not trained on.

The vectors cover all documents; the network learns from a bounded sample of
labelled rows (``text_model.SAMPLE_ROWS``). Null and empty texts are scored as
texts without words; long texts are read whole, in blocks. A null id is not
held out. Without labels of both kinds every score is the share of label 1 (0
when there are none). Repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, map_batches, mix64, save, slices, utf8
from .text_model import BLOCK, Words, adam, held_out_by, labelled, scored

BUCKETS, DIMENSIONS, REACH = 1 << 14, 32, 2
#: Rows of buckets that travel together.
PARTS = 64
HIDDEN, PASSES = 24, 60


def _words() -> Words:
    return kept_by_worker(("quality",), lambda: Words(BUCKETS))


def _index_vectors() -> np.ndarray:
    """Where each bucket's vector holds +1 and where -1."""
    h = mix64(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    plus = (h % np.uint64(DIMENSIONS)).astype(np.int64)
    other = (h >> np.uint64(32)) % np.uint64(DIMENSIONS - 1) + np.uint64(1)
    return np.stack([plus, (plus + other.astype(np.int64)) % DIMENSIONS], 1)


def _gather(texts: list[np.ndarray], index: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    ids = np.concatenate(texts) if texts else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    counts += np.bincount(ids, minlength=BUCKETS)
    for reach in range(1, REACH + 1):
        same = owner[reach:] == owner[:-reach]
        left, right = ids[:-reach][same].astype(np.int64), ids[reach:][same]
        for at, near in ((left, right), (right.astype(np.int64), left)):
            for place, sign in ((0, 1), (1, -1)):
                sums += sign * np.bincount(at * DIMENSIONS + index[near, place], minlength=BUCKETS * DIMENSIONS)


def word_vectors(docs: DataFrame, text: str = "text") -> dict:
    """Vectors and counts of all buckets, from all texts: what each task adds up is summed bucket by bucket in two steps."""
    source = docs.select(utf8(text).alias("utf8"))
    rows = BUCKETS // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        index, words = _index_vectors(), _words()
        sums, counts = np.zeros(BUCKETS * DIMENSIONS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for start, stop in slices(batch.column(0)):
                _gather(words.ids(batch.column(0)[start:stop].to_pylist()), index, sums, counts)
        both = np.concatenate([sums.reshape(BUCKETS, DIMENSIONS), counts[:, None]], 1).reshape(PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId()] * PARTS, pa.int32()), pa.array([_packed(x) for x in both], pa.binary())], names=["part", "task", "data"])

    def add(key, table: pa.Table) -> pa.Table:
        total = np.zeros(rows * (DIMENSIONS + 1), np.int64)
        for x in table.column("data"):
            total += _unpacked(x.as_py())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([0], pa.int32()), "data": pa.array([_packed(total)], pa.binary())})

    kind = "part int, task int, data binary"
    each = map_batches(source, run, kind)
    halfway = each.groupBy("part", F.pmod("task", F.lit(997)).alias("lot")).applyInArrow(lambda key, t: add(key, t), kind)
    found = save(halfway.groupBy("part").applyInArrow(lambda key, t: add(key, t), kind), "word-vectors")
    parts = {r["part"]: _unpacked(r["data"]) for r in found.collect()}  # PARTS rows, 4 MB
    both = np.stack([parts.get(i, np.zeros(rows * (DIMENSIONS + 1), np.int64)) for i in range(PARTS)]).reshape(BUCKETS, DIMENSIONS + 1).astype(np.float64)
    sums, counts = both[:, :-1], both[:, -1]
    share = sums / np.maximum(1, np.abs(sums).sum(0, keepdims=True))
    length = np.linalg.norm(share, axis=1, keepdims=True)
    return {"vectors": (share / np.maximum(length, 1e-12)).astype(np.float32), "weight": (1e-3 / (1e-3 + counts / max(1.0, counts.sum()))).astype(np.float32)}


def _packed(x: np.ndarray) -> bytes:
    import zlib

    return zlib.compress(x.astype("<i8").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(data), "<i8")


WIDTH = 2 * DIMENSIONS + 5


def pooled(model: dict, text: bytes) -> np.ndarray:
    """Weighted mean and spread of the words' vectors, and how alike words are to those next to them."""
    return _pooled(model, _words().ids([text])[0])


def _pooled(model: dict, ids: np.ndarray) -> np.ndarray:
    out = np.zeros(WIDTH)
    if not len(ids):
        return out
    total, square, mass, turn, echo = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0, 0.0
    seen = np.zeros(BUCKETS, bool)
    seen[ids] = True
    for start in range(0, len(ids), BLOCK):
        block = ids[start : start + BLOCK]
        v, w = model["vectors"][block], model["weight"][block]
        total += w @ v
        square += w @ (v * v)
        mass += float(w.sum())
        if len(block) > 1:
            turn += float(np.einsum("ij,ij->", v[1:], v[:-1]))
            echo += float((block[1:] == block[:-1]).sum())
    mean = total / mass
    out[:DIMENSIONS] = mean
    out[DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(0, square / mass - mean**2))
    out[2 * DIMENSIONS :] = mass / len(ids), turn / len(ids), echo / len(ids), np.log1p(len(ids)) / 10, np.count_nonzero(seen) / len(ids)
    return out


def train(model: dict, sample: list[tuple[bytes | np.ndarray, int]], seed: int = 11) -> dict:
    """Learn from texts or from what ``pooled`` makes of them."""
    y = np.array([b for _, b in sample], np.float64)
    model = model | {"prior": float(y.mean()) if len(y) else 0.0}
    if len(set(y.tolist())) < 2:
        return model
    rng = np.random.default_rng(seed)
    x = np.array([a if isinstance(a, np.ndarray) else pooled(model, a) for a, _ in sample])
    fit = rng.random(len(y)) < 0.8
    model["mid"], model["scale"] = x[fit].mean(0), x[fit].std(0) + 1e-6
    x = (x - model["mid"]) / model["scale"]
    net = {"w1": rng.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b2": np.zeros(1)}
    inside, state, best = np.flatnonzero(fit), {}, (np.inf, net)
    for _ in range(PASSES):
        for batch in np.array_split(rng.permutation(inside), max(1, len(inside) // 64)):
            h = np.tanh(x[batch] @ net["w1"] + net["b1"])
            error = (_sigmoid(h @ net["w2"] + net["b2"]) - y[batch]) / len(batch)
            back = np.outer(error, net["w2"]) * (1 - h * h)
            adam(net, {"w2": h.T @ error, "b2": np.array([error.sum()]), "w1": x[batch].T @ back, "b1": back.sum(0)}, state, 0.004, 0.004)
        loss = _loss(_sigmoid(_logits(net, x[~fit])), y[~fit])
        if loss < best[0]:
            best = loss, {k: v.copy() for k, v in net.items()}
    model["net"] = best[1]
    z = _logits(model["net"], x[~fit])
    temperatures = np.exp(np.linspace(-1.5, 1.5, 61))
    model["temperature"] = float(min(temperatures, key=lambda t: (_loss(_sigmoid(z / t), y[~fit]), abs(np.log(t)))))
    return model


def _logits(net: dict, x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    return float(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))) if len(y) else 0.0


def score(model: dict, texts: list[bytes]) -> np.ndarray:
    if "net" not in model:
        return np.full(len(texts), model["prior"])
    x = np.array([_pooled(model, ids) for ids in _words().ids(texts)]).reshape(len(texts), WIDTH)
    return _sigmoid(_logits(model["net"], (x - model["mid"]) / model["scale"]) / model["temperature"])


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", held_out=None) -> DataFrame:
    """key, held_out, score and predicted for every row."""
    held_out = held_out or held_out_by(3, 1)
    vectors = word_vectors(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = labelled(docs, labels, "quality", held_out, key, text, prepare=lambda x: pooled(sent.value, x))
    return scored(docs, train(vectors, sample), score, held_out, key, text)
