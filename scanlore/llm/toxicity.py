"""Operator 2: toxicity by a convolutional text classifier.

A word's embedding is the sum of three hashed ones, of the word, of its first
letters and of its last. Filters of several widths run over the words and the
largest response of each filter in the text goes to a logistic layer. All of it
is trained in numpy by gradients, from random values, on a bounded sample of
labelled rows (``text_model.SAMPLE_ROWS``); words and filters are dropped at
random meanwhile, so that no single word carries a label, the rate falls when the
loss on texts kept out of training no longer does, and the best pass is kept.
The score is shifted by a threshold for the text's language, so that 0.5 is the
calibrated border; languages are groups of texts with alike shares of letters,
found in the sample without labels.

Null and empty texts are scored as texts without words. Long texts are read
whole, in blocks that overlap by the widest filter. A null id is not held out.
Without labels of both kinds every score is the share of toxic labels (0 when
there are none). Repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import string
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY_BYTES, Memo, kept_by_worker, slices, small_batches, utf8
from .text_model import MEMO_BYTES, _letters, adam, held_out_by, learned, scored

#: Bits of the hash of a word or of a part of it; three fit in 64 bits.
BITS = 20
PART_LETTERS = 3
WIDTHS = (1, 2, 3)
FILTERS, EMBEDDED = 24, 16
#: Passes over the sample and steps of a batch, whichever are more.
PASSES, STEPS, BATCH = 16, 800, 32
RATE, TABLE_RATE, DECAY = 0.01, 0.05, 0.02
DROPPED_WORDS, DROPPED_FILTERS = 0.4, 0.3
#: Texts of either label that are to be kept out of training for them to tell the best pass; else all texts tell it.
TOLD_BY = 10
#: Groups of texts that get a threshold of their own, and what a missed text costs in clean ones that are rejected.
GROUPS, MISSED = 6, 4
#: Words looked at together, each with the responses of all filters, and words a worker keeps with their vectors.
BLOCK, KEPT_WORDS = 1 << 14, 1 << 16
_MASK, _MARKS = (1 << BITS) - 1, string.punctuation.encode()
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def packed(word: str | bytes) -> int:
    """Hashes of a word, of its beginning and of its end in one number."""
    begin, end = word[:PART_LETTERS], word[-PART_LETTERS:]
    if isinstance(word, str):
        word, begin, end = word.encode(), begin.encode(), end.encode()
    return (zlib.crc32(word) & _MASK) << 2 * BITS | (zlib.crc32(b"<" + begin) & _MASK) << BITS | zlib.crc32(end + b">") & _MASK


def packed_words(chunk: bytes) -> tuple[int, ...]:
    """The words between white space: runs of letters and digits, or the first run of marks where there are none."""
    bare = chunk.strip(_MARKS)
    if bare.isalnum():  # of ASCII
        return (packed(bare.lower()),)
    found = _letters(chunk.decode("utf-8", "replace").lower())
    return tuple(map(packed, [x for x in found if x[0].isalnum()] or found[:1]))


def parts(words: np.ndarray) -> np.ndarray:
    """The three hashes of each packed word."""
    return np.stack([words >> 2 * BITS, words >> BITS & _MASK, words & _MASK], 1)


def profile(data: bytes) -> np.ndarray:
    """Roots of the shares of a text's letters, by their bytes."""
    counts = np.bincount(np.frombuffer(data.translate(_FOLDED), np.uint8), minlength=256).astype(np.float64)
    counts[:97] = counts[123:128] = 0
    return np.sqrt(counts / max(1.0, counts.sum()))


def prepared(data: bytes) -> np.ndarray:
    """A text as it leaves its task for training: its profile in millionths, then its packed words, two places each."""
    memo = kept_by_worker(("toxicity-words",), lambda: Memo(packed_words, MEMO_BYTES, lambda x: 40 * len(x)))
    words = np.array([n for chunk in data.split() for n in memo[chunk]], np.int64)
    return np.concatenate([(profile(data) * 1e6).astype(np.int32), words.view(np.int32)])


class Encoder:
    """Texts as rows of a table of word vectors under one model; what is new in some texts is looked up together."""

    def __init__(self, model: dict):
        self.model = model
        self._begin()

    def _begin(self) -> None:
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.count, self.store = 0, np.zeros((1024, EMBEDDED), np.float32)

    def rows(self, texts: list[bytes]) -> tuple[dict, list[np.ndarray]]:
        """The model over the words so far, and each text's rows in its table, whose last row is no word."""
        if self.count > KEPT_WORDS:
            self._begin()
        known, waiting, found, long = self.known, [], [], []
        for x in texts:
            chunks = x.split()
            numbers = list(map(known.get, chunks))
            if None in numbers:
                for i, n in enumerate(numbers):
                    if n is None:
                        chunk = chunks[i]
                        n = known.get(chunk)
                        if n is None:
                            new = packed_words(chunk)
                            at = self.count + len(waiting)
                            n = known[chunk] = tuple(range(at, at + len(new)))
                            waiting += new
                            if len(chunk) > KEY_BYTES:
                                long.append(chunk)
                        numbers[i] = n
            found.append(np.fromiter(chain.from_iterable(numbers), np.int64))
        for chunk in long:
            known.pop(chunk, None)
        end = self.count + len(waiting)
        if end + 1 > len(self.store):
            self.store = np.concatenate([self.store, np.zeros((max(len(self.store), end + 1 - len(self.store)), EMBEDDED), np.float32)])
        if waiting:
            self.store[self.count : end] = self.model["table"][_table_rows(self.model, np.array(waiting, np.int64))].sum(1)
            self.count = end
        return self.model | {"table": self.store[: end + 1]}, found


def _table_rows(model: dict, words: np.ndarray) -> np.ndarray:
    """Rows of the three parts of packed words; parts that were not seen in training have the last one, which is zero."""
    ids, found = model["ids"], parts(words)
    at = np.minimum(np.searchsorted(ids, found), len(ids) - 1)
    return np.where(ids[at] == found, at, len(ids))


def _responses(model: dict, x: np.ndarray) -> np.ndarray:
    """Responses at each word of ``x``, which ends with widest - 1 pads, filters of all widths side by side."""
    n, found = len(x) - WIDTHS[-1] + 1, []
    for w in WIDTHS:
        y = x[:n] @ model[f"f{w}"][0]
        for k in range(1, w):
            y += x[k : n + k] @ model[f"f{w}"][k]
        found.append(y)
    y = np.concatenate(found, 1)
    return y + model["bias"] if "bias" in model else y


def _pooled(model: dict, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each text and the word it begins at; zero is the least."""
    width = len(WIDTHS) * FILTERS
    best, where = np.zeros((len(texts), width), np.float32), np.full((len(texts), width), -1)
    pad = np.full(WIDTHS[-1] - 1, len(model["table"]) - 1)
    for i, rows in enumerate(texts):
        padded = np.concatenate([rows, pad])
        for start in range(0, len(rows), BLOCK):
            y = _responses(model, model["table"][padded[start : start + BLOCK + len(pad)]])
            at = y.argmax(0)
            top = y[at, np.arange(width)]
            more = top > best[i]
            best[i][more], where[i][more] = top[more], at[more] + start
    return best, where


def _pool_many(model: dict, texts: list[np.ndarray]) -> np.ndarray:
    """As ``_pooled`` without the places, many short texts at a time."""
    best = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32)
    pad = np.full(WIDTHS[-1] - 1, len(model["table"]) - 1)
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= BLOCK):
            held += len(texts[j])
            j += 1
        if held > BLOCK:
            best[i : i + 1] = _pooled(model, texts[i : i + 1])[0]
        elif held:
            full = [k for k in range(i, j) if len(texts[k])]
            y = _responses(model, model["table"][np.concatenate([x for k in full for x in (texts[k], pad)])])
            starts = np.cumsum([0, *(len(texts[k]) + len(pad) for k in full[:-1])])
            for k in range(1, len(pad) + 1):  # what begins in pads sees the next text's words; zero is the least anyway
                y[starts[1:] - k] = 0
            best[full] = np.maximum(np.maximum.reduceat(y, starts), 0)
        i = j
    return best


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def loss_and_gradients(model: dict, words: np.ndarray, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, kept: np.ndarray) -> tuple[float, dict]:
    """Weighted cross entropy of some texts, and its gradients.

    ``words`` has the three table rows of each word, the last word is none;
    ``texts`` are numbers of words; ``kept`` is 0 for responses that are dropped.
    The table's gradient comes as (rows, gradients).
    """
    used, back = np.unique(np.concatenate([*texts, [len(words) - 1]]), return_inverse=True)
    local = model | {"table": model["table"][words[used]].sum(1)}
    ends = np.cumsum([len(x) for x in texts])
    own = [back[e - len(x) : e] for x, e in zip(texts, ends, strict=True)]
    best, where = _pooled(local, own)
    z = (best * kept) @ model["out"] + model["b"]
    loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
    error = ((_sigmoid(z) - y) * weight).astype(np.float32)
    grads = {"out": (best * kept).T @ error, "b": np.array([error.sum()], np.float32)}
    to_best = error[:, None] * model["out"] * kept * (where >= 0)
    grads["bias"] = to_best.sum(0)
    none = len(local["table"]) - 1
    padded = np.concatenate([x for t in own for x in (t, np.full(WIDTHS[-1] - 1, none))]) if own else np.zeros(0, int)
    starts = np.cumsum([0, *(len(t) + WIDTHS[-1] - 1 for t in own[:-1])]) if own else np.zeros(0, int)
    to_words = np.zeros_like(local["table"])
    for n, w in enumerate(WIDTHS):
        cols = slice(n * FILTERS, (n + 1) * FILTERS)
        text, f = np.nonzero(to_best[:, cols])
        g, at = to_best[:, cols][text, f], where[:, cols][text, f] + starts[text]
        grad = np.zeros((w, FILTERS, EMBEDDED), np.float32)
        for k in range(w):
            row = padded[at + k]
            np.add.at(grad[k], f, g[:, None] * local["table"][row])
            np.add.at(to_words, row, g[:, None] * model[f"f{w}"][k][:, f].T)
        grads[f"f{w}"] = grad.transpose(0, 2, 1)
    to_words[none] = 0
    rows, place = np.unique(words[used], return_inverse=True)
    table = np.zeros((len(rows), EMBEDDED), np.float32)
    for c in range(words.shape[1]):
        np.add.at(table, place.reshape(words[used].shape)[:, c], to_words)
    table[rows == len(model["table"]) - 1] = 0
    return loss, grads | {"table": (rows, table)}


def _shuffled(rng: np.random.Generator, inside: np.ndarray) -> list[np.ndarray]:
    return np.array_split(rng.permutation(inside), max(1, len(inside) // BATCH))


def train(sample: list[tuple[bytes | np.ndarray, int]], seed: int = 7) -> dict:
    """Learn from texts or what ``prepared`` made of them. Parts that occur in two texts at least get an embedding; without such every score is the share of toxic labels."""
    y = np.array([b for _, b in sample], np.float32)
    model: dict = {"prior": float(y.mean()) if len(y) else 0.0, "name": uuid.uuid4().hex}
    if len(set(y.tolist())) < 2:
        return model
    rng = np.random.default_rng(seed)
    given = [a if isinstance(a, np.ndarray) else prepared(a) for a, _ in sample]
    profiles = np.stack([x[:256] for x in given]) / 1e6
    packed_words = [x[256:].view(np.int64) for x in given]
    fit = rng.random(len(given)) < 0.85
    every = np.unique(np.concatenate([np.unique(x) for x in packed_words]))
    seen = [np.unique(parts(np.unique(x))) for x, inside in zip(packed_words, fit, strict=True) if inside]
    ids, times = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_counts=True)
    ids = ids[times >= 2]
    if not len(ids):
        return model
    model |= {"ids": ids, "table": rng.normal(0, 0.1, (len(ids) + 1, EMBEDDED)).astype(np.float32), "b": np.full(1, -1, np.float32)}
    model["table"][-1] = 0
    for w in WIDTHS:
        model[f"f{w}"] = rng.normal(0, (w * EMBEDDED) ** -0.5, (w, EMBEDDED, FILTERS)).astype(np.float32)
    width = len(WIDTHS) * FILTERS
    model |= {"bias": np.zeros(width, np.float32), "out": (0.1 * np.where(rng.random(width) < 0.8, 1, -1)).astype(np.float32)}
    words = np.concatenate([_table_rows(model, every), np.full((1, 3), len(ids))])
    texts = [np.searchsorted(every, x) for x in packed_words]

    share = y[fit].mean() if fit.any() else y.mean()
    weight = np.where(y == 1, 1 - share + 0.05, share + 0.05).astype(np.float32) * 2
    inside, outside = np.flatnonzero(fit), np.flatnonzero(~fit)
    few = min((y[outside] == 1).sum(), (y[outside] == 0).sum()) < TOLD_BY
    held = np.arange(len(y)) if few else outside
    state, squares = {}, np.full(len(model["table"]), 0.01, np.float32)
    least, best, rate, waited = np.inf, {}, 1.0, 0
    passes = max(PASSES, -(-STEPS * BATCH // max(1, len(inside)))) if PASSES else 0
    for _ in range(passes):
        for batch in _shuffled(rng, inside):
            some = [np.where(rng.random(len(texts[i])) < DROPPED_WORDS, len(words) - 1, texts[i]) for i in batch]
            kept = ((rng.random((len(batch), width)) >= DROPPED_FILTERS) / (1 - DROPPED_FILTERS)).astype(np.float32)
            _, grads = loss_and_gradients(model, words, some, y[batch], weight[batch] / len(batch), kept)
            rows, table = grads.pop("table")
            adam(model, {k: v.astype(np.float32) for k, v in grads.items()}, state, rate * RATE)
            squares[rows] += (table * table).mean(1)
            model["table"][rows] -= rate * TABLE_RATE * (table / np.sqrt(squares[rows])[:, None] + DECAY * model["table"][rows])
            model["table"][-1] = 0
        z = _logits(model, words, texts, held)
        loss = float((weight[held] * (np.logaddexp(0, z) - y[held] * z)).mean())
        if loss < least:
            least, best, waited = loss, {k: v.copy() for k, v in model.items() if isinstance(v, np.ndarray)}, 0
            continue
        waited += 1
        if waited % max(1, passes // PASSES) == 0:
            rate *= 0.6
        if waited >= passes // 4:
            break
    model |= best
    return _calibrate(model, _logits(model, words, texts, np.arange(len(texts))), profiles, y, fit)


def _logits(model: dict, words: np.ndarray, texts: list[np.ndarray], which: np.ndarray) -> np.ndarray:
    found = []
    for some in np.array_split(which, max(1, len(which) // 256)):
        used, back = np.unique(np.concatenate([*(texts[i] for i in some), [len(words) - 1]]), return_inverse=True)
        ends = np.cumsum([len(texts[i]) for i in some])
        own = [back[e - len(texts[i]) : e] for i, e in zip(some, ends, strict=True)]
        found.append(_pool_many(model | {"table": model["table"][words[used]].sum(1)}, own) @ model["out"] + model["b"])
    return np.concatenate(found)


def groups(profiles: np.ndarray, most: int = GROUPS) -> np.ndarray:
    """Centres of at most so many groups of alike profiles: begun by draws that prefer what is far from those before, means follow."""
    rng, centres = np.random.default_rng(11), [profiles.mean(0)]
    for _ in range(most - 1):
        far = np.min([((profiles - c) ** 2).sum(1) for c in centres], axis=0)
        if far.max() < 1e-9:
            break
        centres.append(profiles[rng.choice(len(far), p=far / far.sum())])
    found = np.stack(centres)
    for _ in range(20):
        near = group_of(found, profiles)
        found = np.stack([profiles[near == i].mean(0) if (near == i).any() else found[i] for i in range(len(found))])
    return found


def group_of(centres: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * profiles @ centres.T).argmin(1)


def _border(z: np.ndarray, y: np.ndarray, prior: float, weight: float) -> float:
    """The border with the least cost, a missed text costing MISSED clean ones; ``weight`` draws it to ``prior``."""
    edges = np.unique(z)
    edges = np.concatenate([[edges[0] - 1], (edges[1:] + edges[:-1]) / 2, [edges[-1] + 1], [prior]])
    cost = [MISSED * ((z < e) & (y == 1)).sum() + ((z >= e) & (y == 0)).sum() + weight * abs(e - prior) for e in edges]
    good = edges[np.asarray(cost) <= min(cost) + 1e-9]
    return float(good[np.abs(good - prior).argmin()])


def _calibrate(model: dict, z: np.ndarray, profiles: np.ndarray, y: np.ndarray, fit: np.ndarray) -> dict:
    """One threshold for each group of texts, from texts not trained on; few of them lean to the common one."""
    model["centres"] = groups(profiles)
    near = group_of(model["centres"], profiles)
    held = ~fit if 0 < y[~fit].sum() < (~fit).sum() else np.ones_like(fit)
    common = _border(z[held], y[held], 0.0, 2.0)
    own = [held & (near == i) for i in range(len(model["centres"]))]
    model["shift"] = np.array([_border(z[x], y[x], common, 2.0) if x.any() else common for x in own])
    return model


def score(model: dict, texts: list[bytes]) -> np.ndarray:
    if "table" not in model:
        return np.full(len(texts), model["prior"])
    encoder = kept_by_worker(("toxicity", model["name"]), lambda: Encoder(model))
    out = np.empty(len(texts))
    for start in range(0, len(texts), 256):
        some = texts[start : start + 256]
        known, rows = encoder.rows(some)
        z = _pool_many(known, rows) @ model["out"] + model["b"]
        near = group_of(model["centres"], np.stack([profile(x) for x in some]))
        out[start : start + 256] = _sigmoid(z - model["shift"][near])
    return out


def fitted(docs: DataFrame, labels: DataFrame, held_out, key: str, text: str) -> dict:
    return learned(docs, labels, "toxic", held_out, key, text, prepared, train)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", held_out=None) -> DataFrame:
    """key, held_out, score and predicted for every row."""
    held_out = held_out or held_out_by(5, 0)
    return scored(docs, fitted(docs, labels, held_out, key, text), score, held_out, key, text)


def reject_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", held_out=None) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns; only their texts go to Python."""
    held_out = held_out or held_out_by(5, 0)
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, held_out, key, text))
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.float64()), *(pa.array(score(sent.value, [x.as_py() for x in texts[a:b]])) for a, b in slices(texts))])

    return docs.filter(scores(utf8(docs[text])) < 0.5)
