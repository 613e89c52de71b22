r"""Operator 12: target-distribution importance resampling with hashed word runs.

Words are matches of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` with A-Z lowered;
features are all runs of one to ``RUN`` words joined by a space, and a feature's
bucket is the CRC-32 of its bytes modulo ``BUCKETS``. With S features of all
documents, s of them in a bucket, and T and t of the target, a bucket gains
``floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS))))``. A document's
weight is the sum of the gains of its features; a Gumbel variate from its id
is added, and the highest scores are drawn without replacement.

Texts become words between single spaces. A dictionary of distinct words, each
bounded by its delimiters, is an Aho-Corasick automaton whose words carry the
CRC, the length and the CRC behind a space; a scan emits these payloads, and
payloads of adjacent words are composed to the CRC of the run, so no run is
ever hashed. Words that the dictionary lacks lie in the gaps between matches:
they are hashed there and join it when there are enough of them. A worker's
dictionary is bounded in bytes; what it cannot take is always found in the
gaps, so results do not depend on it.

Documents are scanned twice: for the counts of ``BUCKETS`` buckets, then for the
weights. Ranks come from sorted ranges and prefix sums, rows alike as one row
with a count, so no task ranks all documents.

Null and empty texts have no words, weight 0 and no rank. A null id counts as
empty text in its variate and comes last among ties. Repeated rows are ranked
each, one after the other. Very long texts are scanned in pieces that share
their last words. Empty tables give empty results, an empty target counts 0
everywhere; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kept_by_worker, map_batches, save, utf8
from .mixing import _copies as copies
from .mixing import running
from .wordscan import WORDS, pieces

BUCKETS, RUN, SEED = 10_000, 3, 42
MIN_WORDS, PERCENT = 20, 5
#: Bytes of words in a worker's dictionary, and the longest of them.
DICTIONARY_BYTES, WORD_BYTES = 512 << 10, 40
#: Bytes of text scanned together.
SCAN_BYTES = 1 << 20
_POLYNOMIAL = 0xEDB88320


def _over_zeros() -> np.ndarray:
    """Images of the 32 bits of a CRC when one zero byte follows."""
    found = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (_POLYNOMIAL if c & 1 else 0)
        found.append(c)
    return np.array(found, np.uint32)


def _apply(images: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    found = np.zeros_like(crcs)
    for bit in range(32):
        found ^= np.where(crcs >> np.uint32(bit) & np.uint32(1), images[bit], np.uint32(0))
    return found


class Shift:
    """What a CRC becomes when ``n`` more bytes follow, for arrays: by tables up to ``WORD_BYTES``, by doubling beyond."""

    def __init__(self):
        step = _over_zeros()
        images = np.uint32(1) << np.arange(32, dtype=np.uint32)
        byte = np.arange(256)[:, None] >> np.arange(8) & 1
        self.tables = np.zeros((WORD_BYTES + 1, 4, 256), np.uint32)
        for n in range(WORD_BYTES + 1):
            for k in range(4):
                self.tables[n, k] = np.bitwise_xor.reduce(np.where(byte, images[8 * k : 8 * k + 8], np.uint32(0)).astype(np.uint32), axis=1)
            images = _apply(step, images)
        self.flat = self.tables.ravel()
        self.powers = [step]
        for _ in range(31):
            self.powers.append(_apply(self.powers[-1], self.powers[-1]))

    def __call__(self, crcs: np.ndarray, n: np.ndarray) -> np.ndarray:
        short = np.minimum(n, WORD_BYTES) * 1024
        found = self.flat[short + (crcs & 255)]
        for k in range(1, 4):
            found ^= self.flat[short + 256 * k + (crcs >> np.uint32(8 * k) & np.uint32(255))]
        long = np.flatnonzero(n > WORD_BYTES)
        if len(long):
            some, left = crcs[long], n[long].copy()
            for power in self.powers[: int(left.max()).bit_length()]:
                some = np.where(left & 1, _apply(power, some), some)
                left >>= 1
            found[long] = some
        return found


class Dictionary:
    """Words with payloads in an automaton that learns from what it does not find."""

    def __init__(self, most: int = DICTIONARY_BYTES):
        self.most, self.held, self.shift = most, 0, Shift()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.known: dict[bytes, int] = {}
        self.waiting: list[bytes] = []
        self.crc, self.spaced, self.size = (np.zeros(1024, kind) for kind in (np.uint32, np.uint32, np.int64))

    def _payload(self, word: bytes) -> tuple[int, int]:
        n = self.known.get(word, -1)
        if n >= 0:
            return int(self.crc[n]), int(self.spaced[n])
        found = zlib.crc32(word), zlib.crc32(b" " + word)
        if len(word) < WORD_BYTES and self.held + len(word) <= self.most:
            n = self.known[word] = len(self.known)
            if n == len(self.crc):
                self.crc, self.spaced, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.crc, self.spaced, self.size))
            (self.crc[n], self.spaced[n]), self.size[n] = found, len(word) + 1
            self.held += len(word)
            self.waiting.append(word)
        return found

    def _take_in(self) -> None:
        """Rebuild the automaton when the words that wait are a quarter of it, so that all builds together cost a few times the last."""
        if 4 * len(self.waiting) > len(self.known):
            for word in self.waiting:
                self.automaton.add_word(f" {word.decode('latin-1')} ", self.known[word])
            self.automaton.make_automaton()
            self.waiting = []

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word of ``text``, words between single spaces with one at either end: place of the space before it, CRC, CRC behind a space, length with the space."""
        shown = text.decode("latin-1")  # one character for each byte, so that places are bytes
        found = np.fromiter(chain.from_iterable(self.automaton.iter(shown)), np.int64).reshape(-1, 2) if len(self.automaton) else np.zeros((0, 2), np.int64)
        ends, numbers = found[:, 0], found[:, 1]
        starts = ends - self.size[numbers]
        columns = starts, self.crc[numbers], self.spaced[numbers], self.size[numbers]
        # words of the dictionary share the space between them; other words lie between two that do not
        last, until = np.concatenate([[0], ends]), np.concatenate([starts, [len(text) - 1]])
        gaps = np.flatnonzero(until > last)
        missing = []
        for i, j in zip(last[gaps].tolist(), until[gaps].tolist(), strict=True):
            for word in text[i:j].split():
                missing.append((i, *self._payload(word), len(word) + 1))
                i += len(word) + 1
        if not missing:
            return columns
        columns = tuple(np.concatenate([a, np.array(b, a.dtype)]) for a, b in zip(columns, zip(*missing, strict=True), strict=True))
        order = np.argsort(columns[0], kind="stable")
        self._take_in()
        return tuple(c[order] for c in columns)

    def runs(self, text: bytes, ends: np.ndarray, again: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Parts and CRCs of all runs of one word, of two, and so on; a run is within one part and not within its first ``again`` words."""
        places, crc, spaced, size = self.scan(text)
        part = np.searchsorted(ends, places, side="right")
        fresh = np.arange(len(part)) - np.searchsorted(part, np.arange(len(ends)))[part] >= again[part]
        for n in range(RUN):
            if n:
                crc = self.shift(crc[:-1], size[n:]) ^ spaced[n:]
            whole = fresh[n:] & (part[n:] == part[: len(part) - n])
            yield part[n:][whole], crc[whole]
            if len(crc) < 2:
                return


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """Text to scan together: rows of its parts, bytes, ends of the parts, and how many words at a part's begin were there before.

    A part is a text, or a piece of a long one, which begins with the last words of the piece before it.
    """
    parts: list[bytes] = []
    rows, ends, again = [], [0], []

    def block() -> tuple:
        return np.array(rows), b" " + b" ".join(parts) + b" ", np.array(ends[1:]), np.array(again)

    for row, x in enumerate(texts):
        tail: list[bytes] = []
        for at, piece in pieces(x.as_py().translate(WORDS), SCAN_BYTES):
            if at and parts:  # of the same text
                tail = parts[-1].rsplit(None, RUN - 1)[-(RUN - 1) :] if rows[-1] == row else tail
            part = b" ".join([*tail, *piece.split()])
            if len(part) == sum(map(len, tail)) + max(0, len(tail) - 1):
                continue
            if parts and ends[-1] + len(part) > SCAN_BYTES:
                yield block()
                parts, rows, ends, again = [], [], [0], []
            parts.append(part)
            rows.append(row)
            ends.append(ends[-1] + len(part) + 1)
            again.append(len(tail))
    if parts:
        yield block()


def _dictionary() -> Dictionary:
    return kept_by_worker(("resample",), Dictionary)


def bucket_counts(docs: DataFrame, text: str = "text") -> list[int]:
    """How many features fall in each bucket; every task sends one row for each bucket it has, the driver gets ``BUCKETS`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = _dictionary(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, *block in _blocks(batch.column(0)):
                for _, crc in own.runs(*block):
                    counts += np.bincount(crc % BUCKETS, minlength=BUCKETS)
        filled = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array(counts[filled])], names=["bucket", "n"])

    found = map_batches(docs.select(utf8(text).alias("t")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = [0] * BUCKETS
    for r in found:
        counts[r["bucket"]] = r["n"]
    return counts


def bucket_gains(corpus: list[int], target: list[int]) -> np.ndarray:
    s_all, t_all = sum(corpus) + len(corpus), sum(target) + len(target)
    return np.array([math.floor(1000 * math.log(float((t + 1) * s_all) / float((s + 1) * t_all))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_features, weight of every row."""
    source = docs.select(F.col(key).alias("id"), utf8(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _dictionary()
        for batch in batches:
            counts, weight = np.zeros((RUN, batch.num_rows), np.int64), np.zeros(batch.num_rows, np.int64)
            for rows, *block in _blocks(batch.column(1)):
                for n, (part, crc) in enumerate(own.runs(*block)):
                    counts[n] += np.bincount(rows[part], minlength=batch.num_rows)
                    np.add.at(weight, rows[part], gains[crc % BUCKETS])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts[0]), pa.array(counts.sum(axis=0)), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return map_batches(source, run, f"id {source.dtypes[0][1]}, n_words long, n_features long, weight long")


def variate(key: Column, seed: int = SEED) -> Column:
    """A Gumbel variate in thousandths, from the first 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: key, n_features, weight, score, rank (null where it is not drawn)."""
    gains = bucket_gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    with Scratch(docs.sparkSession) as tmp:
        scored = weights(docs, gains, key, text).withColumn("score", F.col("weight") + variate(F.col("id"), seed))
        alike = scored.withColumn("fit", F.col("n_words") >= min_words).groupBy("id", "n_features", "weight", "score", "fit").agg(F.count("*").alias("n"))
        alike = tmp.save(alike.withColumn("tie", F.lit(0)), "resample-scores")
        fit = alike.agg(F.sum(F.when(F.col("fit"), F.col("n")))).first()[0] or 0
        drawn = percent * fit // 100
        order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features")]
        ranked = running(alike.filter("fit"), order, {"before": "n"}, tmp)
        rows = copies(ranked.unionByName(alike.filter("NOT fit").withColumn("before", F.lit(None).cast("long"))), "n", "nth")
        rank = F.col("before") + F.col("nth")
        found = rows.select(F.col("id").alias(key), "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
        return save(found, "resampled")


ORACLE = r"""
WITH RECURSIVE b(i, n, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM b WHERE n < 8),
table_ AS (SELECT list(c ORDER BY i) AS steps FROM b WHERE n = 8),
x AS (SELECT 0 AS target, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT target, r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM x),
f AS (SELECT target, r, array_to_string(w[p:p + k - 1], ' ') AS f FROM (SELECT target, r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w CROSS JOIN (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)),
c AS (SELECT target, r, f, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS hex FROM (SELECT DISTINCT f FROM c)),
u AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, cast(length(hex) / 2 AS integer) + 1), lambda i: ('0x' || substr(hex, cast(2 * i - 1 AS integer), 2))::BIGINT)),
  lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, table_),
k AS (SELECT target, r, bucket, sum(n) AS n FROM c JOIN u USING (f) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE target = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE target = 1), 0)::DOUBLE AS t FROM k GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS gain FROM s),
v AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM k JOIN g USING (bucket) WHERE target = 0 GROUP BY r),
d AS (SELECT r, doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('42:' || coalesce(cast(doc_id AS varchar), '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN v USING (r) WHERE target = 0),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
o AS (SELECT *, CASE WHEN fit THEN row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) END AS place, count(*) FILTER (WHERE fit) OVER () * 5 // 100 AS drawn FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM o
"""
