r"""Operator 11: benchmark decontamination by a generalised suffix automaton of the test items.

Words are matches of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` with A-Z lowered. A
window is ``WINDOW`` consecutive words of an item; an item of fewer words is one
window. Document words inside any occurrence of a window are hit; hit words
that follow one another are a span.

Items are cut in pieces that overlap by all but one word of a window and dealt
to blocks of ``BLOCK_WORDS`` words by prefix sums, so a block's automaton has a
bounded size whatever the benchmark's. A task builds each automaton; the words
of the documents are streamed through it and the length of the longest match
that ends at each word is tracked. Where it reaches a window, the state says
which items hold that window; windows of short items are found on the state's
suffix links. Stretches without enough adjacent words that are adjacent in an
item too cannot hold a window and are passed over. With several blocks the
documents pass through one after the other and carry what was found.

Null and empty texts have no words. Items that share an id are one item; a null
id counts as empty text. Repeated rows are each judged. Very long texts are
taken apart in pieces, their word numbers held once. Empty tables give empty
results, an empty benchmark hits nothing; extra columns are kept by
``decontaminate`` and ignored otherwise.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ddl, fresh, map_batches, save, utf8
from .mixing import running
from .wordscan import WORDS, words

WINDOW = 10
#: Words of items in a block, and in a piece of a long item.
BLOCK_WORDS, PIECE_WORDS = 1 << 19, 1 << 13
#: Words of documents looked at together.
LOT_WORDS = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)
FOUND = "struct<n_words: bigint, n_hit: bigint, spans: array<struct<first: bigint, last: bigint>>, items: array<string>, kept: binary>"


class Automaton:
    """The suffix automaton of several word sequences: all their runs of words, and no other, lead somewhere from state 0."""

    def __init__(self):
        self.steps: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, steps: dict[int, int], link: int) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for what ``p`` and ``word`` spell: ``q``, or a copy of it for its shorter runs."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.steps[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.steps[p].get(word) == q:
            self.steps[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for word in sequence:
            there = self.steps[last].get(word)
            if there is not None:
                last = self._split(last, word, there)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.steps[p]:
                self.steps[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word, self.steps[p][word])
            last = new


class Index:
    """A block's automaton in arrays, with the items of its windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        owners: dict[bytes, set[str]] = {}
        for name, text in items:
            owners.setdefault(text, set()).add(name)
        self.names = [sorted(x) for x in owners.values()]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        sequences = [[number.setdefault(w, len(number) + 1) for w in text.split()] for text in owners]
        self.base = len(number) + 1
        built = Automaton()
        for x in sequences:
            built.add(x)
        self.link, self.length = np.array(built.link, np.int32), np.array(built.length, np.int32)
        edges = np.array([(v * self.base + w, t) for v, steps in enumerate(built.steps) for w, t in steps.items()], np.int64).reshape(-1, 2)
        edges = edges[np.argsort(edges[:, 0])]
        self.codes, self.targets = edges[:, 0], edges[:, 1].astype(np.int32)

        # where a match is as long as a window, the state on its links that a window leads to, and the items there
        at_window = self.length >= window
        self.at = np.where(at_window, np.arange(len(self.link)), -1).astype(np.int32)
        while True:
            up = self.link[self.at]
            climb = (self.at >= 0) & (self.length[up] >= window)
            if not climb.any():
                break
            self.at[climb] = up[climb]
        self.holders: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for n, x in enumerate(sequences):
            state = 0
            for i, w in enumerate(x):
                state = built.steps[state][w]
                if i + 1 >= window:
                    held = self.holders.setdefault(int(self.at[state]), [])
                    if not held or held[-1] != n:
                        held.append(n)
            if len(x) < window:
                self.short.setdefault(state, []).append((len(x), n))
        # the next state on the links, itself first, at which a short item ends
        self.ends = np.full(len(self.link), -1, np.int32)
        for state in np.argsort(self.length, kind="stable").tolist():
            self.ends[state] = state if state in self.short else (self.ends[self.link[state]] if state else -1)

        self.least = min([window, *map(len, sequences)])
        pairs = np.unique(np.array([a * self.base + b for x in sequences for a, b in zip(x, x[1:], strict=False)], np.uint64))
        self.bits = max(16, (16 * len(pairs)).bit_length())
        self.filled = np.zeros(1 << self.bits, bool)
        self.filled[self._place(pairs)] = True
        self._listed = None

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * _ODD) >> np.uint64(64 - self.bits)

    def numbers(self, data: bytes) -> np.ndarray:
        number = self.vocabulary.get
        found = [np.fromiter([number(w, 0) for w in x], np.int32, len(x)) for x in words(data)]
        return found[0] if len(found) == 1 else np.concatenate(found)

    def stretches(self, numbers: np.ndarray) -> list[tuple[int, int]]:
        """Where a window can be: first words and ends of runs whose adjacent words are adjacent in some item."""
        known = numbers > 0
        least = self.least
        if least > 1:
            pairs = numbers[:-1].astype(np.uint64) * np.uint64(self.base) + numbers[1:].astype(np.uint64)
            known = known[:-1] & known[1:]
            known &= self.filled[self._place(pairs)]
            least -= 1
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        first, end = edge[0::2], edge[1::2]
        fit = end - first >= least
        return list(zip(first[fit].tolist(), (end[fit] + (self.least > 1)).tolist(), strict=True))

    def walk(self, stretch: list[int], start: int, spans: list[tuple[int, int]], held: set[int]) -> None:
        """Add the spans hit in a stretch whose first word has the place ``start``, and its items' numbers."""
        if self._listed is None:
            self._listed = array("q", self.codes.tobytes()), self.targets.tolist(), self.link.tolist(), self.length.tolist(), self.at.tolist(), self.ends.tolist()
        codes, targets, link, length, at, ends = self._listed
        window, base, n_codes = self.window, self.base, len(codes)
        state = matched = 0
        for i, word in enumerate(stretch, start):
            while True:
                code = state * base + word
                k = bisect_left(codes, code)
                if k < n_codes and codes[k] == code:
                    state, matched = targets[k], matched + 1
                    break
                if not state:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            if matched >= window:
                held.update(self.holders[at[state]])
                if spans and spans[-1][1] >= i - window:
                    spans[-1] = min(spans[-1][0], i - window + 1), i
                else:
                    spans.append((i - window + 1, i))
            end = ends[state]
            while end >= 0:
                for n, item in self.short[end]:
                    if n <= matched:
                        held.add(item)
                        spans.append((i - n + 1, i))
                end = ends[link[end]] if end else -1


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if found and first <= found[-1][1] + 1:
            found[-1] = found[-1][0], max(last, found[-1][1])
        else:
            found.append((first, last))
    return found


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of some spans and what lies between them."""
    inside = np.frombuffer(b" " + data.translate(WORDS) + b" ", np.uint8) != 32
    edge = np.flatnonzero(np.diff(inside.astype(np.int8)))
    starts, stops, found, at = edge[0::2], edge[1::2], [], 0
    for first, last in spans:
        found.append(data[at : starts[first]])
        at = stops[last]
    return b"".join([*found, data[at:]])


def _pieces(items: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """name, norm (words between single spaces), n (words): long items in overlapping pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [w for part in words(x.as_py()) for w in part]
                for i in range(0, max(1, len(found) - window + 1), PIECE_WORDS) if found else ():
                    part = found[i : i + PIECE_WORDS + window - 1]
                    rows.append((name, b" ".join(part), len(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], names=["name", "norm", "n"])

    named = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), utf8(text).alias("t"))
    return map_batches(named, run, "name string, norm binary, n long").distinct()


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> Iterator[Broadcast]:
    """One index after the other, each of a block of bounded size."""
    session: SparkSession = items.sparkSession

    def build(table: pa.Table) -> pa.Table:
        import pickle

        found = Index(list(zip(table.column("name").to_pylist(), table.column("norm").to_pylist(), strict=True)), window)
        return pa.table({"block": table.column("block")[:1], "made": pa.array([pickle.dumps(found)], pa.binary())})

    with Scratch(session) as tmp:
        placed = running(tmp.save(_pieces(items, key, text, window), "item-pieces"), [F.xxhash64("name", "norm"), F.col("name"), F.col("norm")], {"before": "n"}, tmp)
        placed = placed.select(F.floor(F.col("before") / BLOCK_WORDS).alias("block"), "name", "norm")
        made = tmp.save(placed.groupBy("block").applyInArrow(build, "block long, made binary"), "item-indexes")
        import pickle

        for r in sorted(made.select("block").collect()):  # numbers of blocks
            yield session.sparkContext.broadcast(pickle.loads(made.filter(F.col("block") == r["block"]).first()["made"]))


def _scanned(docs: DataFrame, index: Broadcast, data: str, found: str, last: bool, longest: int | None) -> DataFrame:
    """``docs`` with what one more block finds; ``last``: with its sums and, where ``longest`` is given, the text without longer spans."""
    names = [c for c in docs.columns if c != found]
    carried = len(names) < len(docs.columns)  # then it is the last column

    def lot(own: Index, texts: list[bytes]) -> Iterator[tuple[int, list, set]]:
        numbered = [own.numbers(x) for x in texts]
        ends = np.cumsum([len(x) + 1 for x in numbered])
        gap = np.zeros(1, np.int32)  # no stretch goes on from one text to the next
        every = np.concatenate([y for x in numbered for y in (x, gap)])
        spans, held = [[] for _ in texts], [set() for _ in texts]
        for first, end in own.stretches(every):
            k = int(np.searchsorted(ends, first, side="right"))
            begin = int(ends[k]) - len(numbered[k]) - 1
            own.walk(every[first:end].tolist(), first - begin, spans[k], held[k])
        for x, s, h in zip(numbered, spans, held, strict=True):
            yield len(x), s, {name for n in h for name in own.names[n]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            texts, before = batch.column(names.index(data)), batch.column(len(names)).to_pylist() if carried else None
            rows, waiting, size = [], [], 0
            for i, x in enumerate(texts):
                waiting.append(x.as_py())
                size += len(waiting[-1]) // 4
                if size < LOT_WORDS and i + 1 < len(texts):
                    continue
                for text, (n, spans, held) in zip(waiting, lot(own, waiting), strict=True):
                    if before is not None:
                        earlier = before[len(rows)]
                        spans += [(s["first"], s["last"]) for s in earlier["spans"]]
                        held.update(earlier["items"])
                    spans, kept = merged(spans), None
                    if last and longest is not None:
                        gone = [s for s in spans if s[1] - s[0] + 1 > longest]
                        kept = without(text, gone) if gone else text
                    rows.append((n, sum(b - a + 1 for a, b in spans), spans, sorted(held), kept))
                waiting, size = [], 0
            n, hit, spans, held, kept = list(zip(*rows, strict=True)) or [()] * 5
            span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            pairs = pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], span)
            columns = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pairs, pa.array(held, pa.list_(pa.string())), pa.array(kept, pa.binary())]
            struct = pa.StructArray.from_arrays(columns, names=["n_words", "n_hit", "spans", "items", "kept"])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], struct], names=[*names, found])

    return map_batches(docs, run, f"{ddl(docs.select(*(F.col(f'`{c}`') for c in names)))}, `{found}` {FOUND}")


def scan(docs: DataFrame, items: DataFrame, found: str, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, longest: int | None = None) -> DataFrame:
    """``docs`` with a column ``found``: n_words, n_hit, spans (first and last hit words), items (ids as sorted texts) and, where ``longest`` is given, kept (the text without spans of more words)."""
    (data,) = fresh(docs, "utf8_text")
    rows, blocks = docs.withColumn(data, utf8(docs[text])), indexes(items, item_key, item_text, window)
    index = next(blocks, None) or docs.sparkSession.sparkContext.broadcast(Index([], window))
    for following in blocks:
        rows = save(_scanned(rows, index, data, found, False, None), "scanned")
        index = following
    return _scanned(rows, index, data, found, True, longest).drop(data)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", longest: int = WINDOW - 1, coverage: float = 0.5, **names) -> DataFrame:
    """The rows of ``docs`` of whose words at most a share of ``coverage`` is hit, without spans of more than ``longest`` words."""
    (found,) = fresh(docs, "found")
    cleaned = scan(docs, items, found, text, longest=longest, **names)
    stays = F.col(f"{found}.n_hit") <= coverage * F.col(f"{found}.n_words")
    shown = F.when(F.col(f"`{text}`").isNull(), F.lit(None)).otherwise(F.col(f"{found}.kept").cast("string"))
    return cleaned.filter(stays).withColumn(text, shown).drop(found)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    found = scan(rows, items, "found", "t", **names).select("id", "found.*")
    names_of = F.sha2(F.array_join("items", ","), 256)
    return found.select(F.col("id").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names_of.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH i AS (SELECT coalesce(cast(item_id AS varchar), '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
v AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS words FROM p),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
g AS (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM v) WHERE len(w) >= k),
o AS (SELECT r, p, g.k, item FROM (SELECT r, k, p, array_to_string(w[p:p + k - 1], ' ') AS words FROM g) g JOIN v ON g.k = v.k AND g.words = v.words),
n AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + k)) FROM (SELECT DISTINCT r, p, k FROM o)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
