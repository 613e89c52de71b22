"""Operator 10: near-dedup by BagMinHash signatures of multisets of word shingles.

A text's shingles are its runs of five words (words: ``[^\\x20\\x09-\\x0D]+``); a
text of one to four words has all of them as its one shingle. Texts are near
when the weighted Jaccard similarity of their multisets of shingles, the sum of
least counts over the sum of largest counts, is 0.8 or more, and a class is a
connected group of near texts.

Each unit of a shingle's count has a Poisson process of points in time that
fall on signature places. The units 2, 3-4, 5-8 ... above the first are drawn as
one process each; its points descend the halves of the cell by the bits of their
hash, and where a count ends inside a cell the points on units beyond it are
left out. A place of the signature is the first point that falls on it. Two signatures agree in a place with the weighted Jaccard similarity as the
probability. Bands of places make buckets.

Candidates are verified on the multisets themselves. Texts with the same
multiset are one row from there on. First every text is compared with one pivot
of each of its buckets; in buckets that still hold several classes, with the
text there whose shingles are most common, then one text of each class with one
of the largest class that shares a shingle; that joins large groups without
making their pairs. The texts of such buckets are then compared exactly: with
shingles ordered from rare to common, two near texts have one in common early
in both, and a pair is verified if it lies in different classes and shares such
a shingle, again and again until there is none that has not been looked at. In
each shingle the largest class is not compared with itself. No candidate that
could join two classes is left out.

Null texts and texts without words have no shingles and are classes of their
own row. Repeated rows are alike and share a class; a null id is a row like
others but never a class id unless the whole class has null ids. Empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, kept_by_worker, map_batches, matched, mix64, reduced, save, slices, small, unit, utf8

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 5
PLACES = BANDS * ROWS
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text taken apart together; texts are cut there between words.
BLOCK_BYTES = 1 << 20
#: Words over this are hashed one by one.
LONG_WORD = 1024
#: Numbers drawn at once.
DRAWN = 1 << 19
#: Buckets that may be broadcast.
BROADCAST_BUCKETS = 10_000
#: Bytes of texts' shingles that a task comparing pairs keeps.
HELD_BYTES = 16 << 20
#: Pairs of one text that a task takes at least before they are split.
LEAST_SHARE = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    spaces = np.zeros(256, bool)
    spaces[[9, 10, 11, 12, 13, 32]] = True
    return spaces, mix64(np.arange(1, LONG_WORD + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def _words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of texts that lie side by side in ``data``, and the text it is in; text i is from cuts[i] to cuts[i + 1].

    A word's hash is the sum of its bytes times odd numbers that stand for their places.
    """
    spaces, odd = kept_by_worker(("minhash",), _tables)
    inner = ~spaces[data]
    begins, ends = inner.copy(), inner.copy()
    begins[1:] &= ~inner[:-1]
    ends[:-1] &= ~inner[1:]
    edges = cuts[(cuts > 0) & (cuts < len(data))]
    begins[edges] = inner[edges]
    ends[edges - 1] = inner[edges - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    lengths = last - first + 1
    place = np.flatnonzero(inner)
    starts = np.cumsum(lengths) - lengths
    nth = np.arange(len(place)) - np.repeat(starts, lengths)
    values = (data[place].astype(np.uint64) + np.uint64(1)) * odd[np.minimum(nth, LONG_WORD - 1)]
    hashes = np.add.reduceat(values, starts) if len(first) else np.empty(0, np.uint64)
    hashes = mix64(hashes + lengths.astype(np.uint64) * _STEP)
    for i in np.flatnonzero(lengths > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(data[first[i] : last[i] + 1].tobytes())
    return hashes, np.searchsorted(cuts, first, side="right") - 1


def _blocks(text: bytes) -> Iterator[bytes]:
    """A text in blocks that end between words."""
    start = 0
    while len(text) - start > BLOCK_BYTES:
        stop = start + BLOCK_BYTES
        near = max(text.rfind(x, start, stop) for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if near <= start:  # one word fills the block
            found = [x for x in (text.find(x, stop) for x in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x >= 0]
            near = min(found, default=len(text))
        yield text[start:near]
        start = near
    yield text[start:]


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts, and how many each has; a text over BLOCK_BYTES stands alone."""
    if len(texts) == 1 and len(texts[0]) > BLOCK_BYTES:
        found = np.concatenate([_words(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in _blocks(texts[0]) if x])
        return found, np.array([len(found)])
    cuts = np.cumsum([0, *map(len, texts)])
    # empty texts share their cut with the next one, to which searchsorted gives the words
    hashes, owner = _words(np.frombuffer(b"".join(texts), np.uint8), cuts)
    return hashes, np.bincount(owner, minlength=len(texts))


def many_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text as 64-bit hashes, in order, how often each occurs, and how many different ones each text has."""
    words, n_words = _hashes(texts)
    ends = np.cumsum(n_words)
    begin = ends - n_words
    run = np.minimum(n_words, WORDS)
    n = n_words - run + (n_words > 0)
    at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
    width = np.repeat(run, n)
    h = width.astype(np.uint64)
    for k in range(WORDS):
        short = width <= k
        more = mix64(h * _STEP + words[np.minimum(at + k, len(words) - 1)]) if len(words) else h
        h = np.where(short, h, more) if short.any() else more
    cut = np.cumsum(n)
    for a, b in zip((cut - n).tolist(), cut.tolist(), strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[(cut - n)[n > 0]] = True
    first = np.flatnonzero(new)
    each = np.bincount(np.repeat(np.arange(len(texts)), n)[first], minlength=len(texts))
    return h[first], np.diff(np.append(first, len(h))), each


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles as 64-bit hashes, in order, and how often each occurs."""
    return many_shingles([text])[:2]


def _first_points(cells: np.ndarray, rates: np.ndarray, until: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Points of each cell's process before its ``until``: cell's index, time and a hash that is the point's."""
    for start in range(0, len(cells), DRAWN):
        part = slice(start, start + DRAWN)
        for which, time, h in _points_of(cells[part], rates[part], until[part]):
            yield which + start, time, h


def _points_of(cells: np.ndarray, rates: np.ndarray, until: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    which, now, number, step = np.arange(len(cells)), np.zeros(len(cells)), 0, 2
    while len(which):
        step = max(1, min(step, DRAWN // len(which)))
        k = np.arange(number + 1, number + step + 1, dtype=np.uint64) * _STEP
        h = mix64(cells[which, None] + k)
        time = now[:, None] + np.cumsum(-np.log(unit(h)), 1) / rates[which, None]
        row, col = np.nonzero(time < until[which, None])
        yield which[row], time[row, col], mix64(h[row, col] ^ np.uint64(0xD6E8FEB86659FD93))
        on = time[:, -1] < until[which]
        which, now, number, step = which[on], time[on, -1], number + step, 2 * step


def many_signatures(items: np.ndarray, counts: np.ndarray, each: np.ndarray) -> np.ndarray:
    """For each text the hash of the first point on each place; ``each`` says how many items a text has, one at least.

    The cell of a count's first unit is its own; the units 2, 3-4, 5-8 ... are
    cells of one process each, whose points descend the halves of their cell by
    the bits of their hash until they are at one unit; a point on a unit
    beyond the count is left out.
    """
    n_texts = len(each)
    owner = np.repeat(np.arange(n_texts), each)
    total = np.add.reduceat(counts, np.cumsum(each) - each).astype(np.float64)
    until = (np.log(PLACES) + 3) * PLACES / total
    out, todo = np.zeros((n_texts, PLACES), np.uint64), np.arange(n_texts)
    while len(todo):
        best, mark = np.full(n_texts * PLACES, np.inf), np.zeros(n_texts * PLACES, np.uint64)
        at = np.flatnonzero(np.isin(owner, todo)) if len(todo) < n_texts else np.arange(len(items))
        cell, low, size = mix64(items[at] ^ np.uint64(1)), np.zeros(len(at), np.int64), np.ones(len(at), np.int64)
        while len(at):
            for index, time, h in _first_points(cell, size.astype(np.float64), until[owner[at]]):
                # the point's hash says which unit of its cell it is in
                spot = low[index] + (mix64(h ^ np.uint64(0xA0761D6478BD642F)) % size[index].astype(np.uint64)).astype(np.int64)
                inside = spot < counts[at[index]]
                place = owner[at[index]] * PLACES + (h % np.uint64(PLACES)).astype(np.int64)
                place, time, h = place[inside], time[inside], h[inside]
                before = best[place]
                np.minimum.at(best, place, time)
                won = (time == best[place]) & (time < before)
                mark[place[won]] = h[won]
            low, size = low + size, np.where(low == 0, 1, size * 2)
            more = counts[at] > low
            cell, low, size, at = mix64(cell[more] + np.uint64(77)), low[more], size[more], at[more]
        whole = np.isfinite(best.reshape(n_texts, PLACES)).all(1)
        done = todo[whole[todo]]
        out[done] = mark.reshape(n_texts, PLACES)[done]
        todo = todo[~whole[todo]]
        until *= 2
    return out


def signature(items: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return many_signatures(items, counts, np.array([len(items)]))[0]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in slices(batch.column(1), BLOCK_BYTES // 2):
            items, counts, each = many_shingles([x.as_py() for x in batch.column(1)[start:stop]])
            some = np.flatnonzero(each)
            marks = many_signatures(items, counts, each[some]).reshape(len(some), BANDS, ROWS) if len(some) else np.empty((0, BANDS, ROWS), np.uint64)
            h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(some), BANDS))
            for k in range(ROWS):
                h = mix64(h * _STEP + marks[:, :, k])
            cuts = np.cumsum(each).tolist()
            prints = [xxhash.xxh3_128_digest(items[b - n : b].tobytes() + counts[b - n : b].tobytes()) if n else None for b, n in zip(cuts, each.tolist(), strict=True)]
            there = each > 0
            ends = np.append(0, np.cumsum(there * BANDS)).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(~there, False)), pa.array(h.reshape(-1).view(np.int64)))
            sums = np.append(0, np.cumsum(counts))
            total = sums[np.cumsum(each)] - sums[np.cumsum(each) - each]
            yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], pa.array(prints, pa.binary()), bands, pa.array(total, pa.int64()), batch.column(2)[start:stop]], names=["id", "print", "bands", "n_shingles", "text_hash"])


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, print (16 bytes, of the multiset), bands (array<long>, one bucket for each band), n_shingles, text_hash."""
    source = docs.select(F.col(key).alias("id"), utf8(text).alias("utf8"), F.xxhash64(utf8(text)).alias("text_hash"))
    return map_batches(source, _signed, f"id {source.dtypes[0][1]}, print binary, bands array<long>, n_shingles long, text_hash long")


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of the multisets of shingles."""
    return _overlap(shingles(a), shingles(b))


def _overlap(x, y) -> float:
    (a, m), (b, n) = x, y
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    common = int(np.minimum(m[both], n[at[both]]).sum())
    return common / (int(m.sum()) + int(n.sum()) - common)


def _with_text(rows: DataFrame, pairs: DataFrame, n_pairs: int, texts: DataFrame, end: str, name: str) -> DataFrame:
    """``rows``, which has ``pairs`` (a, b), with the text of the row that column ``end`` names.

    A row that is in more pairs than its share of a task, as the pivot of a
    large bucket is, is split: its text goes to several tasks, each with a part
    of its pairs.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = max(LEAST_SHARE, -(-n_pairs // (4 * tasks)))
    split = pairs.groupBy(end).agg(F.count("*").alias("n")).filter(F.col("n") > each).select(end, F.ceil(F.col("n") / each).alias("ways"))
    split = small(split, split.count())
    dealt = rows.join(split, end, "left").withColumn("way", F.pmod(F.xxhash64("a", "b"), F.coalesce("ways", F.lit(1).cast("long")))).drop("ways")
    copies = texts.select(F.col("row").alias(end), F.col("utf8").alias(name)).join(split, end, "left")
    copies = copies.withColumn("way", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("ways", F.lit(1).cast("long")) - 1))).drop("ways")
    return dealt.join(copies, [end, "way"]).drop("way")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b), a written table, whose similarity is reached; ``texts`` has row and utf8 of all of them."""
    n_pairs = pairs.count()
    left = _with_text(pairs, pairs, n_pairs, texts, "a", "left")
    both = _with_text(left, pairs, n_pairs, texts, "b", "right").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        size = 0

        def known(row: int, text: pa.BinaryScalar) -> tuple:
            nonlocal size
            if row not in held:
                if size > HELD_BYTES:
                    held.clear()
                    size = 0
                held[row] = shingles(text.as_py())
                size += 16 * len(held[row][0])
            return held[row]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            near = [_overlap(known(a[i], batch.column(2)[i]), known(b[i], batch.column(3)[i])) >= SIMILARITY for i in range(len(a))]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return map_batches(both, run, "a long, b long")


def components(edges: DataFrame, tmp: Scratch | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node of each connected group, by sending least labels along links and jumping.

    Each round groups by node, with partial sums before the shuffle, and ends
    when no label changes. Labels are broadcast only where the nodes were
    counted and are within the bound; else they are shuffled.
    """
    tmp = tmp or Scratch(edges.sparkSession)
    links = tmp.save(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct(), "links")
    labels = tmp.save(links.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "labels")
    nodes = labels.count()
    while True:
        near = links.join(small(labels.select(F.col("node").alias("other"), F.col("root").alias("seen")), nodes), "other")
        heard = near.groupBy("node").agg(F.min("seen").alias("seen"))
        told = tmp.save(heard.join(small(labels, nodes), "node").select("node", "root", F.least("root", "seen").alias("low")), "told")
        # what a node hears holds for its root as well
        roots = told.groupBy("root").agg(F.min("low").alias("hooked"))
        hooked = told.join(small(roots, nodes), "root").select("node", F.col("root").alias("old"), F.least("low", "hooked").alias("mid"))
        jump = small(labels.select(F.col("node").alias("mid"), F.col("root").alias("next")), nodes)
        moved = tmp.save(hooked.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("next", "mid")).alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.filter("old != root").isEmpty():
            return labels


def _joined(root: DataFrame, edges: DataFrame, tmp: Scratch) -> DataFrame:
    """``root`` after more edges (a, b): only the groups that they touch are gone through again."""
    ends = edges.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    moved = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")), tmp)
    moved_ = small(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), moved.count())
    old = root.join(moved_, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return tmp.save(old.unionByName(moved.join(root.select("node"), "node", "left_anti")), "roots")


def _pivots(members: DataFrame, order, tmp: Scratch) -> DataFrame:
    """Pairs of each member with the first of its bucket in the given order; the largest buckets' firsts are broadcast."""
    own = [c for c in members.columns if c not in ("band", "bucket")]
    first = members.groupBy("band", "bucket").agg(F.min(F.struct(order.alias("order"), *own)).alias("first"), F.count("*").alias("n"))
    first = tmp.save(first.filter("n > 1").select("band", "bucket", "n", *(F.col(f"first.{c}").alias(f"pivot_{c}") for c in own)), "pivots")
    return matched(members, first, ["band", "bucket"], "n", "inner", BROADCAST_BUCKETS).filter(F.col("row") != F.col("pivot_row"))


def _tokens(texts: DataFrame) -> DataFrame:
    """row, token: every shingle of a text, the second of its kind told from the first, and so on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                items, counts = shingles(text.as_py())
                ends = np.cumsum(counts)
                nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
                tokens = mix64(np.repeat(items, counts) + nth.astype(np.uint64) * _STEP).view(np.int64)
                for at in range(0, len(tokens), 1 << 18):
                    part = tokens[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row.as_py()), pa.int64()), pa.array(part)], names=["row", "token"])

    return map_batches(texts.select("row", "utf8"), run, "row long, token long")


def _prefixes(texts: DataFrame, sizes: DataFrame, n_rows: int, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rarest tokens of each text, of which two near texts always have one in common, and how common its tokens are.

    First: row, token, place (how many rarer ones the text has), as far as a
    near text may begin there. Second: row, common (mean number of texts that
    have its tokens).
    """
    tokens = tmp.save(_tokens(texts.join(small(sizes.select("row"), n_rows), "row")), "tokens")
    held = tokens.groupBy("token").agg(F.count("*").alias("texts")).filter("texts > 1")
    shared = tokens.join(held, "token")
    by_row = tmp.save(shared.groupBy("row").agg(F.count("*").alias("shared"), F.sum("texts").alias("common")).join(small(sizes, n_rows), "row"), "shares")
    # tokens that no other text has come first
    lone = by_row.select("row", "n_shingles", (F.col("n_shingles") - F.col("shared")).alias("lone"))
    open_ = lone.filter(F.col("n_shingles") - F.col("lone") >= SIMILARITY * F.col("n_shingles") - 1e-6)
    ranked = shared.join(small(open_, n_rows), "row").withColumn("nth", F.row_number().over(Window.partitionBy("row").orderBy("texts", "token")))
    placed = ranked.withColumn("place", F.col("lone") + F.col("nth") - 1).filter(F.col("n_shingles") - F.col("place") >= SIMILARITY * F.col("n_shingles") - 1e-6)
    return tmp.save(placed.select("row", "token", "place", "n_shingles"), "prefixes"), by_row.select("row", (F.col("common") / F.col("n_shingles")).alias("common"))


def _across(prefixes: DataFrame, roots: DataFrame, n_rows: int, heads: bool, tmp: Scratch) -> DataFrame:
    """Pairs of different classes that share a token where a near pair's first common one may be.

    In each token the largest class is not compared with itself: only rows of
    other classes look for partners. With ``heads`` one row of each class is
    compared with one of the largest there, so their number is that of the
    classes; what they join has no pairs in the round after.
    """
    placed = prefixes.join(small(roots, n_rows), "row", "left").withColumn("root", F.coalesce("root", "row"))
    classes = placed.groupBy("token", "root").agg(F.count("*").alias("n"))
    several = classes.groupBy("token").agg(F.max_by("root", "n").alias("main"), F.count("*").alias("k")).filter("k > 1").select("token", "main")
    placed = tmp.save(placed.join(several, "token"), "placed")
    if heads:
        placed = placed.groupBy("token", "main", "root").agg(F.min(F.struct("row", "n_shingles", "place")).alias("head")).select("token", "main", "root", "head.*")
    ours, theirs = (placed.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("main", "row", "root", "n_shingles", "place"))) for x in "ab")
    if heads:
        theirs = theirs.filter("root_b = main_b")
    most = F.least(F.col("n_shingles_a") - F.col("place_a"), F.col("n_shingles_b") - F.col("place_b"))
    fits = (1 + SIMILARITY) * most >= SIMILARITY * (F.col("n_shingles_a") + F.col("n_shingles_b")) - 1e-6
    return ours.filter("root_a != main_a").join(theirs, "token").filter((F.col("root_a") != F.col("root_b")) & fits)


def _mixed(members: DataFrame, root: DataFrame, tmp: Scratch) -> DataFrame:
    """Members of buckets that hold two classes or more."""
    named = tmp.save(members.join(root.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")), "named")
    spread = named.groupBy("band", "bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low != high")
    spread = tmp.save(spread.select("band", "bucket", "n"), "spread")
    return tmp.save(matched(named, spread, ["band", "bucket"], "n", "left_semi", BROADCAST_BUCKETS), "mixed")


def _classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    signed = save(signatures(docs, key, text), "signatures")
    some = signed.filter("print IS NOT NULL")
    with Scratch(docs.sparkSession) as tmp:
        rows, root = _roots(docs, some, key, text, tmp)
        roots = rows.select("row", "print", "least", "copies").join(root.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
        sizes = roots.groupBy("root").agg(F.min("least").alias("least"), F.sum("copies").alias("class_size"))
        classes = save(roots.drop("least").join(sizes, "root").select("print", F.col("least.id").alias("class_id"), F.col("least.text_hash").alias("class_hash"), "class_size"), "classes")
    named = some.join(classes, "print").select("id", "text_hash", "class_id", "class_hash", "class_size", "n_shingles")
    alone = signed.filter("print IS NULL").select("id", "text_hash", F.col("id").alias("class_id"), F.col("text_hash").alias("class_hash"), F.lit(1).cast("long").alias("class_size"), "n_shingles")
    return named.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("class_id")))


def _roots(docs: DataFrame, some: DataFrame, key: str, text: str, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """One row for each multiset, and (node, root) of those that have near ones."""
    first, least = F.min(F.struct("id", "text_hash")).alias("first"), F.min(F.struct(F.isnull("id").alias("none"), "id", "text_hash")).alias("least")
    rows = some.groupBy("print").agg(first, least, F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n_shingles"))
    rows = tmp.save(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    buckets = rows.select("row", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    # texts alone in all their buckets have no part in what follows
    members = tmp.save(matched(buckets, tmp.save(shared, "shared"), ["band", "bucket"], "n", "left_semi", BROADCAST_BUCKETS), "buckets")
    involved = tmp.save(rows.join(members.select("row").distinct(), "row", "left_semi").select("first", "row", "n_shingles"), "involved")
    wanted = small(involved.select(F.col("first.id").alias("of_id"), F.col("first.text_hash").alias("of_hash"), "row", "n_shingles"), involved.count())
    sources = docs.select(F.col(key).alias("id"), utf8(text).alias("utf8"))
    found = sources.join(wanted, F.col("id").eqNullSafe(F.col("of_id")) & (F.xxhash64("utf8") == F.col("of_hash")))
    texts = tmp.save(found.groupBy("row").agg(F.first("utf8").alias("utf8")), "texts")

    def named(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()

    # first with one pivot of each bucket, whatever it is
    near_size = F.least("n_shingles", "pivot_n_shingles") >= SIMILARITY * F.greatest("n_shingles", "pivot_n_shingles")
    looked = tmp.save(named(_pivots(members, F.xxhash64("row"), tmp).filter(near_size), "row", "pivot_row"), "pairs")
    root = components(tmp.save(_verify(looked, texts), "near"), tmp)

    # then, in buckets that hold several classes, with the text whose shingles are most common
    mixed = _mixed(members, root, tmp)
    rest = tmp.save(mixed.select("row", "n_shingles").distinct(), "rest")
    n_rows = rest.count()
    prefixes, common = _prefixes(texts, rest, n_rows, tmp)
    order = -(F.col("common") * 1024).cast("long") * (1 << 20) + F.pmod(F.xxhash64("row"), F.lit(1 << 20))
    pairs = named(_pivots(tmp.save(mixed.join(small(common, n_rows), "row"), "mixed"), order, tmp).filter(near_size & (F.col("root") != F.col("pivot_root"))), "row", "pivot_row")
    rounds = 0
    while True:
        pairs = tmp.save(pairs.join(looked, ["a", "b"], "left_anti"), "pairs")
        new = tmp.save(_verify(pairs, texts), "near")
        if not new.isEmpty():
            root = _joined(root, new, tmp)
        elif rounds > 1 and pairs.isEmpty():
            return rows, root
        looked = looked.unionByName(pairs)
        known = tmp.save(root.withColumnRenamed("node", "row").join(small(rest.select("row"), n_rows), "row", "left_semi"), "known")
        rounds += 1
        pairs = named(_across(prefixes, known, n_rows, rounds == 1, tmp), "row_a", "row_b")


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, class_id, class_size, n_shingles, kept."""
    return _classes(docs, key, text).select(F.col("id").alias(key), "class_id", "class_size", "n_shingles", "kept")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each class one with the least id, of its texts the one with the smallest hash."""
    classes = _classes(docs, key, text).filter("class_size > 1")
    stays = F.col("kept") & (F.col("text_hash") == F.col("class_hash"))
    named = classes.groupBy("id", F.col("text_hash").alias("mark")).agg(F.first(stays).alias("stays"), F.count("*").alias("n"))
    named = save(named.filter("NOT stays OR n > 1").drop("n"), "near-dropped")
    return reduced(docs, named, key, F.xxhash64(utf8(docs[text])))
