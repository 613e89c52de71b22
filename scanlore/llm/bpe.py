"""Operator 8: byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece exactly one token can be the last of its encoding:
the one whose pairing with the last token of the shorter prefix would not be
merged otherwise. Storing that token for each prefix gives the encoding by
walking back, lets bytes be appended without looking at earlier ones again, and
after an edit only the entries near it are computed anew.

Null texts count as empty and give no tokens. Bytes that are not UTF-8 become
U+FFFD before splitting. Repeated rows and extra columns pass through. Very long
texts and pieces take time in proportion to their length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ENTRY_BYTES, KEY_BYTES, Memo, ddl, fresh, kept_by_worker, map_batches, slices, utf8

#: Bytes of chunks, and of pieces, that a worker keeps with their ids; as many again that came before them are found too.
MEMO_BYTES = 24 << 20
#: Bytes of pairs of tokens of which it is known whether they fit.
PAIR_BYTES = 24 << 20
#: Bytes up to which the tables of many pieces are filled together.
SHORT = 64


class Vocabulary:
    """Ranks, how each token came about by merging, and which pairs of tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(t, t) for t in range(self.size)]
        self.reachable = bytearray(self.size)
        for rank in range(self.size):
            self._derive(rank)
        self.longest = max(map(len, ranks), default=1)
        self.exact = {t: r for t, r in ranks.items() if self.reachable[r]}
        self.fits = Memo(lambda key: self._fits(*divmod(key, self.size)), PAIR_BYTES)

    @functools.cached_property
    def suffixes(self) -> set[bytes]:
        return {t[i:] for t in self.exact for i in range(len(t))}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def _derive(self, rank: int) -> None:
        """Find the one pair of earlier tokens that merges into this one."""
        token = self.bytes_of[rank]
        if len(token) < 2:
            self.reachable[rank] = len(token) == 1
            return
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
            if left < rank and right < rank and self.reachable[left] and self.reachable[right] and self._fits(left, right):
                self.halves[rank] = left, right
                self.merged[left, right] = rank
                self.reachable[rank] = 1
                return

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both, side by side, gives just these two tokens.

        Undo the merges next to the border, the latest first; if the tokens
        that met there at any time had a merge of lower rank than the one
        undone, that merge would have come first.
        """
        undone = self.size
        while True:
            across = self.merged.get((left, right), self.size)
            if across < undone:
                return False
            if left > right and self.halves[left][0] != left:
                undone, left = left, self.halves[left][1]
            elif self.halves[right][0] != right:
                undone, right = right + 1, self.halves[right][0]
            elif self.halves[left][0] != left:
                undone, left = left, self.halves[left][1]
            else:
                return True


class PrefixTable:
    """The last token of the encoding of every prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _last_at(self, end: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        exact, suffixes, fits, n = v.exact, v.suffixes, v.fits, v.size
        found, start = [], end - 1
        while start >= 0 and (tail := data[start:end]) in suffixes:
            token = exact.get(tail)
            if token is not None:
                found.append((start, token))
            start -= 1
        for start, token in reversed(found):
            if start == 0 or fits[last[start] * n + token]:
                return token
        raise ValueError("a byte is missing from the vocabulary")

    def append(self, more: bytes) -> None:
        """Earlier entries hold for every longer piece, so only the new bytes are looked at."""
        start = len(self.data)
        self.data += more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last_at(end))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes; returns how many entries were computed anew.

        Entries before the edit stay. Behind it they are taken over as soon as
        as many in a row as the longest token has bytes came out as before.
        """
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[: start + 1]
        longest, same = self.vocabulary.longest, 0
        for end in range(start + 1, len(self.data) + 1):
            token = self._last_at(end)
            self.last.append(token)
            before = end - shift
            same = same + 1 if before > stop and old[before] == token else 0
            if same >= longest:
                self.last.extend(old[before + 1 :])
                return end - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes_of[self.last[end]])
        return out[::-1]


class PieceTables:
    """The tables of many short pieces at once: one row for each piece, one column for each prefix."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, v: Vocabulary):
        self.v, self.length = v, np.array([len(x) for x in v.bytes_of] or [0], np.int32)
        self.power = np.cumprod(np.full(SHORT + 1, self._BASE, np.uint64)) * pow(int(self._BASE), -1, 1 << 64)
        names = [x for x in v.exact if len(x) <= SHORT]
        hashes = np.concatenate([self._prefixes(part)[:, -1] for n in range(1, SHORT + 1) if (part := [x for x in names if len(x) == n])])
        tokens = np.array([v.exact[x] for n in range(1, SHORT + 1) for x in names if len(x) == n], np.int32)
        slots = self._slot(hashes)
        order = np.argsort(slots, kind="stable")
        self.hashes, self.tokens = hashes[order], tokens[order]
        # the bytes of each token by eights, to tell it from others with its hash
        self.eights = np.frombuffer(b"".join(x[:SHORT].ljust(SHORT, b"\0") for x in v.bytes_of) or bytes(SHORT), "<u8").reshape(-1, SHORT // 8)
        # where the hashes of each slot begin
        self.begin = np.searchsorted(slots[order], np.arange((1 << 20) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.begin).max(initial=0))
        self.maybe = np.diff(self.begin) > 0
        self.pair, self.pair_fits = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)

    def _prefixes(self, pieces: list[bytes]) -> np.ndarray:
        """Polynomial hashes of all prefixes; pieces are filled up with zeros to the longest."""
        width = max(map(len, pieces))
        data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(len(pieces), width).astype(np.uint64)
        out = np.zeros((len(pieces), width + 1), np.uint64)
        for i in range(width):
            out[:, i + 1] = out[:, i] * self._BASE + data[:, i] + np.uint64(1)
        return out

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs seen lately are in a table with one place for each hash."""
        key = left.astype(np.int64) * self.v.size + right
        at = ((key.astype(np.uint64) * self._BASE) >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self.pair[at] != key)
        out = self.pair_fits[at]
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            found = np.array([self.v.fits[k] for k in keys.tolist()], bool)
            out[new] = found[back]
            self.pair[at[new]], self.pair_fits[at[new]] = key[new], out[new]
        return out

    def _same(self, eights: np.ndarray, row: np.ndarray, begin: np.ndarray, end: int, token: np.ndarray) -> np.ndarray:
        """Whether the bytes from ``begin`` to ``end`` are the token's."""
        length = end - begin
        same = self.length[token] == length
        for k in range(0, int(length.max(initial=0)), 8):
            some = np.flatnonzero(length > k)
            left = np.minimum(length[some] - k, 8).astype(np.uint64) * np.uint64(8)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left)
            same[some] &= (eights[row[some], begin[some] + k] & mask) == self.eights[token[some], k // 8]
        return same

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as int32 bytes."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        start = 0
        while start < len(order):
            widest = len(pieces[order[start]])
            stop = next((i for i in range(start, min(len(order), start + 65536)) if 2 * len(pieces[order[i]]) < widest), min(len(order), start + 65536))
            for i, ids in zip(order[start:stop], self._block([pieces[i] for i in order[start:stop]]), strict=True):
                out[i] = ids
            start = stop
        return out

    def _block(self, pieces: list[bytes]) -> list[bytes]:
        sizes = np.array([len(x) for x in pieces])
        prefix = self._prefixes(pieces)
        # the eight bytes from each place on
        padded = np.frombuffer(b"".join(x.ljust(int(sizes[0]) + 8, b"\0") for x in pieces), np.uint8).reshape(len(pieces), -1)
        eights = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8, 1)).view("<u8")[..., 0]
        last = np.full(prefix.shape, -1, np.int32)
        for end in range(1, prefix.shape[1]):
            rows = int(np.searchsorted(-sizes, -end, side="right"))
            low = max(0, end - self.v.longest)
            tails = prefix[:rows, end, None] - prefix[:rows, low:end] * self.power[end - np.arange(low, end)]
            slots = self._slot(tails)
            row, begin = np.nonzero(self.maybe[slots])
            wanted = tails[row, begin]
            at = self.begin[slots[row, begin]]
            hit = self.hashes[at] == wanted
            for k in range(1, self.deepest):
                other = np.flatnonzero(~hit)
                near = np.minimum(at[other] + k, len(self.hashes) - 1)
                found = self.hashes[near] == wanted[other]
                at[other[found]], hit[other[found]] = near[found], True
            row, begin, token = row[hit], begin[hit] + low, self.tokens[at[hit]]
            same = self._same(eights, row, begin, end, token)
            if not same.all():
                row, begin, token = row[same], begin[same], token[same]
            before = last[row, begin]
            good = begin == 0
            later = np.flatnonzero(~good)
            good[later] = self._fits(before[later], token[later])
            last[row[good], end] = token[good]
        lines, ends, left, walked = np.arange(len(pieces)), sizes.copy(), np.arange(len(pieces)), []
        while len(left):
            token = last[left, ends[left]]
            walked.append((lines[left], token))
            ends[left] -= self.length[token]
            left = left[ends[left] > 0]
        rows = np.concatenate([x for x, _ in walked])
        tokens = np.concatenate([x for _, x in walked])[::-1]
        tokens = tokens[np.argsort(rows[::-1], kind="stable")].astype(np.int32).tobytes()
        cuts = (4 * np.cumsum(np.bincount(rows, minlength=len(pieces)))).tolist()
        return [tokens[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


#: Space that the pattern's own library knows; the other one counts four control characters more.
_EXACT = ((r"(?!\S)", r"(?!\P{White_Space})"), (r"[^\s", r"[^\p{White_Space}"), (r"\s", r"\p{White_Space}"))


class _Kept:
    """Ids by text, in two generations: when the newer holds MEMO_BYTES it becomes the older, which is dropped."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}
        self.held = 0

    def missing(self, wanted: set) -> set:
        """Those of ``wanted`` that are in neither; the others are in the newer one from then on."""
        if self.held > MEMO_BYTES:
            self.old, self.new, self.held = self.new, {}, 0
        wanted = wanted.difference(self.new)
        again = wanted.intersection(self.old)
        old = self.old
        self.new.update({x: old[x] for x in again})
        self.held += ENTRY_BYTES * len(again)
        return wanted.difference(again)

    def add(self, texts: list, ids: list) -> None:
        self.new.update(zip(texts, ids, strict=True))
        self.held += sum(ENTRY_BYTES + 5 * len(x) for x in texts)

    def trim(self) -> None:
        """Long ones are known for the batch only."""
        for x in [x for x in self.new if len(x) > KEY_BYTES]:
            del self.new[x]


class Encoder:
    """Splits texts by the pattern and encodes each piece; repeated chunks come from a memo of bounded size."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.tables = vocabulary, PieceTables(vocabulary)
        for a, b in _EXACT:
            pattern = pattern.replace(a, b)
        self.pieces = regex.compile(pattern).findall
        self.spaces = frozenset(regex.findall(r"\p{White_Space}", "".join(map(chr, range(0x3001)))))
        self.borders = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})").split
        self.chunks, self.known = _Kept(), _Kept()
        self.flat = np.frombuffer(b"".join(vocabulary.bytes_of), np.uint8)
        self.begins = np.cumsum([0, *map(len, vocabulary.bytes_of)])
        digits = [f"{i} ".encode() for i in range(vocabulary.size)]
        width = max(map(len, digits), default=1)
        self.digits = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in digits), f"V{width}")

    def _learn(self, pieces: set[str]) -> None:
        """Ids of pieces that are not in the memo yet; a piece that is a token itself is that token."""
        ranks, short, done, ids = self.vocabulary.ranks, [], [], []
        for piece in self.known.missing(pieces):
            data = piece.encode()
            whole = ranks.get(data)
            if whole is None and len(data) <= SHORT:
                short.append((piece, data))
                continue
            done.append(piece)
            ids.append(np.array(PrefixTable(self.vocabulary, data).tokens() if whole is None else whole, np.int32).tobytes())
        if short:
            done += [x for x, _ in short]
            ids += self.tables.encode([x for _, x in short])
        self.known.add(done, ids)

    def _texts(self, texts: list[str], pieces: Iterable[str]) -> list[bytes]:
        """Ids of texts; those of ``pieces`` are in the memo as well then."""
        split = [self.pieces(x) for x in texts]
        self._learn(set(chain.from_iterable(split)).union(pieces))
        known = self.known.new
        return [b"".join([known[p] for p in x]) for x in split]

    def _parts(self, texts: list[bytes]) -> Iterator[list[bytes]]:
        """Each text's ids in parts. A single space between other characters always begins a piece, so texts split there first."""
        split = [x.split(b" ") for x in texts]
        spaces = self.spaces
        fine: list[bytes] = []
        strings: list[str] = []
        plain: dict[bytes, str] = {}
        odd: set[bytes] = set()
        for x in self.chunks.missing(set().union(*(x[1:] for x in split))):
            text = x.decode("utf-8", "replace")
            if not text or text[0] in spaces or text[-1] in spaces:  # white space touches the single space
                odd.add(x)
            elif x.isalpha():  # of bytes this asks for ASCII letters: one piece with its space
                plain[x] = " " + text
            else:
                fine.append(x)
                strings.append(" " + text)
        heads, whole = {}, {}  # how texts begin that are put together from chunks, and the parts of the others
        for i, (first, *rest) in enumerate(split):
            head = first.decode("utf-8", "replace")
            if head and (head[0] in spaces or head[-1] in spaces) or not head and rest or odd and not odd.isdisjoint(rest):
                first, *more = self.borders(texts[i].decode("utf-8", "replace"))
                whole[i] = len(strings), 1 + len(more)
                strings += [first, *(" " + x for x in more)]
            else:
                heads[i] = len(strings)
                strings.append(head)
        found = self._texts(strings, plain.values())
        self.chunks.add(fine, found[: len(fine)])
        self.chunks.add(list(plain), [self.known.new[p] for p in plain.values()])
        self.known.trim()
        get = self.chunks.new.__getitem__
        for i in range(len(texts)):
            if i in heads:
                yield [found[heads[i]], *map(get, split[i][1:])]
            else:
                start, n = whole[i]
                yield found[start : start + n]
        self.chunks.trim()

    def encode_all(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for parts in self._parts(texts):
            yield np.frombuffer(b"".join(parts), np.int32)

    def count_all(self, texts: list[bytes]) -> list[int]:
        """Number of ids of each text."""
        return [sum(map(len, parts)) // 4 for parts in self._parts(texts)]

    def encode(self, data: bytes) -> list[int]:
        return next(self.encode_all([data])).tolist()

    def decode(self, ids) -> bytes:
        """The bytes of the tokens one after the other."""
        ids = np.asarray(ids, np.int64)
        out = []
        for start in range(0, len(ids), 1 << 16):
            part = ids[start : start + (1 << 16)]
            begin = self.begins[part]
            length = self.begins[part + 1] - begin
            ends = np.cumsum(length)
            out.append(self.flat[np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)].tobytes())
        return b"".join(out)

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space."""
        return self.digits[ids].tobytes().translate(None, b"\0")[:-1]


def encoder(path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return kept_by_worker(("bpe", path, pattern), lambda: Encoder(Vocabulary.load(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column ``ids`` (array<int>) to the rows; a column of that name is replaced."""
    kept = docs.drop(ids)
    source = kept.withColumn(fresh(docs, "utf8")[0], utf8(docs[text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, stop in slices(texts):
                part = batch.slice(start, stop - start)
                found = pa.array(list(enc.encode_all([x.as_py() for x in texts[start:stop]])), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=[*part.schema.names[:-1], ids])

    return map_batches(source, run, f"{ddl(kept)}{', ' if kept.columns else ''}`{ids}` array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the column ``text`` (string) decoded from ``ids``; null ids give an empty text, a column of that name is replaced."""
    kept = encoded.drop(text)
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for start, stop in slices(batch.column(at).cast(pa.list_(pa.int32())), 2_000_000):
                part = batch.slice(start, stop - start)
                found = pa.array([enc.decode(x.values.to_numpy() if x.is_valid else []).decode("utf-8", "replace") for x in part.column(at)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, text])

    return map_batches(kept, run, f"{ddl(kept)}, `{text}` string")


def digest(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode its ids again and return counts and hashes of both."""
    source = docs.select(F.col(key).alias("id"), utf8(text).alias("utf8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                counts, encoded, decoded = [], [], []
                for ids in enc.encode_all([x.as_py() for x in batch.column(1)[start:stop]]):
                    counts.append(len(ids))
                    encoded.append(sha(enc.decimal(ids)).hexdigest())
                    decoded.append(sha(enc.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = map_batches(source, run, f"id {source.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", key)
