"""Words of whole texts as bytes: what the operators on benchmarks, targets and sources share.

Delimiters are ASCII, so words are told from bytes alone: A-Z are lowered and
delimiters become spaces in one pass, and every byte of another character is
part of a word, also in texts that are not valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

# Bytes that are part of a word besides those of characters outside ASCII.
DIGITS = b"0123456789"
LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: Bytes of a text that are taken apart at a time.
PIECE_BYTES = 1 << 20


def _folded(kept: bytes) -> bytes:
    def of(byte: int) -> int:
        lowered = byte + 32 if 65 <= byte <= 90 else byte
        return lowered if lowered > 127 or lowered in kept else 32

    return bytes(map(of, range(256)))


#: For ``bytes.translate``: words of letters and digits, and of letters alone.
WORDS = _folded(DIGITS + LETTERS)
TERMS = _folded(LETTERS)


def pieces(data: bytes, most: int = PIECE_BYTES) -> Iterator[tuple[int, bytes]]:
    """A folded text in parts of about ``most`` bytes with their places, cut at spaces only; a longer word stays whole."""
    start, end = 0, len(data)
    while end - start > most:
        cut = data.rfind(b" ", start, start + most)
        if cut <= start:
            cut = data.find(b" ", start + most)
        if cut < 0:
            break
        yield start, data[start:cut]
        start = cut
    yield start, data[start:] if start else data


def words(data: bytes, table: bytes = WORDS) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    for _, piece in pieces(data.translate(table)):
        yield piece.split()
