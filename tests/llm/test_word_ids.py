"""Words of many texts at a time."""

import time
import zlib

import numpy as np
import regex

from scanlore.llm import quality, text_model


def _plain(text: bytes) -> list[int]:
    found = []
    for chunk in text.split():
        words = regex.findall(r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}\s]+", chunk.decode("utf-8", "replace").lower())
        found += [zlib.crc32(x.encode()) % quality.BUCKETS for x in words]
    return found


def test_word_ids_of_odd_texts(monkeypatch):
    rng = np.random.default_rng(3)
    signs = ["a", "B", "É", "Σ", "İ", "ß", "中", "𝒳", "🙂", "́", "​", " ", "\x85", "\xa0", "\x1c", "\x00", "�", "9", "Ⅷ", ".", "-", *" \t\n\r\v\f"]
    texts = [b"", b" ", b"\n\n", b"x" * 64 + b" " + b"y" * 65 + b"! " + b"z" * 70_000, "中".encode() * 400, b"Word, word\n" * 3_000]
    texts += ["".join(rng.choice(signs, rng.integers(60))).encode() for _ in range(400)]
    texts += [bytes(rng.choice([32, 97, 0xC3, 0xE4, 0xB8, 0xF0, 0x9F, 0xED, 0xA0, 10, 46], rng.integers(40)).astype(np.uint8)) for _ in range(400)]
    want = [_plain(x) for x in texts]
    for size in (text_model.WORDS_BYTES, 50):
        monkeypatch.setattr(text_model, "WORDS_BYTES", size)
        assert [x.tolist() for x in text_model.Words(quality.BUCKETS).ids(texts)] == want
    assert text_model.Words(quality.BUCKETS).ids([]) == []


def test_words_cost_the_same_whatever_the_vocabulary():
    rng = np.random.default_rng(4)
    few = [b" ".join(b"%08x" % i for i in rng.integers(0, 500, 300)) for _ in range(1_000)]
    many = [b" ".join(b"%08x" % i for i in rng.integers(0, 1 << 32, 300)) for _ in range(1_000)]
    words = text_model.Words(quality.BUCKETS)

    def seconds(texts: list[bytes]) -> float:
        start = time.process_time()
        words.ids(texts)
        return time.process_time() - start

    least = {name: min(seconds(texts) for _ in range(3)) for name, texts in (("few", few), ("many", many))}
    assert least["many"] < 3 * least["few"]
