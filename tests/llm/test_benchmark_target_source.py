"""Decontamination, importance resampling and source divergence against plain Python, on odd rows and small blocks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ahocorasick")

from scanlore.llm import divergence, leaks, resample, wordscan  # noqa: E402

CLASHING = ["id", "t", "n", "before", "nth", "tie", "fit", "utf8_text", "found", "place", "term", "slice", "lot", "n_words", "spans", "items"]


def _lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lowered(text))


def _docs(spark, rows):
    """Rows of (doc_id, text, lang, source) with columns that clash with names used inside."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).repartition(3)


def _texts(seed=1, n=60):
    random.seed(seed)
    pool = [f"w{i}" for i in range(30)] + ["Ärger", "ÖL", "the", "x" * 60, "日本"]
    made = [" ".join(random.choices(pool, k=random.randint(0, 80))) for _ in range(n)]
    return [*made, None, "", "...", " lone ", "\tTHE the,tHe\n"]


# --- decontamination


def _items():
    random.seed(7)
    pool = [f"w{i}" for i in range(30)] + ["the", "Ärger"]
    long = [" ".join(random.choices(pool, k=n)) for n in (10, 11, 25, 60, 200)]
    rows = [(i, x) for i, x in enumerate(long)] + [(20, "w1 w2"), (21, "W3-w4, w5"), (22, "nowhere"), (23, None), (24, ""), (None, "w1 w2 w6"), (30, long[0]), (30, "w7 w8 w9"), (31, "w2")]
    return [(i, x) for i, x in rows if x != "w2"], long


def _leaks(docs, items, window=10):
    windows = defaultdict(set)
    for i, x in items:
        w = _words(x)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[p : p + k])].add("" if i is None else str(i))
    sizes = {len(x) for x in windows}
    for i, text in docs:
        w = _words(text)
        hit, names = set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                held = windows.get(tuple(w[p : p + k]))
                if held:
                    hit.update(range(p, p + k))
                    names |= held
        yield i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names, key=str.encode)).encode()).hexdigest(), bool(hit)


def _leaky_docs(long):
    texts = _texts(2)
    inside = [f"before {x} after" for x in long] + [" ".join(long[3].split()[5:15]), " ".join(long[3].split()[5:14]), long[4].upper().replace(" ", "-"), long[1] + " " + long[2] + " and " + long[4], "w1 w2 w1 w2 w6"]
    big = " ".join(f"v{i % 911}" for i in range(400_000)) + " " + long[4] + " v3" * 5
    return list(enumerate([*texts, *inside, big, inside[0], inside[0]])) + [(None, inside[1])] * 2


@pytest.mark.parametrize("block", [leaks.BLOCK_WORDS, 40])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", block)
    monkeypatch.setattr(leaks, "PIECE_WORDS", 50 if block == 40 else 17)
    items, long = _items()
    rows = _leaky_docs(long)
    docs = _docs(spark, [(i, x, None, None) for i, x in rows])
    found = leaks.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(_leaks(rows, items), key=repr)


def test_contamination_by_words_of_one_item(spark):
    """An item of one word makes every word a stretch."""
    rows = [(1, "a b c b"), (2, "c"), (3, None)]
    items = [("x", "b"), ("y", "b c"), ("z", "q")]
    docs = _docs(spark, [(i, x, None, None) for i, x in rows])
    found = leaks.contamination(docs, spark.createDataFrame(items, "item_id string, text string"))
    assert sorted(map(tuple, found.collect())) == sorted(_leaks(rows, items))


def test_contamination_of_empty_tables(spark):
    docs, none = _docs(spark, [(1, "a b", None, None)]), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[1:4] for r in leaks.contamination(docs, none).collect()] == [(2, 0, 0)]
    assert leaks.contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_automaton_holds_every_run_and_no_other():
    random.seed(3)
    sequences = [[random.randint(1, 3) for _ in range(random.randint(1, 12))] for _ in range(30)]
    built = leaks.Automaton()
    for x in sequences:
        built.add(x)
    runs = {tuple(x[i:j]) for x in sequences for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    reached, todo = set(), [((), 0)]
    while todo:
        run, state = todo.pop()
        for word, there in built.steps[state].items():
            reached.add((*run, word))
            todo.append(((*run, word), there))
    assert reached == runs
    assert len(built.link) <= 2 * sum(map(len, sequences))


def test_decontaminate_cuts_spans_and_drops_documents(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, f"{item} and more than twenty other words " + "z " * 40, "en", "a"), (2, item, "en", "a"), (3, "Clean, text.", "en", "a"), (4, None, "en", "a"), (5, "", "en", "a")]
    docs = _docs(spark, [*rows, (6, f"Say: {item}! Fine, " + "Ä " * 30, "en", "a")])
    left = {r.doc_id: r for r in leaks.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert sorted(left) == [1, 3, 4, 5, 6]
    assert left[1].text == " and more than twenty other words " + "z " * 40
    assert left[6].text == "Say: ! Fine, " + "Ä " * 30
    assert (left[3].text, left[4].text, left[5].text) == ("Clean, text.", None, "")
    assert all(r[c] == f"own {c}" for r in left.values() for c in CLASHING)


# --- importance resampling


def _features(text):
    w = _words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _resampled(docs, target):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(_features(x))
    for x in target:
        t.update(_features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for i, x in docs:
        weight = sum(math.floor(1000 * math.log(float((t[b] + 1) * (s_all + 10_000)) / float((s[b] + 1) * (t_all + 10_000)))) for b in _features(x))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(_features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(_words(x)) >= 20))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = 5 * len(fit) // 100
    return [(*r[:4], k if k <= drawn else None) for k, r in enumerate(fit, 1)] + [(*r[:4], None) for r in rows if not r[4]]


def test_resampling(spark):
    texts = _texts(4, 150)
    rows = list(enumerate(texts)) + [(3, texts[3])] * 40 + [(None, texts[5])] * 3 + [(900, "big " + " ".join(f"u{i % 5000}" for i in range(300_000)))]
    target = ["w1 w2 w3 w4 the the", None, "Ärger w5 w6", ""]
    docs = _docs(spark, [(i, x, None, None) for i, x in rows])
    found = resample.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(_resampled(rows, target), key=repr)


def test_resampling_of_empty_tables(spark):
    docs, none = _docs(spark, [(1, "a b " * 30, None, None)]), spark.createDataFrame([], "text string")
    assert [tuple(r) for r in resample.resample(docs, none).collect()] == _resampled([(1, "a b " * 30)], [])
    assert resample.resample(docs.limit(0), none).collect() == []


@pytest.mark.parametrize(("words", "scan"), [(resample.DICTIONARY_BYTES, resample.SCAN_BYTES), (0, 300), (100, 80)])
def test_runs_in_pieces_and_with_small_dictionaries(monkeypatch, words, scan):
    import pyarrow as pa

    monkeypatch.setattr(resample, "SCAN_BYTES", scan)
    texts = [*_texts(9), "y" * 1000 + " z " + "q" * 39 + " " + "r" * 40, " ".join(f"w{i % 7}" for i in range(500))]
    own = resample.Dictionary(words)
    for _ in range(3):
        found = [[] for _ in texts]
        for rows, *block in resample._blocks(pa.array([(x or "").encode() for x in texts], pa.binary())):
            for part, crc in own.runs(*block):
                for row, c in zip(rows[part].tolist(), (crc % 10_000).tolist(), strict=True):
                    found[row].append(c)
        assert [sorted(x) for x in found] == [sorted(_features(x)) for x in texts]


def test_shift_is_what_more_bytes_do():
    shift, heads = resample.Shift(), [b"a", b"some words", bytes(50)]
    for n in (0, 1, 7, resample.WORD_BYTES, resample.WORD_BYTES + 1, 5000):
        tail = bytes(range(256)) * (n // 256 + 1)
        got = shift(np.array([zlib.crc32(x) for x in heads], np.uint32), np.full(len(heads), n)) ^ np.uint32(zlib.crc32(tail[:n]))
        assert got.tolist() == [zlib.crc32(x + tail[:n]) for x in heads]


# --- source divergence


def _diverged(rows, least, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", _lowered(text))) for text, lang, source in rows]
    holding = Counter((lang, t) for lang, _, terms in rows for t in set(terms))
    kept = defaultdict(set)
    for (lang, t), n in holding.items():
        if n >= least:
            kept[lang].add(t)
    counts = defaultdict(Counter)
    for lang, source, terms in rows:
        counts[lang, source].update(t for t in terms if t in kept[lang])
    of_lang = defaultdict(Counter)
    for (lang, _), c in counts.items():
        of_lang[lang] += c

    def price(c, t, lang):
        return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept[lang]))

    for (lang, source), c in counts.items():
        pairs = [(-sum(abs(price(c, t, lang) - price(d, t, lang)) for t in kept[lang]), other.encode()) for (x, other), d in counts.items() if x == lang and other != source]
        terms = [(price(of_lang[lang], t, lang) - price(c, t, lang), t.encode()) for t in kept[lang] if c[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(x for x in terms if x[0] < 0)[:top])):
            for k, (value, item) in enumerate(found, 1):
                yield lang, source, part, item.decode(), -value, k


@pytest.mark.parametrize(("size", "tile"), [(divergence.SLICE, divergence.TILE), (4, 2)])
def test_divergence(spark, monkeypatch, size, tile):
    monkeypatch.setattr(divergence, "SLICE", size)
    monkeypatch.setattr(divergence, "TILE", tile)
    random.seed(5)
    texts = [x and re.sub(r"w(\d+)", lambda m: "w" + "abcdefghij"[int(m[1]) % 10] * (1 + int(m[1]) // 10), x) for x in _texts(6, 120)]
    rows = [(x, random.choice(["en", "de", None]), random.choice(["a", "b", "c", "d", "é", None])) for x in texts] + [("same words here", "en", "a")] * 50
    rows += [(None, "xx", "a"), ("", "xx", "b"), ("alone", "yy", "c"), (" ".join(["again"] * 300_000), "en", "b")]
    docs = _docs(spark, [(None, *r) for r in rows])
    found = divergence.divergence(docs, min_docs=4, top=7)
    assert sorted(map(tuple, found.collect())) == sorted(_diverged(rows, 4, 7))


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(_docs(spark, [(1, "a", "b", "c")]).limit(0)).collect() == []


def test_gallop_finds_what_is_there():
    random.seed(1)
    for n, m in ((0, 5), (5, 0), (1, 1), (300, 4000), (600, 700), (1000, 3)):
        few, many = (np.array(sorted(random.sample(range(9000), k))) for k in (n, m))
        places = {int(x): i for i, x in enumerate(many)}
        assert divergence.gallop(few.astype(np.int64), many.astype(np.int64)).tolist() == [places.get(int(x), -1) for x in few]


def test_prices_are_exact_beyond_doubles():
    for count, total in ((0, 7), (10**15 - 3, 10**15 + 10**9), (123_456_789_012, 999_999_999_999)):
        assert divergence.prices(np.array([count]), total).tolist() == [1 + 10**9 * (count + 5) // total]


def test_prices_agree_in_columns(spark):
    rows = [(0, 7), (10**15 - 3, 10**15 + 10**9), (123_456_789_012, 999_999_999_999), (5, 10**13)]
    found = spark.createDataFrame(rows, "n long, total long").select("n", "total", divergence.price(F.col("n"), F.col("total")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 5) // r.total for r in found)


def test_pieces_are_cut_at_spaces():
    text = b"aa bbb  c dddddddddddd e"
    for most in range(1, 30):
        parts = list(wordscan.pieces(text, most))
        assert b"".join(x for _, x in parts) == text
        assert [w for _, x in parts for w in x.split()] == text.split()
        assert all(text[at : at + len(x)] == x for at, x in parts)


# --- bounds that several operators share


def test_broadcasts_are_bounded_in_bytes(spark, monkeypatch):
    from scanlore.llm import common

    hinted = lambda df: "ResolvedHint (strategy=broadcast)" in df._jdf.queryExecution().analyzed().toString()
    few = spark.createDataFrame([("x" * 1000, 1), ("y" * 1000, 2)], "id string, n long")
    assert hinted(common.small(few, 2)) and not hinted(common.small(few, 2, 1))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 1000)
    assert not hinted(common.light(few, "id", most=1000))
    rows = spark.createDataFrame([("x" * 1000, i) for i in range(30)] + [("z", 1), ("w", 2)], "key string, v long")
    groups = spark.createDataFrame([("x" * 1000, 30), ("z", 1)], "key string, n long")
    for how, want in (("inner", 31), ("left", 32), ("left_semi", 31)):
        assert common.matched(rows, groups, "key", "n", how).count() == want
    # a host with 100,000 lines is not broadcast as if it were one number
    lines = spark.createDataFrame([("h", 100_000)], "key string, n long").withColumn("held", F.lit(100_000 * 40))
    joined = common.matched(rows, lines, "key", "n", "left", 10_000, F.col("held"))
    assert not hinted(joined) and joined.count() == 32


def test_paths_without_scheme_belong_to_the_default_file_system(spark, tmp_path, monkeypatch):
    from scanlore import scratch
    from scanlore.llm import ann

    monkeypatch.setattr(scratch, "scratch_dir", lambda spark: scratch.qualified(spark, str(tmp_path)))
    assert scratch.scratch_path(spark, "x").startswith(f"file://{tmp_path}/x-")
    random.seed(2)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0)
    assert found.count() == 30
    hadoop = spark._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "viewfs://store/")
    hadoop.set("fs.viewfs.mounttable.store.link./some", f"file://{tmp_path}")
    try:
        assert scratch.qualified(spark, "/some/where") == "viewfs://store/some/where"
        assert scratch.qualified(spark, "file:///some/where") == "file:///some/where"
    finally:
        hadoop.set("fs.defaultFS", before or "file:///")


def test_missing_queries_are_an_error(spark, tmp_path):
    from scanlore.llm import ann

    points = spark.createDataFrame([([i], [float(i), 1.0]) for i in range(9)], "ids array<long>, v array<double>")
    with pytest.raises(Exception, match="queries in"):
        ann.search_shards(points, f"file://{tmp_path}/nowhere", {2}, 1, 3).collect()
    assert ann.search_shards(points, f"file://{tmp_path}/nowhere", set(), 1, 3).collect() == []


def test_a_pivot_of_many_pairs_is_split(spark, monkeypatch):
    from scanlore.llm import minhash

    monkeypatch.setattr(minhash, "LEAST_SHARE", 5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base, f"end{i}"]) for i in range(80)] + ["far away " + " ".join(f"v{i}" for i in range(60))]
    table = spark.createDataFrame([(i, x.encode()) for i, x in enumerate(texts)], "row long, utf8 binary")
    pairs = [(0, i) for i in range(1, 81)] + [(3, 4)]
    found = minhash._verify(spark.createDataFrame(pairs, "a long, b long"), table)
    assert sorted(map(tuple, found.collect())) == sorted(p for p in pairs if minhash.similarity(texts[p[0]].encode(), texts[p[1]].encode()) >= minhash.SIMILARITY)
    assert found.count() == 80
