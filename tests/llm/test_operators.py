"""Each operator against a plain version of it, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from scanlore.llm import ann, bpe, chat, exact, linededup, minhash, mixing, quality, text_model, tokencount, toxicity  # noqa: E402
from scanlore.llm.queries import END_OF_DOCUMENT, QUERIES, vocabulary  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x") for i, t, s in rows], DOCS)


def odd_rows():
    long = "word " * 60_000
    return [(1, None, "b"), (2, "", "a"), (3, "Same Text", "a"), (4, "same text", None), (4, "same text", None), (None, "same text", "b"), (5, long, "b"), (6, long.upper(), "a"), (7, "  \n\t ", "c"), (8, "ÄÖ same", "c"), (9, "äö same", "c"), (9, "another", "c"), (10, "a b", None)]


@pytest.fixture(scope="module")
def plain():
    path, pattern = vocabulary()
    own = bpe.Vocabulary.load(path)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_is_exact(plain):
    enc = bpe.encoder(*vocabulary())
    pick = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "'ll", "23", "é", "ß", "\x1c", "\x85", "　", "!", "$$", "中", "😀", "\r\n", "ing", "​"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 25))) for _ in range(3000)]
    texts += [c * 3000 for c in "ab 1!"] + ["", " ", "ab" * 5000, "x" * 65, "<|endoftext|>"]
    for text, ids in zip(texts, enc.encode_all([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == plain.encode_ordinary(text)
        assert enc.decode(ids.tolist()) == text.encode()


def test_bpe_appends_and_edits():
    vocabulary_ = bpe.encoder(*vocabulary()).vocabulary
    pick = random.Random(2)
    for _ in range(200):
        data = "".join(pick.choice("abcdet h") for _ in range(pick.randint(0, 200))).encode()
        a = pick.randint(0, len(data))
        b = pick.randint(a, len(data))
        new = bytes(pick.choice(b"abcde") for _ in range(pick.randint(0, 5)))
        edited, fresh = bpe.PrefixTable(vocabulary_, data), bpe.PrefixTable(vocabulary_, data[:a] + new + data[b:])
        edited.edit(a, b, new)
        assert edited.last == fresh.last
        grown = bpe.PrefixTable(vocabulary_, data[:a])
        grown.append(data[a:])
        assert grown.last == bpe.PrefixTable(vocabulary_, data).last


def test_bpe_frames(spark, plain):
    docs = docs_of(spark, odd_rows())
    rows = bpe.digest(docs, *vocabulary()).collect()
    assert len(rows) == len(odd_rows())
    want = sorted((str(i), len(plain.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in odd_rows())
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in rows) == want
    encoded = bpe.encode(docs.withColumn("ids", F.lit("clash")), *vocabulary())
    assert encoded.columns == [*docs.columns, "ids"]
    again = bpe.decode(encoded, *vocabulary()).select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.text) for r in again) == sorted((str(i), t or "") for i, t, _ in odd_rows())
    assert bpe.digest(docs.limit(0), *vocabulary()).count() == 0


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("hashed", [None, lambda t: F.unhex(F.substring(F.md5(t), 1, 2)), lambda t: F.lit(b"one")])
def test_exact_groups(spark, hashed):
    rows = exact.exact_groups(docs_of(spark, odd_rows()), hashed=hashed).collect()
    groups = {}
    for i, t, _ in odd_rows():
        groups.setdefault(lowered(t), []).append(i)
    want = sorted((str(i), max((x for x in groups[lowered(t)] if x is not None), default=None), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t, _ in odd_rows())
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_exact_dedup(spark):
    docs = docs_of(spark, odd_rows())
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 7, 8, 9, 9, 10]
    assert exact.exact_dedup(docs.limit(0)).count() == 0


def targets_of(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = sum(weight[s] for s in order if s not in full) or 1
        left = 1.5 * total - sum(2 * sizes[s] for s in full)
        target = {s: float(2 * sizes[s]) if s in full else weight[s] * left / free for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("rows", [odd_rows(), [(i, "w " * (i % 7), f"s{i % 5 if i % 3 else 0}") for i in range(400)], []])
def test_mixing(spark, rows):
    found = mixing.mix(docs_of(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, *_ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target = targets_of(sizes)
    assert sorted((len((t or "").split()), sizes[s], round(target[s], 6)) for _, t, s in rows) == sorted((r["size"], r.source_size, round(r.target, 6)) for r in found)
    assert all(0 <= r.taken <= 2 * r["size"] for r in found)
    for s in sizes:
        largest = max(len((t or "").split()) for _, t, x in rows if x == s)
        taken = sum(r.taken for r in found if r.source_size == sizes[s] and r.target == target[s])
        if list(sizes.values()).count(sizes[s]) == 1:
            assert abs(taken - target[s]) <= largest / 2 + 1e-6
    docs = docs_of(spark, rows)
    copies = mixing.mix_documents(docs)
    assert copies.columns == docs.columns
    assert copies.filter("n_chars IS NOT NULL").count() == 0


def test_near_classes(spark):
    pick = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, t, s) for i, t, s in odd_rows()]
    for g in range(12):
        base = [pick.choice(words) for _ in range(pick.choice([3, 40, 150]))]
        for k in range(pick.choice([2, 9])):
            text = list(base)
            for _ in range(pick.choice([0, 1, 2, 4])):
                text[pick.randrange(len(text))] = pick.choice(words)
            rows.append((1000 * (g + 1) + k, "  ".join(text), "a"))
    rows.append((5000, "w " * 900, "a"))
    rows.append((5001, "w " * 1000, "a"))
    items = [minhash.shingles((t or "").encode()) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if minhash._overlap(items[a], items[b]) >= minhash.SIMILARITY:
                parent[find(a)] = find(b)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(a)
    want = sorted((str(rows[a][0]), str(min((rows[x][0] for x in g if rows[x][0] is not None), default=None)) if len(items[a][0]) else str(rows[a][0]), len(g)) for g in groups.values() for a in g)
    docs = docs_of(spark, rows)
    found = minhash.near_classes(docs).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.class_size) for r in found) == want
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert minhash.near_classes(docs.limit(0)).count() == 0
    assert minhash.near_dedup(docs.limit(0)).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(150):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64))
        m = rng.integers(1, rng.integers(2, 20), len(a))
        n = np.maximum(1, m + rng.integers(-2, 3, len(a)))
        off.append((minhash.signature(a, m) == minhash.signature(a, n)).mean() - minhash._overlap((a, m), (a, n)))
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.07


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)}


def test_escapes():
    pick = random.Random(5)
    parts = [*chat.CONTROLS, "\\", "<", "|", ">", "[", "]", "INST", "a", "\n", "[[INST]", "<<s>>"]
    for _ in range(5000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


@pytest.mark.parametrize("budget", [40, 1024])
def test_chats(spark, budget):
    rows = [(1, 0, "system", "be <s> kind"), (1, 1, "user", "hi \\ there"), (1, 2, "assistant", "</s>[INST] ok"), (2, 1, "assistant", None), (2, 1, "assistant", "twice"), (2, None, None, "no number"), (None, 0, "user", "lost"), (3, 0, "assistant", "long " * 3000)]
    rows += [(4, i, ("system", "user", "assistant")[min(i, 1 + i % 2)], f"turn {i} says ok") for i in range(60)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_chats(table, *vocabulary(), budget=budget, history=budget // 4)
    found = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(t for *_, role, t in turns if role == "assistant")
        assert found[conv].n_turns == len(turns)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for w in windows.filter("conv_id = 4").collect():
        assert w.text.startswith("<s><|turn|>system<|text|>") and w.n_tokens <= max(budget, 60)
    assert chat.read_back(chat.format_chats(table.limit(0), *vocabulary())).count() == 0


def test_line_dedup(spark):
    page = "<html><head><title>T{0}</title><style>p{{}}</style></head><body><p>own {0}<br>Foot &amp; line</p><!-- x --><p>own {0}</p></body></html>"
    rows = [(i, "http://A.com:80/x", page.format(i)) for i in range(6)] + [(7, "https://b.org", page.format(7)), (8, None, "<p>Foot &amp; line"), (None, "http://a.com", None), (9, "http://a.com?q", "")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_dropped int")
    found = {r.page_id: r for r in linededup.line_dedup(table).collect()}
    assert len(found) == len(rows)
    assert found[0].text == "T0\nown 0\nown 0" and found[0].n_dropped == 1 and found[0].host_pages == 8
    assert found[7].text == "T7\nown 7\nFoot & line\nown 7" and found[8].text == "Foot & line"
    assert found[None].n_lines == 0
    assert linededup.line_dedup(table.limit(0)).count() == 0


def test_token_counts(spark, plain, tmp_path):
    docs = docs_of(spark, odd_rows())
    found = tokencount.token_counts(docs, *vocabulary(), END_OF_DOCUMENT).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in found) == sorted((str(i), len(plain.encode_ordinary(t or ""))) for i, t, _ in odd_rows())
    assert tokencount.token_counts(docs.limit(0), *vocabulary(), END_OF_DOCUMENT).count() == 0
    pick = random.Random(6)
    for name in ("a", "b", "c"):
        ids = np.array([9 if pick.random() < 0.2 else pick.randint(0, 8) for _ in range(pick.randint(0, 90))], "<u2")
        (tmp_path / f"{name}.tokens").write_bytes(ids.tobytes())
    for block in (2, 6, 10, 1000):
        found = sorted(map(tuple, tokencount.scan_token_files(spark, str(tmp_path), 9, 2, block).collect()))
        want = []
        for name in ("a", "b", "c"):
            ids = np.frombuffer((tmp_path / f"{name}.tokens").read_bytes(), "<u2").tolist()
            lengths, n = [], 0
            for x in ids:
                if x == 9:
                    lengths.append(n)
                    n = 0
                else:
                    n += 1
            want += [(f"{name}.tokens", k, v) for k, v in enumerate(lengths + [n] * (n > 0))]
        assert found == sorted(want)


def test_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    rows += [(600 + i, rows[0][1]) for i in range(30)] + [(5, rows[5][1])]
    rows += [(700, None), (750, [0.0] * 8), (800, [float("nan")] * 8), (850, [None] + [1.0] * 7), (900, [1.0, 2.0]), (950, [1.0, 2.5]), (None, [1.0] * 8), (1000, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    found = ann.nearest(table, F.col("id") % 50 == 0).collect()
    fine = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for q in [i for i in fine if i % 50 == 0]:
        scores = sorted((-float(fine[q] @ v / (np.linalg.norm(fine[q]) * np.linalg.norm(v))), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
        want = scores[:5]
        assert sorted(got[q]) == list(range(1, len(want) + 1))
        hits += len({i for _, i in want} & {i for i, _ in got[q].values()})
        total += len(want)
        assert all(abs(-dict((i, s) for s, i in scores)[i] - s) < 1e-12 for i, s in got[q].values())
    assert hits / total >= 0.9
    assert [i for i, _ in (got[0][k] for k in range(1, 6))] == [600, 601, 602, 603, 604]
    assert ann.nearest(table.limit(0), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("label,fit", [("toxic", toxicity.toxicity), ("quality", quality.quality)])
def test_classifiers(spark, label, fit):
    pick = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(500):
        y = int(i % 3 == 0)
        text = [pick.choice(words) for _ in range(40)]
        if y:
            for _ in range(12):
                text[pick.randrange(40)] = pick.choice(["vile", "awful", "###", "nasty"])
        rows.append((i, " ".join(text), "s"))
        labels.append((i, y, y))
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "word1 " * 100_000, "s"), (None, "word2", "s"), (3, rows[3][1], "s")]
    docs = docs_of(spark, rows).withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (7, None, None), (None, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    found = fit(docs, marks).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 500]
    divisor, rest = (5, 0) if label == "toxic" else (3, 1)
    assert {r.doc_id for r in held} == {i for i in range(500) if zlib.crc32(str(i).encode()) % divisor == rest}
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.9
    assert all(r.score == 0 for r in fit(docs, marks.limit(0)).collect())
    assert fit(docs.limit(0), marks).count() == 0
    again = {(r.doc_id, r.score) for r in fit(docs, marks).collect()}
    assert again == {(r.doc_id, r.score) for r in found}


def test_training_ignores_held_out_labels(spark):
    docs = docs_of(spark, [(i, f"t{i}", "s") for i in range(50)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    sample = text_model.labelled(docs, marks, "toxic", text_model.held_out_by(5, 0))
    assert {t.decode() for t, _ in sample} == {f"t{i}" for i in range(50) if zlib.crc32(str(i).encode()) % 5}


@there
def test_reruns_agree(spark):
    for name in ("op3_mixing", "op5_chat_windows", "op7_exact_dedup"):
        assert sorted(map(str, QUERIES[name](spark, SF).collect())) == sorted(map(str, QUERIES[name](spark, SF).collect()))
