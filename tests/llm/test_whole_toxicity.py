"""A text's toxicity depends on its own words only, whatever stands beside it."""

import numpy as np

from scanlore.llm import toxicity


def _model():
    rng = np.random.default_rng(5)
    model = {"table": rng.normal(0, 1, (40, toxicity.EMBEDDED)).astype(np.float32)}
    model["table"][-1] = 0
    return model | {f"f{w}": rng.normal(0, 1, (w, toxicity.EMBEDDED, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}


def test_pools_agree(monkeypatch):
    rng, model = np.random.default_rng(6), _model()
    texts = [rng.integers(0, 39, n) for n in (5, 1, 0, 2, 3, 0, 40, 1, 1, 17)]
    alone = np.concatenate([toxicity._pool_many(model, [x]) for x in texts])
    paths = toxicity._pooled(model, texts)[0]
    assert np.allclose(alone, paths, atol=1e-4)
    for block in (toxicity.BLOCK, 8, 3):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        for order in (range(len(texts)), rng.permutation(len(texts)), rng.permutation(len(texts))):
            found = toxicity._pool_many(model, [texts[i] for i in order])
            assert np.allclose(found, alone[list(order)], atol=1e-4)


def test_neighbours_do_not_count():
    pick = np.random.default_rng(7)
    calm = [" ".join(f"word{i}" for i in pick.integers(0, 200, 30)) for _ in range(300)]
    vile = [" ".join(["vile", "awful", "nasty"] * 4) + " " + x for x in calm[:150]]
    model = toxicity.train([(x.encode(), 0) for x in calm] + [(x.encode(), 1) for x in vile])
    texts = [x.encode() for pair in zip(calm[:100], vile[:100], strict=True) for x in pair]
    together = toxicity.score(model, texts)
    assert np.allclose(together, [toxicity.score(model, [x])[0] for x in texts], atol=1e-4)
