import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from tessera.llm import lbl, lm


def test_base_score_equals_brute_force_and_model_is_better_on_held_out_texts(spark):
    rng = random.Random(2)
    pairs = {"a": "bcd", "b": "efg", "c": "aef", "d": "gab", "e": "ab", "f": "cd", "g": "ef"}
    rows = []
    for i in range(400):
        t, w = [], "a"
        for _ in range(rng.randint(1, 60)):
            w = rng.choice(pairs[w])
            t.append(w.upper() + ("" if rng.random() < 0.7 else str(rng.randint(0, 300))))
        rows.append((i, " \n".join(t), 1))
    rows += [(1000, None, 1), (1001, "", 1), (None, "A  b", 1), rows[3], (1002, "x" * 100000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").repartition(3)
    got = lm.score_documents(df, own=12, common=20).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(x for d, t, _ in rows if not held(d) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(k := tokens(t)), sum(c[x] > 0 for x in k), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in k), 6)) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score_documents(df.limit(0)).count() == 0


def small_layout():
    return lbl.Layout(np.array([0, 3, 5, 6]), np.array([5.0, 3, 1, 4, 2, 6]))


def test_probabilities_equal_brute_force_and_are_normalised():
    lay, rng = small_layout(), np.random.default_rng(1)
    net = lbl.Net(lay, 4)
    for name in lbl.NAMES:
        setattr(net, name, rng.normal(0, 0.7, getattr(net, name).shape).astype(np.float32))
    off = np.array([0, 4, 5, 9])
    items = np.array([0, 4, 2, 5, 5, 3, 1, 0, 5])
    ctx = lbl.contexts(items, off, 5)
    for text in range(3):
        for t in range(off[text], off[text + 1]):
            assert ctx[t].tolist() == [items[t - k] if t - k >= off[text] else 5 for k in (1, 2, 3)]
    softmax = lambda x: np.exp(x) / np.exp(x).sum()
    want = np.zeros((len(items), 6))
    for t in range(len(items)):
        h = sum(net.R[ctx[t, k]] @ net.position(k) for k in range(3))
        p = softmax(net.A[:, :4] @ h + net.A[:, 4])
        for c in range(3):
            i, j = lay.first[c], lay.first[c + 1]
            want[t, i:j] = p[c] * softmax(net.Q[i:j, :4] @ h + net.Q[i:j, 4])
    assert np.allclose(want.sum(axis=1), 1)
    scorer = lbl.Scorer(net, lay)
    for i in range(6):
        assert np.allclose(10 ** scorer.logs(ctx, np.full(len(items), i), block=4), want[:, i], rtol=1e-4)


def test_noise_contrastive_training_learns_what_follows():
    lay, rng = lbl.Layout(np.array([0, 3, 5, 6]), np.array([100.0, 100, 100, 100, 100, 20])), np.random.default_rng(0)
    after = np.array([[0, 0.9, 0.1, 0, 0], [0, 0, 0, 0.5, 0.5], [1, 0, 0, 0, 0], [0.2, 0.2, 0.2, 0.2, 0.2], [0, 0, 0.7, 0.3, 0]])
    items = [0]
    for _ in range(100_000):
        items.append(rng.choice(5, p=after[items[-1]]))
    items, off = np.array(items), np.array([0, 100_001])
    net = lbl.Net(lay)
    trainer = lbl.Trainer(net, lay, 3)
    for _ in range(8):
        trainer.texts(items, off, 5)
    ctx = lbl.contexts(items, off, 5)
    p = np.stack([10 ** lbl.Scorer(net, lay).logs(ctx, np.full(len(items), i)) for i in range(6)])
    for w in range(5):
        assert np.abs(p[:5, ctx[:, 0] == w].mean(axis=1) - after[w]).max() < 0.06
    assert trainer.uses["Q"][:5].min() > 0 and trainer.uses["R"].sum() == 8 * 3 * len(items)


def test_models_are_averaged_by_their_uses(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "LEARNER", 1000)
    monkeypatch.setattr(lm, "TOKENS", 1)
    words = [f"w{k}" for k in range(30)]
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = lm.score_documents(df, own=20).collect()
    assert len(got) == 300 and all(np.isfinite(r.score) and r.score < 0 for r in got)
    pdf = pd.DataFrame({"name": "Q", "block": 0, "part": [3, 2], "uses": [np.array([1.0, 0]).tobytes(), np.array([3.0, 0]).tobytes()], "rows": [np.array([[4, 0], [9, 9]], np.float32).tobytes(), np.array([[0, 8], [9, 9]], np.float32).tobytes()]})
    one = lm._average(pdf).iloc[0]
    assert one.part == 1 and np.frombuffer(one.uses).tolist() == [4, 0] and np.frombuffer(one.rows, np.float32)[:2].tolist() == [1, 6]
