import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tessera.llm import toxicity


def test_backoff_follows_whole_continuation_counts():
    kinds = np.zeros(toxicity.SIZE)
    kinds[1:5] = 4, 6, 60, 6000
    words = np.tile(kinds, (2, 1))
    model = toxicity.fit_counts(words, kinds, words, kinds, kinds + 0.5)
    assert (model.shared[1:5] == kinds[1:5] + 0.5).all()
    even = toxicity.fit_counts(np.zeros_like(words), kinds, np.zeros_like(words), kinds, np.zeros_like(kinds))
    assert np.allclose(even.heads[0][4] / even.heads[0][1], 6000.5 / 4.5)


def brute_force(texts, labels):
    """log p(word | before, toxic) - log p(word | before, ordinary) from dictionaries of sets, as the method says it."""
    facts = [{(u, v, w) for t, y in zip(texts, labels) if y == c for u, v, w in zip(["", "", *t], ["", *t], t)} for c in (0, 1)]
    every = facts[0] | facts[1]
    words = sorted({w for *_, w in every})
    kinds = {w: len({v for _, v, x in every if x == w}) for w in words}
    of = defaultdict(list)
    for w in words:
        of[w[:4]].append(w)

    def discounted(counts, discount):
        total = [sum(c.values()) for c in counts]
        less = [{k: max(c.get(k, 0) / t - discount / min(total), 0) for k in keys(counts)} for c, t in zip(counts, total)]
        given = [sum(x.values()) for x in less]
        return less, given

    def keys(counts):
        return set(counts[0]) | set(counts[1])

    def count(key):
        out = [defaultdict(int), defaultdict(int)]
        for c in (0, 1):
            for f in facts[c]:
                out[c][key(f)] += 1
        return out

    one, one_given = discounted(count(lambda f: f[2]), toxicity.DISCOUNT)
    head, head_given = discounted(count(lambda f: f[2][:4]), toxicity.DISCOUNT)
    shared = {p: len(x) + 0.5 for p, x in of.items()}
    everything = sum(shared.values()) + 0.5 * (toxicity.SIZE - len(shared))
    pair, after = count(lambda f: f[1:]), count(lambda f: f[1])

    def likelihood(c, v, w):
        h = min(head_given) * head[c][w[:4]] / max(head_given[c], 1e-12) + (1 - min(head_given)) * shared[w[:4]] / everything
        within = sum(kinds[x] + 0.5 for x in of[w[:4]]) + 0.5
        p = min(one_given) * one[c][w] / max(one_given[c], 1e-12) + (1 - min(one_given)) * h * (kinds[w] + 0.5) / within
        t = [after[k][v] for k in (0, 1)]
        if not min(t):
            return p
        less = [{x: max(pair[k][(v, x)] / t[k] - toxicity.PAIR_DISCOUNT / min(t), 0) for x in words} for k in (0, 1)]
        given = [sum(x.values()) for x in less]
        return (1 - min(given)) * p + min(given) * less[c][w] / max(given[c], 1e-12)

    return likelihood


def test_model_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["stone", "stones", "river", "rivers", "blue", "the", "of", "vile", "vileness", "grub"]
    texts = [[rng.choice(vocabulary[: 10 if y else 8]) for _ in range(60)] for y in (k % 3 == 0 for k in range(90))]
    for t in texts:
        for k in range(0, 60, 6):
            t[k : k + 2] = ["of", "the"]  # a frequent pair
    labels = [int(k % 3 == 0) for k in range(90)]
    texts += [texts[0]] * 5  # copies count once
    labels += [labels[0]] * 5
    ids = list(range(len(texts)))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, texts)], "doc_id long, text string")
    marks = spark.createDataFrame(list(zip(ids, labels)), "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    rows, _ = toxicity.labelled(docs, marks)
    used = [(r.text.split(), r.toxic) for r in rows.where("not curve").collect()]
    likelihood = brute_force(*zip(*used))
    (_, w, p, off), = toxicity.word_rows(pa.array([" ".join(t) for t in texts[:4]]))
    want = [[likelihood(c, v, x) for t in texts[:4] for v, x in zip(["", *t], t)] for c in (0, 1)]
    got = model.likelihoods(w, p, off)
    assert len(model.pairs) and np.allclose(got, want, rtol=1e-9)
    features = model.features(w, p, off)
    for k, t in enumerate(texts[:4]):
        r = [math.log(want[1][i]) - math.log(want[0][i]) for i in range(60 * k, 60 * k + 60)]
        middle = sorted(r)[30]
        assert np.allclose(features[k], [sum(x - middle for x in r) / 60, sum(max(x - middle - toxicity.CLEAR, 0) for x in r) / 60])
