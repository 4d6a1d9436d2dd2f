import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import common, jaccard


def sets(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None, links[i]) for i in g]
    return sorted(out, key=str)


def fixture():
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv")
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += ["one", "One", "two three", "", None, "  ", texts[0], texts[0].upper(), texts[3] + " tail"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (None, "nobody else has this one text here"), (7, texts[7])]


@pytest.mark.parametrize("block", [256, 3])
def test_classes_and_links_equal_brute_force(spark, block):
    rows = fixture()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cls string").repartition(4)
    got = jaccard.near_duplicates(df, block=block).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == brute(rows)
    kept = jaccard.distinct_documents(df, block=block)
    assert kept.columns == df.columns
    want = brute(rows)
    classes = len({c for d, c, n in want if c is not None}) + sum(1 for d, c, n in want if c is None)
    assert kept.count() == classes


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posterior_drops_far_pairs_and_keeps_near_ones():
    need = jaccard.least_matches()
    assert list(need) == sorted(need) and 0 < need[0] < 16 and need[-1] < 0.8 * 128
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, (1, 128), dtype=np.uint32)
    b = np.repeat(a, 2000, axis=0)
    b[rng.random(b.shape) > 0.8] += 1
    far = np.repeat(a, 2000, axis=0)
    far[rng.random(far.shape) > 0.3] += 1
    pairs = (np.zeros(2000, int), np.arange(2000))
    assert len(jaccard.survivors(a, b, need, pairs)[0]) == 2000 and len(jaccard.survivors(a, far, need, pairs)[0]) == 0


@pytest.mark.parametrize("rows", [100_000, 0])
def test_components_of_a_long_path(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    edges = spark.range(200).selectExpr("id a", "id + 1 b").union(spark.sql("select 900L, 901L")).union(spark.range(1001, 1100).selectExpr("1000L", "id"))
    got = {r.node: r.label for r in jaccard.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900, **{i: 1000 for i in range(1000, 1100)}}
