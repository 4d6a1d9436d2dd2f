"""Language identification against a version by plain counts, and a grid over all language sets and proportions."""

import itertools
import math
import random
import zlib

import numpy as np

from tessera.llm import langid

VOCABULARY = {"xx": ["tha", "ong", "ere", "wist"], "yy": ["öst", "kra", "uzu", "blim"], "zz": ["qui", "jex", "vop", "çad"]}
STEPS = 40


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain_trigrams(text):
    raw = b" " + bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in text.encode()) + b" "
    grams = [raw[k : k + 3] for k in range(len(raw) - 2)]
    return [int.from_bytes(g, "big") * 2654435761 % 2**32 >> 16 for g in grams if g[1] != 32 or (g[0] != 32 and g[2] != 32)]


def plain_model(rows):
    counts = {}
    for doc_id, text, lang in rows:
        if lang and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            for g in plain_trigrams(text):
                mine = counts.setdefault(lang, {})
                mine[g] = mine.get(g, 0) + 1
    return {lang: (mine, sum(mine.values())) for lang, mine in sorted(counts.items())}


def probability(model, lang, g):
    mine, total = model[lang]
    return (mine.get(g, 0) + 0.5) / (total + 0.5 * 65536)


def grid(k):
    for cuts in itertools.combinations(range(1, STEPS), k - 1):
        ends = (0, *cuts, STEPS)
        yield [(b - a) / STEPS for a, b in itertools.pairwise(ends)]


def plain_answer(model, text):
    """Best set by penalised likelihood, over all sets and a grid of proportions, and the proportions."""
    codes = plain_trigrams(text)
    kinds = sorted(set(codes))
    n = np.array([codes.count(g) for g in kinds])
    best = (-math.inf,)
    for k in range(1, len(model) + 1):
        for langs in itertools.combinations(model, k):
            p = np.array([[probability(model, lang, g) for g in kinds] for lang in langs])
            for share in grid(k):
                fit = float(n @ np.log(np.array(share) @ p))
                value = fit / langid.SHARE - langid.PENALTY * (k - 1) * math.log(max(n.sum() / langid.SHARE, 1.0) + 1)
                best = max(best, (value, dict(zip(langs, share))))
    return best[1]


def test_model_and_answers_equal_plain_ones(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, lang := rng.choice(list(VOCABULARY)), rng.randint(5, 60)), lang) for i in range(240)]
    asked = []
    for i in range(24):
        langs = rng.sample(list(VOCABULARY), 1 + i % 3)
        asked.append((1000 + i, " ".join(prose(rng, lang, rng.randint(30, 90)) for lang in langs), None))
    df = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    model = plain_model(rows)
    langs, p = langid.train(df)
    assert langs == list(model)
    for i, lang in enumerate(langs):
        mine, total = model[lang]
        assert np.allclose(p[i, list(mine)], [probability(model, lang, g) for g in mine], rtol=1e-12) and np.isclose(p[i].sum(), 1)
    got = {r.doc_id: r for r in langid.identify(df).where("doc_id >= 1000").collect()}
    for doc_id, text, _ in asked:
        want, r = plain_answer(model, text), got[doc_id]
        assert set(r.languages) == set(want), (doc_id, r.languages, want)
        assert all(abs(r.languages[x] - want[x]) <= 1.5 / STEPS for x in want), (doc_id, r.languages, want)
        assert r.languages[r.lang_pred] == r.score == max(r.languages.values())
