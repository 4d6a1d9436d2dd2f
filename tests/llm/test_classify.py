import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, toxicity

VOCABULARY = {"xx": ["tha", "ong", "ere", "wist"], "yy": ["öst", "kra", "uzu", "blim"], "zz": ["qui", "jex", "vop", "çad"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(VOCABULARY[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_on_held_out_rows_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice(list(VOCABULARY)), rng.randint(2, 60)), lang, "en") for i in range(600)]
    mixed = prose(rng, "xx", 120) + " " + prose(rng, "yy", 60)
    rows += [(1000, None, "xx", ""), (1001, "12 %% 3", "xx", ""), (1002, mixed, None, ""), (None, rows[0][1], None, ""), rows[1], (1003, "ö", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, languages string")
    got = langid.identify(df, sample=100).collect()
    truth = {r[0]: r[2] for r in rows[:600]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(rows) and len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    by = {r.doc_id: r for r in got}
    assert by[1000].lang_pred == by[1001].lang_pred == "und" and by[1003].lang_pred != "und"
    assert set(by[1002].languages) == {"xx", "yy"} and by[1002].lang_pred == "xx" and 0.5 < by[1002].score < 0.8
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_an_id_of_many_rows_is_learned_from_once(spark):
    rng = random.Random(4)
    rows = [(1, prose(rng, "xx", 9), "xx") for _ in range(50)] + [(None, prose(rng, "yy", 9), "yy") for _ in range(50)] + [(3, prose(rng, "xx", 9), "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert langid.train(df, sample=10)[0] == ["xx", "yy"]
    once = df.where("doc_id is not null").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).unionByName(df.where("doc_id is null").groupBy("doc_id", "lang").agg(F.min("text").alias("text")))
    assert np.array_equal(langid.train(df, sample=10)[1], langid.train(once, sample=10)[1])
    chosen, sizes = toxicity.labelled(df, spark.createDataFrame([(1, 0), (1, 1), (3, 0)], "doc_id long, toxic int"))
    texts = sorted((min(t for i, t, _ in rows if i == k), k == 1) for k in (1, 3) if zlib.crc32(str(k).encode()) % 4 != 2)
    assert sorted((r.text, r.toxic == 1) for r in chosen.collect()) == texts and sum(sizes.values()) == len(texts)


def test_expectation_maximisation_climbs():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(50), 3)
    n = rng.multinomial(5000, 0.7 * p[0] + 0.3 * p[2])
    share, fit = langid.expectation_maximisation(p, n, 200)
    assert np.allclose(share, [0.7, 0, 0.3], atol=0.05) and fit >= langid.expectation_maximisation(p, n, 3)[1]


def test_toxicity_on_held_out_rows_and_edges(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        words = prose(rng, "xx", rng.randint(10, 80)).split()
        bad = rng.random() < 0.25
        for k in range(0, len(words), 12) if bad else ():
            words[k] = rng.choice(["Vileness!", "grubby", "vileness"])
        rows.append((i, " ".join(words), "s"))
        if i % 3:
            labels.append((i, int(bad), 1))
    truth = {r[0]: "ileness" in r[1] or "grubby" in r[1] for r in rows}
    rows += [(2000, None, "s"), (2001, "", "s"), (None, rows[0][1], "s"), rows[1]]
    labels += [(None, 1, 1), (5000, 1, 1), (2000, None, 1), labels[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.97
    kept = toxicity.accept(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(r.score < 0.3 for r in got)
    assert {r.score for r in toxicity.toxicity(df, lab.limit(0)).collect()} == {0.0} and toxicity.toxicity(df.limit(0), lab).count() == 0


def test_backoff_mass_is_shared_and_probabilities_are_normal():
    rng = np.random.default_rng(2)
    words = np.zeros((2, toxicity.SIZE))
    words[0, :3000], words[1, :3000] = rng.poisson(40, 3000), rng.poisson(4, 3000)
    p, mass = toxicity.discounted(words, 2.0)
    assert 0 < mass < 1 and np.allclose(p.sum(axis=1), 1)


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("ab c", 4), ("..é..", 2), ("a . b", 2)])
def test_trigrams_of_short_texts(text, n):
    assert len(langid.trigrams(np.frombuffer(text.encode(), np.uint8))) == n
