import random

import corpus_pipeline
from tessera.llm import decontaminate, jaccard, mixing, suffix, toxicity

from .test_jaccard import sets
from .test_suffix import kept_words, split


def test_stages_take_effect_and_keep_clean_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf).cache()
        if name != "mixing":
            assert out.columns == docs.columns
        kept.append((name, at, out))
        at = out
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = kept
    scores = {r.doc_id: r.score for r in toxicity.toxicity(a, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r.doc_id for r in b.collect()} == {k for k, s in scores.items() if s < 0.3}
    texts = {r.doc_id: r.text for r in c.collect()}
    gone = [sets(r.text) for r in b.collect() if r.doc_id not in texts]
    mine = [sets(t) for t in texts.values()]
    assert all(any(len(g & m) >= 0.8 * len(g | m) for m in mine) for g in gone)
    assert all(len(x & y) < 0.8 * len(x | y) for i, x in enumerate(mine) for y in mine[:i] if x and y)
    cut = {r.doc_id: r for r in d.collect()}
    order = sorted(texts)
    for k, want in zip(order, kept_words([texts[k] for k in order], suffix.PASSAGE["length"])):
        assert split(cut[k].text) == want and cut[k].n_chars == len(cut[k].text)
    items = decontaminate.item_windows([tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 10)
    index = decontaminate.Index(items, {w: 1 for x in items for w in x})
    clean = {k for k, r in cut.items() if not index.find(decontaminate.words(r.text.encode()))[0]}
    assert {r.doc_id for r in e.collect()} == clean
    assert {r.doc_id for r in f.collect()} == clean and mixing.WEIGHTS == (5, 2, 1) and jaccard.THRESHOLD == 0.8


def test_short_passages_are_cut_and_clean_rows_left_alone(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))
    passages = [prose(n) for n in (51, 53, 56, 60, 64, 70)]
    rows = [(i, f"{prose(80)}\n{passages[i % 6].capitalize()}  {prose(80)}") for i in range(60)] + [(100 + i, prose(200)) for i in range(30)]
    rows += [(200, None), (201, ""), (202, passages[0][:-12] + " other words here"), (None, prose(60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row long")
    out = corpus_pipeline.cut_repeats(spark, docs, "")
    assert out.dtypes == docs.dtypes
    got = {r.doc_id: r.text for r in out.collect()}
    for (i, t), want in zip(rows, kept_words([t for _, t in rows], 50)):
        assert (got[i] is None) if t is None else split(got[i]) == want
    assert all(p.lower() not in (got[i] or "").lower() for i in range(60) for p in passages)
    assert all(got[i] == t for i, t in rows if i is None or 100 <= i < 202)


def test_empty_table_and_rows_without_ids_or_texts(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"
    labels, items = spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int"), spark.createDataFrame([("b", "x y z")], "item_id string, text string")
    for rows, name in (([], "none"), ([(None, None, None, None, None, "s", 1.0), (None, "", "", "", 0, None, None), (1, "x", "en", "s", 1, "s", 0.5), (1, "x", "en", "s", 1, "s", 0.5), (2, "y " * 90_000, "en", "s", 180_000, "s", None)], "few")):
        at = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        items.write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, at)
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        got = docs.collect()
        assert sorted((r.doc_id or 0, len(r.text or "")) for r in got) == ([] if not rows else [(0, 0), (0, 0), (1, 1), (2, 90_000 * 2 - 180_000 + len(docs.where("doc_id = 2").first().text))])
        assert corpus_pipeline.run(spark, at).count() == len(got)
