import random

from pyspark.sql import functions as F

from tessera.llm import common, toxicity


def test_every_labelled_row_is_learned_from(spark):
    n = 90_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 50 == 0).cast("int").alias("toxic"))
    rows, sizes = toxicity.labelled(docs, labels)
    held = docs.where(toxicity.crc_mod("doc_id", toxicity.FOLDS) == toxicity.HELD).count()
    assert sizes[0] > 50_000 and rows.count() == sum(sizes.values()) == n - held


def test_every_bigram_above_the_discount_stays(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(12)]
    texts = [[rng.choice(words[: 12 if k % 3 else 9]) for _ in range(40)] for k in range(200)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    used = [(r.text.split(), r.toxic) for r in toxicity.labelled(docs, labels)[0].where("not curve").collect()]
    facts = [{(u, v, w) for t, y in used if y == c for u, v, w in zip(["", "", *t], ["", *t], t)} for c in (0, 1)]
    count = lambda c, *at: sum(f[1 : 1 + len(at)] == at for f in facts[c])
    want = 0
    for v in ["", *words]:
        total = [count(c, v) for c in (0, 1)]
        for w in words if min(total) else ():
            want += max(count(c, v, w) / total[c] for c in (0, 1)) * min(total) > toxicity.PAIR_DISCOUNT
    monkeypatch.setattr(toxicity, "PAIRS", 8, raising=False)  # the bound there was
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)  # labels by a shuffled join
    assert len(toxicity.train(docs, labels).pairs) == want > 20
