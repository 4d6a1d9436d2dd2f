import numpy as np

from tessera.llm import lbl, lm
from tessera.llm.common import UNSPACED, word_groups


def test_texts_train_the_same_model_whatever_the_size_of_the_input(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEARNER", 1 << 40)  # one learner
    rows = [(f"w{k} v{k}", k % 8 == 0) for k in range(80)] * 30
    df = spark.createDataFrame(rows, "text string, early boolean").coalesce(1)
    hashes, counts = np.unique(np.concatenate([g[1] for b in df.select("text").toArrow().to_batches() for g in word_groups(b.column(0), UNSPACED)]), return_counts=True)
    vocabulary = lm.Vocabulary(hashes, counts, np.zeros(160, np.int64), 160, np.zeros(lm.TAILS), len(rows))
    few, many = (lm.train(df, vocabulary, tokens) for tokens in (1_000, 1_000_000_000))
    start = lbl.Net(vocabulary.layout)
    for name in lbl.NAMES:
        assert np.array_equal(getattr(few, name), getattr(many, name)) and not np.array_equal(getattr(few, name), getattr(start, name))
    own = vocabulary.item[vocabulary.item >= 0]
    assert (many.R[own] != start.R[own]).any(axis=1).all()  # each text trains context vectors as well


def test_words_of_their_own_do_not_depend_on_the_size(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(lm, "train", lambda texts, vocabulary, tokens: sizes.append(vocabulary.end) or lbl.Net(vocabulary.layout))
    text = " ".join(f"w{k}" for k in range(100))
    df = spark.createDataFrame([(3, text)], "doc_id long, text string")
    lm.score_documents(df, own=12).count()
    lm.score_documents(spark.range(30_000).selectExpr("3L doc_id", f"'{text}' text"), own=12).count()
    assert sizes[0] == sizes[1] == 12 + lm.TAILS
