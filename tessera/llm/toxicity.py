"""Toxicity by class-conditional Kneser-Ney bigram models.

Each class (toxic, ordinary) has an absolutely discounted model of a word after the word before. It backs off to the
class's discounted model of single words, that to the class's discounted model of word beginnings (`prefix` bytes), within
which words follow counts shared by both classes; beginnings back off to counts shared by both. All counts are
continuation counts: a class's bigram counts by the different words before it, its words by the different pairs
before them, the shared ones by the different words before a word and the different words of a beginning. So a
passage that labelled texts copy from each other counts once. Both classes get the same backoff mass, after each word and as a
whole, and a discount of the same share: a rare expression moves the result only by what its class has seen beyond the other.

A text is scored by its log-likelihood ratio, normalised by its length: the whole of it, and the part that stems from clearly
marked words, both taken above the text's middle word (which stands for its language and subject). A logistic
curve, fitted on labelled rows that the counts have not seen, turns the two into a score.

Size: the models are fitted on all labelled rows and keep every bigram that the discount leaves, at any size of the input. Words and
beginnings fall into 2**18 buckets each by hash, a bigram takes 24 bytes; the model is broadcast. Labelled texts move only if the labels
are too many to broadcast or a doc_id has several rows; each fact moves once. Every text is scored whole.

Edge cases: a null or wordless text has ratio 0 and the score that belongs to it; labels that are null or without a
document are not used, several labels of one document count as their greatest, of several texts of one doc_id the least is learned from; without labels of both classes all
scores are 0; repeated rows are scored alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, crc_mod, keyed, same_row, small, spread_join, word_groups, written

BITS = 18
SIZE = 1 << BITS
PREFIX = 4
DISCOUNT = 2.0
PAIR_DISCOUNT = 3.0
CLEAR = 2.0
FOLDS, HELD = 4, 2
START = 0


def buckets(hashes: np.ndarray) -> np.ndarray:
    """1 to SIZE - 1; 0 stands for the start of a text."""
    return np.maximum(hashes >> np.uint64(64 - BITS), 1).astype(np.int64)


def word_rows(column, prefix: int = PREFIX):
    """Groups of texts as (first row, word buckets, buckets of their beginnings, offsets)."""
    for a, hashes, off, _, heads in word_groups(column, ALNUM, prefix=prefix):
        yield a, buckets(hashes), buckets(heads), off


def before(w: np.ndarray, off: np.ndarray) -> np.ndarray:
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[off[:-1][off[:-1] < len(w)]] = START
    return v


def discounted(counts: np.ndarray, discount: float) -> tuple[np.ndarray, float]:
    """Discounted probabilities (2, n), each class's summing to 1, and the backoff mass that both get.

    The discount is `discount` occurrences in the smaller class, and as large a share of the larger: what is too
    rare to be judged in the one is not judged by the other alone.
    """
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1.0)
    less = np.maximum(counts / total - discount / total.min(), 0)
    mass = 1 - less.sum(axis=1).min()
    return less / np.maximum(less.sum(axis=1, keepdims=True), 1e-12), mass


@dataclass
class Model:
    words: np.ndarray  # (2, SIZE) share of the discounted counts times their mass; row 1 toxic
    heads: np.ndarray  # (2, SIZE) backoff mass times the probability of a beginning, over its shared counts
    shared: np.ndarray  # (SIZE) shared counts of words
    curve: np.ndarray | None = None
    pairs: np.ndarray | None = None  # sorted keys of bigrams
    pair_shares: np.ndarray | None = None  # (2, n) their share after the word before
    rest: np.ndarray | None = None  # (SIZE) backoff mass after a word

    def likelihoods(self, w: np.ndarray, p: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """p(word | word before, class) of the ordinary and the toxic class."""
        out = [self.words[c][w] + self.heads[c][p] * self.shared[w] for c in (0, 1)]
        if self.pairs is None or not len(self.pairs):
            return out
        v = before(w, off)
        key = (v << BITS) | w
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = self.pairs[at] == key
        return [self.rest[v] * out[c] + np.where(hit, self.pair_shares[c][at], 0) for c in (0, 1)]

    def ratios(self, w: np.ndarray, p: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log p(word | word before, toxic) - log p(word | word before, ordinary)."""
        ordinary, toxic = self.likelihoods(w, p, off)
        return np.log(toxic) - np.log(ordinary)

    def features(self, w, p, off) -> np.ndarray:
        """Of each text, both normalised by its length: its log-likelihood ratio above that of its middle word, which stands for its
        language and subject, and the part of it that stems from words at least CLEAR above."""
        r, n = self.ratios(w, p, off), np.diff(off)
        text = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((r, text))
        some = np.flatnonzero(n)
        middle = np.zeros(len(n))
        middle[some] = r[order[off[some] + n[some] // 2]]
        r = r - middle[text]
        total, clear = np.bincount(text, r, len(n)), np.bincount(text, np.maximum(r - CLEAR, 0), len(n))
        n = np.maximum(n, 1)
        return np.stack([total / n, clear / n], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(x))
        k = x.shape[1] + 1
        z = self.curve[0] + np.clip(x / self.curve[k:], -50, 50) @ self.curve[1:k]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_counts(words: np.ndarray, word_kinds: np.ndarray, heads: np.ndarray, head_kinds: np.ndarray, within: np.ndarray, discount: float = DISCOUNT) -> Model:
    """words, heads (2, SIZE): occurrences by class; kinds: continuation counts; within: shared counts of the words of each beginning."""
    w, w_mass = discounted(words, discount)
    h, h_mass = discounted(heads, discount)
    shared = head_kinds + 0.5
    h = (1 - h_mass) * h + h_mass * shared / shared.sum()
    return Model((1 - w_mass) * w, w_mass * h / (within + 0.5), word_kinds + 0.5)


def fit_pairs(model: Model, keys: np.ndarray, shares: np.ndarray) -> Model:
    """Put in bigrams: keys and discounted shares (2, n) after the word before, of which each class gives as much as the one with less."""
    order = np.argsort(keys)
    keys, shares = keys[order], shares[:, order]
    v = keys >> BITS
    sums = np.stack([np.bincount(v, shares[c], SIZE) for c in (0, 1)])
    given = sums.min(axis=0)
    model.pairs, model.pair_shares, model.rest = keys, shares * (given / np.maximum(sums, 1e-12))[:, v], 1 - given
    return model


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Logistic curve by Newton steps with a small ridge: intercept, slopes, scales."""
    if not len(y) or y.min() == y.max():
        return None
    scale = np.maximum(x.std(axis=0), 1e-9)
    a = np.concatenate([np.ones((len(x), 1)), np.clip(x / scale, -50, 50)], axis=1)
    b, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [1e-2] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (y - p) - ridge @ b
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, g)
        b = b + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([b, scale])


def _count(batches):
    """Different facts of labelled texts as longs: (word before, word, word before that, class), and negative ones (word, beginning).

    Shifted by BITS + 1 they are (word before, word), and the negative ones -1 less (word, beginning)."""

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(rows)))], ["fact"])

    rows, size = [], 0
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, w, p, off in word_rows(batch.column(0)):
            c = np.repeat(label[a : a + len(off) - 1], np.diff(off))
            v = before(w, off)
            rows += [(((((v << BITS) | w) << BITS) | before(v, off)) << 1) | c, np.unique(-1 - (((w << BITS) | p) << (BITS + 1)))]
            size += len(w)
            if size > 2_000_000:
                yield flush(rows)
                rows, size = [], 0
    if rows:
        yield flush(rows)


def _features(model):
    def run(batches):
        for batch in batches:
            x = [model.value.features(w, p, off) for _, w, p, off in word_rows(batch.column(0))]
            x = np.concatenate(x) if x else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, x.T)], ["toxic", "a", "b"])

    return run


def labelled(documents: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD):
    """text, toxic and curve (a fifth, for the curve) of all labelled documents outside the held-out fold, and how many labels of each class there are."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = written(marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_mod("doc_id", folds) != held), "marks")
    sizes = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    several = written(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    rows = spread_join(docs, marks, ["doc_id"], ["text"])
    one = rows.join(small(several), "doc_id", "left_anti")
    least = rows.join(small(several), "doc_id", "left_semi").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # an id may hold a large share of the rows
    rows = one.select("doc_id", "text", "toxic").unionByName(least)
    return rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).alias("curve")), sizes


def train(documents: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD) -> Model:
    rows, _ = labelled(documents, labels, folds, held)
    rows = written(rows, "labelled")
    pair, toxic = F.shiftright("fact", BITS + 1), F.col("fact").bitwiseAND(1)
    facts = rows.where("not curve").select("text", "toxic").mapInArrow(_count, "fact long").repartition(pair)
    facts = facts.select(pair.alias("pair"), "fact").distinct()
    counted = written(facts.groupBy("pair").agg(F.count_if(toxic == 0).alias("n0"), F.count_if(toxic == 1).alias("n1")), "pairs")
    pairs = counted.where("pair >= 0").select("pair", F.shiftright("pair", BITS).alias("v"), F.col("pair").bitwiseAND(SIZE - 1).alias("w"), "n0", "n1")
    counts = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    words = written(pairs.groupBy("w").agg(F.count(F.lit(1)).alias("kinds"), *counts), "words")  # at most SIZE rows, as all that follow
    after = written(pairs.groupBy("v").agg(*counts), "after")
    heads = counted.where("pair < 0").select(F.shiftright(-F.col("pair") - 1, BITS).alias("w"), (-F.col("pair") - 1).bitwiseAND(SIZE - 1).alias("p"))
    heads = heads.join(words, "w").groupBy("p").agg(F.count(F.lit(1)).alias("kinds"), *counts, F.sum(F.col("kinds") + 0.5).alias("within"))

    def arrays(frame, at, *names):
        out = np.zeros((len(names), SIZE))
        x = frame.toPandas()
        out[:, x[at].to_numpy(np.int64)] = x[list(names)].to_numpy(float).T
        return out

    w, h = arrays(words, "w", "kinds", "n0", "n1"), arrays(heads, "p", "kinds", "n0", "n1", "within")
    model = fit_counts(w[1:], w[0], h[1:3], h[0], h[3])

    totals = after.select(F.col("v"), F.col("n0").alias("t0"), F.col("n1").alias("t1")).where("t0 > 0 and t1 > 0")
    cut = lambda c: F.greatest(F.col(c) - PAIR_DISCOUNT / F.col("least"), F.lit(0.0)).alias(c)
    known = pairs.join(F.broadcast(totals), "v").select("pair", F.least("t0", "t1").alias("least"), (F.col("n0") / F.col("t0")).alias("s0"), (F.col("n1") / F.col("t1")).alias("s1"))
    found = known.where(F.greatest("s0", "s1") * F.col("least") > PAIR_DISCOUNT).select("pair", cut("s0"), cut("s1")).toPandas()
    model = fit_pairs(model, found["pair"].to_numpy(np.int64), found[["s0", "s1"]].to_numpy(float).T)

    sent = documents.sparkSession.sparkContext.broadcast(model)
    x = rows.where("curve").select("text", "toxic").mapInArrow(_features(sent), "toxic int, a double, b double").toPandas()
    y = x.toxic.to_numpy(float)
    model.curve = fit_curve(x[["a", "b"]].to_numpy(float), y)
    return model


def _score(model, schema):
    def run(batches):
        m = model.value
        for batch in batches:
            x = [m.features(w, p, off) for _, w, p, off in word_rows(batch.column(2))]
            x = np.concatenate(x) if x else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m.scores(x)), pa.array(x[:, 0])], schema)

    return run


def toxicity(documents: DataFrame, labels: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """doc_id, tkey, held_out, score (0 to 1) and ratio (the length-normalised log-likelihood ratio) of each document."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, folds, held))
    docs = keyed(documents).drop("_row")
    out = docs.mapInArrow(_score(model, ["doc_id", "tkey", "score", "ratio"]), "doc_id long, tkey long, score double, ratio double")
    return out.select("doc_id", "tkey", (crc_mod("doc_id", folds) == held).alias("held_out"), "score", "ratio")


def accept(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, **how) -> DataFrame:
    """The rows of documents with a score below threshold, with all their columns."""
    docs = keyed(documents)
    bad = toxicity(documents, labels, **how).where(F.col("score") >= threshold).select("doc_id", "tkey").distinct()
    return docs.join(bad, same_row(docs, bad), "left_anti").select("_row.*")
