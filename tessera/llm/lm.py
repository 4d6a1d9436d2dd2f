"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased words between white space and one end a text. Counts of all training tokens give the base score.
The model (see lbl) predicts each token from the three before it. Its items are the `own` most frequent words, one item for
the other words of each of 256 classes, and the end; a word's class is a hash of its last two bytes, the end is a class.
Class and item in the class are log-bilinear and normalised; a word that shares an item follows its smoothed count there.

Training is the same at any size of the input: one pass over all training texts, in which every text trains all of the
model. Each partition (of `LEARNER` tokens at least, on average) runs noise-contrastive estimation over its texts from the same start, in batches
of `TOKENS`; what the partitions learn is averaged, each row weighted by how often it was trained.

Bounds: what is broadcast or sent to the driver is the `common` (or `own`, if more) most frequent counts and the model, about 40 numbers an item.
Counts of all other words stay in a table; texts list them, and meet them in a shuffled join. Learners' models
are averaged in groups of `FAN`. Words are identified by 64-bit hashes.

Edge cases: a null or empty text is one end; a null doc_id counts as the empty text in the split; unseen words have count 0;
repeated rows are scored alike; an empty table gives an empty result; without training rows every count is 0;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lbl
from .common import UNSPACED, crc_mod, word_groups, written

OWN, TAILS = 4096, 256
COMMON = 1 << 16
FOLDS, HELD = 7, 2
#: Tokens of a batch, and that make a learner.
TOKENS, LEARNER = lbl.BATCH, 1_000_000
FAN = 64
BLOCK = 1024


def tail_class(tail: np.ndarray) -> np.ndarray:
    return ((tail.astype(np.int64) * 40503) & 0xFFFF) >> 8


def _count(batches):
    for batch in batches:
        for _, h, _, tail, _ in word_groups(batch.column(0), UNSPACED, limit=2 << 20):
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(tail_class(tail[at]).astype(np.int16)), pa.array(n)], ["h", "tail", "n"])


class Vocabulary:
    """Frequent words by hash: their counts, and items of any words."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tails: np.ndarray, own: int, rest: np.ndarray, ends: int):
        """hashes by falling count; rest: occurrences of the words without an item, by class."""
        own = min(own, len(hashes))
        by_class = np.lexsort((np.arange(own), tails[:own]))
        sizes = np.bincount(tails[:own], minlength=TAILS)
        first = np.concatenate([[0], np.cumsum(np.append(sizes + 1, 1))])
        item = np.full(len(hashes), -1)
        item[by_class] = np.arange(own) + tails[by_class]
        n = np.ones(first[-1])
        n[item[:own]] = np.maximum(counts[:own], 1)
        n[first[1:-1] - 1] = rest + 1
        n[-1] = max(ends, 1)
        self.layout = lbl.Layout(first, n)
        order = np.argsort(hashes)
        self.hashes, self.counts, self.item = hashes[order], counts[order], item[order]
        self.end = self.layout.items - 1

    def look(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Item, class, whether the item is shared, and count or -1 if it is not among the frequent ones."""
        cls = tail_class(tail)
        item, count, shared = self.layout.first[cls + 1] - 1, np.full(len(h), -1, np.int64), np.ones(len(h), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == h)
            count[hit] = self.counts[at[hit]]
            mine = self.item[at[hit]]
            hit, mine = hit[mine >= 0], mine[mine >= 0]
            item[hit], shared[hit] = mine, False
        return item, cls, shared, count

    def texts(self, item: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items with the ends of texts put in, and the texts' offsets."""
        n = np.diff(off) + 1
        to = np.concatenate([[0], np.cumsum(n)])
        out = np.full(to[-1], self.end)
        out[np.arange(len(item)) + np.repeat(np.arange(len(n)), n - 1)] = item
        return out, to


LEARNED = "name string, block int, part long, uses binary, rows binary"


def _learn(sent, size):
    def run(batches):
        vocabulary, part = sent.value, TaskContext.get().partitionId()
        trainer = lbl.Trainer(lbl.Net(vocabulary.layout), vocabulary.layout, part, size=size)
        for batch in batches:
            for _, h, off, tail, _ in word_groups(batch.column(0), UNSPACED):
                trainer.texts(*vocabulary.texts(vocabulary.look(h, tail)[0], off), vocabulary.end)
        for name in lbl.NAMES:
            rows, uses = getattr(trainer.net, name), trainer.uses[name]
            for k in range(0, len(rows), BLOCK):
                if uses[k : k + BLOCK].any():
                    yield pa.RecordBatch.from_pydict({"name": [name], "block": pa.array([k // BLOCK], pa.int32()), "part": [part], "uses": [uses[k : k + BLOCK].tobytes()], "rows": [rows[k : k + BLOCK].tobytes()]})

    return run


def _average(pdf):
    """One row of several: rows averaged by their uses."""
    pdf = pdf.sort_values("part")
    uses = np.stack([np.frombuffer(x, np.float64) for x in pdf["uses"]])
    rows = np.stack([np.frombuffer(x, np.float32).reshape(uses.shape[1], -1) for x in pdf["rows"]])
    total = uses.sum(axis=0)
    mean = np.einsum("lr,lrd->rd", uses, rows.astype(np.float64)) / np.maximum(total, 1)[:, None]
    one = pdf.iloc[:1].copy()
    one["part"], one["uses"], one["rows"] = one["part"] // FAN, [total.tobytes()], [mean.astype(np.float32).tobytes()]
    return one


def train(texts: DataFrame, vocabulary: Vocabulary, tokens: int) -> lbl.Net:
    net = lbl.Net(vocabulary.layout)
    sent, parts = texts.sparkSession.sparkContext.broadcast(vocabulary), max(1, tokens // LEARNER)
    found = texts.select("text").coalesce(parts).mapInArrow(_learn(sent, TOKENS), LEARNED)
    while parts > FAN:
        found, parts = found.groupBy("name", "block", F.floor(F.col("part") / FAN)).applyInPandas(_average, LEARNED), -(-parts // FAN)
    for r in found.groupBy("name", "block").applyInPandas(_average, LEARNED).collect():  # the model's blocks
        at = np.flatnonzero(np.frombuffer(r.uses, np.float64) > 0)
        rows = getattr(net, r.name)
        rows[at + r.block * BLOCK] = np.frombuffer(r.rows, np.float32).reshape(-1, rows.shape[1])[at]
    return net


SCHEMA = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("h", pa.list_(pa.int64())), ("n", pa.list_(pa.int32()))])


def _score(model):
    def run(batches):
        vocabulary, net, inside, ends = model.value
        scorer = lbl.Scorer(net, vocabulary.layout)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc = batch.column(0)
            for a, h, off, tail, _ in word_groups(batch.column(1), UNSPACED):
                texts = len(off) - 1
                item, cls, shared, count = vocabulary.look(h, tail)
                items, to = vocabulary.texts(item, off)
                by = lambda x, o: np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])[o])  # noqa: E731  sums by text
                rare = count < 0
                logs = np.where(rare, 0, np.log10(np.maximum(count, 0) + 1.0))
                score = by(scorer.logs(lbl.contexts(items, to, vocabulary.end), items), to) + by(np.where(shared, logs - inside[cls], 0), off)
                text = np.repeat(np.arange(texts), np.diff(off))[rare]
                order = np.lexsort((h[rare], text))
                x, t = h[rare][order], text[order]
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1]) | (t[1:] != t[:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(x))).astype(np.int32)
                lists = pa.array(np.searchsorted(t[start], np.arange(texts + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + texts)), doc.slice(a, texts), pa.array(np.diff(off) + 1), pa.array((by(~rare, off) + (ends > 0)).astype(np.int64)), pa.array(by(logs, off) + np.log10(ends + 1.0)), pa.array(score), pa.ListArray.from_arrays(lists, pa.array(x[start].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(times))],
                    schema=SCHEMA,
                )
                rid += texts

    return run


def score_documents(documents: DataFrame, folds: int = FOLDS, held: int = HELD, own: int = OWN, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    training = docs.where(crc_mod("doc_id", folds) != held)
    counts = training.select("text").mapInArrow(_count, "h long, tail short, n long").groupBy("h", "tail").agg(F.sum("n").alias("n"))
    counts = written(counts, "counts")
    ends = training.count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, size = words + ends, kinds + (ends > 0)
    top = counts.orderBy(F.desc("n"), "h").limit(max(common, own)).select("h", "tail", "n").toArrow()
    hashes, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()

    by_tail = np.zeros((2, TAILS))
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():  # at most 256 rows
        by_tail[:, r.tail] = r.n, r.k
    tails = top.column("tail").to_numpy().astype(np.int64)
    by_tail -= np.stack([np.bincount(tails[:own], n[:own], TAILS), np.bincount(tails[:own], minlength=TAILS)])
    inside = np.log10(by_tail.sum(axis=0) + 1)

    vocabulary = Vocabulary(hashes, n, tails, own, by_tail[0], ends)
    net = train(training, vocabulary, total)
    model = spark.sparkContext.broadcast((vocabulary, net, inside, ends))
    base = written(docs.mapInArrow(_score(model), "rid long, doc_id long, n_tokens long, known long, logs double, score double, h array<long>, n array<int>"), "scored")
    rare = base.select("rid", F.explode(F.arrays_zip("h", "n")).alias("x")).select("rid", F.col("x.h").alias("h"), F.col("x.n").alias("times"))
    found = rare.join(counts, "h").groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("k")).withColumnRenamed("rid", "r")
    out = base.drop("h", "n").join(found, F.col("rid") == F.col("r"), "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        (crc_mod("doc_id", folds) == held).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * float(np.log10(total + size + 1))).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )
