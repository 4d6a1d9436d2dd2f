"""Language identification by multilingual mixture inference.

Each language has a smoothed distribution over byte trigrams of letters. A document's trigrams are drawn from a mixture of
the languages; expectation-maximisation estimates its proportions. Language sets grow from the best single language by
the next one of the full mixture; the set with the best penalised likelihood is kept, where `share` trigrams count
as one observation, as they overlap, and each further language costs `penalty` * log(observations). The prediction is the
kept set's largest proportion, the score that proportion.

Bounds: the distributions are fitted on at most `sample` labelled documents of each language (those first by a hash of
their id) and have 2**16 entries each. Every text is read whole.

Edge cases: a null text, or one without a letter, is `und` with score 0, as is every text if nothing can be learned; ties go
to the language first in code points; null langs are not learned from; of rows with one doc_id (or none) and lang only the
least text is learned from; repeated rows are predicted alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWERED, crc_mod, keyed, small, text_buffer, written

SAMPLE = 2000
FOLDS, HELD = 4, 2
SIZE = 1 << 16
SHARE, PENALTY = 3.0, 2.0
ROUNDS, CLOSE = 30, 1e-3
UND = "und"

_LETTER = ((LOWERED >= 97) & (LOWERED <= 122)) | (np.arange(256) >= 128)
#: Letters lower-cased, everything else a space.
FOLDED = np.where(_LETTER, LOWERED, 32).astype(np.uint8)


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Hashed trigrams of a text, with a space at both ends and without those that are mostly space."""
    t = np.concatenate([[32], FOLDED[raw], [32]]).astype(np.uint32)
    if len(t) < 3:
        return np.zeros(0, np.int64)
    code = (t[:-2] << np.uint32(16)) | (t[1:-1] << np.uint32(8)) | t[2:]
    keep = (t[1:-1] != 32) | ((t[:-2] != 32) & (t[2:] != 32))
    return ((code[keep] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def has_letter(raw: np.ndarray) -> bool:
    return bool((FOLDED[raw[raw < 128]] != 32).any()) or any(c.isalpha() for c in raw[raw >= 128].tobytes().decode("utf-8", "ignore"))


def expectation_maximisation(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of a mixture. p (languages, kinds): probabilities; n: occurrences."""
    share, total = np.full(len(p), 1 / len(p)), n.sum()
    for _ in range(rounds if len(p) > 1 else 0):
        mix = share @ p
        new = share * (p @ (n / mix)) / total
        done = np.abs(new - share).max() < CLOSE
        share = new
        if done:
            break
    return share, float(n @ np.log(share @ p))


def infer(p: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Proportion of each language in a document; zero outside the kept set."""
    kinds, n = np.unique(codes, return_counts=True)
    q, n = p[:, kinds], n.astype(np.float64)
    first = int((np.log(q) @ n).argmax())
    share, _ = expectation_maximisation(q, n)
    order = [first] + [i for i in np.argsort(-share, kind="stable") if i != first]
    seen = max(n.sum() / SHARE, 1.0)
    out = np.zeros(len(p))
    best = -np.inf
    for k in range(1, len(order) + 1):
        part, fit = expectation_maximisation(q[order[:k]], n)
        value = fit / SHARE - PENALTY * (k - 1) * np.log(seen + 1)
        if value <= best:
            break
        best = value
        out[:] = 0
        out[order[:k]] = part
    return out


def _count(batches):
    for batch in batches:
        raw, off = text_buffer(batch.column(0))
        table: dict = {}
        for lang, a, b in zip(batch.column(1).to_pylist(), off[:-1].tolist(), off[1:].tolist()):
            table.setdefault(lang, []).append(trigrams(raw[a:b]))
        for lang, codes in table.items():
            n = np.bincount(np.concatenate(codes), minlength=SIZE)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])


def train(documents: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the probabilities (languages, SIZE) of trigrams."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text"))
    known = rows.where("lang is not null and text is not null").where(crc_mod("doc_id", folds) != held)
    # Ranking is left with about 1.5 * sample rows a language: those below a share of the hash that its count tells.
    ids = known.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("place"))
    sizes = small(written(known.groupBy(F.col("lang").alias("of")).agg((F.approx_count_distinct("doc_id") + 1).alias("n")), "sizes"))
    ids = ids.join(sizes, F.col("lang") == F.col("of")).where(F.col("place") * F.col("n") <= float(1.5 * sample * (1 << 30)))
    ids = ids.select("doc_id", "lang", "place").distinct()  # an id may hold a large share of the rows
    by_lang = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = ids.withColumn("k", F.row_number().over(by_lang)).where(F.col("k") <= sample).groupBy(F.col("doc_id").alias("id")).agg(F.lit(1).alias("one"))
    chosen = small(written(chosen, "sample"))
    texts = known.join(chosen, F.col("doc_id").eqNullSafe(F.col("id"))).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "lang")
    counts = texts.mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts.lang.unique())
    p = np.zeros((len(langs), SIZE))
    for i, lang in enumerate(langs):
        mine = counts[counts.lang == lang]
        p[i, mine.gram.to_numpy(np.int64)] = mine.n.to_numpy()
    p = (p + 0.5) / (p.sum(axis=1, keepdims=True) + 0.5 * SIZE) if langs else p
    return langs, p


def _predict(model):
    def run(batches):
        langs, p = model.value
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            name, score, mix = [], [], []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                codes = trigrams(raw[a:b]) if langs and has_letter(raw[a:b]) else ()
                if not len(codes):
                    name.append(UND), score.append(0.0), mix.append({})
                    continue
                share = infer(p, codes)
                k = int(share.argmax())
                name.append(langs[k]), score.append(min(1.0, float(share[k]))), mix.append({langs[i]: float(share[i]) for i in np.flatnonzero(share)})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array([list(m.items()) for m in mix], pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "languages"])

    return run


def identify(documents: DataFrame, folds: int = FOLDS, held: int = HELD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages (the kept set with its proportions) of each document."""
    model = documents.sparkSession.sparkContext.broadcast(train(documents, folds, held, sample))
    docs = keyed(documents).select("doc_id", "text")
    out = docs.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, languages map<string,double>")
    return out.select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "lang_pred", "score", "languages")
