"""Benchmark decontamination: a prefix-filtered set join of documents with the word windows of benchmark items.

A window is `window` consecutive words of an item (an item with fewer words, but not none, is one window). Only full
containment counts, so the necessary prefix of a window is one word: its rarest, by counts over all documents. A
document word that is some window's prefix gives candidate starts by its offset in the window (positional bound) and
the window's length (length bound); the words there are then compared whole.

Items are read in blocks of about `block_bytes` of text; a block's index is broadcast and all documents pass by it
once, with no shuffle. Words are counted in one pass for all blocks. Hot words cost at most one lookup a (offset, length) pair and occurrence.

Edge cases: a null text has no words; an item without words has no window; repeated items are one item; a null item_id
hits words but is not listed or counted; a null doc_id and repeated rows are ordinary rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, same_row, texts_of, written

WINDOW = 10
BLOCK_BYTES = 16 << 20

#: Bytes of words: digits, letters lower-cased, and all bytes above ASCII; every other byte ends a word.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


def item_windows(items, window: int) -> dict[tuple, set]:
    """Windows of (item_id, text) pairs, with the ids of their items."""
    out = defaultdict(set)
    for item, text in items:
        w = words((text or "").encode())
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            out[tuple(w[s : s + n])].add(None if item is None else str(item))
    return dict(out)


class Index:
    """Windows by their prefix: word -> (offset in the window, length) pairs."""

    def __init__(self, windows: dict[tuple, set], counts: dict[bytes, int]):
        self.windows = windows
        prefix = defaultdict(set)
        for w in windows:
            at = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i]))
            if all(counts.get(x, 0) for x in w):  # a window with a word that no document has cannot occur
                prefix[w[at]].add((at, len(w)))
        self.prefix = {k: sorted(v) for k, v in prefix.items()}

    def find(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged runs of hit words, and the items."""
        rare = self.prefix.keys() & set(doc)
        if not rare:
            return [], set()
        spans, items = [], set()
        for p, word in enumerate(doc):
            if word in rare:
                for at, n in self.prefix[word]:
                    if p >= at and p - at + n <= len(doc):
                        hit = self.windows.get(tuple(doc[p - at : p - at + n]))
                        if hit:
                            spans.append((p - at, p - at + n))
                            items |= hit
        return merged(spans), items - {None}


def merged(spans) -> list[tuple[int, int]]:
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


RUNS = "array<struct<start:int,end:int>>"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _count(vocabulary):
    def run(batches):
        for batch in batches:
            have = defaultdict(int)
            known = vocabulary.value
            for raw in texts_of(batch.column(0)):
                for w in words(raw):
                    if w in known:
                        have[w] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.binary()), pa.array(list(have.values()), pa.int64())], ["word", "n"])

    return run


def _count_all(batches):
    for batch in batches:
        have = defaultdict(int)
        for raw in texts_of(batch.column(0)):
            for w in words(raw):
                have[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.binary()), pa.array(list(have.values()), pa.int64())], ["word", "n"])


def _scan(index, all_rows):
    def run(batches):
        for batch in batches:
            out = []
            for doc, key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                w = words(raw)
                runs, items = index.value.find(w)
                if runs or all_rows:
                    out.append((doc, key, len(w), [{"start": s, "end": e} for s, e in runs], sorted(items)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)

    return run


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: doc_id, tkey, n_words, runs of hit words (start, end) and the items that occur."""
    spark = documents.sparkSession
    docs = keyed(documents).drop("_row")
    items = benchmark.select("item_id", "text").distinct()  # copies of an item would all land in one block
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    schema = f"doc_id long, tkey long, n_words long, runs {RUNS}, items array<string>"
    found = []
    total = lambda counted: counted.groupBy("word").agg(F.sum("n").alias("n"))
    every = written(total(docs.select("text").mapInArrow(_count_all, "word binary, n long")), "words") if blocks > 1 else None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        windows = item_windows(block, window)
        known = {x for w in windows for x in w}
        if every is None:
            counts = total(docs.select("text").mapInArrow(_count(spark.sparkContext.broadcast(known)), "word binary, n long"))
        else:  # at most block_bytes of words
            counts = every.join(F.broadcast(spark.createDataFrame([(bytearray(x),) for x in known], "word binary")), "word", "left_semi")
        index = spark.sparkContext.broadcast(Index(windows, {bytes(r.word): r.n for r in counts.collect()}))
        one = docs.mapInArrow(_scan(index, b == 0), schema)
        if b:  # only one block's index is held at a time, besides the first
            one = written(one.select("doc_id", "tkey", "runs", "items"), "hits")
            index.destroy()
        found.append(one)
    if blocks == 1:
        return found[0]

    @F.pandas_udf(RUNS)
    def joined(runs):
        return runs.map(lambda r: [{"start": s, "end": e} for s, e in merged((x["start"], x["end"]) for x in r)])

    rest = found[1]
    for f in found[2:]:
        rest = rest.unionByName(f)
    rest = rest.groupBy("doc_id", "tkey").agg(F.flatten(F.collect_list("runs")).alias("more"), F.flatten(F.collect_list("items")).alias("others"))
    base = found[0]
    none = F.array().cast
    return base.join(rest, same_row(base, rest), "left").select(
        base["doc_id"],
        base["tkey"],
        "n_words",
        joined(F.concat("runs", F.coalesce("more", none(RUNS)))).alias("runs"),
        F.array_sort(F.array_distinct(F.concat("items", F.coalesce("others", none("array<string>"))))).alias("items"),
    )


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of documents without any hit, with all their columns."""
    docs = keyed(documents)
    bad = contamination(documents, benchmark, **how).where(F.size("runs") > 0).select("doc_id", "tkey").distinct()
    return docs.join(bad, same_row(docs, bad), "left_anti").select("_row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) l, unnest(range(1, len(w) - least(10, len(w)) + 2)) s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, list_slice(w, s, s + l - 1) win FROM bs),
ds AS (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) s FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l),
dw AS (SELECT r, l, s, list_slice(w, s, s + l - 1) win FROM ds),
hit AS (SELECT r, s, bw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.win = bw.win),
pos AS (SELECT r, count(DISTINCT p) n FROM (SELECT r, unnest(range(s, s + l)) p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) n, string_agg(i, ',' ORDER BY i) ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) i FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(pos.n, 0) AS BIGINT) n_hit, CAST(coalesce(its.n, 0) AS BIGINT) n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(pos.n, 0) > 0 contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
