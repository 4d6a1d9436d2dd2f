"""Near-duplicate join on the Jaccard similarity of word shingles, with Bayesian pruning of candidates.

Texts are sets of `shingle`-word shingles of lower-cased words between white space (a text with fewer words, but not none,
is one shingle). Texts with equal sets form one class and are compared once. Candidates share a band of MinHash values
(32 bands of 4: a pair at the threshold 0.8 is missed with a probability below 1e-7). A pair's MinHash
values are compared `STEP` at a time; after m matches of n the similarity has a beta posterior, and the pair is
dropped as soon as its probability of reaching the threshold falls below `tolerance`. The others are verified on
their whole shingle sets.

Scale: a bucket is compared in pairs of blocks of `block` members, so no task holds a whole bucket, and tasks return
at most an edge for each member: a spanning forest of what survives. Its components, found by hashed min-label
rounds over tables, hold every surviving pair; their members' shingles are fetched once and compared in the same block
pairs, which return counts of links and again only a spanning forest. No list of all pairs exists anywhere, and
nothing about all documents reaches the driver.

Edge cases: a null or wordless text is alone in its class, without links; a null doc_id takes part, and a class is named by its
smallest non-null doc_id (null if it has none); repeated rows are links of each other; an empty table gives an empty
result; extra columns are ignored or, in `distinct_documents`, kept.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UNSPACED, keyed, mix, same_row, spread_join, word_groups, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    if not len(words):
        return words
    k = min(k, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h ^ words[i : len(words) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(h)


@lru_cache(1)
def _seeds(n: int = BANDS * ROWS) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def min_hashes(s: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of multiplicative hashes, by 32 high bits."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 1024):
        np.minimum(low, (s[a : a + 1024, None] * _seeds()).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


@lru_cache(8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, n: int = BANDS * ROWS, step: int = STEP) -> tuple[int, ...]:
    """Matches below which a pair is dropped after step, 2 * step, ... values: P(s >= threshold | m of n) under Beta(m + 1, n - m + 1)."""
    s = (np.arange(20000) + 0.5) / 20000
    out = []
    for k in range(step, n + 1, step):
        for m in range(k + 1):
            log = m * np.log(s) + (k - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= threshold].sum() / p.sum() >= tolerance:
                out.append(m)
                break
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, need: tuple[int, ...], pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of a, rows of b) that no step drops."""
    i, j = pairs
    have = np.zeros(len(i), np.int32)
    for t, least in enumerate(need):
        c = slice(t * STEP, (t + 1) * STEP)
        have += (a[i, c] == b[j, c]).sum(axis=1, dtype=np.int32)
        keep = have >= least
        i, j, have = i[keep], j[keep], have[keep]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component, for edges i - j among n."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _signatures(k):
    schema = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("sig", pa.binary())])

    def run(batches):
        for batch in batches:
            cls, n, sig = [], [], []
            for _, hashes, off, _, _ in word_groups(batch.column(2), UNSPACED):
                for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                    s = shingles(hashes[a:b], k)
                    n.append(len(s))
                    cls.append(set_hash(s) if len(s) else None)
                    sig.append(min_hashes(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], schema=schema)

    return run


def set_hash(s: np.ndarray) -> int:
    return int(mix(np.array([(s * np.uint64(0x9E3779B97F4A7C15)).sum() ^ np.bitwise_xor.reduce(mix(s)), len(s)], np.uint64)).sum().astype(np.int64))


def _bands(sig: str) -> list:
    """Band numbers with a hash of the band's part of sig."""
    w = ROWS * 4
    return [F.xxhash64(F.lit(i), F.substring(sig, i * w + 1, w)) for i in range(BANDS)]


def block_pairs(members: DataFrame, group: str, block: int) -> DataFrame:
    """Members (group, cls, size, ...) of groups with several, once for each pair (left, right) of blocks that they are in.

    A group of n is cut into ceil(n / block) blocks by hash; a member meets every block in one task each.
    """
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("cls", F.lit(11)), blocks).cast("int")
    rows = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("left", F.least("mine", "other")).withColumn("right", F.greatest("mine", "other")).drop("other", "size")


def _tasks(batches, columns: int):
    """Runs of rows with equal first three columns, as lists of columns; batches are sorted by them."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != last:
                if len(held) > 1:
                    yield list(zip(*held))
                held, last = [], row[:3]
            held.append(row)
    if len(held) > 1:
        yield list(zip(*held))


def _cross(cls: np.ndarray, mine: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a task: within the block if left = right, else across."""
    if left == right:
        return np.triu_indices(len(cls), 1)
    a, b = np.flatnonzero(mine == left), np.flatnonzero(mine == right)
    return np.repeat(a, len(b)), np.tile(b, len(a))


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _prune(need):
    def run(batches):
        for rows in _tasks(batches, 6):
            _, first = np.unique(np.array(rows[3]), return_index=True)
            cls, mine = np.array(rows[3])[first], np.array(rows[4])[first]
            sig = np.stack([np.frombuffer(rows[5][k], np.uint32) for k in first])
            i, j = survivors(sig, sig, need, _cross(cls, mine, rows[1][0], rows[2][0]))
            label = forest(len(cls), i, j)
            child = np.flatnonzero(label != np.arange(len(cls)))
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(cls[child]), pa.array(cls[label[child]])], schema=EDGES)

    return run


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _verify(need, threshold):
    """Spanning forest (a, b) of verified links, and for each member (a, null) the copies it links to."""

    def run(batches):
        for rows in _tasks(batches, 8):
            _, first = np.unique(np.array(rows[3]), return_index=True)
            cls, mine, times = (np.array(rows[c])[first] for c in (3, 4, 5))
            sig = np.stack([np.frombuffer(rows[6][k], np.uint32) for k in first])
            sets = [np.frombuffer(rows[7][k], np.uint64) for k in first]
            i, j = survivors(sig, sig, need, _cross(cls, mine, rows[1][0], rows[2][0]))
            ok = exact(sets, i, j, threshold)
            i, j = i[ok], j[ok]
            if len(i):
                links = np.bincount(i, times[j], len(cls)) + np.bincount(j, times[i], len(cls))
                label = forest(len(cls), i, j)
                child = np.flatnonzero(label != np.arange(len(cls)))
                have = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cls[child], cls[have]])), pa.array(cls[label[child]].tolist() + [None] * len(have), pa.int64()), pa.array(np.concatenate([np.zeros(len(child), np.int64), links[have].astype(np.int64)]))], schema=LINKS)

    return run


def exact(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of threshold or more, by whole sets."""
    out = np.zeros(len(i), bool)
    if not len(i):
        return out
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(ids.max()) + 1, bool)
    order = np.argsort(i, kind="stable")
    cut = np.flatnonzero(np.diff(i[order])) + 1
    for run in np.split(order, cut):
        me = ids[at[i[run[0]]] : at[i[run[0]] + 1]]
        mark[me] = True
        both = np.array([int(np.count_nonzero(mark[ids[at[k] : at[k + 1]]])) for k in j[run]])
        mark[me] = False
        whole = sizes[i[run[0]]] + sizes[j[run]] - both
        out[run] = both >= threshold * whole - 1e-9
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges (a, b): label is the smallest node of the component.

    Alternating large-star and small-star rounds over tables until nothing changes; each halves the depth of what remains. The edges of a
    hub are many, so the least neighbours (a row a node) are broadcast or the hub's edges salted.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = spread_join(both.where("b > a"), low, ["a"], ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b"))  # larger neighbours to the least one
        large = written(large.where("a <> b").distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small_ = spread_join(large, low, ["a"], ["b"]).select("a", "b", "m")
        edges = written(small_.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _fetch(k):
    schema = pa.schema([("cls", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for batch in batches:
            sets = []
            for _, hashes, off, _, _ in word_groups(batch.column(1), UNSPACED):
                sets += [shingles(hashes[a:b], k).tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], schema=schema)

    return run


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, tkey, cls (hash of the shingle set), label (component), class_id and n_links of each document."""
    docs = keyed(documents).drop("_row")
    need = least_matches(threshold, tolerance)
    rows = written(docs.mapInArrow(_signatures(shingle), "doc_id long, tkey long, cls long, n int, sig binary"), "signatures")
    classes = rows.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), "tkey")).alias("one"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    classes = written(classes, "classes")

    keys = classes.select("cls", F.explode(F.array(*_bands("sig"))).alias("band"))
    crowded = written(keys.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "crowded")
    members = spread_join(keys, crowded, ["band"], ["cls"], sizes="size").select(F.col("band").alias("g"), "cls", "size")
    members = members.join(classes.select("cls", "sig"), "cls").select("g", "cls", "size", "sig")
    dealt = block_pairs(members, "g", block).select("g", "left", "right", "cls", "mine", "sig").repartition("g", "left", "right").sortWithinPartitions("g", "left", "right")
    edges = dealt.mapInArrow(_prune(need), "a long, b long")
    near = written(components(edges), "near")

    sizes = written(near.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "sizes")
    inside = spread_join(near, sizes, ["label"], ["node"], sizes="size").join(classes, F.col("node") == F.col("cls")).select(F.col("label").alias("g"), "cls", "size", "times", "sig", "one")
    inside = written(inside, "inside")
    wanted = inside.select("cls", "one.id", F.col("one.tkey").alias("k"))
    texts = docs.join(wanted, (F.coalesce(docs["doc_id"], F.lit(-(2**63))) == wanted["id"]) & (docs["tkey"] == wanted["k"])).select("cls", "text")
    sets = texts.mapInArrow(_fetch(shingle), "cls long, shingles binary")
    full = inside.drop("one").join(sets, "cls")
    dealt = block_pairs(full, "g", block).select("g", "left", "right", "cls", "mine", "times", "sig", "shingles").repartition("g", "left", "right").sortWithinPartitions("g", "left", "right")
    found = written(dealt.mapInArrow(_verify(need, threshold), "a long, b long, links long"), "links")
    label = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))

    out = classes.select("cls", "times", "one").join(label, F.col("cls") == F.col("node"), "left").join(links, F.col("cls") == F.col("a"), "left")
    out = out.select("cls", F.coalesce("label", "cls").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = written(out, "classes_linked")
    rows = rows.select("doc_id", "tkey", "cls")
    ids = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least")).join(out.select("cls", "label"), "cls").groupBy("label").agg(F.min("least").alias("class_id"))
    ids = written(ids, "class_ids")
    out = written(spread_join(out, ids, ["label"], ["cls"]).select("cls", "label", "class_id", "n_links"), "answers")
    alone = rows.where("cls is null").select("doc_id", "tkey", "cls", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return spread_join(rows.where("cls is not null"), out, ["cls"], ["doc_id", "tkey"]).unionByName(alone)


def distinct_documents(documents: DataFrame, **how) -> DataFrame:
    """documents with one row of each class of near duplicates, the one with the smallest doc_id (null first counts last)."""
    docs = keyed(documents)
    found = written(near_duplicates(documents, **how), "near")
    first = found.where("cls is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("one")).select("one.doc_id", "one.tkey")
    alone = found.where("cls is null").select("doc_id", "tkey").distinct()
    once = docs.join(first, same_row(docs, first), "left_semi").dropDuplicates(["doc_id", "tkey"])
    return once.unionByName(docs.join(alone, same_row(docs, alone), "left_semi")).select("_row.*")
