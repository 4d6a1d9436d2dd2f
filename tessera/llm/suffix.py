"""Removal of every long string that occurs at two or more places of the corpus, by bytes or by words.

Method: merging of Burrows-Wheeler transforms by iterative interleave refinement. Candidate contexts are cut
around winnowed anchors (any string of `length` units holds one, at the same offset in each occurrence, so no
repeat is missed); equal contexts are counted, not repeated. The contexts of an anchor are dealt to shards, each
shard sorts only its own suffixes into a BWT over symbols of `symbol` units, and the merge refines the interleave
of the shards one symbol per round. The round in which a boundary first appears between two rows is their common
prefix, and the repeated intervals are the runs of rows whose common prefix is whole after length / symbol rounds.
No suffix is sorted again across shards.

Units: bytes of the UTF-8 text, or words between white space (A-Z lower-cased, by 64-bit hashes).

Scale: an anchor is a row of about 40 bytes for each 170 bytes of text; only contexts whose anchor occurs in
two different contexts travel as text. Contexts of a hot anchor are salted to merges of `hot` contexts, whose
distinct windows meet by fingerprint in packed blocks, as many as the counted contexts ask for. Symbols and equal
contexts are compared by 64-bit fingerprints.

Edge cases: a null text is empty (0 bytes, nothing removed); a text shorter than `length` has no windows; repeated
rows are repeats of each other; a null doc_id is an ordinary row; an empty table gives an empty result; extra
columns pass through `dedup_text` unchanged and are ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UNSPACED, Rolling, keyed, mix, radix_order, same_row, spread_join, text_buffer, word_groups, words_in, written

LENGTH = 400
GRAM = 64
SYMBOL = 100
PIECE = 1 << 20
HOT = 512
#: Passages by words: a passage of 50 words or more that also occurs elsewhere.
PASSAGE = {"words": True, "length": 50, "gram": 8, "symbol": 10}
#: Units of contexts after which a merge ends with its group; more no longer fit the processor's caches.
MERGE = 1 << 17
#: Windows of hot anchors that meet in one group.
MEET = 1 << 20
SPAN = "doc_id long, tkey long, s int, n int"
RANGES = "array<struct<start:long,end:long>>"
DIGEST = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long, runs {RANGES}, passages {RANGES}"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(x) - w + 1
    pad = -len(x) % w
    rows = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def sequences(column, words: bool):
    """Groups of texts as (first row, their units one after the other, offsets)."""
    if words:
        for a, hashes, off, _, _ in word_groups(column, UNSPACED):
            yield a, hashes, off
    else:
        yield 0, *text_buffer(column)


def anchors(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: (first start, windows, anchor key, context hash). ends: where the pieces of raw end."""
    if len(raw) < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    roll = Rolling(raw)
    at = np.arange(len(raw) - gram + 1)
    code = (roll.of(at, at + gram) & ~np.uint64(PIECE * 2 - 1)) | at.astype(np.uint64)
    low = sliding_min(code, length - gram + 1)
    start = np.arange(len(low))
    fits = start + length <= ends[np.searchsorted(ends, start, side="right")]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (fits[1:] != fits[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(low)))
    first, count = first[keep := fits[first]], count[keep]
    place = (low[first] & np.uint64(PIECE * 2 - 1)).astype(np.int64) - first
    shape = mix(place.astype(np.uint64) * np.uint64(1 << 32) + count.astype(np.uint64))
    return first, count, low[first] >> np.uint64(21), mix(roll.of(first, first + count + length - 1) ^ shape)


def _pieces(off: np.ndarray, length: int):
    """Groups of (row, start, end) whose bytes fill at most PIECE; long texts are cut so that each window lies in one piece."""
    group, size = [], 0
    for row in np.flatnonzero(np.diff(off) >= length).tolist():
        a, b = int(off[row]), int(off[row + 1])
        while a + length <= b:
            e = min(b, a + PIECE)
            if size + e - a > PIECE:
                yield group
                group, size = [], 0
            group.append((row, a, e))
            size += e - a
            a = e - length + 1
    if group:
        yield group


def _anchor_rows(length, gram, words):
    def rows(batch, first_row, raw, off):
        for group in _pieces(off, length):
            row, a, e = (np.array(x, np.int64) for x in zip(*group))
            ends = np.cumsum(e - a)
            first, count, key, ctx = anchors(np.concatenate([raw[x:y] for _, x, y in group]), ends, length, gram)
            piece = np.searchsorted(ends, first, side="right")
            s = first - (ends - (e - a))[piece] + a[piece] - off[row[piece]]
            at = pa.array(row[piece] + first_row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(s.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64))], ["doc_id", "tkey", "s", "n", "key", "ctx"])

    def run(batches):
        for batch in batches:
            for part in sequences(batch.column(2), words):
                yield from rows(batch, *part)

    return run


# --- Burrows-Wheeler transforms -----------------------------------------------------------------


class Collection:
    """Strings laid out with one slot a position and one for the end; the strings of a collection share an alphabet."""

    def __init__(self, strings: list[bytes], symbol: int, unit: type = np.uint8):
        width = np.dtype(unit).itemsize
        sizes = np.array([len(x) // width + 1 for x in strings], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(bytes(width).join([*strings, b""]), unit)
        self.owner = np.repeat(np.arange(len(strings)), sizes)
        slot = np.arange(len(raw))
        left = self.first[self.owner + 1] - 1 - slot
        self.whole = left >= symbol  # a whole symbol starts here; elsewhere the string (of this phase) ends
        self.rank = np.zeros(len(raw), np.int64)
        places = np.flatnonzero(self.whole)
        self.roll = Rolling(raw)
        self.rank[places] = np.unique(self.roll.of(places, places + symbol), return_inverse=True)[1] + 1
        self.before = slot - symbol >= self.first[self.owner]
        self.symbol = symbol


def shard_bwt(c: Collection, a: int, b: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of slots a..b to `depth` symbols, and the symbol before each suffix (0 at a string's start)."""
    whole, size = c.whole[a:b], b - a
    stops = np.flatnonzero(~whole)
    rank = c.rank[a:b] + len(stops)
    rank[stops] = np.arange(len(stops))  # each end differs from all others
    have = 1
    while have < depth:
        step = min(have, depth - have)
        after = np.minimum(np.arange(size) + step * c.symbol, size - 1)
        pair = (rank << 32) | np.where(whole, rank[after], 0)
        rank = np.unique(pair, return_inverse=True)[1]
        have += step
    order = radix_order(rank) + a
    return order, np.where(c.before[order], c.rank[order - c.symbol], 0)


def merge_bwts(c: Collection, cuts: list[int], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the BWTs of the shards between cuts: slots in merged order, and each one's common prefix with the one before, in symbols.

    The interleave z says which shard each merged row comes from. A round reads the BWT symbols along z and deals
    the rows to their symbols' buckets, stably; so blocks that share h symbols become blocks that share h + 1.
    """
    orders, bwts = zip(*(shard_bwt(c, a, b, depth) for a, b in zip(cuts[:-1], cuts[1:])))
    sizes = np.diff(cuts)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    bwt = np.concatenate(bwts)
    z = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint16)
    block = np.zeros(len(z), np.int64)
    lcp = np.full(len(z), depth)
    for h in range(depth):
        read = np.empty(len(z), np.int64)
        read[np.argsort(z, kind="stable")] = np.arange(len(z))  # each shard's BWT is read in its own order
        symbols = bwt[read]
        to = radix_order(symbols)
        z, symbols, block = z[to], symbols[to], block[to]
        new = np.ones(len(z), bool)
        new[1:] = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1]) | (symbols[1:] == 0)
        lcp[new & (lcp == depth)] = h
        block = np.cumsum(new) - 1
    read = np.empty(len(z), np.int64)
    read[np.argsort(z, kind="stable")] = np.arange(len(z))
    return np.concatenate(orders)[read], lcp


def repeated(strings: list[bytes], times: np.ndarray, length: int = LENGTH, symbol: int = SYMBOL, shards: int = 4, unit: type = np.uint8) -> tuple[np.ndarray, Collection]:
    """For each slot of the strings: does the substring of `length` that starts there occur twice? times: copies of each string."""
    c = Collection(strings, symbol, unit)
    per = -(-len(strings) // shards)
    cuts = [int(c.first[i]) for i in range(0, len(strings), per)] + [len(c.owner)]
    depth = length // symbol
    slots, lcp = merge_bwts(c, cuts, depth)
    interval = np.cumsum(lcp < depth) - 1
    enough = c.first[c.owner + 1] - 1 - slots_left(c) >= length
    weight = np.where(enough[slots], times[c.owner[slots]], 0)
    out = np.zeros(len(c.owner), bool)
    out[slots] = (np.bincount(interval, weight)[interval] >= 2) & enough[slots]
    return out, c


def slots_left(c: Collection) -> np.ndarray:
    return np.arange(len(c.owner))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


OUT = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("part", pa.int32()), ("packed", pa.binary())])
WINDOW = np.dtype([("f", "<u8"), ("d", "<i8"), ("nil", "<i8"), ("t", "<i8"), ("s", "<i8")])


def _merge_rows(length, symbol, shards, parts, unit):
    limit = MERGE * np.dtype(unit).itemsize

    def merge(rows):
        ctxs = [r[6] for r in rows]
        flags, c = repeated(ctxs, np.array([r[5] for r in rows]), length, symbol, shards, unit)
        flags[c.first[1:] - 1] = False
        start, count = _runs(flags)
        who = c.owner[start]
        keep = np.array([r[5] for r in rows])[who] < 2  # contexts with copies are removed whole already
        start, count, who = start[keep], count[keep], who[keep]
        doc, key, s0 = (pa.array([r[i] for r in rows], pa.int64()) for i in (2, 3, 4))
        idx = pa.array(who)
        s = (np.array([r[4] for r in rows], np.int64)[who] + start - c.first[who]).astype(np.int32)
        nil = pa.nulls(len(s), pa.int32())
        yield pa.RecordBatch.from_arrays([doc.take(idx), key.take(idx), pa.array(s), pa.array(count.astype(np.int32)), nil, pa.nulls(len(s), pa.binary())], schema=OUT)
        hot = np.array([r[7] > 1 for r in rows])
        if hot.any():
            yield from pack(rows, flags, c, hot)

    def pack(rows, flags, c, hot):
        """One window of each content, by its fingerprint, from the contexts of hot anchors. nil: 1 if doc_id is null, 2 if no row waits for the answer."""
        left = c.first[c.owner + 1] - 1 - slots_left(c)
        slots = np.flatnonzero((left >= length) & hot[c.owner])
        prints = c.roll.of(slots, slots + length)
        prints, one = np.unique(prints, return_index=True)
        slots = slots[one]
        own = c.owner[slots]
        out = np.zeros(len(slots), WINDOW)
        out["f"], out["t"] = prints, np.array([r[3] for r in rows])[own]
        out["d"] = np.array([r[2] or 0 for r in rows])[own]
        out["nil"] = np.where(flags[slots] | (np.array([r[5] for r in rows])[own] > 1), 2, np.array([r[2] is None for r in rows])[own])
        out["s"] = np.array([r[4] for r in rows])[own] + slots - c.first[own]
        part = (prints % np.uint64(parts)).astype(np.int64)
        to = np.argsort(part, kind="stable")
        edge = np.searchsorted(part[to], np.arange(parts + 1))
        have = np.flatnonzero(np.diff(edge))
        n = len(have)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(have.astype(np.int32)), pa.array([out[to[edge[p] : edge[p + 1]]].tobytes() for p in have], pa.binary())], schema=OUT)

    def run(batches):
        rows, size, last = [], 0, None
        for batch in batches:
            cols = [x.to_pylist() for x in batch.columns]
            for r in zip(*cols):
                if r[:5] == last:  # the same row of a table that repeats rows
                    continue
                if last is not None and r[:2] != last[:2] and size >= limit:
                    yield from merge(rows)
                    rows, size = [], 0
                last = r[:5]
                rows.append(r)
                size += len(r[6])
        if rows:
            yield from merge(rows)

    return run


def _meet(pdf):
    """Windows of hot anchors that several merges hold: spans of those that no merge has found by itself."""
    import pandas as pd

    x = np.concatenate([np.frombuffer(b, WINDOW) for b in pdf["packed"]])
    _, inverse, count = np.unique(x["f"], return_inverse=True, return_counts=True)
    x = x[(count[inverse] >= 2) & (x["nil"] < 2)]
    return pd.DataFrame({"doc_id": pd.array(np.where(x["nil"] == 1, 0, x["d"]), "Int64").copy(), "nil": x["nil"] == 1, "tkey": x["t"], "s": x["s"].astype(np.int32)})


def _cut_contexts(length, words):
    schema = pa.schema([("key", pa.int64()), ("salt", pa.int64()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("s", pa.int64()), ("times", pa.int64()), ("ctx", pa.binary()), ("salts", pa.int64())])

    def run(batches):
        for batch in batches:
            docs, keys, wants = (batch.column(k).to_pylist() for k in (0, 1, 3))
            out, size = [], 0
            for first_row, raw, off in sequences(batch.column(2), words):
                for row, at in enumerate(off[:-1].tolist(), first_row):
                    for w in wants[row]:
                        ctx = raw[at + w["s"] : at + w["s"] + w["n"] + length - 1].tobytes()
                        out.append((w["key"], w["salt"], docs[row], keys[row], w["s"], w["times"], ctx, w["salts"]))
                        size += len(ctx)
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                            out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return run


def repeat_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, symbol: int = SYMBOL, shards: int = 4, hot: int = HOT, words: bool = False) -> DataFrame:
    """Rows (doc_id, tkey, s, n): at n starts from unit s on, the string of `length` units also starts elsewhere."""
    if length % symbol or gram > length:
        raise ValueError("length must be a multiple of symbol and at least gram")
    docs = keyed(documents).drop("_row")
    runs = written(docs.where(F.octet_length("text") >= length).mapInArrow(_anchor_rows(length, gram, words), f"{SPAN}, key long, ctx long"), "anchors")
    classes = written(runs.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "tkey", "s", "n")).alias("one")), "classes")
    copied = classes.where("times > 1").select("key", "ctx", "times")
    copies = spread_join(runs, copied, ["key", "ctx"], ["doc_id", "tkey", "s"], sizes="times").select("doc_id", "tkey", "s", "n")
    shared = written(classes.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "shared")
    crowd = shared.where(F.col("kinds") > hot).agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    parts = max(64, -(-crowd * (length - gram + 1) // MEET))
    salts = F.ceil(F.col("kinds") / hot)
    want = (
        spread_join(classes, shared, ["key"], ["ctx"], sizes="kinds")
        .select("one.doc_id", "one.tkey", F.struct("key", F.pmod("ctx", salts).alias("salt"), "one.s", "one.n", "times", salts.alias("salts")).alias("w"))
        .groupBy("doc_id", "tkey")
        .agg(F.collect_list("w").alias("want"))
    )
    found = docs.join(want, same_row(docs, want)).select(docs["doc_id"], docs["tkey"], docs["text"], "want")
    contexts = found.mapInArrow(_cut_contexts(length, words), "key long, salt long, doc_id long, tkey long, s long, times long, ctx binary, salts long")
    dealt = contexts.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc_id", "tkey", "s")
    unit = np.uint64 if words else np.uint8
    merged = written(dealt.mapInArrow(_merge_rows(length, symbol, shards, parts, unit), f"{SPAN}, part int, packed binary"), "merged")
    far = merged.where("part is not null").groupBy("part").applyInPandas(_meet, "doc_id long, nil boolean, tkey long, s int")
    far = far.select(F.when(~F.col("nil"), F.col("doc_id")).alias("doc_id"), "tkey", "s", F.lit(1).alias("n"))
    return copies.unionByName(merged.where("part is null").drop("part", "packed")).unionByName(far)


def removed_runs(spans, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows of spans."""
    out: list[tuple[int, int]] = []
    for s, n in sorted(spans):
        e = s + n - 1 + length
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _row_runs(spans: pa.ListArray, of: int, length: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """removed_runs of all rows of a batch, for the spans of one search: each row's place in them, and their starts and ends."""
    row = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    which, s, n = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans.flatten().flatten())
    row, s, n = (x[which == of] for x in (row, s, n))
    to = np.argsort(key := (row << 32) + s, kind="stable")
    row, key = row[to], key[to]
    high = np.maximum.accumulate(key + n[to] - 1 + length)  # a later row is above any end of the one before
    first = np.flatnonzero(np.concatenate([[True], key[1:] > high[:-1]])[: len(key)])
    last = np.append(first[1:], len(key))[: len(first)] - 1
    low = (1 << 32) - 1
    return np.searchsorted(row[first], np.arange(len(spans) + 1)), (key[first] & low, high[last] & low)


def _kept_sha256(raw: np.ndarray, starts: list[int], ends: list[int]) -> str:
    digest = hashlib.sha256()
    for a, b in zip([0, *ends], [*starts, len(raw)]):
        digest.update(raw[a:b])
    return digest.hexdigest()


def kept_bytes(raw: bytes, runs) -> bytes:
    out, at = [], 0
    for s, e in runs:
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]])


def _with_spans(documents: DataFrame, *hows: dict) -> DataFrame:
    """Each row with the spans of all searches; if there are several, `of` says which one found a span."""
    docs = keyed(documents)
    found = reduce(DataFrame.unionByName, (repeat_spans(documents, **how).withColumn("of", F.lit(k)) for k, how in enumerate(hows)))
    spans = found.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct(*["of"][: len(hows) - 1], "s", "n")).alias("spans"))
    return docs.join(spans, same_row(docs, spans), "left").select("_row", docs["doc_id"], docs["text"], "spans")


def suffix_dedup(documents: DataFrame, length: int = LENGTH, passage: dict = PASSAGE, **how) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words, the removed runs (start, end) in bytes and the passages in words.

    Passages are the maximal runs of repeated strings by the search `passage`, of any number of bytes; they are counted, not removed.
    """

    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            found = [_row_runs(batch.column(2), k, n) for k, n in enumerate((length, passage["length"]))]
            cuts, (starts, ends) = found[0]
            kept = [_kept_sha256(raw[i:j], starts[a:b].tolist(), ends[a:b].tolist()) for i, j, a, b in zip(off[:-1].tolist(), off[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist())]
            n_removed, n_words = (np.diff(np.concatenate([[0], np.cumsum(e - s)])[at]) for at, (s, e) in found)
            lists = (pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(s), pa.array(e)], fields=list(ranges.value_type))) for at, (s, e) in found)
            columns = [batch.column(0), pa.array(np.diff(off)), pa.array(n_removed), pa.array(np.diff(cuts)), pa.array(kept, pa.string()), pa.array(np.diff(found[1][0])), pa.array(n_words), *lists]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in DIGEST.split(", ")])

    rows = _with_spans(documents, {"length": length, **how}, passage).select("doc_id", "text", "spans")
    return rows.mapInArrow(run, DIGEST)


def _whole_characters(raw: bytes, runs):
    for s, e in runs:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        yield s, e


def _word_bytes(raw: bytes, runs):
    starts, ends = words_in(np.frombuffer(raw, np.uint8), np.zeros(0, np.int64), UNSPACED)
    return [(int(starts[s]), int(ends[e - 1])) for s, e in runs]


def dedup_text(documents: DataFrame, length: int = LENGTH, words: bool = False, **how) -> DataFrame:
    """documents with the repeated runs cut from text, in whole characters (one that lies partly in a run stays) or in whole words."""

    @F.pandas_udf("string")
    def cut(text, spans):
        out = []
        for t, x in zip(text, spans):
            if x is not None and len(x) and t is not None:
                raw = t.encode()
                runs = removed_runs(((y["s"], y["n"]) for y in x), length)
                t = kept_bytes(raw, (_word_bytes if words else _whole_characters)(raw, runs)).decode()
            out.append(t)
        import pandas as pd

        return pd.Series(out, dtype=object)

    rows = _with_spans(documents, {"length": length, "words": words, **how})
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans"))
    return rows.select(*(text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in documents.columns))
