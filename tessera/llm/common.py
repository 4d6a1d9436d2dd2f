"""Helpers shared by the operators: scratch tables, Arrow loops and 64-bit hashing in numpy."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and holds at most as much as this many rows of ROW_BYTES, 10 MB.
BROADCAST_ROWS, ROW_BYTES = 100_000, 100
#: Rows of one key that one task of a shuffled join may get.
HOT_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode (tests) one of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame) -> bool:
    """May a written table of numbers and texts be broadcast, by its counted bytes?"""
    texts = [F.octet_length(f.name) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    wide = sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(8 * (len(df.columns) - len(texts))))
    return (df.agg(F.sum(wide.cast("long"))).first()[0] or 0) <= BROADCAST_ROWS * ROW_BYTES


def small(df: DataFrame) -> DataFrame:
    """Mark a written table for broadcast if its counted bytes allow it; otherwise Spark picks a shuffled join."""
    return F.broadcast(df) if fits(df) else df


def spread_join(big: DataFrame, other: DataFrame, keys: list[str], row: list[str], how: str = "inner", sizes: str | None = None) -> DataFrame:
    """Inner or left join of a table whose keys may be hot with a written one that has few rows a key.

    other is broadcast if it is counted to be small. Else the rows of each key that has more than HOT_ROWS of big are
    salted, by a hash of the columns `row`, to as many tasks as their count asks for, and other repeats that key for
    each. The list of hot keys is broadcast; it has at most BROADCAST_ROWS rows, as a key must hold that share of big.
    sizes: a column of other with the rows of big for each key; without it they are counted.
    """
    if fits(other):
        return big.join(F.broadcast(other), keys, how)
    counted = other.select(*keys, F.col(sizes).alias("_n")) if sizes else big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = other.agg(F.sum(sizes)).first()[0] if sizes else big.count()
    per = max(HOT_ROWS, rows // max(BROADCAST_ROWS, 1))
    hot = written(counted.where(F.col("_n") > per).select(*keys, F.ceil(F.col("_n") / per).cast("int").alias("_salts")), "hot")
    if hot.isEmpty():
        return big.join(other, keys, how)
    hot = F.broadcast(hot)
    salts = F.coalesce("_salts", F.lit(1))
    left = big.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*row), salts).cast("int")).drop("_salts")
    right = other.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def text_key() -> Column:
    """Identity of a row's text; with doc_id it is the key under which results are joined back to rows."""
    return F.xxhash64("text", F.crc32(F.col("text").cast("binary")))


def keyed(documents: DataFrame) -> DataFrame:
    """Internal view of documents: the whole row is kept apart in _row, so extra columns cannot clash."""
    return documents.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), "text")


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tkey"] == b["tkey"])


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - off[0] if len(off) else np.zeros(1, np.int64)


def texts_of(column: pa.Array):
    """Each text of a column as bytes; nulls are empty."""
    raw, off = text_buffer(column)
    view = raw.tobytes()
    return [view[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    fill = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))])
    return fill(base), fill(pow(base, -1, 1 << 64))


@lru_cache(1)
def byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Rolling:
    """Fingerprints of any substrings of a buffer of bytes, or of 64-bit hashes, from one prefix sum (polynomial modulo 2**64)."""

    def __init__(self, raw: np.ndarray):
        size = 1 << max(10, int(len(raw)).bit_length())
        up, self.down = powers(size)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        codes = byte_codes()[raw] if raw.dtype == np.uint8 else raw
        np.cumsum(codes * up[: len(raw)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def radix_order(x: np.ndarray) -> np.ndarray:
    """Stable argsort of non-negative integers below 2**32, by two passes of 16 bits."""
    low = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    high = (x >> 16).astype(np.uint16)
    return low if not len(x) or not high.any() else low[np.argsort(high[low], kind="stable")]


#: Lower-cased byte of each byte, and whether it belongs to a word, for two kinds of words.
_BYTE = np.arange(256)
LOWERED = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
UNSPACED = ~np.isin(_BYTE, (32, 9, 10, 11, 12, 13))
ALNUM = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
CHUNK = 1 << 20


def words_in(raw: np.ndarray, bounds: np.ndarray, kind: np.ndarray):
    """Starts and ends of the words of raw; a word ends at each of bounds."""
    inside = kind[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = bounds[(bounds > 0) & (bounds < len(raw))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_groups(column: pa.Array, kind: np.ndarray = UNSPACED, limit: int = CHUNK, prefix: int = 0):
    """Hashes of the lower-cased words of a text column, vectorised: (first row, hashes, offsets of its rows, last two bytes of each word, hashes of prefixes).

    Prefixes have `prefix` bytes at most; with 0 there are none.
    Rows come in groups of about `limit` bytes; a longer text is hashed in parts cut between words.
    """
    raw, off = text_buffer(column)
    rows, a = len(off) - 1, 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        b = min(b, rows)
        part = LOWERED[raw[off[a] : off[b]]]
        starts, ends = words_in(part, off[a : b + 1] - off[a], kind)
        hashes = np.empty(len(starts), np.uint64)
        heads = np.empty(len(starts) if prefix else 0, np.uint64)
        k = 0
        while k < len(starts):
            m = max(k + 1, int(np.searchsorted(ends, starts[k] + 2 * limit)))
            base = int(starts[k])
            roll = Rolling(part[base : ends[m - 1]])
            hashes[k:m] = roll.of(starts[k:m] - base, ends[k:m] - base)
            if prefix:
                heads[k:m] = roll.of(starts[k:m] - base, np.minimum(ends[k:m], starts[k:m] + prefix) - base)
            k = m
        tail = part[ends - 1].astype(np.uint16) << np.uint16(8) | part[np.maximum(ends - 2, starts)] if len(ends) else np.zeros(0, np.uint16)
        yield a, hashes, np.searchsorted(starts, off[a : b + 1] - off[a]), tail, heads
        a = b
