"""Assets: files or rows of bytes, decoded in one Arrow stage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalars import detect_format
from ..schemas import DECODED

MAX_BYTES = 1 << 30
#: Decoded assets of one Arrow batch.
ROWS = 64


def read_assets(spark: SparkSession, path: str, glob: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """asset_id, path, size_bytes, content of the files under path; larger files than max_bytes come without content and are decoded by path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    small = df.where(F.col("length") <= max_bytes).select("path", F.col("length").alias("size_bytes"), "content")
    large = df.where(F.col("length") > max_bytes).select("path", F.col("length").alias("size_bytes"), F.lit(None).cast("binary").alias("content"))
    return _assets(small.unionByName(large))


def stream_assets(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """The same as a stream of new files."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return _assets(df.select("path", F.col("length").alias("size_bytes"), "content"))


def memory_assets(df: DataFrame) -> DataFrame:
    """Assets from columns path and content; a blank path is `<memory>`."""
    path = F.when(F.trim(F.coalesce("path", F.lit(""))) == "", "<memory>").otherwise(F.col("path"))
    return _assets(df.select(path.alias("path"), F.octet_length("content").cast("bigint").alias("size_bytes"), "content"))


def _assets(df: DataFrame) -> DataFrame:
    return df.select(F.xxhash64("path", "size_bytes", F.when(F.col("path") == "<memory>", F.xxhash64("content"))).alias("asset_id"), "path", "size_bytes", "content")


def decode_assets(assets: DataFrame, probe: bool = False, formats=None) -> DataFrame:
    """asset_id, path, size_bytes, detected_format, status, error_message, container, nodes, entries, issues: one row an asset.

    The format is told in the JVM, so a filter on formats keeps other contents out of Python; contents end here. Rows with a
    size but no content are large files, which are read by path in ranges.
    """
    ddl = "asset_id bigint, path string, size_bytes bigint, detected_format string, " + DECODED
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        from .decode import decode, decode_file

        rows = []
        for batch in batches:
            ids, paths, sizes, formats_ = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            for k, content in enumerate(batch.column(3)):
                by_path = not content.is_valid and sizes[k] is not None
                found = decode_file(paths[k], probe, formats) if by_path else decode(content.as_py(), formats_[k], probe)
                if found is None:
                    continue
                rows.append({"asset_id": ids[k], "path": paths[k], "size_bytes": sizes[k]} | found)
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    rows = assets.withColumn("detected_format", detect_format(F.col("content")))
    if formats:
        rows = rows.where(F.col("detected_format").isin(*formats) | (F.col("content").isNull() & F.col("size_bytes").isNotNull()))
    return rows.select("asset_id", "path", "size_bytes", "content", "detected_format").mapInArrow(run, ddl)


def entries_of(decoded: DataFrame) -> DataFrame:
    return decoded.select("asset_id", F.explode("entries").alias("e")).select("asset_id", "e.*")


def issues_of(decoded: DataFrame) -> DataFrame:
    return decoded.select("asset_id", F.explode("issues").alias("i")).select("asset_id", "i.*")


def nodes_of(decoded: DataFrame) -> DataFrame:
    return decoded.select("asset_id", F.explode("nodes").alias("n")).select("asset_id", "n.*")


__all__ = ["decode_assets", "entries_of", "issues_of", "memory_assets", "nodes_of", "read_assets", "stream_assets"]
