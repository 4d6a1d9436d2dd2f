"""Entry points for a path, an object of a store, or bytes: probe and extract as JSON documents, and a table function for SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..operators import views
from ..schemas import DECODED
from .assets import decode_assets, memory_assets, read_assets

COLUMNS = ("detected_format", "status", "error_message", "container", "nodes", "entries", "issues")


def object_path(request: dict, scheme: str = "s3a") -> str:
    """The path of a request: its `path`, else its `bucket` and `key`. Glob characters of a key stand for themselves."""
    if request.get("path"):
        return request["path"]
    bucket, key = request.get("bucket"), request.get("key")
    if not bucket or not key:
        raise ValueError("a request needs path, or bucket and key")
    return f"{scheme}://{bucket}/" + re.sub(r"([\\*?\[\]{}])", r"\\\1", key.lstrip("/"))


def _source(spark: SparkSession, asset, name: str | None) -> DataFrame:
    if isinstance(asset, (bytes, bytearray)):
        return memory_assets(spark.createDataFrame([(name, bytearray(asset))], "path string, content binary"))
    return read_assets(spark, object_path(asset) if isinstance(asset, dict) else asset)


def probe(spark: SparkSession, asset, name: str | None = None) -> DataFrame:
    """asset_id and json of a path, a request (see object_path), or bytes with a name: containers and issues."""
    return views.probe(decode_assets(_source(spark, asset, name), probe=True))


def extract(spark: SparkSession, asset, view: str = "full", name: str | None = None, pretty: bool = False) -> DataFrame:
    """asset_id and json of the same, by view; an unknown view is a ValueError."""
    return views.to_json(views.analysis(decode_assets(_source(spark, asset, name)), view), pretty)


class DecodeMedia:
    """A row for each content; its columns are those of decode_assets from detected_format on."""

    def eval(self, content):
        from .decode import decode
        from .decode.ranged import detect

        found = decode(content, None if content is None else detect(content))
        yield tuple(found[c] for c in COLUMNS)


def register(spark: SparkSession, name: str = "decode_media") -> None:
    """Make decode_media(content) callable in SQL: SELECT a.path, m.status FROM assets a, LATERAL decode_media(a.content) m."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(DecodeMedia, returnType="detected_format string, " + DECODED))


__all__ = ["extract", "object_path", "probe", "register"]
