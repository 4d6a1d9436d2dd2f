"""Streaming ingest (an extension): new files are decoded and appended; reconciliation is per asset, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.assets import decode_assets, stream_assets


def decoded_stream(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    return decode_assets(stream_assets(spark, path, glob))


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, view: str = "full", glob: str | None = None) -> StreamingQuery:
    """Append analyses of the files that are there now; call again for later ones. A batch that is replayed replaces its own folder."""
    from ..operators.views import analysis

    def put(batch: DataFrame, number: int) -> None:
        analysis(batch, view).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return decoded_stream(spark, path, glob).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
