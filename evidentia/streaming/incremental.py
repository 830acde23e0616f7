"""Passages of arriving pages, as a stream.  An extension: the batch operators define the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evidentia.operators import chunk


def stream_passages(pages: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Write the passages of a stream of whole sources ``(source_id, version, page, text)``.

    Each batch is written under its number, so a batch that is retried replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunk.chunks(batch, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
