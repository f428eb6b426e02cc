"""Keeping an index fresh from a stream of file batches: each micro-batch is one snapshot refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Index


def refresh_from_stream(stream: DataFrame, index: Index, make_chunks: Callable[[DataFrame], DataFrame], edges: Callable[[DataFrame], DataFrame], root_key: str, config: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Files that arrive replace those of their paths; the others stay. Columns: path, content_hash and what ``make_chunks``
    needs. A batch that is delivered again after a failure changes nothing: its files have the stored hashes."""

    def step(batch: DataFrame, _: int) -> None:
        batch = batch.dropDuplicates(["path"])
        if index.manifest() is not None:
            stored = index.table("files")
            batch = stored.join(batch.select("path"), "path", "left_anti").unionByName(batch, allowMissingColumns=True)
        index.refresh(batch, make_chunks, edges(batch), root_key, config)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(stream: DataFrame, time_col: str, key_col: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """``window, key, n``: arrivals per window and key; rows later than the watermark are left out."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("window"), F.col(key_col).alias("key")).agg(F.count("*").alias("n"))
