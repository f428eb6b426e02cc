"""Fitting chunks into limits: prefix cuts, pools of tokens, trims of what was rendered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PROGRAMMING
from ..session import checkpointed, parts_for


def prefix_sum(rows: DataFrame, order: list[Column], value: str, out: str = "running", partitions: int | None = None) -> DataFrame:
    """The running sum of a column over all rows in an order, without gathering them in one task.

    Rows are range-partitioned by the order; each range is summed where it lies; the ranges' sums, one number each, are
    turned to offsets. The order must be total for the result to be defined.
    """
    n = partitions or parts_for(rows)
    ranged = checkpointed(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    offsets = sums.select("_part", (F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_sum")).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("_own", F.sum(value).over(within)).join(F.broadcast(offsets), "_part").withColumn(out, F.col("_own") + F.col("_offset")).drop("_part", "_own", "_offset")


def byte_budget(files: DataFrame, limit: int, size: str = "size_bytes", order: list[Column] | None = None) -> DataFrame:
    """The files with ``kept``: the first that doesn't fit drops all behind it. Sizes are not negative."""
    return prefix_sum(files, order or [F.desc("priority"), F.asc("path")], size).withColumn("kept", F.col("running") <= limit).drop("running")


@dataclass
class _Row:
    id: str
    path: str
    tokens: int
    source: bool
    tags: tuple[str, ...]


def _select(rows: list[_Row], limit: int, kept: list[_Row], ids: set[str]) -> None:
    """First a chunk of each file not seen yet, then more of those seen; what doesn't fit is passed over."""
    used, seen = 0, set()
    for first in (True, False):
        for r in rows:
            if r.id in ids or first == (r.path in seen) or used + r.tokens > limit:
                continue
            used += r.tokens
            seen.add(r.path)
            ids.add(r.id)
            kept.append(r)


def two_pool(rows: list[_Row], limit: int) -> list[_Row]:
    """Two fifths for source, the rest for context: one chunk of source is guaranteed, a readme and a configuration chunk
    are reserved, and what is left over is lent to either."""
    kept: list[_Row] = []
    ids: set[str] = set()
    source = limit * 40 // 100
    _select([r for r in rows if r.source], source, kept, ids)
    if not any(r.source for r in kept):
        for r in rows:
            if r.source and r.tokens <= limit:
                kept.append(r)
                ids.add(r.id)
                break
    context = min(limit - source, max(0, limit - sum(r.tokens for r in kept if r.source)))
    reserved = 0
    for tag in ("readme", "config"):
        for r in rows:
            if not r.source and tag in r.tags and r.id not in ids and reserved + r.tokens <= context:
                reserved += r.tokens
                ids.add(r.id)
                kept.append(r)
                break
    _select([r for r in rows if not r.source], max(0, context - reserved), kept, ids)
    _select(rows, max(0, limit - sum(r.tokens for r in kept)), kept, ids)
    return kept


def token_budget(chunks: DataFrame, limit: int, score: str = "priority") -> DataFrame:
    """``id, ord`` of the chunks that fit the limit of tokens, in the order taken.

    The fold is sequential by definition: whether a chunk fits depends on all before it. It runs on the driver over narrow
    rows (no text) streamed in order, of each file ``limit`` at most; their number grows with that of the files, so this
    is for one repository or focus at a time. Columns: id, file_path, start_line, language, token_estimate, tags.
    """
    rows = chunks.select(
        "id", F.col("file_path").alias("path"), "start_line", F.greatest(F.coalesce("token_estimate", F.lit(0)), F.lit(0)).alias("tokens"), F.coalesce(F.col("language").isin(*PROGRAMMING), F.lit(False)).alias("source"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.col(score).alias("score"),
    ).where(F.col("tokens") <= limit)
    order = [F.desc_nulls_last(F.nanvl("score", F.lit(None).cast("double"))), F.asc("path"), F.asc("start_line"), F.asc("id")]
    # Rows of no tokens cost nothing and are all kept.
    free = rows.where("tokens = 0").select("id")
    paid = rows.where("tokens > 0")
    first = paid.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where(F.col("_n") <= limit)
    taken = first.orderBy(*order).toLocalIterator(prefetchPartitions=True)
    kept = two_pool([_Row(r["id"], r["path"], r["tokens"], r["source"], tuple(r["tags"])) for r in taken], limit)
    spark = chunks.sparkSession
    chosen = spark.createDataFrame([(r.id, i) for i, r in enumerate(kept)], "id string, ord bigint")
    return chosen.union(free.select("id", F.lit(None).cast("bigint")))


def trim_to_rendered(chunks: DataFrame, limit_tokens: int, rendered: Column, value: list[Column]) -> DataFrame:
    """The chunks whose rendered bytes by four fit the limit when the least valuable are dropped first (``value`` ascending)."""
    sized = chunks.withColumn("_bytes", F.octet_length(rendered) + 1)
    summed = prefix_sum(sized, [F.struct(*value).desc()], "_bytes", "_running")
    return summed.where(F.floor(F.col("_running") / 4) <= limit_tokens).drop("_bytes", "_running")
