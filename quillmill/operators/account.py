"""Accounting: unions of spans, what was emitted, what was redacted where."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_union(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``key, islands, covered``: number and length of the unions of each key's spans; touching spans are one; empty and
    null spans count nothing. One window per key, no pairs of spans."""
    rows = spans.where(F.col(end) > F.col(start)).select(F.col(key).alias("key"), F.col(start).alias("s"), F.col(end).alias("e"))
    before = F.max("e").over(Window.partitionBy("key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("reach", before)
    gain = F.greatest(F.col("e") - F.greatest("s", F.coalesce("reach", F.col("s"))), F.lit(0))
    return marked.groupBy("key").agg(F.count_if(F.col("reach").isNull() | (F.col("s") > F.col("reach"))).alias("islands"), F.sum(gain).alias("covered"))


def overlap_free(chunks: DataFrame, key: str = "file_path", start: str = "start_line", end: str = "end_line", id_col: str = "id") -> DataFrame:
    """``key, id, first_line, last_line``: what each chunk adds to those before it; chunks that add nothing are left out."""
    order = Window.partitionBy(key).orderBy(start, end, id_col).rowsBetween(Window.unboundedPreceding, -1)
    first = F.greatest(F.col(start), F.coalesce(F.max(end).over(order), F.lit(0)) + 1)
    return chunks.withColumn("first_line", first).where(F.col("first_line") <= F.col(end)).select(F.col(key).alias("key"), F.col(id_col).alias("id"), "first_line", F.col(end).alias("last_line"))


def occurrences_in_chunks(spans: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``rule, occurrences, paths``: occurrences (path, rule, start, end) that lie in a span (path, start, end), each once.

    Both sides meet on the path alone; an empty occurrence lies in a span that holds its place, ends included.
    """
    o = occurrences.select("path", "rule", F.col("start").alias("os"), F.col("end").alias("oe")).distinct()
    s = spans.where("start < end").select("path", F.col("start").alias("ss"), F.col("end").alias("se"))
    inside = F.when(F.col("os") == F.col("oe"), (F.col("ss") <= F.col("os")) & (F.col("os") <= F.col("se"))).otherwise((F.col("ss") < F.col("oe")) & (F.col("se") > F.col("os")))
    hit = o.join(s, "path").where(inside).select("path", "rule", "os", "oe").distinct()
    return hit.groupBy("rule").agg(F.count("*").alias("occurrences"), F.countDistinct("path").alias("paths"))


def rag_dispositions(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``path, reason``: how each file was taken in, from its chunks; files without chunks were dropped."""
    per_file = chunks.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("n"))
    ladder = F.when(F.col("n").isNull(), "dropped_token_budget").when(F.array_contains("tags", "lock-file"), "included_summary_only").when(F.col("n") > 1, "included_chunked").otherwise("included_full")
    return files.select("path", F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).join(per_file, "path", "left").select("path", ladder.alias("reason"))
