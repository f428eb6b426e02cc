"""Joins that survive hot keys and don't move what can't match: shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
FILTER_BITS = 1 << 27  # 16 MB: what is broadcast is never larger, however many rows there are


def salted_join(rows: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", spread_by: str = "id") -> DataFrame:
    """Join of rows with a table of few rows a key, the rows of each key dealt to ``SALTS`` tasks by ``spread_by``: a third of
    all rows may have the same key."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
    return left.join(one.withColumn("_salt", salts), [*keys, "_salt"], how).drop("_salt")


def _places(h: Column, bits: int) -> list[Column]:
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.call_function("shiftrightunsigned", h, F.lit(32)).bitwiseOR(F.lit(1))
    return [(low + high * k).bitwiseAND(F.lit(bits - 1)) for k in range(3)]


def filter_words(hashes: DataFrame, column: str, per_row: int = 16) -> np.ndarray:
    """A Bloom filter of a column of 64-bit hashes, as words of 64 bits. Its size is a power of two from ``per_row`` bits a
    row, ``FILTER_BITS`` at most: one that is full lets everything through, and the join behind it still decides."""
    bits = min(FILTER_BITS, 1 << max(12, (per_row * hashes.count()).bit_length()))
    at = hashes.select(F.explode(F.array(*_places(F.col(column), bits))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    rows = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    table = np.zeros(bits // 64, np.int64)
    table[[r["word"] for r in rows]] = [r["bits"] for r in rows]
    return table


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (64-bit integers) the filter lets through."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    hit = np.ones(len(h), bool)
    for k in range(3):
        at = ((low + high * np.uint64(k)) & np.uint64(len(table) * 64 - 1)).astype(np.int64)
        hit &= (table[at >> 6] >> (at & 63)) & 1 == 1
    return hit
