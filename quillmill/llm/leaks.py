"""Evaluation texts leaking into training text (problem 8).

Words are what remains between white space after case and everything but letters and digits is dropped. A document leaks
an item if it holds ``window`` (12) consecutive words of it.

Method: size-partitioned MinHash containment search. What must be contained is a window of an item, so windows are signed, by
the least hash among their five-word shingles: equal windows have equal signatures, so the search misses nothing, and
neighbouring windows mostly share theirs, so an item or document has few. Items are partitioned by their number of windows;
each partition has a Bloom filter of its signatures, of bounded size, and a document's window becomes a candidate of those
partitions whose filter lets its signature through. Candidates and items' windows are joined on partition and signature by a
shuffle (documents dealt to several tasks a key, as a passage may stand in a third of them), and a pair counts if the windows
are equal word for word.

Neither items nor documents come to the driver, and documents are read once, however many items there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread
from .joins import filter_words, passes, salted_join

_DROPPED = re.compile(r"[^\w\s]+|_+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
STRIDE = 1 << 19  # words looked at at once
#: Greatest number of windows of an item in each partition but the last.
PARTITIONS = (8, 32, 128, 512)

_memo: dict[str, int] = {}


def words_of(text: str) -> list[str]:
    """Words after letter case and punctuation are dropped."""
    return _DROPPED.sub("", text.lower()).split()


def _hashes(words: list[str]) -> np.ndarray:
    get, digest = _memo.get, xxhash.xxh64_intdigest
    if len(_memo) > 400_000:
        _memo.clear()
    out = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        h = get(w)
        if h is None:
            h = _memo[w] = digest(w)
        out[i] = h
    return out


def signatures(ids: np.ndarray, window: int, shingle: int) -> np.ndarray:
    """For each window of a run of word hashes the least hash of the shingles inside."""
    n = len(ids) - shingle + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(shingle):
            h = h * _MIX + ids[k : k + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    m = n - (window - shingle)
    best = h[:m].copy()
    for j in range(1, window - shingle + 1):
        np.minimum(best, h[j : j + m], out=best)
    return best


def size_partition(windows: int) -> int:
    return sum(windows > p for p in PARTITIONS)


_SIGNED = "item_id bigint, part int, sig bigint, words string"


def _signer(window: int, shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every window of every item with its signature and the item's size partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                n = len(words) - window + 1
                if n > 0:
                    sig = signatures(_hashes(words), window, shingle).view(np.int64)
                    rows = [" ".join(words[i : i + window]) for i in range(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([size_partition(n)] * n, pa.int32()), pa.array(sig), pa.array(rows, pa.string())], ["item_id", "part", "sig", "words"])

    return run


def _candidates(filters, window: int, shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of documents whose signature some partition's filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = filters.value
        for batch in batches:
            block: list[tuple[int, list[str]]] = []
            size = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) >= window:
                    block.append((key, words))
                    size += len(words)
                if size >= STRIDE:
                    yield _look(block, tables, window, shingle)
                    block, size = [], 0
            if block:
                yield _look(block, tables, window, shingle)

    return run


def _look(block: list[tuple[int, list[str]]], tables: dict[int, np.ndarray], window: int, shingle: int) -> pa.RecordBatch:
    every = [w for _, words in block for w in words]
    lengths = np.array([len(words) for _, words in block])
    ends = np.cumsum(lengths)
    sig = signatures(_hashes(every), window, shingle)
    docs: list[int] = []
    parts: list[int] = []
    sigs: list[int] = []
    texts: list[str] = []
    for part, table in tables.items():
        at = np.flatnonzero(passes(table, sig))
        owner = np.searchsorted(ends, at, side="right")
        inside = at + window <= ends[owner]
        for i, o in zip(at[inside].tolist(), owner[inside].tolist()):
            docs.append(block[o][0])
            parts.append(part)
            sigs.append(int(sig[i].astype(np.int64)))
            texts.append(" ".join(every[i : i + window]))
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(parts, pa.int32()), pa.array(sigs, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "part", "sig", "words"])


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 12,
    shingle: int = 5,
) -> DataFrame:
    """``doc_id, item_id`` for every document that holds ``window`` consecutive words of an item.

    Defined results: null ids or texts give no row; items or documents of fewer words than the window give no row; repeated
    rows count once; an item text shared by several items gives a row for each; extra columns are ignored; either table
    empty gives an empty result.
    """
    spark = documents.sparkSession
    texts = spread(documents.where(F.col(doc_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(doc_col).cast("bigint"), F.col(text_col)))
    query = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("bigint"), F.col(item_text_col))
    signed = checkpointed(spread(query).mapInArrow(_signer(window, shingle), _SIGNED).distinct())
    used = sorted(r["part"] for r in signed.select("part").distinct().collect())
    tables = {part: filter_words(signed.where(F.col("part") == part).select("sig").distinct(), "sig", 32) for part in used}
    found = texts.mapInArrow(_candidates(spark.sparkContext.broadcast(tables), window, shingle), "doc_id bigint, part int, sig bigint, words string")
    return salted_join(found, signed.withColumnRenamed("words", "item_words"), ["part", "sig"], spread_by="doc_id").where("words = item_words").select("doc_id", "item_id").distinct()
