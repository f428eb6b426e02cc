"""Filling fixed-capacity containers with items (problem 7).

Texts are measured in tokens of a public tokenizer. Only a text larger than the container is split: into full containers
and a rest. The rest of the problem depends on the sizes alone, so it is solved on their histogram, which has at most as
many entries as the container has tokens, however many texts there are: variable-capacity best fit opens a bin for the
largest size left, fills it from the sizes left for each permitted length, keeps the length of least unused share, and
uses the pattern found as often as the counts allow. Each pattern uses up at least one size, so there are at most a few
thousand. The texts are then dealt to the patterns' slots by their rank among the texts of their size, in parallel.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pretokenisation pattern this vocabulary is published with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[tuple[str, str], object] = {}


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer, loaded once per worker."""
    key = (vocabulary, pattern)
    if key not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def _counter(vocabulary: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "tokens"])

    return run


def token_sizes(documents: DataFrame, doc_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, tokens``; a row delivered twice counts once, and the larger of two texts of one id stands."""
    rows = documents.where(F.col(doc_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(doc_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(rows).mapInArrow(_counter(vocabulary, pattern), "doc_id bigint, tokens bigint").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


class _Stock:
    """Sizes left, with the sums that one, two or three of them reach, as bit sets."""

    def __init__(self, counts: dict[int, int], most: int) -> None:
        self.counts = {s: n for s, n in counts.items() if n > 0}
        self.most, self.mask = most, (1 << (most + 1)) - 1
        self.refresh()

    def refresh(self) -> None:
        self.sizes = sorted(self.counts, reverse=True)
        one = sum(1 << s for s in self.sizes)
        two = three = 0
        for s in self.sizes:
            two |= one << s
        two &= self.mask
        for s in self.sizes:
            three |= two << s
        self.reach = [1, one, two, three & self.mask]

    def take(self, pattern: Counter, times: int) -> None:
        used_up = False
        for s, k in pattern.items():
            self.counts[s] -= k * times
            if not self.counts[s]:
                del self.counts[s]
                used_up = True
        if used_up:
            self.refresh()

    def fill(self, first: int, length: int) -> Counter:
        """Sizes that fill a bin of the length beside its first item, with as little room left as found."""
        pattern, gap = Counter({first: 1}), length - first
        left = lambda s: self.counts[s] - pattern[s]
        # While three items can't close the gap, take the largest that fit.
        for s in self.sizes:
            if gap <= 3 * self.sizes[0] or s > gap:
                continue
            k = min(left(s), (gap - 2 * s) // s)
            if k > 0:
                pattern[s] += k
                gap -= k * s
        tries = 0
        target = gap
        while target > 0 and tries < 40:
            low = (1 << (target + 1)) - 1
            best = max(((r & low).bit_length() - 1, -n) for n, r in enumerate(self.reach) if n)
            if best[0] <= 0:
                break
            parts = self._parts(best[0], -best[1], left)
            if parts is not None:
                pattern.update(parts)
                break
            target, tries = best[0] - 1, tries + 1
        return pattern

    def _parts(self, total: int, n: int, left: Callable[[int], int]) -> list[int] | None:
        if n == 1:
            return [total] if total in self.counts and left(total) > 0 else None
        seen = 0
        for s in self.sizes:
            if s >= total or not self.reach[n - 1] >> (total - s) & 1 or left(s) <= 0:
                continue
            rest = self._parts(total - s, n - 1, lambda x, s=s: left(x) - (x == s))
            if rest is not None:
                return [s, *rest]
            seen += 1
            if seen > 20:
                return None
        return None


def pack_histogram(counts: dict[int, int], lengths: tuple[int, ...]) -> list[tuple[Counter, int, int]]:
    """Patterns as (sizes with their number in one bin, number of bins, length of the bin). Places every item."""
    lengths = tuple(sorted(lengths))
    stock, out = _Stock(counts, lengths[-1]), []
    while stock.counts:
        largest = stock.sizes[0]
        options = []
        for length in lengths:
            if length >= largest:
                pattern = stock.fill(largest, length)
                used = sum(s * k for s, k in pattern.items())
                options.append((round((length - used) / length, 2), -length, pattern, used))  # ties go to the longer bin
        _, _, pattern, used = min(options, key=lambda o: o[:2])
        times = min(stock.counts[s] // k for s, k in pattern.items())
        out.append((pattern, times, next(x for x in lengths if x >= used)))  # downsized to its contents
        stock.take(pattern, times)
    return out


def pack_documents(
    documents: DataFrame,
    capacity: int = 2048,
    lengths: tuple[int, ...] = (512, 1024, 2048),
    doc_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    rows_per_group: int = 500_000,
) -> DataFrame:
    """``doc_id, piece_index, token_start, token_end, container_id, container_tokens``: every text in its container(s).

    Defined results: null ids or texts give no row; a repeated id counts once; an empty text has one row with equal offsets
    and a null container; extra columns are ignored; an empty table gives an empty result. A text is split only if it has
    more than ``capacity`` tokens; no container holds more than ``container_tokens``, one of ``lengths``, the largest of
    which is ``capacity``. ``rows_per_group`` is the number of rows ranked together and changes no container's fill.
    """
    lengths = tuple(sorted({x for x in lengths if x < capacity} | {capacity}))
    sizes = checkpointed(token_sizes(documents, doc_col, text_col, vocabulary, pattern))
    pieces = sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("bigint") - 1))).alias("piece_index"))
    pieces = pieces.select(
        "doc_id",
        F.col("piece_index").cast("bigint").alias("piece_index"),
        (F.col("piece_index") * capacity).cast("bigint").alias("token_start"),
        F.least(F.col("tokens"), (F.col("piece_index") + 1) * capacity).cast("bigint").alias("token_end"),
    ).withColumn("size", F.col("token_end") - F.col("token_start"))
    # At most ``capacity`` rows, whatever the number of texts.
    histogram = {r["size"]: r["n"] for r in pieces.where("size > 0").groupBy("size").agg(F.count("*").alias("n")).collect()}
    slots, base, used = [], 0, Counter()
    for bin_sizes, times, length in pack_histogram(histogram, lengths):
        for s, k in bin_sizes.items():
            slots.append((s, used[s], used[s] + k * times, k, base, length))
            used[s] += k * times
        base += times
    slot_rows = documents.sparkSession.createDataFrame(slots, "size bigint, first_rank bigint, end_rank bigint, per_bin bigint, base bigint, container_tokens bigint")
    groups = max(1, -(-sum(histogram.values()) // rows_per_group))
    keyed = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_index"), F.lit(groups)))
    offsets = keyed.groupBy("size", "salt").agg(F.count("*").alias("n"))
    offsets = offsets.select("size", "salt", (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("offset"))
    ranked = keyed.join(offsets, ["size", "salt"]).withColumn("rank", F.col("offset") + F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece_index")) - 1)
    placed = ranked.join(F.broadcast(slot_rows), "size", "left").where("size = 0 OR (rank >= first_rank AND rank < end_rank)")
    return placed.select(
        "doc_id",
        "piece_index",
        "token_start",
        "token_end",
        (F.col("base") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("per_bin"))).cast("bigint").alias("container_id"),
        "container_tokens",
    )


def container_fill(packed: DataFrame) -> DataFrame:
    """Per container length: containers, texts placed, tokens, unused tokens and the share of the room used."""
    bins = packed.where("container_id IS NOT NULL").groupBy("container_id", "container_tokens").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("tokens"), F.count("*").alias("items"))
    return bins.groupBy("container_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("container_tokens") - F.col("tokens")).alias("unused_tokens"),
        F.round(F.sum("tokens") / F.sum("container_tokens"), 6).alias("used_share"),
    )
