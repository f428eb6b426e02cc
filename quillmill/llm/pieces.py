"""Splitting oversized items at natural boundaries (problem 2).

The text is viewed as a string of its UTF-8 bytes (one Latin-1 character per byte), so that the limit, which is stated in
bytes, is a bounded quantifier of a regular expression. One ``regexp_extract_all`` consumes the text in stretches: its
alternatives are ordered by the strength of the boundary they end at, and the last one takes characters up to the limit.
The overlap is a lookback from each stretch, cut forward to the start of a line or word. Everything is a chain of SQL
array functions inside one stage; no Python, no shuffle but the one that drops repeated deliveries of oversized rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BYTES_PER_TOKEN = 4
BLOCK = 256  # stretches summed at once
LOOK_STRETCHES = 4


def stretch_pattern(most: int) -> str:
    """Regular expression that consumes a byte string in stretches of at most ``most`` bytes.

    Alternatives, the first that fits is taken: (1) the rest of the text, (2) before a heading or a definition that starts a
    line at the margin, (3) after a blank line, (4) before an indented definition, (5) after a line, (6) after a sentence,
    (7) after white space, each in the last half of the stretch; (8) after a line or (9) white space in its first half;
    (10) anywhere but inside a UTF-8 character.
    """
    half = most // 2
    some = rf"[\x00-\xFF]{{{half},{most}}}"
    line = r"(?<=\n)"
    definition = (
        r"(?:#{1,6} |@|(?:export |default |pub(?:\([a-z]+\))? |public |private |protected |static |abstract |final |async |unsafe )*"
        r"(?:def|class|function|func|fn|impl|struct|enum|trait|mod|type|interface|const|module|CREATE|INSERT|SELECT)\b)"
    )
    return (
        rf"[\x00-\xFF]{{1,{most}}}\z"
        rf"|{some}{line}(?={definition})"
        rf"|{some}(?<=\n\r?\n)"
        rf"|{some}{line}(?=[ \t]+{definition})"
        rf"|{some}{line}"
        rf"|{some}(?<=[.!?;] )"
        rf"|{some}(?<=[ \t])"
        rf"|[\x00-\xFF]{{1,{half}}}{line}"
        rf"|[\x00-\xFF]{{1,{half}}}(?<=[ \t])"
        rf"|[\x00-\xFF]{{1,{most}}}(?![\x80-\xBF])"
        rf"|[\x00-\xFF]{{1,{most}}}"
    )


def _as_bytes(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _as_text(byte_string: Column) -> Column:
    return F.decode(F.encode(byte_string, "ISO-8859-1"), "UTF-8")


def _breaks(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("bigint")


def _once(rows: DataFrame, column: str) -> DataFrame:
    """The column computed here, once, and not again for each element where it is used below."""
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.explode(F.array(column)).alias(column))


def _block_sums(numbers: str) -> Column:
    """Sums of the numbers before each block of ``BLOCK``: with them a running sum looks at a block's numbers only."""
    blocks = F.sequence(F.lit(0), F.floor(F.size(numbers) / BLOCK).cast("int"))
    return F.aggregate(
        blocks,
        F.array(F.lit(0).cast("bigint")),
        lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(F.slice(numbers, k * BLOCK + 1, F.lit(BLOCK)), F.lit(0).cast("bigint"), lambda x, y: x + y))),
    )


def split_oversized(
    items: DataFrame,
    id_col: str = "id",
    text_col: str = "content",
    first_line_col: str | None = "start_line",
    limit_tokens: int = 800,
    overlap_tokens: int = 120,
) -> DataFrame:
    """Pieces of every item whose text has more than ``limit_tokens`` tokens (UTF-8 bytes / 4, rounded down).

    Returns ``chunk_id, piece_index, pieces_in_chunk, content, start_line, end_line, token_estimate, overlap_bytes``.

    Defined results: null ids or texts and texts within the limit give no row; a row delivered twice (same id and text)
    counts once; a null first line counts as 1; columns beyond those named are ignored, whatever their names; an empty
    table gives an empty result. A piece never has more than ``limit_tokens`` tokens, pieces in order with their overlap
    left out give back the text byte for byte, and no piece begins or ends inside a UTF-8 character.
    """
    if not 0 <= overlap_tokens < limit_tokens:
        raise ValueError("overlap_tokens must be at least 0 and less than limit_tokens")
    back = overlap_tokens * BYTES_PER_TOKEN
    most = (limit_tokens - overlap_tokens) * BYTES_PER_TOKEN
    first = F.coalesce(F.col(first_line_col), F.lit(1)) if first_line_col else F.lit(1)
    big = (
        items.where(F.octet_length(text_col) >= (limit_tokens + 1) * BYTES_PER_TOKEN)
        .select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("_text"), first.cast("bigint").alias("_first"))
        .where("chunk_id IS NOT NULL")
        .dropDuplicates(["chunk_id", "_text"])
    )
    # Everything per piece is read from the array of stretches, never from the whole text, so the cost is in proportion to it.
    stretches = F.regexp_extract_all(_as_bytes(F.col("_text")), F.lit(stretch_pattern(most)), F.lit(0))
    cut = _once(big.select("chunk_id", "_first", stretches.alias("_parts")), "_parts")
    cut = _once(cut.withColumn("_lines", F.transform("_parts", _breaks)), "_lines")
    cut = _once(cut.withColumn("_sums", _block_sums("_lines")), "_sums")
    rows = cut.select(
        "chunk_id",
        "_first",
        F.size("_parts").alias("pieces_in_chunk"),
        F.posexplode(
            F.transform(
                "_parts",
                lambda part, i: F.struct(
                    part.alias("part"),
                    # The last few stretches hold the lookback, whatever boundaries they end at.
                    F.right(F.array_join(F.slice("_parts", F.greatest(F.lit(1), i + 1 - LOOK_STRETCHES), F.least(i, F.lit(LOOK_STRETCHES))), ""), F.lit(back)).alias("before"),
                    (F.get("_sums", F.floor(i / BLOCK).cast("int")) + F.aggregate(F.slice("_lines", F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("lines"),
                ),
            )
        ).alias("piece_index", "_p"),
    )
    third = max(1, back // 3)
    # Cut the lookback forward to a line start, else a word start, else a character start.
    shared = F.regexp_extract("_p.before", rf"^(?:[\x00-\xFF]{{0,{third}}}?\n|[\x00-\xFF]{{0,{third}}}?[ \t]|[\x80-\xBF]{{0,3}})([\x00-\xFF]*)\z", 1) if back else F.lit("")
    rows = rows.withColumn("_shared", shared)
    piece = F.concat("_shared", "_p.part")
    start = F.col("_first") + F.col("_p.lines") - _breaks(F.col("_shared"))
    rows = rows.select(
        "chunk_id",
        F.col("piece_index").cast("bigint").alias("piece_index"),
        F.col("pieces_in_chunk").cast("bigint").alias("pieces_in_chunk"),
        piece.alias("_piece"),
        start.cast("bigint").alias("start_line"),
        F.length("_shared").cast("bigint").alias("overlap_bytes"),
    )
    # The line break that ends a piece belongs to its last line.
    inner = _breaks(F.col("_piece")) - F.when(F.col("_piece").endswith("\n"), 1).otherwise(0)
    return rows.select(
        "chunk_id",
        "piece_index",
        "pieces_in_chunk",
        _as_text(F.col("_piece")).alias("content"),
        "start_line",
        (F.col("start_line") + inner).cast("bigint").alias("end_line"),
        F.floor(F.length("_piece") / BYTES_PER_TOKEN).cast("bigint").alias("token_estimate"),
        "overlap_bytes",
    )


def rejoined(pieces: DataFrame) -> DataFrame:
    """``chunk_id, sha, start_line, end_line, fits``: what the pieces of each item make together, their overlap left out."""
    own = F.substring(_as_bytes(F.col("content")), F.col("overlap_bytes").cast("int") + 1, F.octet_length("content"))
    parts = pieces.select("chunk_id", F.struct("piece_index", own.alias("own")).alias("p"), "start_line", "end_line", ((F.octet_length("content") <= 3203) & (F.col("overlap_bytes") <= 480)).alias("fits"))
    whole = parts.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["own"]), "").alias("b"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("fits").alias("fits"))
    return whole.select("chunk_id", F.sha2(F.encode("b", "ISO-8859-1"), 256).alias("sha"), "start_line", "end_line", "fits")
