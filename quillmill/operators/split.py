"""Structure-aware splitting: line windows, headings, definitions, JSON; coalescing and enriching of the pieces.

Headings and definitions are found with windows over exploded lines or by array functions; the walks whose next step depends
on the last (line windows, coalescing) run per text in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, token_estimate
from ..session import spread

PIECE = "path string, language string, start_line bigint, end_line bigint, content string, tags array<string>, token_estimate bigint, priority double, byte_start bigint, byte_end bigint"


def tokens(text: str) -> int:
    return len(text.encode()) // 4


def _lines(text: str) -> list[str]:
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def _boundary(lines: list[str], start: int, end: int) -> int | None:
    best, weight = None, 0
    for i in range(start, min(end, len(lines))):
        t = lines[i].lstrip()
        w = 4 if t.startswith("class ") else 3 if t.startswith(("def ", "fn ", "pub fn ", "async fn ", "pub async fn ")) else 0 if t.strip() else 1
        if w > weight:
            best, weight = i, w
    return best


def line_windows(text: str, most: int = 800, overlap: int = 120) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of windows of about ``most`` tokens, ended at a definition or blank line near their end."""
    lines = _lines(text)
    if not lines:
        return []
    average = max(1, max(1, tokens(text)) // len(lines))
    target, back = max(1, most // average), overlap // average
    out, start = [], 0
    while start < len(lines):
        end = min(start + target, len(lines))
        if end < len(lines):
            found = _boundary(lines, min(start + int(target * 0.8), end), min(end + 10, len(lines)))
            end = end if found is None else found
        if end <= start:
            end = min(start + 1, len(lines))
        piece = "".join(lines[start:end])
        if not piece.strip():
            start = end
            continue
        out.append((start + 1, end, piece))
        start = end if end - back <= start else end - back
    return out


_HEADING = re.compile(r"\s*(#{1,6})[ \t]")


def markdown_sections(text: str, most: int = 800, overlap: int = 120) -> list[tuple[int, int, str, str | None]]:
    """(first line, last line, text, tag) of the sections headings begin; a section over ``most`` tokens is windowed."""
    lines, marks = _lines(text), []
    for i, line in enumerate(lines):
        if _HEADING.match(line):
            marks.append((i, line.strip().lstrip("#").strip()[:30]))
    starts = sorted({0, *(i for i, _ in marks)}) if lines else []
    names = dict(marks)
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        body = "".join(lines[a:b])
        if tokens(body) <= most:
            out.append((a + 1, b, body, f"section:{names[a]}" if names.get(a) else None))
        else:
            out += [(a + s, a + e, piece, None) for s, e, piece in line_windows(body, most, overlap)]
    return out


#: Beginnings of definitions by language. Fixed values.
DEFINITIONS = {
    "python": ("def ", "async def ", "class ", "@"), "javascript": ("function ", "async function ", "export ", "class ", "const ", "let "), "typescript": ("function ", "async function ", "export ", "class ", "interface ", "type ", "const ", "enum "),
    "rust": ("fn ", "pub fn ", "async fn ", "pub async fn ", "struct ", "pub struct ", "enum ", "pub enum ", "impl ", "trait ", "pub trait ", "mod ", "pub mod "), "go": ("func ", "type "), "java": ("public ", "private ", "protected ", "class ", "interface ", "enum "),
    "c": ("static ", "struct ", "typedef ", "int ", "void ", "char "),
}
#: (pattern, kind) of what a definition names. Fixed values.
SYMBOLS = (
    (r"^(?:export\s+)?(?:default\s+)?(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?(?:def|fn|func|function)\s+(?:\([^)]*\)\s*)?([\w$]+)", "def"),
    (r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:public\s+|private\s+|protected\s+|static\s+|final\s+)*(?:pub(?:\([a-z]+\))?\s+)?(?:class|struct|enum|trait|interface|type)\s+([\w$]+)", "type"),
    (r"^impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?([\w:]+)", "impl"),
)
_SYMBOLS = [(re.compile(p), kind) for p, kind in SYMBOLS]


def symbol_tag(piece: str) -> str | None:
    """What the first line of code in a piece defines, as ``kind:name``."""
    for line in piece.split("\n"):
        t = line.strip()
        if not t or t.startswith(("@", "//", "#[", "/*", "*")):
            continue
        for pattern, kind in _SYMBOLS:
            if m := pattern.match(t):
                return f"{kind}:{m[1]}"
        return None
    return None


def code_sections(text: str, language: str, most: int = 800, overlap: int = 120) -> list[tuple[int, int, str, str | None]]:
    """Like ``markdown_sections``, split where definitions begin; up to two definitions fall back to line windows."""
    begins = DEFINITIONS.get(language)
    lines = _lines(text)
    marks = [i for i, line in enumerate(lines) if begins and line.lstrip().startswith(begins)]
    if len(marks) <= 2:
        return [(a, b, piece, symbol_tag(piece)) for a, b, piece in line_windows(text, most, overlap)]
    starts = sorted({0, *marks})
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)]):
        body = "".join(lines[a:b])
        if not body.strip():
            continue
        if tokens(body) <= most:
            out.append((a + 1, b, body, symbol_tag(body)))
        else:
            out += [(a + s, a + e, piece, symbol_tag(piece)) for s, e, piece in line_windows(body, most, overlap)]
    return out


def json_summary(value: object, depth: int = 2, keys: int = 16) -> object:
    """The shape of a JSON value: names and kinds to a depth, at most so many names."""
    if isinstance(value, dict):
        return {k: json_summary(v, depth - 1, keys) for k, v in list(value.items())[:keys]} if depth else "object"
    if isinstance(value, list):
        return [json_summary(value[0], depth - 1, keys)] if depth and value else "array"
    return "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


def json_pieces(text: str, most: int = 800) -> list[tuple[int, int, str, str | None]] | None:
    """A summary of the shape, then batches of members within the limit; None where the text isn't JSON."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    compact = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    out: list[tuple[int, int, str, str | None]] = [(1, max(1, len(_lines(text))), compact(json_summary(value)), "json-schema")]
    members = list(value.items()) if isinstance(value, dict) else [(str(i), v) for i, v in enumerate(value)] if isinstance(value, list) else [("value", value)]
    batch: dict | list = {} if isinstance(value, dict) else []
    line = 1001
    for key, v in members:
        grown = {**batch, key: v} if isinstance(batch, dict) else [*batch, v]
        if batch and tokens(compact(grown)) > most:
            out.append((line, line, compact(batch), f"json-key:{next(iter(batch))}" if isinstance(batch, dict) else "json-array"))
            line, batch = line + 1, {key: v} if isinstance(batch, dict) else [v]
        else:
            batch = grown
    if batch:
        out.append((line, line, compact(batch), f"json-key:{next(iter(batch))}" if isinstance(batch, dict) else "json-array"))
    return out


def split_text(text: str, language: str, most: int = 800, overlap: int = 120) -> list[tuple[int, int, str, list[str]]]:
    """The splitter of the language: markdown family by headings, JSON by members, code by definitions, others by lines."""
    if language in ("markdown", "restructuredtext", "asciidoc"):
        parts = markdown_sections(text, most, overlap)
    elif language == "json":
        parts = json_pieces(text, most) or [(a, b, p, None) for a, b, p in line_windows(text, most, overlap)]
    elif language in DEFINITIONS:
        parts = code_sections(text, language, most, overlap)
    else:
        parts = [(a, b, p, None) for a, b, p in line_windows(text, most, overlap)]
    return [(a, b, p, [t] if t else []) for a, b, p, t in parts]


def coalesce_pieces(pieces: list[dict], least: int = 200, most: int = 800) -> list[dict]:
    """Neighbours of one text are merged while either is under ``least`` tokens and both together within ``most``."""
    out: list[dict] = []
    for p in sorted(pieces, key=lambda p: (p["path"], p["start_line"])):
        last = out[-1] if out else None
        if last and last["path"] == p["path"] and p["start_line"] <= last["end_line"] + 1 and min(last["token_estimate"], p["token_estimate"]) < least and last["token_estimate"] + p["token_estimate"] <= most:
            own = _lines(last["content"])
            keep = last["content"] if p["start_line"] > last["end_line"] else "".join(own[: p["start_line"] - last["start_line"]])
            content = keep + p["content"]
            last |= {"end_line": p["end_line"], "content": content, "tags": sorted({*last["tags"], *p["tags"]}), "token_estimate": tokens(content), "priority": max(last["priority"], p["priority"])}
        else:
            out.append(dict(p))
    return out


def _placed(text: str, pieces: list[dict]) -> list[dict]:
    """The pieces with the bytes that their lines take in the text; none for pieces that are summaries or members of JSON."""
    ends = [0]
    for line in _lines(text):
        ends.append(ends[-1] + len(line.encode()))
    for p in pieces:
        real = p["end_line"] < len(ends) and not any(t.startswith(("json-", "json_")) for t in p["tags"])
        p["byte_start"], p["byte_end"] = (ends[p["start_line"] - 1], ends[p["end_line"]]) if real else (None, None)
    return pieces


def _splitter(most: int, overlap: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, text, priority in zip(*(batch.column(i).to_pylist() for i in range(4))):
                pieces = [{"path": path, "language": language, "start_line": a, "end_line": b, "content": p, "tags": t, "token_estimate": tokens(p), "priority": priority} for a, b, p, t in split_text(text, language or "", most, overlap)]
                rows += _placed(text, coalesce_pieces(pieces, least, most) if least else pieces)
            types = {"path": pa.string(), "language": pa.string(), "start_line": pa.int64(), "end_line": pa.int64(), "content": pa.string(), "tags": pa.list_(pa.string()), "token_estimate": pa.int64(), "priority": pa.float64(), "byte_start": pa.int64(), "byte_end": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in types.items()], list(types))

    return run


def split_files(files: DataFrame, path_col: str = "path", language_col: str = "language", text_col: str = "content", priority_col: str | None = None, most: int = 800, overlap: int = 120, least: int = 200) -> DataFrame:
    """The pieces of every text; ``least`` = 0 leaves small neighbours apart."""
    narrow = files.where(F.col(path_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(path_col).alias("path"), F.col(language_col).alias("language"), F.col(text_col).alias("content"), (F.col(priority_col) if priority_col else F.lit(0.5)).cast("double").alias("priority"))
    return spread(narrow).mapInArrow(_splitter(most, overlap, least), PIECE)


def enrich(pieces: DataFrame) -> DataFrame:
    """Adds identity, position in the file and fingerprints."""
    by_file = Window.partitionBy("path")
    return pieces.withColumns(
        {
            "id": chunk_id("path", "start_line", "end_line", "content"),
            "file_id": F.substring(F.sha2("path", 256), 1, 16),
            "content_sha256": F.sha2("content", 256),
            "chunk_index": (F.row_number().over(by_file.orderBy("start_line", "end_line", "content")) - 1).cast("bigint"),
            "chunks_in_file": F.count("*").over(by_file).cast("bigint"),
        }
    )


def sections_by_window(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, section, start_line, end_line, heading, content``: heading sections with built-in functions alone."""
    lines = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line", "text"))
    heading = F.col("text").rlike(r"^\s*#{1,6}[ \t]").cast("int")
    running = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("section", F.sum(heading).over(running) + F.when(F.first(heading).over(running) == 0, 1).otherwise(0))
    grouped = marked.groupBy("id", "section").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("rows"))
    first = F.element_at("rows", 1)["text"]
    return grouped.select(
        "id",
        F.col("section").cast("bigint").alias("section"),
        (F.col("a") + 1).cast("bigint").alias("start_line"),
        (F.col("b") + 1).cast("bigint").alias("end_line"),
        F.when(first.rlike(r"^\s*#{1,6}[ \t]"), F.substring(F.trim(F.regexp_replace(F.trim(first), r"^#+", "")), 1, 30)).alias("heading"),
        F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("content"),
    )


def line_offsets(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line, byte_start, byte_end`` of every line, without the line break."""
    lines = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line", "text"))
    before = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0))
    return lines.select("id", (F.col("line") + 1).cast("bigint").alias("line"), start.cast("bigint").alias("byte_start"), (start + F.octet_length("text")).cast("bigint").alias("byte_end"))


def fingerprint_config(config: dict) -> str:
    """Order of keys doesn't matter."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=sorted).encode()).hexdigest()


__all__ = ["coalesce_pieces", "code_sections", "enrich", "json_pieces", "line_offsets", "line_windows", "markdown_sections", "sections_by_window", "split_files", "split_text", "symbol_tag", "token_estimate"]
