"""Artifacts: chunks as JSON lines, a Markdown context pack, a JSON report, an impact pack."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, symbols_of


def json_line(evidence: bool = False) -> Column:
    """One chunk as JSON with its keys in alphabetical order; missing values have no key, a priority that is no number is null."""
    tags = F.array_sort(F.coalesce(F.col("tags"), F.array().cast("array<string>")))
    has = lambda t: F.array_contains(tags, t)
    priority = F.when(F.isnan("priority") | (F.abs("priority") == float("inf")), F.lit(None).cast("double")).otherwise(F.round("priority", 3))
    fields = {
        "byte_end": F.col("byte_end"), "byte_start": F.col("byte_start"), "chunk_hash": F.col("content_sha256"), "chunk_index": F.col("chunk_index"), "chunks_in_file": F.col("chunks_in_file"), "content": F.col("content"), "content_sha256": F.col("content_sha256"),
        "disposition": F.when(has("lock-file"), "included_summary_only").when(F.col("chunks_in_file") > 1, "included_chunked").otherwise("included_full"), "end_line": F.col("end_line"), "file_id": F.col("file_id"), "file_sha256": F.col("file_sha256"),
        "generated": has("generated"), "id": F.col("id"), "lang": F.col("language"), "lockfile": has("lock-file"), "minified": has("minified"), "path": F.col("file_path"), "priority": priority, "role": F.array_join(tags, ","),
        "start_line": F.col("start_line"), "symbols": symbols_of(tags), "tags": tags, "token_estimate": F.col("token_estimate"),
    }
    if evidence:
        fields["retrieval"] = F.struct(F.col("depth"), F.col("reasons"), F.round("score", 6).alias("score"))
    # What isn't known has no key, but a priority always has one.
    head, tail = ([c.alias(k) for k, c in sorted(fields.items()) if (k < "priority") == first and k != "priority"] for first in (True, False))
    known, rest = F.to_json(F.struct(*head)), F.to_json(F.struct(*tail))
    middle = F.concat(F.lit('"priority":'), F.coalesce(F.regexp_extract(F.to_json(F.struct(priority.alias("p"))), r":(.+)\}$", 1), F.lit("")))
    middle = F.when(priority.isNull(), F.lit('"priority":null')).otherwise(middle)
    inner = [F.nullif(F.substring(c, F.lit(2), F.length(c) - 2), F.lit("")) for c in (known, rest)]
    return F.concat(F.lit("{"), F.concat_ws(",", inner[0], middle, inner[1]), F.lit("}"))


def jsonl(chunks: DataFrame, evidence: bool = False) -> DataFrame:
    """``id, line``."""
    return chunks.select("id", json_line(evidence).alias("line"))


def write_jsonl(chunks: DataFrame, path: str, order: list[Column], evidence: bool = False) -> None:
    """Lines in one order over all part files: range-partitioned, so that no task holds them all."""
    chunks.orderBy(*order).select(json_line(evidence).alias("value")).write.mode("overwrite").text(path)


def escape_cell(c: Column | str) -> Column:
    """For a cell of a Markdown table."""
    return F.regexp_replace(F.regexp_replace(col(c), r"\|", r"\\|"), r"[\r\n]+", " ")


def fence(c: Column | str) -> Column:
    """A fence longer than any run of backticks in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(col(c), F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def inline(c: Column | str) -> Column:
    """A text as inline code: on one line, in more backticks than stand in it."""
    flat = F.regexp_replace(col(c), r"[\r\n]+", " ")
    runs = F.transform(F.regexp_extract_all(flat, F.lit("`+"), F.lit(0)), lambda r: F.length(r))
    mark = F.repeat(F.lit("`"), F.coalesce(F.array_max(runs), F.lit(0)) + 1)
    pad = F.when(flat.contains("`"), " ").otherwise("")
    return F.concat(mark, pad, flat, pad, mark)


_ORD = "struct<a:bigint,b:string,c:bigint,d:string>"
CATEGORIES = (("Entry points", "entrypoint"), ("Configuration", "config"), ("Tests", "test"), ("Workflows", "workflow"))


def _section(rows: DataFrame, number: int, order: Column, text: Column) -> DataFrame:
    return rows.select(F.lit(number).alias("section"), order.cast(_ORD).alias("ord"), text.alias("text"))


def _ord(a=0, b="", c=0, d="") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(a), lit(b), lit(c), lit(d))


def readme_excerpt(chunks: DataFrame, most_lines: int = 15, look: int = 50) -> DataFrame:
    """One row, ``text``: lines of the first readme's first chunk, without the blank lines and badges it begins with."""
    first = chunks.where(F.lower(F.substring_index("file_path", "/", -1)).startswith("readme")).orderBy(F.length("file_path"), "file_path", "start_line").limit(1)
    lines = F.slice(F.split("content", "\n"), 1, look)
    plain = lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^(\[?!\[|<img|<a |<p|<div)")
    begin = F.array_position(F.transform(lines, plain), True)
    return first.select(F.array_join(F.slice(lines, F.greatest(begin, F.lit(1)).cast("int"), most_lines), "\n").alias("text"))


def code_map(files: DataFrame, languages: int = 5, folders: int = 10, names: int = 10) -> DataFrame:
    """``language, folder, path`` of the commonest languages' folders and their first files: a map, cut as a map is."""
    from pyspark.sql import Window

    f = files.where("language IS NOT NULL").select("language", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), "path").distinct()
    per_language = f.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(languages)
    per_folder = f.join(F.broadcast(per_language), "language").groupBy("language", "folder").agg(F.count("*").alias("m"))
    top = per_folder.withColumn("r", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("m"), "folder"))).where(F.col("r") <= folders)
    inside = f.join(F.broadcast(top.select("language", "folder", "r")), ["language", "folder"])
    return inside.withColumn("k", F.row_number().over(Window.partitionBy("language", "folder").orderBy("path"))).where(F.col("k") <= names)


def context_pack(chunks: DataFrame, files: DataFrame, title: str, inventory: int = 200, task: str | None = None, scope: str | None = None) -> DataFrame:
    """``section, ord, text``: the parts of a Markdown pack; ordered by (section, ord) and joined by line breaks they are it.

    Columns: chunks id, file_path, language, start_line, end_line, content, priority, tags and, where a task was given, reasons;
    files path, language, size_bytes, priority, tags. Sections: task or focus, overview, readme, key files, code map, files,
    contents. Chunks that only serve retrieval are left out; overlaps are shown once; lists are cut as a pack's lists are.
    """
    from pyspark.sql import Window

    from .account import overlap_free

    spark = chunks.sparkSession
    if "tags" not in files.columns:
        files = files.withColumn("tags", F.lit(None).cast("array<string>"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    shown = chunks.where(~F.array_contains(tags, "rag-only"))
    free = overlap_free(shown).select("id", "first_line")
    body = shown.join(free, "id").withColumn("text", F.array_join(F.slice(F.split("content", "\n"), F.col("first_line") - F.col("start_line") + 1, F.greatest(F.lit(1), F.size(F.split("content", "\n")))), "\n"))
    language = F.coalesce("language", F.lit("?"))
    spoken = files.groupBy("language").agg(F.count("*").alias("n"))
    languages = _section(spoken.orderBy(F.desc("n"), "language").limit(5), 1, _ord(-F.col("n"), language), F.format_string("- %s: %d", language, "n"))
    excerpt = _section(readme_excerpt(chunks), 2, _ord(), F.concat(F.lit("## Readme\n\n"), F.col("text"), F.lit("\n")))
    ranked = []
    for i, (name, tag) in enumerate(CATEGORIES):
        f = files.where(F.array_contains(tags, tag)).orderBy(F.desc("priority"), "path").limit(5)
        ranked.append(_section(f, 3, _ord(i, F.col("path")), F.concat(F.lit(f"- {name}: "), inline("path"))))
    mapped = code_map(files)
    maps = _section(mapped, 4, _ord(0, F.concat_ws("/", "language", F.lpad("r", 3, "0")), F.col("k"), F.col("path")), F.concat(F.lit("- "), F.col("language"), F.lit(": "), inline("path")))
    listed = files.orderBy(F.desc("priority"), "path").limit(inventory)
    rows = _section(listed, 5, _ord(F.row_number().over(Window.orderBy(F.desc("priority"), "path"))), F.format_string("| %s | %s | %d |", escape_cell("path"), language, F.coalesce("size_bytes", F.lit(0))))
    why = F.when(F.size("reasons") > 0, F.concat(F.lit("reason: "), F.array_join("reasons", ", "), F.lit("\n\n"))).otherwise("") if "reasons" in chunks.columns else F.lit("")
    per_file = Window.partitionBy("file_path")
    placed = body.withColumn("_p", F.max(F.coalesce("priority", F.lit(0.0))).over(per_file))
    code = _section(placed, 6, _ord((-F.col("_p") * 1000).cast("bigint"), F.col("file_path"), F.col("first_line"), F.col("id")), F.concat(F.lit("### "), F.col("file_path"), F.format_string(" (%d-%d)\n\n", F.col("first_line"), F.col("end_line")), F.coalesce(why, F.lit("")), fence("text"), F.regexp_replace(F.coalesce("language", F.lit("")), "[^A-Za-z0-9+#-]", ""), F.lit("\n"), F.col("text"), F.lit("\n"), fence("text"), F.lit("\n")))
    head = [(0, f"# {title}\n")]
    if task:
        head.append((0, "Task: " + re.sub(r"[`\r\n]+", " ", task).strip() + "\n"))
    if scope:
        head.append((0, f"Focus: {scope}\n"))
    head += [(1, "## Overview\n"), (3, "\n## Key files\n"), (4, "\n## Code map\n"), (5, "\n## Files\n\n| path | language | bytes |\n|-|-|-|"), (6, "\n## Contents\n")]
    out = spark.createDataFrame(head, "section int, text string").select("section", F.lit(None).cast(_ORD).alias("ord"), "text")
    for p in (languages, excerpt, *ranked, maps, rows, code):
        out = out.union(p)
    return out


def pack_text(parts: DataFrame) -> str:
    """The pack as one text, for a sink on the driver; parts are streamed in order."""
    return "\n".join(r["text"] for r in parts.orderBy("section", F.col("ord").asc_nulls_first()).toLocalIterator())


def report(files: DataFrame, chunks: DataFrame, dispositions: DataFrame, config: dict) -> dict:
    """Figures of a run as one document; aggregates only reach the driver."""
    c = chunks.agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens")).first().asDict()
    languages = {r["language"] or "?": r["n"] for r in files.groupBy("language").agg(F.count("*").alias("n")).collect()}
    reasons = {r["reason"]: r["n"] for r in dispositions.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    safe = {k: re.sub(r"(://)[^/@\s]*@", r"\1", v) if isinstance(v, str) else v for k, v in config.items()}
    return {"schema_version": "1.5.0", "stats": c | {"languages_detected": dict(sorted(languages.items(), key=lambda x: (-x[1], x[0])))}, "dispositions": reasons, "config": safe}


def write_atomic(path: str, text: str) -> None:
    """A file that is either the old or the new one, whenever it is looked at."""
    import os
    import tempfile

    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder, prefix=".partial-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def report_text(value: dict) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"
