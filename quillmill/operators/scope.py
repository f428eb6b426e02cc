"""Entry points, workspaces, style sheets, trees and candidates for a focus."""

from __future__ import annotations

import json
import posixpath
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, col

#: Entry files that import style sheets, and where these usually lie. Fixed values.
STYLE_ENTRIES = ("app.tsx", "app.ts", "entry-client.tsx", "entry-client.ts", "index.tsx", "index.ts", "main.tsx", "main.ts")
STYLE_PATHS = ("src/styles.css", "src/index.css", "src/main.css", "styles.css", "index.css")
MOST_FILE_CANDIDATES = 45


def manifest_entrypoints(manifests: dict[str, str], paths: list[str] | None = None) -> tuple[str, ...]:
    """Entry points that the root manifests name: scripts, mains and binaries, commands, workspace members, main scene."""
    out: set[str] = set()
    norm = lambda p: posixpath.normpath(p.replace("\\", "/").removeprefix("res://"))
    if text := manifests.get("pyproject.toml"):
        try:
            scripts = tomllib.loads(text).get("project", {}).get("scripts", {})
        except tomllib.TOMLDecodeError:
            scripts = {}
        for target in scripts.values():
            module = str(target).split(":")[0]
            if "." in module:
                out |= {module.replace(".", "/") + ".py", module.replace(".", "/") + "/__init__.py"}
    if text := manifests.get("package.json"):
        try:
            package = json.loads(text)
        except ValueError:
            package = {}
        named = [package.get(k) for k in ("main", "module", "types")]
        bins = package.get("bin")
        named += [bins] if isinstance(bins, str) else list(bins.values()) if isinstance(bins, dict) else []
        out |= {norm(n) for n in named if isinstance(n, str)}
    if "go.mod" in manifests:
        out |= {p for p in paths or [] if re.fullmatch(r"(?:cmd/[^/]+/)?main\.go", p)}
    if text := manifests.get("Cargo.toml"):
        out |= {root for root in crate_roots(workspace(manifests), paths or [])}
    if text := manifests.get("project.godot"):
        from .engine import parse_project

        if scene := parse_project(text)["main_scene"]:
            out.add(norm(scene))
    return tuple(sorted(out))


def workspace(manifests: dict[str, str]) -> list[dict]:
    """``name, root, path_deps`` of every crate whose Cargo.toml is given by path."""
    out = []
    for path, text in sorted(manifests.items()):
        if posixpath.basename(path) != "Cargo.toml":
            continue
        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            continue
        root = posixpath.dirname(path)
        if "package" in data:
            deps = {k: v for table in ("dependencies", "dev-dependencies", "build-dependencies") for k, v in data.get(table, {}).items()}
            local = sorted(posixpath.normpath(posixpath.join(root, v["path"])) for v in deps.values() if isinstance(v, dict) and isinstance(v.get("path"), str))
            out.append({"name": data["package"].get("name", root), "root": root, "path_deps": local})
    return out


def crate_roots(crates: list[dict], paths: list[str]) -> list[str]:
    known = set(paths)
    return sorted(p for c in crates for p in known if re.fullmatch(re.escape(c["root"] + "/" if c["root"] else "") + r"src/(?:(?:lib|main)\.rs|bin/(?:[^/]+\.rs|[^/]+/main\.rs))", p))


def is_crate_root(path: Column | str) -> Column:
    return col(path).rlike(r"(^|/)src/(lib|main)\.rs$|(^|/)src/bin/([^/]+\.rs|[^/]+/main\.rs)$")


def lock_summary(path: Column | str, size: Column | str) -> Column:
    """What stands for a lock file's text."""
    return F.format_string("# Lock file summary\n# Path: %s\n# Size: %s bytes\n", col(path), F.format_number(col(size), 0))


# ---- style sheets ----------------------------------------------------------------------------------------------------

_ATTRIBUTES = ("class", "className")


def _attribute_values(text: str) -> Iterator[tuple[str, bool]]:
    """(value, whether it is a template) of each class attribute: a quoted value, or a literal in braces."""
    n, at = len(text), 0
    while (at := text.find("class", at)) >= 0:
        end = at
        while end < n and (text[end].isalnum() or text[end] in "_-$:"):
            end += 1
        name, begins = text[at:end], at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "_-$.:")
        at = end
        end = _past_blanks(text, end)
        if name not in _ATTRIBUTES or not begins or text[end : end + 1] != "=":
            continue
        end = _past_blanks(text, end + 1)
        braced = text[end : end + 1] == "{"
        if braced:
            end = _past_blanks(text, end + 1)
        quote = text[end : end + 1]
        if quote not in ('"', "'", "`") or quote == "`" and not braced or quote == "'" and not braced:
            continue
        close = text.find(quote, end + 1)
        if close > end + 1 and (not braced or text[_past_blanks(text, close + 1) :][:1] == "}"):
            yield text[end + 1 : close], quote == "`"
            at = close + 1


def _past_blanks(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _template_words(value: str) -> Iterator[str]:
    """Words of a template's fixed text; of a word that goes on with a value, its beginning up to the hyphen before it."""
    fixed, at = "", 0
    while (hole := value.find("${", at)) >= 0 and (close := value.find("}", hole)) > hole:
        piece = value[at:hole]
        tail = piece[len(piece.rstrip(_NAME_SIGNS)) :]
        if tail.endswith("-"):
            yield tail
        fixed, at = fixed + piece + " ", close + 1
    yield from (fixed + value[at:]).split()


_NAME_SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"


def class_names(text: str) -> set[str]:
    """Class names of a component, and the fixed beginnings of those put together at run time."""
    out: set[str] = set()
    for value, template in _attribute_values(text):
        for word in _template_words(value) if template else value.split():
            while word and not (word[0].isalnum() or word[0] in "_-"):
                word = word[1:]
            while word and not (word[-1].isalnum() or word[-1] in "_-"):
                word = word[:-1]
            if word:
                out.add(word)
    return out


def style_blocks(css: str) -> list[tuple[str, str]]:
    """(selector, body) of the blocks of the outermost level."""
    out, start, depth, opened = [], 0, 0, 0
    for i, c in enumerate(css):
        if c == "{":
            if depth == 0:
                opened = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                if selector := css[start:opened].strip():
                    out.append((selector, css[opened + 1 : i]))
                start = i + 1
    return out


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = sorted({n for t in batch.column(0).to_pylist() for n in class_names(t)})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p, i, s, b, w) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, (s, b) in enumerate(style_blocks(t)) for w in sorted(set(re.findall(r"[A-Za-z0-9_-]+", s)))]
        types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["path", "block", "selector", "body", "word"])


def scoped_styles(styles: DataFrame, components: DataFrame) -> DataFrame:
    """``path, content``: each style sheet with only the blocks whose selector names a class of the components.

    Selectors and class names meet word by word in an equi-join; names put together at run time match by their beginning.
    """
    names = components.where("content IS NOT NULL").select("content").mapInArrow(_class_rows, "name string").distinct()
    blocks = styles.where("content IS NOT NULL").select("path", "content").mapInArrow(_block_rows, "path string, block bigint, selector string, body string, word string")
    whole = blocks.join(names, blocks["word"] == names["name"], "left_semi")
    heads = blocks.withColumn("head", F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", i, F.lit(1)) == "-"), lambda i: F.substring("word", F.lit(1), i))))
    begun = heads.join(names, heads["head"] == names["name"], "left_semi").select(*blocks.columns)
    kept = whole.union(begun).select("path", "block", "selector", "body").distinct()
    text = F.transform(F.array_sort(F.collect_list(F.struct("block", "selector", "body"))), lambda b: F.concat(b["selector"], F.lit(" {"), b["body"], F.lit("}\n\n")))
    return kept.groupBy("path").agg(F.array_join(text, "").alias("content"))


def style_files(files: DataFrame) -> DataFrame:
    """``path`` of the style sheets that entry files import, and of those in the usual places."""
    css = files.where(F.lower(F.col("path")).endswith(".css")).select("path")
    entries = files.where(base_name("path").isin(*STYLE_ENTRIES) & F.col("content").isNotNull())
    spec = entries.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"import\s+['\"](\.[^'\"]+\.css)['\"]"), F.lit(1))).alias("spec"))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    joined = F.concat(folder, F.regexp_replace("spec", r"^\./", ""))
    for _ in range(4):  # a/../b
        joined = F.regexp_replace(joined, r"(^|/)[^/.][^/]*/\.\./", "$1")
    imported = css.join(spec.select(joined.alias("path")).distinct(), "path", "left_semi")
    return imported.union(css.where(F.col("path").isin(*STYLE_PATHS))).distinct()


# ---- trees and candidates --------------------------------------------------------------------------------------------


def tree_rows(files: DataFrame, depth: int = 4) -> DataFrame:
    """``path, level, is_dir, files``: every folder and file to a depth, in the order of a tree when sorted by ``sort_key``."""
    parts = files.select(F.split("path", "/").alias("p")).distinct()
    levels = parts.select("p", F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size("p")))).alias("level"))
    rows = levels.select(F.array_join(F.slice("p", 1, F.col("level")), "/").alias("path"), F.col("level").cast("bigint").alias("level"), (F.col("level") < F.size("p")).alias("is_dir"))
    grouped = rows.groupBy("path", "level").agg(F.max("is_dir").alias("is_dir"), F.count("*").alias("files"))
    # Folders before files at every level.
    key = F.concat(F.regexp_replace(F.regexp_replace("path", r"[^/]*$", ""), r"([^/]+)/", "0$1/"), F.when(F.col("is_dir"), "0").otherwise("1"), base_name("path"))
    return grouped.withColumn("sort_key", key)


def focus_candidates(files: DataFrame, edges: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """``path, kind, imports, used_by``: single files where there are few sources, else folders of two or more sources."""
    sources = files.where(F.col("language").isin(*languages)).select("path").distinct()
    out = edges.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("imports"))
    into = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("used_by"))
    if sources.limit(MOST_FILE_CANDIDATES + 1).count() <= MOST_FILE_CANDIDATES:
        rows = sources.join(out, "path", "left").join(into, "path", "left")
        return rows.select("path", F.lit("file").alias("kind"), F.coalesce("imports", F.lit(0)).alias("imports"), F.coalesce("used_by", F.lit(0)).alias("used_by"))
    folders = sources.withColumn("folder", F.regexp_replace("path", r"/?[^/]*$", "")).join(out, "path", "left").join(into, "path", "left")
    grouped = folders.groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.coalesce("imports", F.lit(0))).alias("imports"), F.sum(F.coalesce("used_by", F.lit(0))).alias("used_by"))
    return grouped.where("n >= 2").select(F.col("folder").alias("path"), F.lit("module").alias("kind"), "imports", "used_by")
