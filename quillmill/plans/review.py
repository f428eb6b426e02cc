"""What a change set touches, as one report: changed files with their symbols, related files, and documents that speak of them."""

from __future__ import annotations

import ast
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, impact, redact
from ..operators.render import report_text
from ..session import checkpointed
from ..sources import git
from ..sources.config import Config

#: (beginning of a line, kind) of what languages define, at any depth. Fixed values.
_KINDS = (
    (re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+|public\s+|private\s+|protected\s+|static\s+|final\s+)*(?:class|interface)\s+([\w$]+)"), "class"),
    (re.compile(r"\s*(?:pub(?:\([a-z]+\))?\s+)?(?:struct|enum|trait|union)\s+(\w+)|\s*type\s+(\w+)"), "type"),
    (re.compile(r"\s*impl(?:\s*<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?([\w:]+)"), "impl"),
    (re.compile(r"\s*(?:pub(?:\([a-z]+\))?\s+)?mod\s+(\w+)"), "module"),
    (re.compile(r"func\s+\([^)]*\)\s*(\w+)"), "method"),
    (re.compile(r"\s*(?:export\s+)?(?:default\s+)?(?:pub(?:\([a-z]+\))?\s+)?(?:const\s+|unsafe\s+|async\s+)*(?:fn|func|function)\s*\*?\s+(\w+)"), "function"),
    (re.compile(r"\s*(?:public|private|protected|static|final|synchronized|\s)+[\w<>\[\],. ]+\s+(\w+)\s*\([^;]*$"), "method"),
    (re.compile(r"\s*(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|[\w$]+\s*=>)"), "function"),
)
_CODE = (".js", ".mjs", ".jsx", ".ts", ".tsx", ".go", ".rs", ".java", ".c", ".h")


def symbol_spans(path: str, text: str, most: int = impact.MAX_SYMBOLS) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of what a source defines at any depth, in order; ``most`` is a bound of the report."""
    out: list[tuple[str, str, int, int]] = []
    if path.endswith(".py"):
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []
        queue: list[tuple[ast.AST, bool]] = [(tree, False)]
        while queue:
            node, in_class = queue.pop()
            for child in ast.iter_child_nodes(node):
                is_class = isinstance(child, ast.ClassDef)
                if is_class or isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    out.append(("class" if is_class else "method" if in_class else "function", child.name, child.lineno, child.end_lineno))
                queue.append((child, is_class))
    elif path.endswith(".gd"):
        lines = text.split("\n")
        begins = [(i, m) for i, line in enumerate(lines, 1) if (m := re.match(r"(?:static\s+)?(func|class|class_name|signal|enum|const|var)\s+(\w+)", line))]
        kinds = {"func": "function", "class": "class", "class_name": "class", "enum": "type"}
        for (i, m), after in zip(begins, [*(b[0] for b in begins[1:]), len(lines) + 1]):
            out.append((kinds.get(m[1], "binding"), m[2], i, after - 1))
    elif path.endswith(_CODE):
        lines = text.split("\n")
        open_at: list[tuple[int, int]] = []  # (index in out, depth at which it was opened)
        depth = 0
        for i, line in enumerate(lines, 1):
            bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|//.*", "", line)
            for pattern, kind in _KINDS:
                if m := pattern.match(line):
                    out.append((kind, next(g for g in m.groups() if g), i, i))
                    open_at.append((len(out) - 1, depth))
                    break
            depth += bare.count("{") - bare.count("}")
            while open_at and (depth <= open_at[-1][1] and ("}" in bare or ";" in bare)):
                k, _ = open_at.pop()
                out[k] = (*out[k][:3], i)
        for k, _ in open_at:
            out[k] = (*out[k][:3], len(lines))
    return sorted(out, key=lambda s: (s[2], s[0], s[1]))[:most]


def review(spark: SparkSession, root: str, base: str = "HEAD", head: str | None = None, most_related: int = 128, redacted: bool = True) -> dict:
    """The impact report between two states of a repository, or of its working tree against one."""
    from .export import scan

    files, lines = git.changes(spark, root, base, head)
    files = checkpointed(files.withColumn("status", impact.delta_status("status")))
    lines = checkpointed(lines)
    changed = [r.asDict() for r in files.orderBy("path").limit(impact.MAX_FILES).collect()]
    spans = []
    for c in changed:  # bounded by MAX_FILES
        for side, state in (("old", base), ("new", head)):
            text = git.content(root, c["path"], state)
            spans += [(c["path"], side, kind, name, a, b) for kind, name, a, b in (symbol_spans(c["path"], text) if text else [])]
    symbols = checkpointed(impact.symbol_changes(spark.createDataFrame(spans, "path string, side string, kind string, name string, start bigint, end bigint"), lines))
    corpus = checkpointed(scan(spark, root, Config()).where("reason = 'included_full'"))
    related = checkpointed(impact.related_files(files, graph.import_edges(corpus), most_related))
    mentioned = mentions_of_changes(corpus.where(impact.is_documentation_path("path")), files, symbols).orderBy("path", "name").limit(most_related)
    shown = impact.capped(lines, ["path"], [F.desc("side"), F.asc("line")], impact.MAX_LINES)
    clean = redact.Redactor().redact if redacted else lambda text: (text, {}, [])
    per_file: dict[str, dict] = {c["path"]: c | {"lines": [], "symbols": [], "lines_truncated": False} for c in changed}
    for r in shown.join(files.select("path").orderBy("path").limit(impact.MAX_FILES), "path", "left_semi").orderBy("path", F.desc("side"), "line").collect():
        f = per_file[r["path"]]
        f["lines"].append({"side": r["side"], "line": r["line"], "text": clean(r["text"])[0]})
        f["lines_truncated"] = r["truncated"]
    for r in symbols.orderBy("path", "kind", "name").limit(impact.MAX_SYMBOLS).collect():
        if r["path"] in per_file:
            per_file[r["path"]]["symbols"].append({k: r[k] for k in ("kind", "name", "status")})
    kinds = files.select("path", F.when(impact.is_test_path("path"), "test").when(impact.is_config_path("path"), "config").when(impact.is_documentation_path("path"), "documentation").otherwise("source").alias("kind"))
    for r in kinds.collect() if len(changed) < impact.MAX_FILES else ():
        per_file[r["path"]]["kind"] = r["kind"]
    summary = impact.summarise(files, symbols, related).first().asDict()
    return {
        "schema_version": "1.0.0", "base": base, "head": head, "summary": summary, "files_truncated": files.count() > impact.MAX_FILES, "changed_files": list(per_file.values()),
        "related_files": [r.asDict() for r in related.orderBy("path", "relation").collect()], "mentions": [r.asDict() for r in mentioned.collect()],
    }


def mentions_of_changes(documents: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``path, name, relation`` of documents whose text holds a changed path, the stem of one, or a changed symbol as a word.

    Texts are cut to words where they lie; words and names meet in an equi-join, paths by their last part first.
    """
    d = documents.where("content IS NOT NULL").select(F.col("path"), F.lower("content").alias("text"))
    words = d.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\w./$-]*[\w$]"), F.lit(0)))).alias("word"))
    last = F.substring_index("word", "/", -1)
    words = words.select("path", "word", last.alias("last"), F.regexp_replace(last, r"\.[^.]*$", "").alias("stem"))
    changed = files.select(F.lower("path").alias("name")).distinct()
    base = F.substring_index("name", "/", -1)
    by_path = words.join(changed.select("name", base.alias("last")), "last").where(F.expr("endswith(word, name) OR endswith(name, word)")).select("path", F.col("name"), F.lit("path").alias("relation"))
    stems = changed.select("name", F.regexp_replace(base, r"\.[^.]*$", "").alias("stem")).where(F.length("stem") >= 3)
    by_stem = words.join(stems, "stem").select("path", F.col("stem").alias("name"), F.lit("stem").alias("relation"))
    named = symbols.select(F.lower("name").alias("word")).distinct().where(F.length("word") >= 3)
    by_symbol = words.join(named, "word").select("path", F.col("word").alias("name"), F.lit("symbol").alias("relation"))
    return by_path.union(by_stem).union(by_symbol).distinct().join(files.select("path"), "path", "left_anti")


def impact_text(report: dict) -> str:
    """The report for people."""
    s = report["summary"]
    out = [f"Impact of {report['base']}..{report['head'] or 'working tree'}", f"{s['files']} files changed, {s['added']} added, {s['deleted']} deleted; {s['symbols']} symbols; {s['related']} related files, {s['tests']} of them tests", ""]
    for f in report["changed_files"]:
        out.append(f"{f['status']}: {f['path']}")
        out += [f"  {x['status']} {x['kind']} {x['name']}" for x in f["symbols"]]
        if f["lines_truncated"]:
            out.append("  (more lines changed than are listed)")
    for title, rows, line in (("Related files", report["related_files"], lambda r: f"  {r['relation']} at {r['distance']}: {r['path']}"), ("Mentions", report["mentions"], lambda r: f"  {r['path']}: {r['name']} ({r['relation']})")):
        if rows:
            out += ["", title, *map(line, rows)]
    return "\n".join(out) + "\n"


def impact_json(report: dict) -> str:
    return report_text(json.loads(json.dumps(report, default=str)))
