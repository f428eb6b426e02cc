"""What a change set touches: changed lines and symbols, related files, bounded lists with their truncation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from .graph import distances

MAX_FILES, MAX_LINES, MAX_SNIPPETS, MAX_SYMBOLS, MAX_NODES = 256, 256, 48, 2048, 512
CONFIG_NAMES = ("cargo.toml", "go.mod", "go.work", "package.json", "tsconfig.json", "pyproject.toml", "setup.cfg", "tox.ini", "makefile", "dockerfile", "project.godot", "justfile", "taskfile.yml", "taskfile.yaml")


def is_test_path(path: Column | str) -> Column:
    return F.lower(col(path)).rlike(r"(^|/)(tests?|specs?)(/|$)|_test\.|\.test\.|_spec\.|\.spec\.")


def is_config_path(path: Column | str) -> Column:
    low = F.lower(col(path))
    return F.substring_index(low, "/", -1).isin(*CONFIG_NAMES) | low.startswith(".github/workflows/")


def is_documentation_path(path: Column | str) -> Column:
    low = F.lower(col(path))
    return low.rlike(r"\.(md|rst|adoc)$") | low.startswith("docs/")


def touched_symbols(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Symbols (path, side, kind, name, start, end) with a changed line (path, side, line) within them; the last of a name stands.

    The two meet on path and side; each symbol is kept at most once (a semi-join), whatever the number of its lines.
    """
    l = lines.select("path", "side", "line")
    hit = symbols.join(l, (symbols["path"] == l["path"]) & (symbols["side"] == l["side"]) & l["line"].between(symbols["start"], symbols["end"]), "left_semi")
    last = Window.partitionBy("path", "side", "kind", "name").orderBy(F.desc("start"), F.desc("end"))
    return hit.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def symbol_changes(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """``path, kind, name, status`` and the spans of either side: a full outer join of the touched symbols of both sides."""
    t = touched_symbols(symbols, lines)
    side = lambda s: t.where(F.col("side") == s).select("path", "kind", "name", F.col("start").alias(f"{s}_start_line"), F.col("end").alias(f"{s}_end_line"))
    both = side("old").join(side("new"), ["path", "kind", "name"], "full_outer")
    status = F.when(F.col("old_start_line").isNull(), "added").when(F.col("new_start_line").isNull(), "removed").otherwise("changed")
    return both.withColumn("status", status)


def capped(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, and whether there were more: the cap is a feature of the report."""
    w = Window.partitionBy(*by)
    return rows.withColumns({"_n": F.row_number().over(w.orderBy(*order)), "_all": F.count("*").over(w)}).where(F.col("_n") <= most).withColumn("truncated", F.col("_all") > most).drop("_n", "_all")


def related_files(changed: DataFrame, edges: DataFrame, most: int = 128, hops: int = 8) -> DataFrame:
    """``path, relation, distance`` of files that the changed ones (path) reach or are reached from; tests that import a
    changed file are its tests. The nearest of each (path, relation) stands; the list is cut by path and relation."""
    starts = changed.select(F.col("path").alias("node")).distinct()
    out = distances(starts, edges, hops, MAX_NODES).select(F.col("node").alias("path"), F.lit("dependency").alias("relation"), "distance")
    back = distances(starts, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), hops, MAX_NODES)
    back = back.select(F.col("node").alias("path"), F.when(is_test_path("node"), "test").otherwise("caller").alias("relation"), "distance")
    both = out.union(back).join(changed.select("path").distinct(), "path", "left_anti")
    return both.groupBy("path", "relation").agg(F.min("distance").alias("distance")).orderBy("path", "relation").limit(most)


def mentions(documents: DataFrame, names: list[str], id_col: str, text_col: str, first_bytes: int = 65536) -> DataFrame:
    """``id, name`` of the documents whose text holds a name, letter case aside; the names are a bounded list."""
    low = F.lower(F.col(text_col))
    found = F.filter(F.array(*[F.lit(n.lower()) for n in names]), lambda n: F.instr(low, n) > 0) if names else F.array().cast("array<string>")
    return documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(found).alias("name"))


def delta_status(letter: Column | str) -> Column:
    c = col(letter)
    return F.when(c.isin("A", "?"), "added").when(c == "D", "deleted").when(c == "R", "renamed").when(c == "C", "copied").when(c == "T", "type_changed").otherwise("modified")


def summarise(files: DataFrame, symbols: DataFrame, related: DataFrame) -> DataFrame:
    f = files.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "deleted").alias("deleted"))
    s = symbols.agg(F.count("*").alias("symbols"))
    r = related.agg(F.count("*").alias("related"), F.count_if(F.col("relation") == "test").alias("tests"))
    return f.crossJoin(s).crossJoin(r)


_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_patch(patch: str) -> tuple[list[tuple[str, str]], list[tuple[str, str, int, str]]]:
    """(path, status) and (path, side, line, text) rows of a unified patch."""
    files, lines = [], []
    old = new = ""
    status, o, n = "M", 0, 0
    for line in patch.split("\n"):
        if line.startswith("diff --git "):
            status = "M"
        elif line.startswith("new file"):
            status = "A"
        elif line.startswith("deleted file"):
            status = "D"
        elif line.startswith("--- "):
            old = line[4:].removeprefix("a/")
        elif line.startswith("+++ "):
            new = line[4:].removeprefix("b/")
            files.append((old if status == "D" else new, status))
        elif m := _HUNK.match(line):
            o, n = int(m[1]), int(m[3])
        elif line.startswith("-") and files:
            lines.append((files[-1][0], "old", o, line[1:]))
            o += 1
        elif line.startswith("+") and files:
            lines.append((files[-1][0], "new", n, line[1:]))
            n += 1
        elif line.startswith(" "):
            o, n = o + 1, n + 1
    return files, lines
