"""Change sets of a git repository as rows. The git binary runs on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from ..operators.impact import parse_patch

MOST_BYTES = 2 * 1024 * 1024


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", check=True).stdout


def changes(spark: SparkSession, root: str, base: str = "HEAD", head: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``path, status`` and ``path, side, line, text`` of what lies between two states; without ``head`` the working tree,
    files that git doesn't know yet included."""
    if head:
        if git(root, "status", "--porcelain").strip():
            raise ValueError("the working tree must be clean to compare two states")
        if git(root, "rev-parse", head).strip() != git(root, "rev-parse", "HEAD").strip():
            raise ValueError("the state to review must be checked out")
    files, lines = parse_patch(git(root, "diff", "--unified=3", "--no-renames", base, *([head] if head else [])))
    if not head:
        for path in git(root, "ls-files", "--others", "--exclude-standard").split("\n"):
            if path:
                files.append((path, "?"))
                text = content(root, path, None)
                lines += [(path, "new", i, x) for i, x in enumerate((text or "").split("\n"), 1)]
    return spark.createDataFrame(files, "path string, status string"), spark.createDataFrame(lines, "path string, side string, line bigint, text string")


def content(root: str, path: str, state: str | None) -> str | None:
    """A file's text in a state or the working tree; None for what is too large, binary or not there."""
    try:
        if state:
            raw = subprocess.run(["git", "-C", root, "show", f"{state}:{path}"], capture_output=True, check=True).stdout
        else:
            with open(f"{root}/{path}", "rb") as f:
                raw = f.read(MOST_BYTES + 1)
    except (OSError, subprocess.CalledProcessError):
        return None
    if len(raw) > MOST_BYTES or b"\0" in raw:
        return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
