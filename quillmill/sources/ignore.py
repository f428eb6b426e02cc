"""Which files a repository's ignore files hide: patterns of each folder, the last that fits decides, nearer folders later."""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    base: str  # folder of the ignore file, with its slash, or empty
    pattern: re.Pattern[str]
    keeps: bool
    only_folders: bool


def _translate(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif glob[i] == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += "[^/]*"
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def rules(text: str, base: str = "") -> list[Rule]:
    """The rules of one ignore file; lines that don't compile are left out."""
    found = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        line = line[keeps:]
        only_folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        line = line.removeprefix("/")
        try:
            found.append(Rule(base, re.compile(("" if anchored else "(?:[^/]+/)*") + _translate(line)), keeps, only_folders))
        except re.error:
            continue
    return found


def ignored(path: str, is_folder: bool, known: list[Rule]) -> bool:
    """Whether the rules hide a path; folders above it are looked at by the walk."""
    hidden = False
    for rule in known:
        if path.startswith(rule.base) and (is_folder or not rule.only_folders) and rule.pattern.fullmatch(path[len(rule.base) :]):
            hidden = not rule.keeps
    return hidden
