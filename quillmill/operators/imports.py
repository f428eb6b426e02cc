"""What a source file imports, read from its tokens: a small lexer for each family of languages, then the statement's grammar."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, text (a literal's content), mark, line
    value: str


_LINE_COMMENT = {"python": "#[^\n]*", "c": "//[^\n]*|/\\*(?s:.*?)\\*/"}
_LITERAL = {
    "python": "(?P<raw>[rbuRBU]{0,2}(?:\"\"\"(?s:.*?)\"\"\"|'''(?s:.*?)'''|\"(?:[^\"\\\\\n]|\\\\.)*\"|'(?:[^'\\\\\n]|\\\\.)*'))",
    "c": "(?P<raw>\"(?:[^\"\\\\\n]|\\\\.)*\"|'(?:[^'\\\\\n]|\\\\.)*'|`(?:[^`\\\\]|\\\\.)*`)",
    "rust": "(?P<raw>\"(?:[^\"\\\\]|\\\\.)*\")",
}
_LEXERS = {
    family: re.compile(f"(?:{_LINE_COMMENT['python' if family == 'python' else 'c']})|{literal}|(?P<name>[^\\W\\d][\\w$]*)|(?P<line>\\\\?\n)|(?P<mark>[^\\s\\w])", re.S if family == "c" else 0)
    for family, literal in _LITERAL.items()
}


def tokens(text: str, family: str) -> list[Token]:
    """Names, literals, marks and line breaks in order; comments, numbers and blanks are left out."""
    out = []
    for m in _LEXERS[family].finditer(text):
        kind = m.lastgroup
        if kind == "raw":
            body = m["raw"].lstrip("rbuRBU")
            quote = 3 if body[:3] in ('"""', "'''") else 1
            out.append(Token("text", body[quote:-quote]))
        elif kind and not (kind == "line" and m.group()[0] == "\\"):
            out.append(Token(kind, m.group()))
    return out


class Reader:
    """A place in a list of tokens."""

    def __init__(self, items: list[Token]) -> None:
        self.items, self.at = items, 0

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.items[i] if i < len(self.items) else Token("end", "")

    def take(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def takes(self, value: str) -> bool:
        if self.peek().value == value and self.peek().kind != "text":
            self.at += 1
            return True
        return False

    def skip_lines(self) -> None:
        while self.peek().kind == "line":
            self.at += 1


class _Scripts(HTMLParser):
    """Bodies of the script elements of a component."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.bodies: list[str] = []
        self.inside = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "script":
            self.inside = True
            self.bodies.append("")

    def handle_endtag(self, tag: str) -> None:
        self.inside = self.inside and tag != "script"

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.bodies[-1] += data


def scripts(text: str) -> list[str]:
    parser = _Scripts()
    parser.feed(text)
    parser.close()
    return parser.bodies


def script_modules(text: str) -> list[str]:
    """Modules that a script names: import and export declarations, dynamic imports and calls of require."""
    out: dict[str, None] = {}
    r = Reader([t for t in tokens(text, "c") if t.kind != "line"])
    while (t := r.take()).kind != "end":
        if t.kind != "name" or r.at > 1 and r.items[r.at - 2].value == ".":
            continue
        if t.value in ("import", "require") and r.peek().value == "(" and r.peek(1).kind == "text":
            out[r.peek(1).value] = None
        elif t.value == "import" and r.peek().kind == "text":
            out[r.take().value] = None
        elif t.value == "import" and (r.peek().kind == "name" or r.peek().value in ("{", "*")) or t.value == "export" and r.peek().value in ("{", "*", "type"):
            # The clause ends at its source; a declaration without one at whatever can't stand in a clause.
            ahead = 0
            while (n := r.peek(ahead)).kind in ("name", "mark") and not (n.kind == "mark" and n.value not in "{},*"):
                if n.value == "from" and r.peek(ahead + 1).kind == "text":
                    out[r.peek(ahead + 1).value] = None
                    break
                ahead += 1
    return list(out)


def python_modules(text: str) -> list[tuple[str, list[str]]]:
    """(module with its leading dots, names taken from it or an empty list) for each import statement."""
    out = []
    r = Reader(tokens(text, "python"))
    begins = True  # of a statement
    while (t := r.take()).kind != "end":
        if begins and t.kind == "name" and t.value == "import":
            while True:
                if module := _dotted(r):
                    out.append((module, []))
                _alias(r)
                if not r.takes(","):
                    break
        elif begins and t.kind == "name" and t.value == "from":
            module = _dotted(r)
            if module and r.takes("import"):
                names, wrapped = [], r.takes("(")
                while True:
                    if wrapped:
                        r.skip_lines()
                    if r.peek().kind != "name" and r.peek().value != "*":
                        break
                    names.append(r.take().value)
                    _alias(r)
                    if wrapped:
                        r.skip_lines()
                    if not r.takes(","):
                        break
                out.append((module, names))
        begins = r.at == 0 or r.items[min(r.at, len(r.items)) - 1].kind == "line" or r.items[min(r.at, len(r.items)) - 1].value in (";", ":")
    return out


def _dotted(r: Reader) -> str:
    out = ""
    while r.peek().value == "." and r.peek().kind == "mark":
        out += r.take().value
    while r.peek().kind == "name" and r.peek().value not in ("import", "as"):
        out += r.take().value
        if r.peek().value == "." and r.peek(1).kind == "name":
            out += r.take().value
        else:
            break
    return out


def _alias(r: Reader) -> None:
    if r.takes("as"):
        r.take()


def rust_items(text: str) -> tuple[list[tuple[str, str | None]], list[list[str]]]:
    """Modules declared in other files as (name, path given by an attribute), without those only built for tests; and the
    paths of use declarations that begin in this crate, groups written out."""
    modules, uses = [], []
    r = Reader([t for t in tokens(text, "rust") if t.kind != "line"])
    attributes: list[list[Token]] = []
    while (t := r.take()).kind != "end":
        if t.value == "#" and r.takes("["):
            depth, body = 1, []
            while depth and r.peek().kind != "end":
                n = r.take()
                depth += (n.value == "[") - (n.value == "]") if n.kind == "mark" else 0
                body.append(n)
            attributes.append(body[:-1])
            continue
        if t.value == "pub":
            if r.takes("("):
                while r.peek().kind != "end" and not r.takes(")"):
                    r.take()
            continue
        if t.kind == "name" and t.value == "mod" and r.peek().kind == "name" and r.peek(1).value == ";":
            said = [[x.value for x in a] for a in attributes]
            if ["cfg", "(", "test", ")"] not in said:
                modules.append((r.peek().value, next((a[2] for a in said if a[:2] == ["path", "="] and len(a) == 3), None)))
        elif t.kind == "name" and t.value == "use" and r.peek().value in ("crate", "self", "super"):
            uses += _use_tree(r)
        attributes = []
    return modules, uses


def _use_tree(r: Reader) -> list[list[str]]:
    """The paths of one tree: a name, then nothing, an alias, or ``::`` with a tree or a group of trees."""
    if r.takes("{"):
        out = []
        while r.peek().kind != "end" and not r.takes("}"):
            out += _use_tree(r)
            r.takes(",")
        return out
    head = r.take().value
    if r.peek().value == ":" and r.peek(1).value == ":":
        r.at += 2
        return [[head, *rest] for rest in _use_tree(r)]
    _alias(r)
    return [[head]]


def go_packages(text: str) -> list[str]:
    """Paths of the packages of a file's import declarations, which stand before everything else but the package clause."""
    out = []
    r = Reader(tokens(text, "c"))
    while (t := r.take()).kind != "end":
        if t.kind == "line" or t.value == ";":
            continue
        if t.value == "package":
            r.take()
        elif t.value == "import":
            group = r.takes("(")
            while r.peek().kind != "end":
                n = r.take()
                if n.kind == "text":
                    out.append(n.value)
                if n.value == ")" or not group and n.kind in ("text", "line"):
                    break
        else:
            break
    return out


def engine_paths(text: str) -> list[str]:
    """Paths within the project that literals of a scene, resource or script name."""
    return list(dict.fromkeys(t.value.removeprefix("res://") for t in tokens(text, "python") if t.kind == "text" and t.value.startswith("res://")))


SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".svelte")
_ENGINE = ("gdscript", "godot_scene", "godot_resource", "godot_project", "godot_shader")


def candidates(path: str, language: str, text: str) -> Iterator[list[str]]:
    """For each import the paths it may mean, likeliest first, relative to the repository's root."""
    here = posixpath.dirname(path)
    if language in ("javascript", "typescript", "svelte", "vue"):
        bodies = scripts(text) if language in ("svelte", "vue") else [text]
        for module in dict.fromkeys(m for body in bodies for m in script_modules(body)):
            if module.startswith("."):
                base = posixpath.normpath(posixpath.join(here, module))
                index = [f"{base}/index{e}" for e in SCRIPT_ENDINGS[:4]]
                yield [base, *index] if posixpath.splitext(base)[1] else [base + e for e in SCRIPT_ENDINGS] + index
    elif language == "python":
        named = dict.fromkeys(m for module, names in python_modules(text) for m in (module, *(module + ("" if module.endswith(".") else ".") + n for n in names)))
        for module in named:
            dots = len(module) - len(module.lstrip("."))
            inner = module[dots:].replace(".", "/")
            folders = here.split("/") if here else []
            bases = ["/".join(folders[: max(0, len(folders) - dots + 1)])] if dots else ["/".join(folders[:i]) for i in range(len(folders) + 1)]
            roots = [posixpath.join(b, inner) if inner else b for b in bases]
            yield [x for root in roots for x in (f"{root}.py", f"{root}/__init__.py")]
    elif language == "rust":
        stem = posixpath.splitext(posixpath.basename(path))[0]
        inner = here if stem in ("mod", "lib", "main") else posixpath.join(here, stem)
        modules, uses = rust_items(text)
        for name, given in modules:
            yield [posixpath.normpath(posixpath.join(here, given))] if given else [f"{inner}/{name}.rs", f"{inner}/{name}/mod.rs"]
        parts = path.split("/")
        root = "/".join(parts[: parts.index("src") + 1]) if "src" in parts else here
        for head, *names in uses:
            base = {"crate": root, "self": inner, "super": posixpath.dirname(inner)}.get(head, root)
            while names and names[0] == "super":
                base, names = posixpath.dirname(base), names[1:]
            names = [n for n in names if n != "*"]
            tries = [x for k in range(len(names), 0, -1) for at in [posixpath.join(base, *names[:k])] for x in (f"{at}.rs", f"{at}/mod.rs")]
            if tries:
                yield tries
    elif language in _ENGINE:
        yield from ([p] for p in engine_paths(text))
