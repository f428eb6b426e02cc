"""Configuration: defaults, a TOML file, arguments; what a fetched repository may set of its own."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

SECTIONS = ("quillmill",)
FILE_NAMES = ("quillmill.toml", ".quillmill.toml", "pyproject.toml")
#: What the configuration of a fetched repository may set. Fixed values.
SAFE = frozenset({"exclude_globs", "max_file_bytes", "max_total_bytes", "max_tokens", "chunk_tokens", "tree_depth"})


@dataclass(frozen=True)
class Config:
    include_extensions: tuple[str, ...] = (".py", ".js", ".mjs", ".ts", ".tsx", ".go", ".rs", ".java", ".c", ".h", ".md", ".json", ".toml", ".yaml", ".yml", ".txt", ".sql", ".css")
    exclude_globs: tuple[str, ...] = ("node_modules/**", "dist/**", "build/**")
    max_file_bytes: int = 1_048_576
    max_total_bytes: int = 20_000_000
    max_tokens: int | None = None
    chunk_tokens: int = 800
    chunk_overlap: int = 120
    min_chunk_tokens: int = 200
    redaction_mode: str = "standard"
    follow_symlinks: bool = False
    include_minified: bool = False
    tree_depth: int = 4
    use_ignore_files: bool = True
    skip_redaction: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.chunk_tokens <= 0 or not 0 <= self.chunk_overlap < self.chunk_tokens or self.max_file_bytes <= 0:
            raise ValueError("chunk_tokens must be positive, chunk_overlap less than it, max_file_bytes positive")
        if self.redaction_mode not in ("fast", "standard", "paranoid", "structure-safe"):
            raise ValueError(f"no such redaction mode: {self.redaction_mode}")


def as_list(value: str | list | tuple) -> tuple[str, ...]:
    """A list, or a string with commas."""
    parts = value.split(",") if isinstance(value, str) else value
    return tuple(p.strip() for p in parts if p.strip())


def coerce(values: dict) -> dict:
    """Known settings in their types; extensions get their dot."""
    out = {}
    known = {f.name for f in fields(Config)}
    for key, value in values.items():
        name = key.replace("-", "_")
        if name not in known:
            continue
        if name in ("include_extensions", "exclude_globs", "skip_redaction"):
            value = as_list(value)
        if name == "include_extensions":
            value = tuple(v.lower() if v.startswith(".") else "." + v.lower() for v in value)
        out[name] = value
    return out


def load_file(path: str | None, root: str = ".") -> dict:
    """Settings of a named file, or of the first that is found; a named file that can't be read is an error, others are not."""
    tries = [Path(path)] if path else [Path(root) / n for n in FILE_NAMES]
    for p in tries:
        try:
            data = tomllib.loads(p.read_text("utf-8"))
        except FileNotFoundError:
            if path:
                raise
            continue
        except tomllib.TOMLDecodeError:
            if path:
                raise
            return {}
        for section in SECTIONS:
            inner = data.get(section) or data.get("tool", {}).get(section)
            if isinstance(inner, dict):
                return coerce(inner)
        if p.name != "pyproject.toml":
            return coerce(data)
    return {}


def merged(arguments: dict, file: dict) -> Config:
    """Arguments before the file before the defaults."""
    return Config(**(file | {k: v for k, v in coerce(arguments).items() if v is not None}))


def with_repository(config: Config, theirs: dict) -> Config:
    """What a fetched repository asks for: only safe settings that are still as by default, and limits only lower."""
    default, changes = asdict(Config()), {}
    for name, value in coerce(theirs).items():
        current = getattr(config, name)
        if name not in SAFE or current != default[name]:
            continue
        if isinstance(value, int) and isinstance(current, int):
            value = min(value, current)
        changes[name] = current + tuple(v for v in value if v not in current) if name == "exclude_globs" else value
    return replace(config, **changes)
