"""Files of a directory tree as rows: listed on the driver, read and decoded by the executors."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension_of, language_of
from .ignore import Rule, ignored, rules

#: Directories that are never entered. Fixed values.
PRUNED = frozenset({"node_modules", "__pycache__", ".git", ".venv", "venv", "target"})
BOMS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


#: Encodings that a text without a mark may be in, commonest first. Fixed values.
GUESSES = ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr", "cp1252", "cp1251", "koi8_r", "iso8859_7")


def detect_encoding(raw: bytes) -> str:
    """The encoding under which the bytes beyond ASCII read most like text: letters of one script, in words of one case."""
    best, most = "cp1252", 0.0
    for name in GUESSES:
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        high, plain = [c for c in text if ord(c) > 127], sum(c.isascii() and c.isalpha() for c in text)
        scripts: dict[str, int] = {}
        for c in high:
            if c.isalpha():
                script = unicodedata.name(c, "?").split()[0]
                script = "KANA" if script in ("HIRAGANA", "KATAKANA", "CJK") and name in GUESSES[:2] else script
                scripts[script] = scripts.get(script, 0) + (1 if c.islower() or not c.isupper() else 0)
        if len(high) >= 4 and scripts.get("LATIN", 0) > plain or len(high) < 4 and name in ("cp1251", "koi8_r", "iso8859_7") and not plain:
            continue  # accented letters are fewer than the others of a text
        share = max(scripts.values(), default=0) / max(1, len(high))
        # Two bytes a character leave half as many chances to be wrong.
        score = share + (0.1 if name in GUESSES[:5] and len(high) >= 4 else 0.0)
        if score > most + 1e-9:
            best, most = name, score
    return best


def decode_bytes(raw: bytes) -> tuple[str, str]:
    """Text and encoding: strict UTF-8 first (a mark at its start stays in the text), then marks of other encodings, then the
    likeliest encoding; what it can't read is replaced."""
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    for mark, encoding in BOMS:
        if raw.startswith(mark):
            return raw[len(mark) :].decode(encoding, "replace"), encoding
    encoding = detect_encoding(raw)
    return raw.decode(encoding, "replace"), encoding


def is_binary(sample: bytes) -> bool:
    """Empty isn't; a NUL is; else three tenths of control bytes in the first 8,192."""
    sample = sample[:8192]
    if not sample:
        return False
    control = sum(b < 32 and b not in (9, 10, 12, 13) or b == 127 for b in sample)
    return b"\0" in sample or control / len(sample) >= 0.30


def find_root(path: str) -> str:
    """The repository that a path lies in: the nearest folder upwards with a ``.git``; else the path itself."""
    here = os.path.realpath(path)
    while not os.path.exists(os.path.join(here, ".git")):
        above = os.path.dirname(here)
        if above == here:
            return os.path.realpath(path)
        here = above
    return here


def walk(root: str, follow_links: bool = False, use_ignore: bool = True, most_ignored: int = 50_000) -> list[tuple[str, str | None]]:
    """(path within the root, reason it is left out or None), in order. Links out of the root are never followed.

    What ignore files hide is listed as such, at most ``most_ignored`` files of it: that is a bound of the inventory.
    """
    real, out, seen, hidden_count = os.path.realpath(root), [], set(), 0
    hidden_folders: set[str] = set()
    known: dict[str, list[Rule]] = {"": []}
    for folder, dirs, names in os.walk(root, followlinks=follow_links):
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        at = "" if at == "." else at + "/"
        above = known.get(at[:-1].rpartition("/")[0], []) if at else []
        mine = list(above)
        if use_ignore and ".gitignore" in names:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                mine += rules(f.read(), at)
        known[at[:-1]] = mine
        hidden_here = at[:-1] in hidden_folders
        kept = []
        for d in sorted(dirs):
            full = os.path.join(folder, d)
            if d in PRUNED or (d.startswith(".") and d != ".github"):
                continue
            if os.path.islink(full) and not (follow_links and os.path.realpath(full).startswith(real + os.sep)):
                out.append((os.path.relpath(full, root), "skipped_symlink"))
                continue
            if hidden_here or ignored(at + d, True, mine):
                hidden_folders.add(at + d)
            kept.append(d)
        dirs[:] = kept
        for n in sorted(names):
            full = os.path.join(folder, n)
            rel = at + n
            try:
                rel.encode("utf-8")
            except UnicodeEncodeError:
                out.append((rel.encode("utf-8", "replace").decode(), "skipped_encoding"))
                continue
            target = os.path.realpath(full)
            if target != real and not target.startswith(real + os.sep):
                out.append((rel, "skipped_symlink"))
            elif hidden_here or ignored(rel, False, mine):
                hidden_count += 1
                if hidden_count <= most_ignored:
                    out.append((rel, "skipped_gitignore"))
            elif target in seen:
                out.append((rel, "skipped_symlink"))
            else:
                seen.add(target)
                out.append((rel, None))
    return out


def _reader(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
                sizes, texts, encodings, binaries, reasons = [], [], [], [], []
                for path, reason in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    raw = None
                    if reason is None:
                        try:
                            with open(os.path.join(root, path), "rb") as f:
                                raw = f.read()
                        except OSError:
                            reason = "error_reading_metadata"
                    binary = raw is not None and is_binary(raw)
                    text, encoding = decode_bytes(raw) if raw is not None and not binary else (None, None)
                    sizes.append(len(raw) if raw is not None else None)
                    texts.append(text)
                    encodings.append(encoding)
                    binaries.append(binary)
                    reasons.append(reason or ("skipped_binary" if binary else None))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(texts, pa.string()), pa.array(encodings, pa.string()), pa.array(reasons, pa.string())], ["path", "size_bytes", "content", "encoding", "skipped"])

    return run


def read_tree(spark: SparkSession, root: str, follow_links: bool = False, use_ignore: bool = True) -> DataFrame:
    """One row for each file found: ``path, size_bytes, content, encoding, skipped, extension, language``. The folder must be
    one that the executors see too."""
    listed = spark.createDataFrame(walk(root, follow_links, use_ignore), "path string, reason string").repartition(max(1, spark.sparkContext.defaultParallelism))
    rows = listed.mapInArrow(_reader(root), "path string, size_bytes bigint, content string, encoding string, skipped string")
    return rows.withColumns({"extension": extension_of("path"), "language": language_of("path")})


def ranged_lines(texts: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """Lines of one file by number."""
    lines = texts.where(F.col("path") == path).select(F.posexplode(F.split("content", "\n")).alias("line", "text"))
    return lines.select((F.col("line") + 1).alias("line"), "text").where(F.col("line").between(first, last))
