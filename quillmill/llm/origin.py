"""Generated, minified or vendored source files (problem 1).

Two linear support-vector classifiers are trained on a bounded sample: one on hashed character n-grams of the text (as it is
and by its shape) with path components, from which the opening and closing comments, where giveaways stand, are masked; and
one on the n-grams of those comments, line by line. Labels of the first come from conventions of names, directories and
shapes, cleared by the tags of earlier scans. Labels of the second are the tags of earlier scans and the first's labels;
they are noisy, so lines on which a classifier of the other repositories disagrees are left out (cross-fitting). No wording
of a header is part of this module but the conventions tools document. Repositories are split between training and
validation; ``p1_validation`` shows the result.

The scores are linear, so a file's score is the sum over its chunks: each chunk is scored where it lies and only numbers are
shuffled. A text feature's weight is divided by the file's number of n-grams, which makes a table in a file of code count by
its share.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

BITS = 17
SIZE = 1 << BITS
SCALE = 40.0  # of the text's n-grams, whose shares add up to one
PATH_SCALE = 2.5  # of each path component

# ---- seeds: conventions that label the training sample. Fixed values. ------------------------------------------------
MADE_DIRS = frozenset("generated gen autogen auto __generated__ __snapshots__ dist out _build build public node_modules vendor third_party thirdparty 3rdparty external extern deps pods site-packages bower_components jspm_packages".split())
HAND_DIRS = frozenset("generator generators codegen minify minifier vendors deposits dependencies distribution distributions gene genes external-api builders builder snapshots output outputs publications automation".split())
MADE_NAMES = (".min.js", ".min.css", "-min.js", ".bundle.js", ".packed.js", ".min.mjs", "-min.mjs", ".bundle.mjs", ".packed.mjs", "_pb2.py", ".pb.go", ".g.ts", "_pb2_grpc.py", ".pb.cc", ".g.dart", "-1.2.3.js", "-1.2.3.c", "-1.2.3.py", ".0a1b2c3d.css", ".0a1b2c3d.js", ".lock", "-lock.json", ".sum", "_generated.go", ".designer.cs")
HAND_NAMES = (".js", ".py", ".css", ".go", ".ts", ".c", ".rs", ".mjs", ".java", ".toml", ".json", ".md", "_view.js", "_model.py", "_util.ts")

_COMMENT = re.compile(r"^\s*(?://|#(?!include|define|!|\[|if|endif)|--|/\*|\*|;|<!--|\"\"\"|%|exports\[)")
#: Marks that tools document for their output. Fixed values.
_HEADER_SEED = re.compile(r"^\W*code generated .* do not edit\.?\W*$|@generated\b|\bauto-?generated\b|automatically generated|[#@] ?sourcemappingurl=", re.I)
_NAME_SEED = re.compile(r"[.\-](?:min|bundle|packed)\.(?:js|mjs|css)$|_pb2(?:_grpc)?\.py$|\.pb\.(?:go|cc|h)$|\.g\.(?:ts|dart)$|-\d+\.\d+\.\d+\.\w+$|\.[0-9a-f]{8}\.(?:js|mjs|css)$|\.lock$|(?:^|/)(?:package-lock\.json|go\.sum|yarn\.lock)$", re.I)
_TABLE_LINE = re.compile(r"[ \t]*(?:(?:0x[0-9a-fA-F]{2}|\d{1,3}),[ \t]*){6,}(?:0x[0-9a-fA-F]{2}|\d{1,3})?,?[ \t]*\r?|[ \t]*[\"']?[A-Za-z0-9+/=]{50,}[\"']?,?[ \t]*\+?\r?|[ \t]*[(\[{](?:\"[^\"]*\"|-?[\d.]+)(?:, *(?:\"[^\"]*\"|-?[\d.]+)){2,}[)\]}],?\r?")


class Example(NamedTuple):
    repo_id: int
    path: str
    text: str
    tagged: bool


def seed_label(e: Example) -> tuple[int, bool]:
    """(1 made, -1 by hand, 0 unclear; whether only its comments say so)."""
    low = e.path.lower()
    dirs = set(low.split("/")[1:-1])
    ext = low.rsplit(".", 1)[-1]
    code = ext in ("js", "mjs", "ts", "css", "py", "go", "rs", "c", "h", "java", "sql")
    lines = e.text.split("\n")
    made = bool(_NAME_SEED.search(low)) or bool(dirs & (MADE_DIRS - {"build", "out", "public", "auto", "external", "deps"}))
    if code and not made:
        longest = max(map(len, lines))
        table = sum(1 for x in lines if _TABLE_LINE.fullmatch(x))
        made = (
            table > 0.5 * len(lines)
            or longest > 400 and ext in ("js", "mjs", "css") and len(e.text) / len(lines) > 150
            or longest > 2000 and longest > 0.5 * len(e.text)
            or "base64," in e.text and longest > 400
            or 'Object.defineProperty(exports, "__esModule"' in e.text
            or e.text.startswith("exports[`")
        )
    if not made and dirs & {"build", "out", "public", "auto", "external", "deps"}:
        return (1, False) if e.tagged else (0, False)
    if made:
        return 1, False
    if any(map(_HEADER_SEED.search, header_of(lines))):
        return 1, True
    return (0, False) if e.tagged and dirs & HAND_DIRS == set() and not code else (-1, False)


_LEAD = re.compile(r"^\s*$|^#!|^\s*package\s+[\w.]+;?\s*$|^\s*[\"']use strict[\"'];?\s*$|^\s*(?:<\?php|<\?xml[^>]*>)\s*$")


def _opening(lines: list[str]) -> int:
    """Number of lines before the first that is neither a comment nor blank, a shebang, a directive or a package line."""
    inside = ""
    for i, x in enumerate(lines):
        t = x.strip()
        if inside:
            if inside in t:
                inside = ""
            continue
        if t.startswith("/*"):
            inside = "" if "*/" in t[2:] else "*/"
            if not inside and not t.endswith("*/"):
                return i + 1
        elif t[:3] in ('"""', "'''"):
            inside = "" if t[:3] in t[3:] else t[:3]
        elif t.startswith("<!--"):
            inside = "" if "-->" in t else "-->"
        elif not (_COMMENT.match(x) or _LEAD.match(x)):
            return i
    return len(lines)


def _closing(lines: list[str], start: int) -> int:
    """Where the comments begin that close a text."""
    b = len(lines)
    while b > start and (not lines[b - 1].strip() or _COMMENT.match(lines[b - 1])):
        b -= 1
    return b


def header_of(lines: list[str], first: bool = True, last: bool = True) -> list[str]:
    """The lines of the comments that open and close a text, whole: where giveaways stand."""
    a = _opening(lines) if first else 0
    b = _closing(lines, a) if last else len(lines)
    return [t for x in (*lines[:a], *lines[b:]) if (t := x.strip()) and not _LEAD.match(x)]


def masked(lines: list[str], first: bool = True, last: bool = True) -> str:
    """The text without the comments that open and close it."""
    a = _opening(lines) if first else 0
    return "\n".join(lines[a : _closing(lines, a) if last else len(lines)])


# ---- features --------------------------------------------------------------------------------------------------------

_SHAPE = np.arange(256, dtype=np.uint8)
for _lo, _hi, _to in (("a", "z", "a"), ("A", "Z", "A"), ("0", "9", "0")):
    _SHAPE[ord(_lo) : ord(_hi) + 1] = ord(_to)
_SHAPE[128:] = ord("a")
_RAW = np.arange(256, dtype=np.uint8)
_RAW[ord("0") : ord("9") + 1] = ord("0")
_RAW[ord("A") : ord("Z") + 1] += 32


def _grams(values: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hashes of the n-grams of a byte array."""
    if len(values) < n:
        return np.zeros(0, np.int64)
    v = values.astype(np.uint32)
    h = np.full(len(v) - n + 1, salt, np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) + v[k : len(v) - n + 1 + k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return (h & np.uint32(SIZE - 1)).astype(np.int64)


def text_grams(text: str) -> np.ndarray:
    """Hashed n-grams of a text: five characters as they are, seven of its shape with runs drawn together."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    shape = _SHAPE[raw]
    if len(shape):
        keep = np.ones(len(shape), bool)
        same = shape[1:] == shape[:-1]
        # Runs of letters, digits and blanks count once.
        keep[1:] = ~(same & np.isin(shape[1:], np.frombuffer(b"aA0 \t", np.uint8)))
        shape = shape[keep]
    return np.concatenate((_grams(_RAW[raw], 5, 1), _grams(shape, 7, 2)))


def _word_hash(word: str, salt: int) -> int:
    h = salt
    for b in word.encode():
        h = (h * 0x01000193 + b) & 0xFFFFFFFF
    h ^= h >> 15
    h = h * 0x85EBCA6B & 0xFFFFFFFF
    return (h ^ h >> 13) & (SIZE - 1)


def path_grams(path: str) -> list[int]:
    """Hashed components of a path: directories, and the parts of the name with what separates them."""
    parts = path.lower().split("/")
    name = re.sub(r"\d+\.\d+\.\d+", "<v>", parts[-1])
    name = re.sub(r"(?<=\.)(?=[0-9a-f]*\d)[0-9a-f]{8}(?=\.)", "<x>", name)
    tokens = re.findall(r"[._\-]?[^._\-]+", name)
    words = ["d:" + d for d in parts[1:-1]] + ["f:" + tokens[0] if tokens else "f:"] + ["n:" + re.sub(r"\d", "0", t) for t in tokens[1:]] + ["e:" + "".join(tokens[-2:])]
    return [_word_hash(w, 3) for w in words]


def header_grams(header: str) -> np.ndarray:
    """Hashed n-grams of comments, each once."""
    raw = _RAW[np.frombuffer(header.encode("utf-8", "surrogatepass"), np.uint8)]
    return np.unique(np.concatenate((_grams(raw, 4, 4), _grams(raw, 6, 5))))


# ---- training --------------------------------------------------------------------------------------------------------


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], positive_weight: float = 3.0, epochs: int = 12, reg: float = 1e-5, seed: int = 5) -> tuple[np.ndarray, float]:
    """Linear support-vector classifier by averaged stochastic subgradient on the squared hinge."""
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(SIZE), np.full(SIZE, 1e-2)
    total, bias, bias_total, steps, b2 = np.zeros(SIZE), 0.0, 0.0, 0, 1.0
    y = np.array(labels, float)
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, val = rows[i]
            margin = y[i] * (w[idx] @ val + bias)
            if margin < 1:
                c = (positive_weight if y[i] > 0 else 1.0) * min(1.0, 1 - margin) * y[i]
                step = c * val
                g2[idx] += step * step
                w[idx] += 0.3 * step / np.sqrt(g2[idx])
                b2 += c * c
                bias += 0.3 * c / np.sqrt(b2)
            w[idx] *= 1 - reg
        if epoch >= epochs // 2:
            total += w
            bias_total += bias
            steps += 1
    return total / steps, bias_total / steps


def fit_dense(rows: list[np.ndarray], labels: np.ndarray, positive_weight: float, steps: int = 80, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear support-vector classifier of rows of equal weights, by full steps of AdaGrad on the squared hinge."""
    if not len(rows):
        return np.zeros(SIZE), -1.0
    flat = np.concatenate(rows)
    counts = np.array(list(map(len, rows)))
    starts, owner = np.cumsum(counts) - counts, np.repeat(np.arange(len(rows)), counts)
    val = (1.0 / np.sqrt(counts))[owner]
    y, cost = labels.astype(float), np.where(labels > 0, positive_weight, 1.0)
    w, bias, g2 = np.zeros(SIZE), -1.0, np.full(SIZE, 1e-3)  # what nothing speaks for is no giveaway
    for _ in range(steps):
        margin = y * (np.add.reduceat(w[flat] * val, starts) + bias)
        pull = cost * y * np.clip(1 - margin, 0.0, 1.0) / len(rows)
        g = np.bincount(flat, pull[owner] * val, SIZE) - reg * w
        g2 += g * g
        w += 0.2 * g / np.sqrt(g2)
    return w, bias


class Model(NamedTuple):
    content: np.ndarray
    content_bias: float
    header: np.ndarray
    header_bias: float
    report: dict


def fit_headers(rows: list[np.ndarray], labels: list[int], repos: list[int], positive_weight: float, folds: int = 5) -> tuple[np.ndarray, float, dict]:
    """The classifier of comment lines from noisy labels: each line is judged by a classifier of the other repositories;
    lines on which it disagrees with the label are left out, of both kinds. The report is on the repositories held out."""
    y, fold = np.array(labels), np.array(repos) % folds
    said = np.zeros(len(rows))
    for k in range(folds):
        inner = np.flatnonzero(fold != k)
        w, b = fit_dense([rows[i] for i in inner], y[inner], positive_weight)
        for i in np.flatnonzero(fold == k):
            said[i] = w[rows[i]].sum() / np.sqrt(len(rows[i])) + b
    agree = np.flatnonzero((said > 0) == (y > 0))
    w, b = fit_dense([rows[i] for i in agree], y[agree], 3.0)
    report = {"train": len(agree), "held_out": len(rows), "right": int(len(agree)), "made": int((y > 0).sum()), "made_found": int(((said > 0) & (y > 0)).sum()), "wrongly_found": int(((said > 0) & (y < 0)).sum())}
    return w, b, report


def _content_row(path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    grams = text_grams(text)
    idx, n = np.unique(grams, return_counts=True)
    val = n * (SCALE / max(200, len(grams)))
    p = np.array(path_grams(path), np.int64)
    return np.concatenate((idx, p)), np.concatenate((val, np.full(len(p), PATH_SCALE)))


#: How much more a tag of an earlier scan counts than its absence, in the whole corpus: tags are often missing.
TAG_WEIGHT = 17.0
#: What a comment line must reach: half the margin of the classifier, as its labels are noisy.
HEADER_MARGIN = 0.5


def fit(examples: list[Example], tagged_rate: float = 1.0, other_rate: float = 1.0) -> Model:
    """Both classifiers, and how they do on repositories held out (a fifth at a time for the second). The rates say
    which share of the tagged and of the other files the examples are."""
    rows, labels, held = [], [], []
    header_rows, header_labels, header_repos = [], [], []
    for e in sorted(examples, key=lambda e: e.path):
        y, only_header = seed_label(e)
        lines = e.text.split("\n")
        for h in header_of(lines):
            if len(g := header_grams(h)):
                header_rows.append(g)
                header_labels.append(1 if y > 0 or e.tagged or _HEADER_SEED.search(h) else -1)
                header_repos.append(hash_repo(e.repo_id))
        if y and not only_header:
            rows.append(_content_row(e.path, masked(lines)))
            labels.append(y)
            held.append(hash_repo(e.repo_id) % 5 == 0)
    # Conventions as examples of their own, so that small corpora know them too. Each stands beside a plain text.
    plain = [(e.path, e.text) for e in examples if seed_label(e) == (-1, False)][:160] or [("repo/src/a/b.py", "x = 1\n")]
    k = 0
    for seeds, y in ((MADE_DIRS, 1), (HAND_DIRS, -1)):
        for d in sorted(seeds):
            for _ in range(10):
                path, text = plain[k % len(plain)]
                k += 1
                parts = path.split("/")
                rows.append(_content_row("/".join([*parts[:-1], d, parts[-1]]), masked(text.split("\n"))))
                labels.append(y)
                held.append(False)
    for seeds, y in ((MADE_NAMES, 1), (HAND_NAMES, -1)):
        for s in seeds:
            for _ in range(3):
                path, text = plain[k % len(plain)]
                k += 1
                rows.append(_content_row(re.sub(r"\.\w+$", "", path) + s, masked(text.split("\n"))))
                labels.append(y)
                held.append(False)
    train = [i for i, o in enumerate(held) if not o]
    w, b = fit_svm([rows[i] for i in train], [labels[i] for i in train])
    said = [(w[rows[i][0]] @ rows[i][1] + b > 0, labels[i] > 0) for i, o in enumerate(held) if o]
    report = {"content": {"train": len(train), "held_out": len(said), "right": sum(p == t for p, t in said), "made": sum(t for _, t in said), "made_found": sum(p and t for p, t in said), "wrongly_found": sum(p and not t for p, t in said)}}
    header, header_bias, report["header"] = fit_headers(header_rows, header_labels, header_repos, TAG_WEIGHT * other_rate / tagged_rate)
    return Model(w, b, header, header_bias, report)


def hash_repo(repo_id: int | None) -> int:
    return ((repo_id or 0) * 2654435761 & 0xFFFFFFFF) >> 8


# ---- scoring ---------------------------------------------------------------------------------------------------------


def _chunk_scorer(model: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, header, header_bias = model
        for batch in batches:
            ids, index = batch.column(0), batch.column(1)
            sums, counts, headers = [], [], []
            for i, n, text in zip(index.to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lines = text.split("\n")
                first, last = not i, i is None or n is None or i >= n - 1
                g = text_grams(masked(lines, first, last))
                sums.append(float(content[g].sum()))
                counts.append(len(g))
                scores = [float(header[hg].sum() / np.sqrt(len(hg)) + header_bias) for h in header_of(lines, first, last) if len(hg := header_grams(h))]
                headers.append(max(scores, default=-1.0))
            yield pa.RecordBatch.from_arrays([ids, index, pa.array(sums, pa.float64()), pa.array(counts, pa.int64()), pa.array(headers, pa.float64())], ["file_id", "chunk_index", "sums", "grams", "header"])

    return run


def _path_scorer(model: tuple) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, bias = model
        for batch in batches:
            scores = [float(content[path_grams(p)].sum()) * PATH_SCALE + bias for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["file_id", "path", "path_score"])

    return run


def training_sample(files: DataFrame, chunks: DataFrame, tagged_bound: int = 2500, other_bound: int = 4000, bytes_bound: int = 40_000) -> tuple[list[Example], float, float]:
    """At most so many files that an earlier scan tagged and so many others, chosen by a hash of the id; of either those of
    at most ``bytes_bound`` bytes. With the shares of both kinds that they are."""
    marked = F.coalesce(F.arrays_overlap("tags", F.array(F.lit("generated"), F.lit("vendored"), F.lit("lock-file"))), F.lit(False)) | F.coalesce(F.lower("classification").isin("generated", "vendored"), F.lit(False))
    one = files.where("file_id IS NOT NULL AND path IS NOT NULL AND coalesce(size_bytes, 0) <= %d" % bytes_bound).groupBy("file_id").agg(F.max(F.struct("path", "repo_id")).alias("f"), F.max(marked).alias("tagged")).select("file_id", "f.path", "f.repo_id", "tagged")
    every = {r["tagged"]: r["n"] for r in one.groupBy("tagged").agg(F.count("*").alias("n")).collect()}
    rates = [min(1.0, bound / max(1, every.get(kind, 0))) for kind, bound in ((True, tagged_bound), (False, other_bound))]
    order = [F.xxhash64("file_id"), F.col("file_id")]
    chosen = one.where("tagged").orderBy(*order).limit(tagged_bound).union(one.where("NOT tagged").orderBy(*order).limit(other_bound))
    rows = chunks.where("content IS NOT NULL").join(F.broadcast(chosen), "file_id").select("file_id", F.col("path"), "tagged", chosen["repo_id"], "chunk_index", "content")
    texts: dict[str, dict] = {}
    for r in rows.collect():
        texts.setdefault(r["file_id"], {"meta": r, "parts": {}})["parts"][r["chunk_index"] or 0] = r["content"]
    return [Example(t["meta"]["repo_id"] or 0, t["meta"]["path"], "\n".join(x for _, x in sorted(t["parts"].items())), bool(t["meta"]["tagged"])) for t in texts.values()], *rates


def made_scores(files: DataFrame, chunks: DataFrame, tagged_bound: int = 2500, other_bound: int = 4000) -> tuple[DataFrame, dict]:
    """``file_id, path, content_score, header_score, made`` for every file, and the report on the held-out repositories.

    Defined results: null ids or paths give no row; a file scanned again counts once; a file without chunks is judged by its
    path; a chunk delivered again counts once; null chunk numbers count as a file of one chunk; extra columns are ignored;
    an empty table gives an empty result.
    """
    model = fit(*training_sample(files.select("file_id", "repo_id", "path", "size_bytes", "tags", "classification"), chunks.select("file_id", "chunk_index", "content"), tagged_bound, other_bound))
    content, header = model.content.astype(np.float32), model.header.astype(np.float32)
    scored = chunks.where("file_id IS NOT NULL AND content IS NOT NULL").select("file_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("chunks_in_file").cast("bigint").alias("chunks_in_file"), "content")
    scored = spread(scored).mapInArrow(_chunk_scorer((content, header, model.header_bias)), "file_id string, chunk_index bigint, sums double, grams bigint, header double")
    per_chunk = scored.groupBy("file_id", "chunk_index").agg(F.max("sums").alias("sums"), F.max("grams").alias("grams"), F.max("header").alias("header"))
    per_file = per_chunk.groupBy("file_id").agg(F.sum("sums").alias("sums"), F.sum("grams").alias("grams"), F.max("header").alias("header"))
    paths = files.where("file_id IS NOT NULL AND path IS NOT NULL").groupBy("file_id").agg(F.max("path").alias("path"))
    paths = paths.mapInArrow(_path_scorer((content, model.content_bias)), "file_id string, path string, path_score double")
    joined = paths.join(per_file, "file_id", "left")
    content_score = F.round(F.col("path_score") + F.coalesce(F.col("sums") * SCALE / F.greatest(F.lit(200), F.col("grams")), F.lit(0.0)), 6)
    header_score = F.round(F.coalesce("header", F.lit(-1.0)), 6)
    return joined.select("file_id", "path", content_score.alias("content_score"), header_score.alias("header_score"), ((content_score > 0) | (header_score > HEADER_MARGIN)).alias("made")), model.report
