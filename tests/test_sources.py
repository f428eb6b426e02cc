import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quillmill.operators import store
from quillmill.sources import config, files, git
from quillmill.streaming.refresh import arrivals, refresh_from_stream


def test_walk_and_read(spark, tmp_path):
    root = tmp_path / "r"
    for name, raw in {"a.py": b"x = 1\n", "d/b.txt": "é".encode("cp1252"), "d/u.txt": "é".encode("utf-16"), "c.bin": b"\0\1", "node_modules/x.js": b"x", ".hidden/x": b"x", ".github/w.yml": b"x", "empty.py": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    (tmp_path / "secret.txt").write_text("s")
    os.symlink(tmp_path / "secret.txt", root / "link.txt")
    rows = {r["path"]: r for r in files.read_tree(spark, str(root), follow_links=True).collect()}
    assert set(rows) == {"a.py", "d/b.txt", "d/u.txt", "c.bin", ".github/w.yml", "empty.py", "link.txt"}
    assert rows["link.txt"]["skipped"] == "skipped_symlink" and rows["link.txt"]["content"] is None
    assert rows["c.bin"]["skipped"] == "skipped_binary" and rows["d/b.txt"]["content"] == "é" and rows["d/u.txt"]["skipped"] == "skipped_binary"
    assert files.decode_bytes("\ufeffé".encode("utf-16-le")) == ("é", "utf-16-le") and files.decode_bytes(b"\xef\xbb\xbfx")[0] == "\ufeffx"
    assert rows["a.py"]["language"] == "python" and rows["empty.py"]["content"] == ""


def test_config(tmp_path):
    (tmp_path / "quillmill.toml").write_text('[quillmill]\nchunk-tokens = 500\ninclude-extensions = "py, .RS"\n')
    c = config.merged({"chunk_tokens": None, "chunk_overlap": 50}, config.load_file(None, str(tmp_path)))
    assert (c.chunk_tokens, c.chunk_overlap, c.include_extensions) == (500, 50, (".py", ".rs"))
    with pytest.raises(FileNotFoundError):
        config.load_file(str(tmp_path / "no.toml"))
    with pytest.raises(ValueError):
        config.Config(chunk_overlap=900)
    theirs = config.with_repository(config.Config(), {"max_file_bytes": 10**9, "max_total_bytes": 5, "redaction_mode": "fast", "exclude_globs": ["x/**"]})
    assert theirs.max_file_bytes == 1_048_576 and theirs.max_total_bytes == 5 and theirs.redaction_mode == "standard" and theirs.exclude_globs[-1] == "x/**"


def test_git(spark, tmp_path):
    root = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("one\ntwo\n")
    run("add", ".")
    run("commit", "-qm", "x")
    (tmp_path / "a.py").write_text("one\n2\n")
    (tmp_path / "new.py").write_text("n")
    changed, lines = git.changes(spark, root)
    assert {tuple(r) for r in changed.collect()} == {("a.py", "M"), ("new.py", "?")}
    assert {(r["path"], r["side"], r["line"]) for r in lines.collect()} == {("a.py", "old", 2), ("a.py", "new", 2), ("new.py", "new", 1)}
    with pytest.raises(ValueError):
        git.changes(spark, root, "HEAD", "HEAD")
    assert git.content(root, "a.py", "HEAD") == "one\ntwo\n" and git.content(root, "none", None) is None


def test_streaming_refresh(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write = lambda n, rows: (source / f"{n}.json").write_text("\n".join(json.dumps({"path": p, "content_hash": h}) for p, h in rows))
    index = store.Index(spark, f"file://{tmp_path}/idx")
    chunks = lambda f: f.select(F.concat(F.lit("c"), "path", "content_hash").alias("id"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.array(F.lit("def:x")).alias("tags"))
    edges = lambda f: f.select(F.col("path").alias("src"), F.col("path").alias("dst")).limit(0)
    for n, rows in (("1", [("a", "1"), ("b", "1")]), ("2", [("b", "2"), ("c", "1")])):
        write(n, rows)
        stream = spark.readStream.schema("path string, content_hash string").json(str(source))
        refresh_from_stream(stream, index, chunks, edges, "root", "cfg", str(tmp_path / "ckpt")).awaitTermination()
    assert {r["id"] for r in index.load_chunks().collect()} == {"ca1", "cb2", "cc1"}
    events = spark.readStream.schema("ts timestamp, kind string").json(str(source))
    assert arrivals(events, "ts", "kind").isStreaming
