import json
import subprocess

import pytest

from quillmill.__main__ import main
from quillmill.plans.review import symbol_spans
from quillmill.sources.files import detect_encoding, find_root, walk
from quillmill.sources.ignore import ignored, rules


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-q")
    (root / "lib.py").write_text("def one():\n    return 1\n\n\ndef two():\n    return 2\n")
    (root / "app.py").write_text("import lib\n\nprint(lib.one())\n")
    (root / "tests").mkdir()
    (root / "tests" / "test_lib.py").write_text("import lib\n\n\ndef test_one():\n    assert lib.one() == 1\n")
    (root / "README.md").write_text("![badge](x)\n\n# Title\n\nCall `one` of lib.py.\n")
    (root / ".gitignore").write_text("*.log\nout/\n!keep.log\n")
    (root / "a.log").write_text("x")
    (root / "keep.log").write_text("x")
    (root / "out").mkdir()
    (root / "out" / "x.py").write_text("x = 1\n")
    run("add", ".")
    run("commit", "-qm", "one")
    (root / "lib.py").write_text("def one():\n    return 11\n\n\ndef three():\n    return 3\n")
    return root


def test_ignore_rules():
    known = rules("*.log\n!keep.log\n/top\nbuild/\ndocs/**/x\n# no\na[!b]c\n") + rules("sub.txt\n", "d/")
    for path, folder, hidden in (("a.log", False, True), ("d/a.log", False, True), ("keep.log", False, False), ("top", False, True), ("d/top", False, False), ("build", True, True), ("build", False, False), ("docs/p/q/x", False, True), ("docs/x", False, True), ("abc", False, False), ("axc", False, True), ("d/sub.txt", False, True), ("sub.txt", False, False)):
        assert ignored(path, folder, known) is hidden, path


def test_walk_and_root(repo):
    rows = dict(walk(str(repo)))
    assert rows["a.log"] == rows["out/x.py"] == "skipped_gitignore" and rows["keep.log"] is None and rows["lib.py"] is None
    assert dict(walk(str(repo), use_ignore=False))["a.log"] is None
    assert find_root(str(repo / "out")) == str(repo.resolve())


def test_encodings():
    assert detect_encoding("Все люди рождаются".encode("cp1251")) == "cp1251" and detect_encoding("日本語の文書です".encode("shift_jis")) == "shift_jis" and detect_encoding("déjà vu".encode("cp1252")) == "cp1252"


def test_symbols():
    assert symbol_spans("a.py", "class A:\n    def f(self):\n        def g(): pass\n") == [("class", "A", 1, 3), ("method", "f", 2, 3), ("function", "g", 3, 3)]
    assert symbol_spans("a.go", "type T struct {\n}\n\nfunc (t T) M() {\n}\n\nfunc F() {\n\tx()\n}\n") == [("type", "T", 1, 2), ("method", "M", 4, 5), ("function", "F", 7, 9)]
    assert symbol_spans("a.gd", "func a():\n\tpass\nvar b = 1\n") == [("function", "a", 1, 2), ("binding", "b", 3, 4)]
    assert symbol_spans("a.py", "def (") == []


def test_review(spark, repo, capsys):
    assert main(["review", str(repo), "--format", "json"]) == 0
    report = json.loads(capsys.readouterr().out)
    lib = next(f for f in report["changed_files"] if f["path"] == "lib.py")
    assert {(s["name"], s["status"]) for s in lib["symbols"]} == {("one", "changed"), ("two", "removed"), ("three", "added")}
    assert {(r["path"], r["relation"]) for r in report["related_files"]} == {("app.py", "caller"), ("tests/test_lib.py", "test")}
    assert {("README.md", "one", "symbol"), ("README.md", "lib.py", "path")} <= {(m["path"], m["name"], m["relation"]) for m in report["mentions"]}
    assert main(["review", str(repo)]) == 0 and "changed function one" in capsys.readouterr().out


def test_export_index_info(spark, repo, tmp_path, capsys):
    assert main(["export", str(repo), "--output-dir", str(tmp_path / "out"), "--task", "one of lib"]) == 0
    pack = (tmp_path / "out" / "repo" / "context_pack.md").read_text()
    for part in ("# repo", "Task: one of lib", "## Overview", "## Readme\n\n# Title", "## Key files", "## Code map", "### lib.py (1-"):
        assert part in pack, part
    lines = [json.loads(x) for p in (tmp_path / "out" / "repo" / "chunks.jsonl").glob("part-*") for x in p.read_text().splitlines()]
    text = (repo / "lib.py").read_bytes()
    one = next(x for x in lines if x["path"] == "lib.py")
    assert text[one["byte_start"] : one["byte_end"]].decode() == one["content"] and not any(x["path"].startswith("out/") for x in lines)
    assert main(["index", str(repo), "--index-dir", str(tmp_path / "i")]) == 0 and "added" in capsys.readouterr().out
    (repo / "app.py").write_text("import lib\n")
    assert main(["index", str(repo), "--index-dir", str(tmp_path / "i")]) == 0 and "1 updated" in capsys.readouterr().out
    assert main(["info", str(repo)]) == 0 and "python" in capsys.readouterr().out
    assert main(["info", str(tmp_path / "nowhere")]) == 2
