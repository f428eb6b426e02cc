import random
from collections import Counter, defaultdict

import pytest

from quillmill.llm.leaks import leaked_items, words_of
from quillmill.llm.origin import Example, fit, header_grams, header_of, made_scores, masked, seed_label
from quillmill.llm.packing import container_fill, encoder, pack_documents, pack_histogram
from quillmill.llm.syntax import assemble, deep_json_error, exact_error, judged_files, lex_errors, nesting_errors, permitted

GOOD = {
    "js": ['"use strict";\nclass A {\n  constructor(x) {\n    this.x = x;\n  }\n  get(k) {\n    return this.m.get(k) ?? `a-${k}-1`;\n  }\n}\n', "const f = async (a) => {\n  const r = await a.b({ limit: 1, name: \"x\" });\n  return r.rows.filter((y) => y.c !== null);\n};\n", 'const re = /[{("\']+/;\nconst s = "{[("; // not closed: ({[\n', "for (let i = 0; i < n; i++) { x += y / 2; }\n", "export default function () {}\n", "var A = (function () { function A(_a) { var b = _a.c, d = b === void 0 ? 1 : b; } return A; }());\n"],
    "ts": ["interface A {\n  a: string;\n  b?: boolean;\n}\nfunction f(x: string, n = 3): number[] {\n  const s = new Set<string>();\n  return x.split(\"a\").map((y) => y.length + 1);\n}\n", "class Q {\n  private q: Record<string, number> = {};\n  constructor(private readonly s: string) {}\n}\n"],
    "go": ['package a\n\nimport "fmt"\n\ntype T struct {\n\tA string\n\trows []int\n}\n\nfunc (x *T) Add(n int) {\n\tif n > 5 {\n\t\tx.rows = append(x.rows, n)\n\t}\n}\n\nfunc f(v []string, l int) (map[string]int, error) {\n\tout := make(map[string]int)\n\tfor i, x := range v {\n\t\tif len(x) > l {\n\t\t\treturn nil, fmt.Errorf("a %d: %s", i, x)\n\t\t}\n\t\tout[x] += 8\n\t}\n\treturn out, nil\n}\n', 'package d\n\nvar t = []byte{\n\t1, 2,\n\t3,\n}\nvar m = map[string]string{"a": "b"}\n'],
    "rust": ["use std::fmt;\n\n#[derive(Debug, Clone)]\npub struct A<'a> {\n    pub x: &'a str,\n}\n\nimpl<'a> fmt::Display for A<'a> {\n    fn fmt(&self, f: &mut fmt::Formatter) -> fmt::Result {\n        write!(f, \"{}\", self.x)\n    }\n}\n\npub fn f(v: &[u64], l: u64) -> Option<u64> {\n    let t: u64 = v.iter().map(|x| x * 3).filter(|x| *x > l).sum();\n    match t { 0 => None, n if n > 3 => Some(n), _ => Some(t) }\n}\n"],
    "java": ["package a.b;\n\nimport java.util.List;\n\npublic final class A {\n    private final String x;\n    private int n = 3;\n    /** Doc. */\n    public static int f(List<String> v, int l) {\n        int t = 0;\n        for (String s : v) {\n            if (s.isEmpty()) throw new IllegalStateException(\"a: \" + s);\n            t += s.hashCode() % 7;\n        }\n        return t;\n    }\n}\n"],
    "c": ["#include <stdio.h>\n\nstruct a {\n    int b;\n    const char *c;\n    struct a *next;\n};\n\n#define N 53\n\nstatic int f(const int *v, int n)\n{\n    int t = 7;\n    int k;\n    for (k = 0; k < n; k++) {\n        if (v[k] > 3) {\n            return -1;\n        }\n        t += v[k];\n    }\n    return t;\n}\n\nconst unsigned char d[] = {\n  0xbe, 0xe5,\n};\n"],
}
BREAKS = [("{% if x %}\n", "front"), ("<? x ?>\n", "front"), ("<%= x %>\n", "front"), ("<!DOCTYPE html>\n<html>\n", "front"), ("<<<<<<< HEAD\n", "middle"), ("@@ -1,2 +3,4 @@\n-\n", "middle"), ("The importer skips every page whose list is empty.\n", "middle"), ("\nimport json\nimport os\n\ndef f(path):\n    return 1\n", "back")]


@pytest.mark.parametrize("grammar", GOOD)
def test_valid_code_passes_and_broken_code_does_not(grammar):
    def broken(text):
        pairs, reason = lex_errors(grammar, text)
        return reason is not None or any(not permitted(grammar, *p) for p in pairs)

    for text in GOOD[grammar]:
        assert not broken(text), (lex_errors(grammar, text)[1], [p for p in lex_errors(grammar, text)[0] if not permitted(grammar, *p)])
        lines = text.splitlines(True)
        for junk, where in BREAKS:
            k = {"front": 0, "middle": len(lines) // 2, "back": len(lines)}[where]
            assert broken("".join(lines[:k]) + junk + "".join(lines[k:])), (junk, text)
        if "{\n" in text:
            assert broken(text[: text.index("{\n") + 2])
        for cut in ("}", ")"):
            if cut in text:
                at = text.rindex(cut) if cut == "}" else text.index(cut)
                if grammar != "js" or "re = /" not in text:
                    assert broken(text[:at] + text[at + 1 :]), cut


def test_exact_parsers():
    assert exact_error("python", "x = 1\n") is None and exact_error("python", "def f(:\n") and exact_error("python", "if x:\npass\n")
    assert exact_error("json", '{"a": [1, 2]}') is None and exact_error("json", '{"a": NaN}') and exact_error("json", "{'a': 1}") and exact_error("json", "")
    assert exact_error("toml", 'a = 1\n[b]\nc = "d"\n') is None and exact_error("toml", "a = \n")


def test_assemble_shares_lines():
    parts = [{"start_line": 3, "chunk_index": 1, "content": "c\nd"}, {"start_line": 1, "chunk_index": 0, "content": "a\nb\nc"}, {"start_line": 1, "chunk_index": 0, "content": "a\nb\nc"}]
    assert assemble(parts) == "a\nb\nc\nd"


FILES = "file_id string, repo_id bigint, language string, extension string, scanned_at timestamp, path string, size_bytes bigint, tags array<string>, classification string, pieces string"
CHUNKS = "file_id string, start_line bigint, chunk_index bigint, chunks_in_file bigint, content string, reason string"


def test_judged_table(spark):
    files = [("a", 1, None, ".py", None, "r/a.py", 1, None, None, None), ("a", 1, None, "PY", None, "r/a.py", 1, None, None, None), ("b", None, "x", "json", None, "r/b", 1, [], None, None), ("c", 1, "x", None, None, "r/c", 1, [], None, None), (None, 1, "x", "py", None, None, 1, None, None, None), ("d", 1, "x", "md", None, "r/d.md", 1, [], None, None), ("e", 1, "x", "go", None, "r/e.go", 1, [], None, None)]
    chunks = [("a", 1, 0, 2, "def f():", "q"), ("a", 2, 1, 2, "    return 1", "q"), ("a", 1, 0, 2, "def f():", "q"), ("b", 1, 0, 1, "{", None), ("c", 1, 0, 1, "x", None), (None, 1, 0, 1, "x", None), ("b", None, None, None, None, None), ("d", 1, 0, 1, "# x", None), ("e", 1, 0, 1, "package a\n\nfunc f( {\n}", None)]
    got = {r["file_id"]: r["valid"] for r in judged_files(spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS)).collect()}
    assert got == {"a": True, "b": False, "e": False}
    assert judged_files(spark.createDataFrame([], FILES), spark.createDataFrame([], CHUNKS)).count() == 0


def test_nesting_windows(spark):
    """The windows over the brackets agree with a stack."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("()[]{}\n") for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["([{}])", "([)]", "(", ")", "{\n(\n)\n}"]
    rows, want = [], set()
    for i, text in enumerate(texts):
        stack: list[str] = []
        for at, c in enumerate(text):
            if c != "\n":
                rows.append((str(i), at, c))
            if c in "([{":
                stack.append(c)
            elif c != "\n" and (not stack or stack.pop() != {")": "(", "]": "[", "}": "{"}[c]):
                want.add(str(i))
                break
        else:
            if stack:
                want.add(str(i))
    got = {r["file_id"] for r in nesting_errors(spark.createDataFrame(rows, "file_id string, at bigint, bracket string")).collect()}
    assert got == want and 5 < len(want) < len(texts)


def test_deep_texts():
    assert exact_error("json", "[" * 200_000) and exact_error("json", "[" * 200_000 + "]" * 200_000) is None and exact_error("json", "[" * 200_000 + "1," + "]" * 200_000)
    assert deep_json_error('{"a": [1, {"b": null}], "c": "d"}') is None and deep_json_error('{"a" 1}') and deep_json_error("[1,]") and deep_json_error("1 2") and deep_json_error("{,}")


def test_packing_patterns():
    rng = random.Random(1)
    for sizes in ([rng.randint(1, 2048) for _ in range(3000)], [3] * 5000, [2048] * 7, [1500] * 10, [], [rng.choice((700, 701, 30)) for _ in range(999)]):
        placed, room = Counter(), 0
        for pattern, times, length in pack_histogram(Counter(sizes), (512, 1024, 2048)):
            used = sum(s * k for s, k in pattern.items())
            assert used <= length and times > 0
            placed.update({s: k * times for s, k in pattern.items()})
            room += length * times
        assert placed == Counter(sizes)
        if len(sizes) == 3000:
            assert sum(sizes) / room > 0.985


DOCS = "doc_id bigint, text string, source string, size bigint"


def test_packed_table(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "γ", "x1")) for _ in range(rng.randint(1, 900))), "s", 1) for i in range(60)]
    rows += [(100, "word " * 9000, "s", None), (101, "", "s", None), (102, None, "s", None), (None, "x", "s", None), (0, rows[0][1], "s", 2)]
    packed = pack_documents(spark.createDataFrame(rows, DOCS))
    got = packed.collect()
    encode = encoder().encode_ordinary
    by_doc, by_bin = defaultdict(list), defaultdict(int)
    for r in got:
        by_doc[r["doc_id"]].append((r["token_start"], r["token_end"]))
        if r["container_id"] is not None:
            by_bin[r["container_id"], r["container_tokens"]] += r["token_end"] - r["token_start"]
    assert set(by_doc) == {*range(60), 100, 101}
    for i, text in [(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None]:
        spans = sorted(by_doc[i])
        assert spans[0][0] == 0 and spans[-1][1] == len(encode(text)) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) == 1 or len(encode(text)) > 2048
    assert all(n <= size for (_, size), n in by_bin.items())
    assert sum(r["containers"] for r in container_fill(packed).collect()) == len(by_bin)
    assert pack_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60))), "x") for i in range(30)] + [(99, None, "x"), (None, "a", "x"), (3, None, "x")]
    docs = []
    for d in range(80):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if d % 3 == 0:
            t = items[rng.randint(0, 29)][1].split()
            n = rng.choice((11, 12, 13, 40))
            words[10:10] = [w.upper() + rng.choice(("", ",", "!", "*")) for w in t[:n]]
        docs.append((d, rng.choice((" ", "\n// ", "\n> ", "\t")).join(words), "s", None))
    docs += [(200, None, "s", None), (None, items[0][1], "s", None), docs[0]]
    shingles = defaultdict(set)
    for i, t, _ in items:
        if i is not None and t:
            w = words_of(t)
            for k in range(len(w) - 11):
                shingles[tuple(w[k : k + 12])].add(i)
    want = {(d, i) for d, t, *_ in docs if d is not None and t for w in [words_of(t)] for k in range(len(w) - 11) for i in shingles.get(tuple(w[k : k + 12]), ())}
    q = spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    got = {tuple(r) for r in leaked_items(spark.createDataFrame(docs, DOCS), q).collect()}
    assert got == want and len(want) > 5
    assert leaked_items(spark.createDataFrame([], DOCS), q).count() == 0
    assert leaked_items(spark.createDataFrame(docs, DOCS), q.limit(0)).count() == 0


HAND = "\n".join(f"def load_{i}(path):\n    with open(path) as handle:\n        rows = [x for x in handle if x.strip()]\n    return rows\n" for i in range(6))
MINI = "var w={};" + "".join(f"function p{i}(i,z){{return i.a>{i}?z:i.length}}w.j=w.j||{{}},w.j.s=\"q\",w.x=!1;" for i in range(60))


def corpus(n=60):
    rows = []
    for k in range(n):
        rows += [(k % 9, f"r{k % 9}/src/m_{k}/load_{k}.py", HAND.replace("load", f"load{k}"), False), (k % 9, f"r{k % 9}/src/m_{k}/view_{k}.min.js", MINI, k % 2 == 0), (k % 9, f"r{k % 9}/lib/m_{k}/vendor/libx/a{k}.py", HAND, k % 2 == 0), (k % 9, f"r{k % 9}/src/m_{k}/gen{k}.py", f"# Spat out by the frobnicator from m{k}.tmpl, hands off\n" + HAND, k % 3 == 0)]
    return rows


def test_origin_held_out_accuracy():
    """The wording of headers is learnt from tags of earlier scans, a part of which are missing."""
    rows = corpus() + [(k % 9, f"r{k % 9}/src/h_{k}/hand{k}.py", f"# Reads the rows of h{k}\n" + HAND, k % 20 == 0) for k in range(60)]
    model = fit([Example(*r) for r in rows])
    r = model.report["content"]
    assert r["held_out"] and r["made_found"] == r["made"], model.report
    said = lambda h: model.header[header_grams(h)].sum() / len(header_grams(h)) ** 0.5 + model.header_bias > 0
    assert said("# Spat out by the frobnicator from zebra.tmpl, hands off") and not said("# Returns the page or nothing if the list is missing")
    assert header_of(["x = 1", "# Code generated by hand"]) == ["# Code generated by hand"]
    assert header_of(["#!/bin/sh", "", "/* a licence", "   of many", "   lines", "   and more", "*/", "package x", "// DO NOT EDIT", "x = 1"])[-1] == "// DO NOT EDIT"
    assert masked(["// a", "x", "// b"]) == "x" and masked(["// a", "x", "// b"], first=False) == "// a\nx"
    assert seed_label(Example(1, "r/src/a/notes.py", HAND, True)) == (-1, False)


def test_no_header_wording_of_the_test_data_is_in_the_module():
    """No opening comment of the test data's files, names and numbers aside, stands in the module's text."""
    import inspect
    import re
    from pathlib import Path

    import pyarrow.parquet as pq

    from quillmill.llm import abuse, origin, secrets

    path = Path("/root/testdata/sf0.01/chunks.parquet")
    if not path.exists():
        pytest.skip("no test data here")
    words = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    runs = set()
    for t in pq.read_table(path, columns=["content"]).column(0).to_pylist():
        for line in header_of(t.split("\n")):
            w = words(line)
            runs.update(" ".join(w[i : i + 5]) for i in range(len(w) - 4))
    for module in (abuse, origin, secrets):
        w = words(inspect.getsource(module))
        shared = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} & runs
        assert not shared, (module.__name__, shared)


def test_origin_table(spark):
    rows = corpus(40)
    files = [(f"f{i}", r, "x", "py", None, p, len(t), ["generated"] if tagged else None, None, None) for i, (r, p, t, tagged) in enumerate(rows)]
    files += [files[0], ("n", None, None, None, None, "q/vendor/l/x.py", None, None, None, None), (None, 1, None, None, None, "x", 1, None, None, None), ("z", 1, None, None, None, None, 1, None, None, None)]
    chunks = [(f"f{i}", 1, 0, 1, t, None) for i, (_, _, t, _) in enumerate(rows)] + [("f0", 1, None, None, None, None), (None, 1, 0, 1, "x", None)]
    scores, report = made_scores(spark.createDataFrame(files, FILES), spark.createDataFrame(chunks, CHUNKS))
    got = {r["file_id"]: r["made"] for r in scores.collect()}
    assert set(got) == {f"f{i}" for i in range(len(rows))} | {"n"}
    right = sum(got[f"f{i}"] == (i % 4 != 0) for i in range(len(rows)))
    assert right / len(rows) > 0.95 and report["content"]["train"] > 0
    empty, _ = made_scores(spark.createDataFrame([], FILES), spark.createDataFrame([], CHUNKS))
    assert empty.count() == 0
