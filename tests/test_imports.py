from quillmill.operators.graph import go_edges, import_edges
from quillmill.operators.imports import candidates, engine_paths, go_packages, python_modules, rust_items, script_modules, scripts
from quillmill.operators.scope import class_names


def test_scripts():
    text = '// import "no"\nimport a, { b as c } from "./a"\nimport "./side.css"\nexport * from \'./e\'; export { x } from "./x"\nconst y = require("./y"); const z = await import(`./z`)\nlet from = "q"; import * as n from "pkg"; foo.require("./m"); /* import "no" */ s = "import \'no\'"\nimport type { T } from "./t"\n'
    assert script_modules(text) == ["./a", "./side.css", "./e", "./x", "./y", "./z", "pkg", "./t"]
    assert scripts('<p>x</p><script lang="ts">import "./a"</script><script>b</script>') == ['import "./a"', "b"]
    assert next(candidates("src/m.ts", "typescript", 'import x from "../u/v"'))[:2] == ["u/v.ts", "u/v.tsx"]


def test_python():
    text = 'import os, a.b as c\nfrom . import x, y as z\nfrom ..p.q import (\n    m,\n    n,  # no\n)\n"""\nimport no\n"""\nif t: import late\nx = 1; from k import *\n'
    assert python_modules(text) == [("os", []), ("a.b", []), (".", ["x", "y"]), ("..p.q", ["m", "n"]), ("late", []), ("k", ["*"])]
    assert list(candidates("a/b/c.py", "python", "from ..d import e"))[0][0] == "a/d.py"


def test_rust_and_go():
    modules, uses = rust_items('mod a;\n#[cfg(test)]\nmod t;\n#[path = "odd.rs"]\npub(crate) mod o;\nuse crate::{x::Y, z as w, self};\nuse std::io;\nuse super::k::*; // use crate::no;\nmod inline { }\n')
    assert modules == [("a", None), ("o", "odd.rs")]
    assert uses == [["crate", "x", "Y"], ["crate", "z"], ["crate", "self"], ["super", "k", "*"]]
    assert go_packages('package m\n\nimport "fmt"\nimport (\n\tx "a/b" // no\n\t_ "c"\n)\n\nfunc f() { s := "import" }\n') == ["fmt", "a/b", "c"]
    assert engine_paths('load("res://a/b.gd") # "res://no"') == ["a/b.gd"]


def test_edges(spark):
    rows = [("go.mod", "text", "module ex.org/m\n"), ("main.go", "go", 'package main\nimport "ex.org/m/lib"\n'), ("lib/a.go", "go", "package lib\n"), ("lib/b.go", "go", "package lib\n"), ("a.py", "python", "import b\n"), ("b.py", "python", ""), ("n.py", None, None)]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    assert {tuple(r) for r in import_edges(files).collect()} == {("main.go", "lib/a.go"), ("main.go", "lib/b.go"), ("a.py", "b.py")}
    assert go_edges(files.where("path <> 'go.mod'")).count() == 0


def test_class_names():
    text = '<a class="one two"><b className={"three"}><c className={`four btn-${x} ${y} end`} data-class="no"><d class = "(five)"><e className={style.no}>'
    assert class_names(text) == {"one", "two", "three", "four", "btn-", "end", "five"}
