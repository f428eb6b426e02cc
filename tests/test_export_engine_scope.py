import json

from quillmill.operators import engine, scope
from quillmill.plans.export import export, info
from quillmill.sources.config import Config


def test_export(spark, tmp_path):
    root = tmp_path / "r"
    secret = "sk-" + "a1B2" * 8
    for name, text in {"README.md": "# Demo\n\nA page about the token refresh.\n", "src/main.py": f"def main():\n    key = '{secret}'\n    return key\n", "src/auth.py": "def refresh_token():\n    return 1\n", "docs/guide.md": "# Guide\ntext\n", "Cargo.lock": "# lock\n" + "x\n" * 200, "dist/x.js": "1", "pyproject.toml": "[project]\nname = 'x'\n", "data.bin": "\0"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    config = Config(chunk_tokens=200, chunk_overlap=20, min_chunk_tokens=80, include_extensions=(".py", ".md", ".toml", ".lock", ".js", ".bin"))
    report = export(spark, str(root), str(tmp_path / "out"), config)
    lines = [json.loads(x) for x in "\n".join(p.read_text() for p in sorted((tmp_path / "out" / "chunks.jsonl").glob("part-*"))).split("\n") if x]
    pack = (tmp_path / "out" / "context_pack.md").read_text()
    assert secret not in pack and all(secret not in json.dumps(x) for x in lines) and report["redactions"] == {"openai_key": 1}
    assert {x["path"] for x in lines} == {"README.md", "src/main.py", "src/auth.py", "docs/guide.md", "Cargo.lock", "pyproject.toml"}
    assert sum(report["dispositions"].values()) == 8 and report["dispositions"]["skipped_glob"] == 1 and report["dispositions"]["included_summary_only"] == 1
    assert all(0 <= x["chunk_index"] < x["chunks_in_file"] for x in lines)
    task = export(spark, str(root), str(tmp_path / "task"), Config(max_tokens=40), task="refresh token")
    assert task["stats"]["tokens"] <= 40
    assert info(spark, str(root))["top"][0] == "README.md"


def test_engine(spark):
    project = 'config_version=5\n[application]\nrun/main_scene="res://main.tscn"\n[autoload]\nSave="*res://scripts/save.gd"\n[input]\njump={}\n'
    rows = [("project.godot", "godot_project", project, False), ("main.tscn", "godot_scene", '[gd_scene]\n[ext_resource type="Script" path="res://scripts/player.gd" id="1"]\n[ext_resource type="PackedScene" path="res://gone.tscn" id="2"]\n[node name="P" type="Node"]\nscript = ExtResource("1")\n[node name="Q" parent="." instance=ExtResource("2")]\n', False), ("scripts/player.gd", "gdscript", "extends Base\nclass_name Player\nfunc go():\n\tSave.run()\n\tif Input.is_action_pressed(\"jump\"):\n\t\tload(\"res://data.json\")\n", False), ("scripts/base.gd", "gdscript", "class_name Base\n", False), ("tests/t.gd", "gdscript", "extends \"res://scripts/base.gd\"\nvar p = preload(\"res://scripts/player.gd\")\n", True), ("s.gdshader", "godot_shader", 'shader_type spatial;\n#include "res://inc.gdshaderinc"\n', None), ("x", None, None, None)]
    df = spark.createDataFrame(rows, "path string, language string, content string, is_test boolean")
    got = {(r["source"], r["kind"], r["target"], r["resolved"]) for r in engine.relationships(df, project).collect()}
    assert got == {
        ("main.tscn", "scene_attaches_script", "res://scripts/player.gd", True), ("main.tscn", "scene_instantiates_scene", "res://gone.tscn", False), ("main.tscn", "scene_references_resource", "res://scripts/player.gd", True), ("main.tscn", "scene_references_resource", "res://gone.tscn", False),
        ("scripts/player.gd", "script_loads", "res://data.json", False), ("scripts/player.gd", "script_uses_autoload", "Save", True), ("scripts/player.gd", "script_extends_script", "scripts/base.gd", True), ("tests/t.gd", "script_extends_script", "res://scripts/base.gd", True),
        ("tests/t.gd", "test_references", "res://scripts/base.gd", True), ("tests/t.gd", "test_references", "res://scripts/player.gd", True), ("s.gdshader", "shader_includes", "res://inc.gdshaderinc", False), ("project.godot", "project_main_scene", "res://main.tscn", True), ("project.godot", "project_autoload:Save", "res://scripts/save.gd", False),
    }
    assert engine.parse_script(rows[2][2])["input_actions"] == ["jump"] and engine.summary(df, project)["scripts"] == 3


def test_scope(spark):
    assert scope.class_names('<a class="x y"/><b className={`btn-${k} z`}/>') == {"x", "y", "z", "btn-"}
    css = spark.createDataFrame([("src/app.css", ".x { a: b }\n.q { c: d }\n.btn-big { e: f }\n@media p { .y { g: h } }")], "path string, content string")
    parts = spark.createDataFrame([('<a class="x"/><b className={`btn-${k}`}/>',), (None,)], "content string")
    assert scope.scoped_styles(css, parts).first()["content"] == ".x { a: b }\n\n.btn-big { e: f }\n\n"
    files = spark.createDataFrame([("src/app.tsx", "import './ui/../app.css'"), ("src/app.css", ""), ("styles.css", ""), ("other.css", "")], "path string, content string")
    assert {r["path"] for r in scope.style_files(files).collect()} == {"src/app.css", "styles.css"}
    names = scope.manifest_entrypoints({"pyproject.toml": "[project.scripts]\nx = 'a.b:main'", "package.json": '{"main": "./lib/i.js", "bin": {"q": "bin/q.js"}}', "Cargo.toml": "[package]\nname = 'c'"}, ["src/main.rs", "src/x.rs"])
    assert names == ("a/b.py", "a/b/__init__.py", "bin/q.js", "lib/i.js", "src/main.rs")
    tree = [r["path"] for r in scope.tree_rows(spark.createDataFrame([("b.txt",), ("a/c/d.py",), ("a/e.py",)], "path string")).orderBy("sort_key").collect()]
    assert tree == ["a", "a/c", "a/c/d.py", "a/e.py", "b.txt"]
    few = scope.focus_candidates(spark.createDataFrame([("a.py", "python"), ("b.py", "python")], "path string, language string"), spark.createDataFrame([("a.py", "b.py")], "src string, dst string"), ("python",))
    assert {(r["path"], r["imports"], r["used_by"]) for r in few.collect()} == {("a.py", 1, 0), ("b.py", 0, 1)}
