"""Projects of the Godot engine: sectioned settings, scripts, scenes, shaders, and how they relate."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RES = re.compile(r"[\"'](res://[^\"']+)[\"']")
_ATTRIBUTE = re.compile(r"(\w+)=(?:\"([^\"]*)\"|(\w+)\(\s*\"([^\"]*)\"\s*\)|([^\s\]]+))")
_ACTION = re.compile(r"(?:is_action\w*|get_action_strength|action_press|action_release|get_axis|get_vector)\s*\(([^)]*)\)")
_INCLUDE = re.compile(r"#include\s+\"([^\"]+)\"")
ASSETS = ("image_asset", "model_asset", "audio_asset", "godot_uid", "godot_import", "godot_binary_resource")
TEST_RUNNERS = ("gut_cmdln.gd", "GdUnitCmdTool.gd", "--headless")


def _bare(value: str) -> str:
    return value.strip().strip('"')


def parse_project(text: str) -> dict:
    """``main_scene, features, autoloads, input_actions, plugins, config_version`` and the settings of known sections."""
    out: dict = {"config_version": None, "main_scene": None, "features": [], "autoloads": {}, "input_actions": [], "plugins": [], "rendering": {}, "display": {}, "physics": {}, "internationalization": {}, "layer_names": {}}
    section = ""
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line[0] in ";#":
            continue
        if line[0] == "[" and line[-1] == "]":
            section = line[1:-1]
            continue
        key, equals, value = line.partition("=")
        if not equals:
            continue
        key, value = key.strip(), value.strip()
        if section == "" and key == "config_version":
            out["config_version"] = _bare(value)
        elif section == "application" and key == "run/main_scene":
            out["main_scene"] = _bare(value)
        elif section == "application" and key == "config/features":
            out["features"] = re.findall(r'"([^"]*)"', value)
        elif section == "autoload":
            out["autoloads"][key] = _bare(value).lstrip("*")
        elif section == "input":
            out["input_actions"].append(key)
        elif section == "editor_plugins" and key == "enabled":
            out["plugins"] = re.findall(r'"([^"]*)"', value)
        else:
            for name in ("rendering", "display", "physics", "internationalization", "layer_names"):
                if section.startswith(name) or name == "layer_names" and name in section:
                    out[name][key] = _bare(value)
    out["input_actions"] = sorted(set(out["input_actions"]))
    return out


_DECLARED = (("signals", r"signal\s+(\w+)"), ("enums", r"enum\s+(\w+)"), ("constants", r"const\s+(\w+)"), ("methods", r"(?:static\s+)?func\s+(\w+)"), ("inner_classes", r"class\s+(\w+)"), ("exported", r"@export\w*(?:\([^)]*\))?\s+var\s+(\w+)"), ("onready", r"@onready\s+var\s+(\w+)"))


def parse_script(text: str) -> dict:
    """What a script extends, is named, declares, loads and listens to."""
    out: dict = {"extends": None, "class_name": None, "references": list(dict.fromkeys(_RES.findall(text)))}
    if m := re.search(r"(?m)^\s*extends\s+(.+?)\s*$", text):
        out["extends"] = _bare(m[1])
    if m := re.search(r"(?m)^\s*class_name\s+(\w+)", text):
        out["class_name"] = m[1]
    for name, pattern in _DECLARED:
        out[name] = list(dict.fromkeys(re.findall(rf"(?m)^\s*{pattern}", text)))
    out["static_methods"] = list(dict.fromkeys(re.findall(r"(?m)^\s*static\s+func\s+(\w+)", text)))
    out["members"] = list(dict.fromkeys(re.findall(r"(?m)^(?:@\w+(?:\([^)]*\))?\s+)?var\s+(\w+)", text)))
    out["input_actions"] = list(dict.fromkeys(a for body in _ACTION.findall(text) for a in re.findall(r'"([^"]+)"', body)))
    return out


def parse_scene(text: str) -> dict:
    """External resources by id, nodes with their scripts and instances, connections of signals."""
    resources: dict[str, dict] = {}
    nodes: list[dict] = []
    connections: list[dict] = []
    node: dict | None = None
    for raw in text.splitlines():
        line = raw.strip()
        if line.startswith("["):
            head = line[1:].split(None, 1)[0].rstrip("]")
            values = {m[0]: m[1] or m[3] or m[4] for m in _ATTRIBUTE.findall(line)}
            node = None
            if head == "ext_resource" and values.keys() >= {"path", "id"}:
                resources[values["id"]] = {"path": values["path"], "type": values.get("type", "")}
            elif head == "node":
                node = {"name": values.get("name", ""), "type": values.get("type"), "parent": values.get("parent"), "script": None, "instance": resources.get(values.get("instance", ""), {}).get("path")}
                nodes.append(node)
            elif head == "connection":
                connections.append({k: values.get(k) for k in ("signal", "from", "to", "method")})
        elif node is not None and (m := re.match(r"script\s*=\s*ExtResource\(\s*\"?([^\")]+)\"?\s*\)", line)):
            node["script"] = resources.get(m[1].strip(), {}).get("path")
    return {"resources": resources, "nodes": nodes, "connections": connections}


def parse_shader(text: str) -> dict:
    return {
        "type": (re.search(r"shader_type\s+(\w+)", text) or [None, None])[1],
        "includes": list(dict.fromkeys(_INCLUDE.findall(text))),
        "uniforms": list(dict.fromkeys(re.findall(r"(?m)^\s*(?:global\s+|instance\s+)?uniform\s+\w+\s+(\w+)", text))),
        "functions": list(dict.fromkeys(re.findall(r"(?m)^\s*(?:void|float|int|bool|vec[234]|mat[234])\s+(\w+)\s*\(", text))),
    }


_STAGE = "source string, kind string, target string, class_name string"


def _relate(autoloads: list[str]):
    patterns = [(a, re.compile(rf"\b{re.escape(a)}\b")) for a in autoloads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, language, text, is_test in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if language == "gdscript":
                    s = parse_script(text)
                    if s["class_name"]:
                        rows.append((path, "_class", path, s["class_name"]))
                    if s["extends"]:
                        rows.append((path, "script_extends_script" if s["extends"].startswith("res://") else "_extends", s["extends"], None))
                    rows += [(path, "test_references" if is_test else "script_loads", t, None) for t in s["references"]]
                    rows += [(path, "script_uses_autoload", a, None) for a, p in patterns if p.search(text)]
                elif language in ("godot_scene", "godot_resource"):
                    s = parse_scene(text)
                    rows += [(path, "scene_attaches_script", n["script"], None) for n in s["nodes"] if n["script"]]
                    rows += [(path, "scene_instantiates_scene", n["instance"], None) for n in s["nodes"] if n["instance"]]
                    rows += [(path, "scene_references_resource", r["path"], None) for r in s["resources"].values()]
                elif language in ("godot_shader", "godot_shader_include"):
                    rows += [(path, "shader_includes", t, None) for t in parse_shader(text)["includes"]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["source", "kind", "target", "class_name"])

    return run


def relationships(files: DataFrame, project: str | None) -> DataFrame:
    """``source, kind, target, resolved`` of a project. Columns: path, language, content, is_test; ``project`` is the text of
    its settings. Named parents are found by class name; a target in the project is resolved if it is a file."""
    spark = files.sparkSession
    settings = parse_project(project or "")
    rows = files.where("content IS NOT NULL").select("path", "language", "content", F.coalesce("is_test", F.lit(False)).alias("is_test"))
    found = rows.mapInArrow(_relate(sorted(settings["autoloads"])), _STAGE)
    classes = found.where("kind = '_class'").groupBy("class_name").agg(F.max("target").alias("file"))
    parents = found.where("kind = '_extends'").join(classes.withColumnRenamed("class_name", "name"), F.col("target") == F.col("name")).select("source", F.lit("script_extends_script").alias("kind"), F.col("file").alias("target"))
    own = [("project.godot", f"project_autoload:{n}", t) for n, t in settings["autoloads"].items()]
    if settings["main_scene"]:
        own.append(("project.godot", "project_main_scene", settings["main_scene"]))
    every = found.where("kind NOT LIKE '\\_%'").select("source", "kind", "target").union(parents).union(spark.createDataFrame(own, "source string, kind string, target string")).distinct()
    known = files.select(F.concat(F.lit("res://"), "path").alias("target"), F.lit(True).alias("known")).distinct()
    return every.join(known, "target", "left").select("source", "kind", "target", (F.col("known").isNotNull() | ~F.col("target").startswith("res://")).alias("resolved"))


def summary(files: DataFrame, project: str | None) -> dict:
    """Counts of the project's parts."""
    kinds = {r["language"]: r["n"] for r in files.groupBy("language").agg(F.count("*").alias("n")).collect()}
    return {"scripts": kinds.get("gdscript", 0), "scenes": kinds.get("godot_scene", 0), "resources": kinds.get("godot_resource", 0), "shaders": kinds.get("godot_shader", 0) + kinds.get("godot_shader_include", 0), "assets": {k: n for k, n in sorted(kinds.items(), key=str) if k in ASSETS}, "project": parse_project(project or "")}


def test_commands(files: DataFrame) -> DataFrame:
    """``path, command``: lines that run the project's tests without a window."""
    lines = files.where("content IS NOT NULL").select("path", F.explode(F.split("content", "\n")).alias("line"))
    return lines.where(F.col("line").contains("godot") & (F.col("line").contains(TEST_RUNNERS[0]) | F.col("line").contains(TEST_RUNNERS[1]) | F.col("line").contains(TEST_RUNNERS[2]))).select("path", F.trim("line").alias("command")).distinct()


def detect(paths: DataFrame) -> bool:
    return not paths.where("path = 'project.godot'").isEmpty()


def as_json(value: dict) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False)
