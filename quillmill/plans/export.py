"""From a folder or a table of files to artifacts: scan, rank, cut, redact, split, pack, write."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..operators import account, budget, classify, graph, redact, render, retrieve, split, store
from ..operators.render import report_text
from ..operators.impact import is_test_path
from ..operators.scope import lock_summary
from ..sources.config import Config
from ..sources.files import read_tree
from ..session import checkpointed


def scan(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """One row for each file found, with its reason, priority and tags."""
    files = read_tree(spark, root, config.follow_symlinks, config.use_ignore_files)
    excluded = "|".join(classify.glob_to_regex(g) for g in config.exclude_globs) or None
    reason = F.coalesce("skipped", classify.disposition("path", "size_bytes", "content", config.include_extensions, excluded, config.max_file_bytes, config.include_minified, special=True))
    ranked = classify.rank_files(files.withColumn("reason", reason), "path", "content")
    doc = classify.rank_signals("path")
    return ranked.withColumnRenamed("rank_priority", "priority").withColumnRenamed("rank_tags", "tags").withColumns({"is_readme": doc["readme"], "is_config": doc["config"], "is_doc": doc["doc"], "content_hash": F.sha2("content", 256)})


def chunk(files: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """``chunks`` and ``occurrences``: redaction comes first, so that fingerprints and offsets are those of the redacted text."""
    redacted = redact.redact_tracked(files.withColumn("id", F.col("path")), "id", "content", "language", "path", redact.Redaction(mode=config.redaction_mode, skip_files="|".join(classify.glob_to_regex(g) for g in config.skip_redaction) or None))
    redacted = checkpointed(redacted)
    meta = files.select(F.col("path").alias("id"), "language", "priority", F.col("tags").alias("file_tags"), "size_bytes")
    whole = redacted.join(meta, "id")
    lock = F.array_contains("file_tags", "lock-file")
    texts = whole.select(F.col("id").alias("path"), F.when(lock, "text").otherwise(F.col("language")).alias("language"), F.when(lock, lock_summary("id", "size_bytes")).otherwise(F.col("content")).alias("content"), "priority")
    pieces = split.enrich(split.split_files(texts, priority_col="priority", most=config.chunk_tokens, overlap=config.chunk_overlap, least=config.min_chunk_tokens))
    tagged = pieces.join(meta.select(F.col("id").alias("path"), "file_tags", F.col("language").alias("own")), "path").withColumn("tags", F.array_sort(F.array_union("tags", "file_tags"))).withColumn("language", F.col("own")).drop("file_tags", "own")
    sha = redacted.select(F.col("id").alias("path"), F.sha2("content", 256).alias("file_sha256"))
    chunks = tagged.join(sha, "path").withColumns({"file_path": F.col("path"), "byte_start": F.when(F.array_contains("tags", "lock-file"), F.lit(None).cast("bigint")).otherwise(F.col("byte_start")), "byte_end": F.when(F.array_contains("tags", "lock-file"), F.lit(None).cast("bigint")).otherwise(F.col("byte_end"))}).drop("path")
    occurrences = redacted.select(F.col("id").alias("path"), F.explode("occurrences").alias("o")).select("path", "o.*")
    return chunks, occurrences


def export(spark: SparkSession, root: str, out: str, config: Config = Config(), task: str | None = None, title: str = "repository") -> dict:
    """Writes ``chunks.jsonl/``, ``context_pack.md`` and ``report.json`` to a folder; the report is returned."""
    files = checkpointed(scan(spark, root, config))
    ranked = budget.byte_budget(files.where("reason = 'included_full'"), config.max_total_bytes)
    included = checkpointed(ranked)
    kept = included.where("kept").drop("kept")
    chunks, occurrences = chunk(kept, config)
    chunks = checkpointed(chunks)
    score = "priority"
    if task:
        plan = retrieve.plan(chunks, kept.select("path", "is_readme", "is_config", "tags", "priority"), graph.import_edges(kept), task)
        chunks = checkpointed(chunks.join(plan.select("id", "score", "depth", "reasons"), "id", "left").withColumn("score", F.coalesce("score", F.lit(-1.0))))
        score = "score"
    if config.max_tokens is not None:
        chosen = budget.token_budget(chunks, config.max_tokens, score)
        chunks = checkpointed(chunks.join(chosen.select("id"), "id", "left_semi"))
    render.write_jsonl(chunks, f"{out}/chunks.jsonl", [F.desc(score), F.asc("file_path"), F.asc("start_line"), F.asc("id")], evidence=bool(task))
    render.write_atomic(f"{out}/context_pack.md", render.pack_text(render.context_pack(chunks, kept, title, task=redact.Redactor().redact(task)[0] if task else None)))
    dropped = included.where("NOT kept").select("path", F.lit("dropped_byte_budget").alias("reason"))
    from ..operators.account import rag_dispositions

    taken = rag_dispositions(kept, chunks)
    dispositions = files.where("reason <> 'included_full'").select("path", "reason").union(dropped).union(taken)
    report = render.report(kept, chunks, dispositions, asdict(config) | ({"task_sha256": retrieve.task_fingerprint(task)} if task else {}))
    held = account.occurrences_in_chunks(chunks.where("byte_start IS NOT NULL").select(F.col("file_path").alias("path"), F.col("byte_start").alias("start"), F.col("byte_end").alias("end")).distinct(), occurrences.select("path", "rule", F.col("start_byte").alias("start"), F.col("end_byte").alias("end")))
    report["redactions_emitted"] = {r["rule"]: r["occurrences"] for r in held.collect()}
    report["manifests"] = manifests(kept)
    report["redactions"] = {r["rule"]: r["n"] for r in occurrences.groupBy("rule").agg(F.count("*").alias("n")).collect()}
    render.write_atomic(f"{out}/report.json", render.report_text(report))
    return report


def manifests(files: DataFrame) -> dict:
    """Name, description and scripts of the root manifest, its texts redacted."""
    rows = files.where(F.col("path").isin("package.json", "pyproject.toml", "Cargo.toml")).select("path", "content").collect()  # three at most
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["path"]):
        try:
            data = json.loads(r["content"]) if r["path"].endswith(".json") else tomllib.loads(r["content"])
        except ValueError:
            continue
        table = data if r["path"] == "package.json" else data.get("project" if r["path"] == "pyproject.toml" else "package", {})
        out[r["path"]] = redact.redact_values({k: table[k] for k in ("name", "description", "scripts", "version") if k in table})
    return out


def info(spark: SparkSession, root: str) -> dict:
    """Languages, counts and the ten files that matter most."""
    files = checkpointed(scan(spark, root, Config()))
    kept = files.where("reason = 'included_full'")
    return {
        "languages": {r["language"]: r["n"] for r in kept.groupBy("language").agg(F.count("*").alias("n")).collect()},
        "reasons": {r["reason"]: r["n"] for r in files.groupBy("reason").agg(F.count("*").alias("n")).collect()},
        "top": [r["path"] for r in kept.orderBy(F.desc("priority"), "path").limit(10).collect()],
        "tests": kept.where(is_test_path("path")).count(),
        "named": sorted({r["n"] for r in kept.where("is_config").select(base_name("path").alias("n")).collect()}),
    }


def build_index(spark: SparkSession, root: str, where: str, config: Config) -> dict:
    """Builds or refreshes the index of a folder; texts are always redacted. Counts by action."""
    files = checkpointed(scan(spark, root, config).where("reason = 'included_full'"))
    narrow = files.select("path", "language", "size_bytes", "priority", "tags", "content_hash", "is_readme", "is_config", "is_doc", "content")
    fingerprint = split.fingerprint_config(asdict(config))
    stored = store.Index(spark, where)
    return stored.refresh(narrow, lambda f: chunk(f, config)[0], graph.import_edges(files), root_key(root), fingerprint)


def root_key(root: str) -> str:
    return hashlib.sha256(os.path.realpath(root).encode()).hexdigest()
