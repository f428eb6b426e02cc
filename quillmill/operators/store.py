"""A snapshot index of a corpus in Parquet: validated on opening, refreshed by difference, committed by one pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION, CHUNK_VERSION = "1", "chunk-v1"
TABLES = ("files", "chunks", "imports", "symbols")


class IndexError_(ValueError):
    """The index is of another root, schema or configuration kind and can't be used."""


def refresh_plan(current: DataFrame, stored: DataFrame, key: str = "path", fingerprint: str = "content_hash", config_changed: bool = False) -> DataFrame:
    """``key, action``: reused, updated, added or removed for every path of either side. One full outer join on the key."""
    a = current.select(F.col(key).alias("key"), F.col(fingerprint).alias("now")).dropDuplicates(["key"])
    b = stored.select(F.col(key).alias("key"), F.col(fingerprint).alias("was"), F.lit(True).alias("known")).dropDuplicates(["key"])
    joined = a.withColumn("present", F.lit(True)).join(b, "key", "full_outer")
    action = F.when(F.col("present").isNull(), "removed").when(F.col("known").isNull(), "added").when(F.lit(config_changed) | ~F.col("now").eqNullSafe(F.col("was")), "updated").otherwise("reused")
    return joined.select("key", action.alias("action"))


class Index:
    """One directory: ``v-<id>/`` snapshots of the tables and ``current-<n>.json``, the highest of which names the one that counts."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        return self.spark.read.option("wholetext", True).text(f"{self.root}/{name}").first()[0]

    def _write(self, name: str, text: str) -> None:
        temporary, final = self._path(f"{self.root}/{name}.{uuid.uuid4().hex}"), self._path(f"{self.root}/{name}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.rename(temporary, final)

    def manifest(self) -> dict | None:
        last = self._numbers()[-1:]
        return json.loads(self._read(f"current-{last[0]:012d}.json")) if last else None

    def _numbers(self) -> list[int]:
        """Numbers of the manifests, in order: the highest counts. One is never replaced, so there is always a whole one."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[8:-5]) for n in names if n.startswith("current-") and n.endswith(".json") and n[8:-5].isdigit())

    def open(self, root_key: str, config: str) -> tuple[dict | None, bool]:
        """The manifest, and whether the configuration has changed since; another root, schema or raw text is refused."""
        m = self.manifest()
        if m is None:
            return None, False
        if m["schema"] != SCHEMA_VERSION or m["chunker"] != CHUNK_VERSION:
            raise IndexError_(f"index schema {m['schema']}/{m['chunker']} is not {SCHEMA_VERSION}/{CHUNK_VERSION}")
        if m["root"] != root_key:
            raise IndexError_("the index belongs to another root")
        if not m.get("redacted"):
            raise IndexError_("the index holds text that was not redacted")
        return m, m["config"] != config

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.manifest()['snapshot']}/{name}")

    def load_chunks(self) -> DataFrame:
        return self.table("chunks").orderBy("file_path", "start_line", "end_line", "id")

    def commit(self, tables: dict[str, DataFrame], root_key: str, config: str) -> dict:
        """Writes a new snapshot beside the old one and then turns the pointer; a failure on the way leaves the old one."""
        snapshot = f"v-{uuid.uuid4().hex}"
        for name in TABLES:
            if name in tables:
                tables[name].write.parquet(f"{self.root}/{snapshot}/{name}")
        manifest = {"schema": SCHEMA_VERSION, "chunker": CHUNK_VERSION, "root": root_key, "config": config, "redacted": True, "snapshot": snapshot}
        number = (self._numbers() or [0])[-1] + 1
        self._write(f"current-{number:012d}.json", json.dumps(manifest, sort_keys=True))
        return manifest

    def refresh(self, files: DataFrame, make_chunks, imports: DataFrame, root_key: str, config: str) -> dict:
        """Counts by action. ``make_chunks`` gets the files that are new or changed; chunks of the others are kept as stored."""
        m, changed = self.open(root_key, config)
        if m is None:
            chunks = make_chunks(files)
            counts = {"added": files.select("path").distinct().count()}
        else:
            plan = refresh_plan(files, self.table("files"), config_changed=changed)
            counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
            stale = plan.where("action IN ('added', 'updated')").select(F.col("key").alias("path"))
            kept = plan.where("action = 'reused'").select(F.col("key").alias("file_path"))
            chunks = self.table("chunks").join(kept, "file_path", "left_semi").unionByName(make_chunks(files.join(stale, "path", "left_semi")))
        self.commit({"files": files, "chunks": chunks, "imports": imports, "symbols": symbol_rows(chunks)}, root_key, config)
        return {k: counts.get(k, 0) for k in ("reused", "added", "updated", "removed")}


def symbol_rows(chunks: DataFrame) -> DataFrame:
    """``name, kind, chunk_id`` of the symbols in the chunks' tags."""
    pairs = chunks.select(F.col("id").alias("chunk_id"), F.explode(F.coalesce("tags", F.array().cast("array<string>"))).alias("t")).where(F.col("t").rlike(r"^(def|type|impl|class|method|function):."))
    return pairs.select(F.split("t", ":", 2)[1].alias("name"), F.split("t", ":", 2)[0].alias("kind"), "chunk_id").distinct()
