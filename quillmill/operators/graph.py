"""Import graphs: what a file imports, which file that is, and walks over the edges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .imports import candidates, go_packages, rust_items


def _extractor() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for k, tries in enumerate(candidates(path, language or "", text)):
                    rows += [(path, k, r, c) for r, c in enumerate(tries)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["src", "spec", "rank", "dst"])

    return run


def import_edges(files: DataFrame, path_col: str = "path", language_col: str = "language", text_col: str = "content") -> DataFrame:
    """``src, dst``: each import with the first of its candidates that is a file, and those of Go modules. One equi-join on the path."""
    rows = files.where(F.col(path_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(path_col).alias("path"), F.col(language_col).alias("language"), F.col(text_col).alias("content"))
    tries = rows.mapInArrow(_extractor(), "src string, spec bigint, rank bigint, dst string")
    known = files.select(F.col(path_col).alias("dst")).distinct()
    found = tries.join(known, "dst", "left_semi").groupBy("src", "spec").agg(F.min_by("dst", "rank").alias("dst")).where("src <> dst").select("src", "dst")
    return found.union(go_edges(files, path_col, text_col)).distinct()


def _go_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(path, spec) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for spec in dict.fromkeys(go_packages(text))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["src", "spec"])


def module_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, language, module`` of what Go files import and what Rust files use of their own crate."""
    for batch in batches:
        rows = []
        for key, language, text in zip(*(c.to_pylist() for c in batch.columns)):
            found = go_packages(text) if language == "go" else ["::".join(u) for u in rust_items(text)[1]]
            rows += [(key, language, m) for m in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["id", "language", "module"])


def go_modules(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """``root, module`` of every go.mod: the folder it lies in, with its slash, and the module it names."""
    mods = files.where((F.col(path_col) == "go.mod") | F.col(path_col).endswith("/go.mod"))
    return mods.select(F.regexp_replace(path_col, r"go\.mod$", "").alias("root"), F.regexp_extract(text_col, r"(?m)^module\s+(\S+)", 1).alias("module")).where("module <> ''")


def go_edges(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """``src, dst`` of Go modules: an import of a package of the module is an import of each of its files."""
    go = files.where(F.col(path_col).endswith(".go") & F.col(text_col).isNotNull()).select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    specs = go.mapInArrow(_go_reader, "src string, spec string")
    # A module's name is a beginning of the import's path: all beginnings are joined by equality, the longest stands.
    parts = F.split("spec", "/")
    heads = specs.select("src", "spec", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("module"))
    package = F.regexp_replace(F.concat("root", F.expr("substring(spec, length(module) + 2)")), "/$", "")
    named = heads.join(go_modules(files, path_col, text_col), "module").where(F.col("src").startswith(F.col("root"))).select("src", package.alias("package"))
    target = go.select(F.col("path").alias("dst"), F.regexp_replace("path", r"/?[^/]*$", "").alias("package"))
    return named.distinct().join(target, "package").where("src <> dst").select("src", "dst").distinct()


def incoming(edges: DataFrame) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("incoming"))


def distances(starts: DataFrame, edges: DataFrame, most_hops: int = 16, most_nodes: int | None = None, start_col: str = "node") -> DataFrame:
    """``start, node, distance``: breadth first from each start, over each node once; cycles end it.

    ``most_nodes`` keeps the nearest nodes of each start (ties by name), with ``truncated`` where there were more. The
    frontier is joined to the edges by key and checkpointed, so that lineage stays short and a lost executor costs a step.
    """
    pairs = edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b")).distinct()
    reached = checkpointed(starts.select(F.col(start_col).alias("start"), F.col(start_col).alias("node"), F.lit(0).cast("bigint").alias("distance")).distinct())
    frontier = reached
    for hop in range(1, most_hops + 1):
        step = frontier.join(pairs, F.col("node") == F.col("_a")).select("start", F.col("_b").alias("node")).distinct()
        frontier = checkpointed(step.join(reached, ["start", "node"], "left_anti").withColumn("distance", F.lit(hop).cast("bigint")))
        if frontier.isEmpty():
            break
        reached = checkpointed(reached.union(frontier))
        if most_nodes is not None:
            # A start that has more than it may keep goes no further: what lies beyond is farther away.
            open_starts = reached.where("distance > 0").groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") <= most_nodes)
            frontier = frontier.join(open_starts.select("start"), "start", "left_semi")
    if most_nodes is None:
        return reached
    order = Window.partitionBy("start").orderBy("distance", "node")
    counted = reached.where("distance > 0").withColumns({"_rank": F.row_number().over(order), "_all": F.count("*").over(Window.partitionBy("start"))})
    return counted.where(F.col("_rank") <= most_nodes).select("start", "node", "distance", (F.col("_all") > most_nodes).alias("truncated"))


REASONS = ("selected", "entry_path", "outbound_dependency", "caller", "related_test", "crate_fallback", "runtime_module", "css_scope")


def focus_scope(candidates: DataFrame) -> DataFrame:
    """``path, reason`` from (path, reason) candidates: the first reason in the fixed order stands."""
    order = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    return candidates.groupBy("path").agg(F.min_by("reason", order).alias("reason"))


def file_scope(entry: str, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Scope of one file: itself, all it depends on, its direct callers, its related tests."""
    from .retrieve import related_tests

    spark = edges.sparkSession
    start = spark.createDataFrame([(entry,)], "path string")
    deps = distances(start.withColumnRenamed("path", "node"), edges).where("distance > 0").select(F.col("node").alias("path"), F.lit("outbound_dependency").alias("reason"))
    callers = edges.where(F.col("dst") == entry).select(F.col("src").alias("path"), F.lit("caller").alias("reason"))
    tests = related_tests(start, files).select("path", F.lit("related_test").alias("reason"))
    own = start.select("path", F.lit("selected").alias("reason"))
    return focus_scope(own.union(deps).union(callers).union(tests).join(files.select("path").distinct(), "path", "left_semi"))


def folder_scope(folder: str, edges: DataFrame, files: DataFrame) -> DataFrame:
    """Scope of a folder: its files, what they import directly, and who imports them."""
    paths = files.select("path").distinct()
    inside = paths.where(F.col("path").startswith(folder + "/"))
    own = inside.select("path", F.lit("selected").alias("reason"))
    out = edges.join(inside.withColumnRenamed("path", "src"), "src", "left_semi").select(F.col("dst").alias("path"), F.lit("outbound_dependency").alias("reason"))
    into = edges.join(inside.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path"), F.lit("caller").alias("reason"))
    return focus_scope(own.union(out).union(into).join(paths, "path", "left_semi"))
