"""Ranking chunks for a task: BM25, seeds, neighbours over the import graph, related tests, repository anchors, one plan."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamped_priority, col, symbols_of, words
from ..session import checkpointed, spread

K1, B = 1.5, 0.75
MAX_SEEDS, MAX_SUPPORT_FILES, MAX_SUPPORT_CHUNKS = 64, 128, 128
DEPENDENCY_DECAY, IMPORTER_DECAY, TEST_DECAY, ANCHOR_DECAY = 0.65, 0.55, 0.45, 0.30


def task_words(task: str) -> list[str]:
    """The words of a task, as ``functions.text.words`` splits them."""
    spaced = re.sub(r"(?<=[a-z\d])(?=[A-Z])", " ", task)
    return [w.lower() for w in re.split(r"[^\w]+|_", spaced) if len(w) >= 2]


def bm25(docs: DataFrame, id_col: str, text_col: str, task: str, unique: bool = False) -> DataFrame:
    """``id, bm25`` of every document that holds a word of the task; repeated words of the task count again.

    Only the task's own words leave the exploding stage; corpus counts come from one aggregate beside it.
    """
    query = task_words(task)
    if not query:
        return docs.sparkSession.createDataFrame([], "id string, bm25 double").select(F.col("id"), "bm25").limit(0)
    docs = spread(docs.where(F.col(text_col).isNotNull()).select(id_col, text_col))
    tokenised = docs.select(F.col(id_col).alias("id"), words(text_col).alias("w")).select("id", F.size("w").alias("length"), F.filter("w", lambda x: x.isin(*sorted(set(query)))).alias("w"))
    # Read once: the corpus counts, the document counts and the scores all need it, and it is far smaller than the texts.
    # A row delivered twice counts once.
    tokenised = checkpointed(tokenised.dropDuplicates(["id"]) if unique else tokenised)
    corpus = tokenised.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("length")).alias("average"))
    tf = tokenised.select("id", "length", F.explode("w").alias("word")).groupBy("id", "length", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    weight = F.create_map(*[F.lit(x) for w in sorted(set(query)) for x in (w, float(query.count(w)))])
    # Both joined sides have at most one row a query word, and one row.
    scored = tf.join(F.broadcast(df), "word").crossJoin(F.broadcast(corpus))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    return scored.groupBy("id").agg(F.sum(part * weight[F.col("word")]).alias("bm25"))


SALTS = 16


def bm25_many(docs: DataFrame, id_col: str, text_col: str, tasks: DataFrame, task_col: str, task_text_col: str) -> DataFrame:
    """``task, id, bm25`` for many tasks in one pass: the tasks' words meet the documents' on the word."""
    q = tasks.where(F.col(task_text_col).isNotNull()).select(F.col(task_col).alias("task"), F.explode(words(task_text_col)).alias("word")).groupBy("task", "word").agg(F.count("*").alias("qn"))
    docs = spread(docs.where(F.col(text_col).isNotNull()).select(id_col, text_col))
    # Read once: lengths for the corpus counts, and each task word's uses. A word that a third of the documents hold is dealt
    # to several tasks wherever rows meet on it.
    tokenised = checkpointed(docs.select(F.col(id_col).alias("id"), words(text_col).alias("w")).select("id", F.size("w").alias("length"), "w"))
    corpus = tokenised.agg(F.count("*").alias("n"), F.greatest(F.lit(1.0), F.avg("length")).alias("average"))
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    salted = tokenised.select("id", "length", F.explode("w").alias("word")).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    tf = salted.groupBy("id", "length", "word", "_salt").agg(F.count("*").alias("tf")).join(q.select("word").distinct().withColumn("_salt", salts), ["word", "_salt"], "left_semi")
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    asked = q.join(df, "word").withColumn("_salt", salts)
    # The corpus counts are one row.
    part = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    scored = tf.join(asked, ["word", "_salt"]).crossJoin(F.broadcast(corpus)).select("task", "id", "qn", part.alias("part"))
    return scored.groupBy("task", "id").agg(F.sum(F.col("part") * F.col("qn")).alias("bm25"))


def overlap(query: list[str], found: Column) -> Column:
    """Share of the task's words, repeats counted, that an array holds."""
    if not query:
        return F.lit(0.0)
    hits = F.size(F.filter(F.array(*[F.lit(w) for w in query]), lambda w: F.array_contains(found, w)))
    return F.when(F.size(found) > 0, hits / len(query)).otherwise(0.0)


def seeds(chunks: DataFrame, task: str) -> DataFrame:
    """``id, path, start_line, score, reasons`` of the chunks the task speaks of. Columns: id, file_path, start_line, content, priority, tags.

    An id delivered again counts once; texts are read where they lie, only what is computed from them is shuffled."""
    query = task_words(task)
    scored = bm25(chunks, "id", "content", task, unique=True)
    best = scored.agg(F.max("bm25").alias("best"))
    symbol_words = F.flatten(F.transform(symbols_of("tags"), words))
    base = chunks.select("id", F.col("file_path").alias("path"), "start_line", clamped_priority("priority").alias("p"), overlap(query, words("file_path")).alias("path_overlap"), overlap(query, symbol_words).alias("symbol_overlap")).dropDuplicates(["id"])
    rows = base.join(scored, "id", "left").crossJoin(F.broadcast(best)).withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))
    normal = F.when(F.col("best") > 0, F.col("bm25") / F.col("best")).otherwise(0.0)
    return rows.where("bm25 > 0 OR path_overlap > 0 OR symbol_overlap > 0").select(
        "id",
        "path",
        "start_line",
        F.round(0.70 * normal + 0.20 * F.col("p") + 0.10 * F.greatest("path_overlap", "symbol_overlap"), 6).alias("score"),
        F.array_compact(F.array(F.when(F.col("path_overlap") > 0, "exact_path_match"), F.when(F.col("symbol_overlap") > 0, "symbol_definition"), F.when(F.col("bm25") > 0, "task_match"))).alias("reasons"),
    )


def neighbours(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``start, path, depth, reason, decay`` within two hops of the edges (src, dst), either way; the nearest hop of a reason stands.

    The decay is that of the last edge to the power of the depth. Joins on the edge keys only: no pair of starts meets.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("static_dependency").alias("reason"), F.lit(DEPENDENCY_DECAY).alias("step"))
    both = both.union(edges.select("dst", "src", F.lit("static_importer"), F.lit(IMPORTER_DECAY))).distinct()
    one = starts.select(F.col("path").alias("start")).distinct().join(both, F.col("start") == F.col("a")).select("start", F.col("b").alias("path"), F.lit(1).alias("depth"), "reason", F.col("step").alias("step"))
    two = one.select("start", F.col("path").alias("mid")).where("mid <> start").distinct().join(both, F.col("mid") == F.col("a")).select("start", F.col("b").alias("path"), F.lit(2).alias("depth"), "reason", "step")
    nearest = one.union(two).groupBy("start", "path", "reason").agg(F.min("depth").alias("depth"), F.any_value("step").alias("step"))
    return nearest.select("start", "path", F.col("depth").cast("bigint").alias("depth"), "reason", F.round(F.pow("step", "depth"), 9).alias("decay"))


def is_test_path(path: Column | str) -> Column:
    low = F.lower(col(path))
    return low.rlike(r"(^|/)tests?(/|$)") | low.contains("_test.") | low.contains(".test.")


def path_stem(path: Column | str) -> Column:
    name = F.substring_index(col(path), "/", -1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1"), r"(_test)+$", ""), r"(\.test)+$", ""))


def related_tests(starts: DataFrame, files: DataFrame) -> DataFrame:
    """``start, path``: tests whose stem contains, or is contained in, that of a source file, and the other way round.

    All starts count; callers hand over few (the seeds of a plan, the entry of a scope).
    """
    # The join may be broadcast or not, as sizes say; ``plan`` hands over its bounded seeds.
    s = starts.select(F.col("path").alias("start"), path_stem("path").alias("sa"), is_test_path("path").alias("ta")).distinct()
    f = files.select("path", path_stem("path").alias("sb"), is_test_path("path").alias("tb")).distinct()
    return f.join(s, (F.col("ta") != F.col("tb")) & (F.col("sa") != "") & (F.col("sb") != "") & (F.col("sa").contains(F.col("sb")) | F.col("sb").contains(F.col("sa")))).select("start", "path")


def plan(chunks: DataFrame, files: DataFrame, edges: DataFrame, task: str) -> DataFrame:
    """``id, path, start_line, score, depth, reasons`` of every chunk the task reaches: seeds and their support.

    ``files`` has path, is_readme, is_config, tags. Where no chunk speaks of the task, every chunk counts with its file's
    priority. Caps on seeds and support are features of the plan: the highest scores, ties by path.
    """
    all_seeds = checkpointed(seeds(chunks, task))
    # At most MAX_SEEDS rows.
    best_seeds = all_seeds.orderBy(F.desc("score"), "path", "start_line", "id").limit(MAX_SEEDS).collect()
    top = chunks.sparkSession.createDataFrame(best_seeds, all_seeds.schema)
    files = files.groupBy("path").agg(F.max("is_readme").alias("is_readme"), F.max("is_config").alias("is_config"), F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"), F.max("priority").alias("file_priority"))
    n = neighbours(top, edges).withColumnRenamed("path", "to")
    near = top.join(n, F.col("path") == F.col("start")).select(F.col("to").alias("path"), (F.col("score") * F.col("decay")).alias("score"), "depth", "reason")
    t = related_tests(top, files).withColumnRenamed("path", "to")
    tests = top.join(t, F.col("path") == F.col("start")).select(F.col("to").alias("path"), (F.col("score") * TEST_DECAY).alias("score"), F.lit(1).cast("bigint").alias("depth"), F.lit("related_test").alias("reason"))
    anchors = files.where(F.coalesce("is_readme", F.lit(False)) | F.coalesce("is_config", F.lit(False)) | F.array_contains("tags", "entrypoint")).select("path")
    best = top.agg(F.max("score").alias("score"))
    anchored = anchors.crossJoin(F.broadcast(best)).where("score IS NOT NULL").select("path", (F.col("score") * ANCHOR_DECAY).alias("score"), F.lit(1).cast("bigint").alias("depth"), F.lit("repository_anchor").alias("reason"))
    support = near.union(tests).union(anchored).join(files.select("path"), "path", "left_semi").groupBy("path", "depth", "reason").agg(F.max("score").alias("score"))
    ranked = support.withColumn("file_rank", F.max("score").over(Window.partitionBy("path")))
    chosen = ranked.select("path", "file_rank").distinct().orderBy(F.desc("file_rank"), "path").limit(MAX_SUPPORT_FILES)
    kept = ranked.join(F.broadcast(chosen.select("path")), "path", "left_semi")
    applied = chunks.select("id", F.col("file_path").alias("path"), "start_line").dropDuplicates(["id"]).join(kept, "path").orderBy(F.desc("score"), "path", "depth", "reason", "start_line", "id").limit(MAX_SUPPORT_CHUNKS)
    evidence = all_seeds.select("id", "path", "start_line", "score", F.lit(0).cast("bigint").alias("depth"), "reasons").union(applied.select("id", "path", "start_line", "score", "depth", F.array("reason").alias("reasons")))
    merged = evidence.groupBy("id").agg(F.min("path").alias("path"), F.min("start_line").alias("start_line"), F.round(F.max("score"), 6).alias("score"), F.min("depth").alias("depth"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    none = all_seeds.agg((F.count("*") == 0).alias("none"))
    fallback = chunks.dropDuplicates(["id"]).join(files.select(F.col("path").alias("file_path"), clamped_priority("file_priority").alias("fp")), "file_path", "left").crossJoin(F.broadcast(none)).where("none").select("id", F.col("file_path").alias("path"), "start_line", F.round(F.coalesce("fp", F.lit(0.0)), 6).alias("score"), F.lit(0).cast("bigint").alias("depth"), F.array().cast("array<string>").alias("reasons"))
    return merged.union(fallback)


def task_fingerprint(task: str) -> str:
    return hashlib.sha256(task.encode()).hexdigest()
