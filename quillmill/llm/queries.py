"""Queries of the training-data problems, by name, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .abuse import abuse_scores, source_rates
from .copies import collapse_copies, copy_pairs
from .garbled import garbled_lines, restored_chunks
from .leaks import leaked_items
from .origin import made_scores
from .packing import container_fill, pack_documents
from .pieces import rejoined, split_oversized
from .secrets import credential_spans, redact_credentials
from .syntax import GRAMMARS, invalid_rates, judged_files

Query = Callable[[SparkSession, str], DataFrame]


def p1_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every file with the scores of both classifiers."""
    return made_scores(table(spark, root, "files"), table(spark, root, "chunks"))[0]


def p1_validation(spark: SparkSession, root: str) -> DataFrame:
    """How both classifiers do on repositories that they weren't trained on."""
    report = made_scores(table(spark, root, "files"), table(spark, root, "chunks"))[1]
    names = ("train", "held_out", "right", "made", "made_found", "wrongly_found")
    return spark.createDataFrame([(part, *(int(r[n]) for n in names)) for part, r in sorted(report.items())], "classifier string, " + ", ".join(f"{n} bigint" for n in names))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """The files that weren't written by hand."""
    return p1_scores(spark, root).where("made").select("file_id")


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Every piece of every oversized chunk."""
    return split_oversized(table(spark, root, "chunks"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The chunks that were cut."""
    return p2_pieces(spark, root).where("piece_index = 0").select("chunk_id")


def p2_rejoined(spark: SparkSession, root: str) -> DataFrame:
    """What the pieces of each chunk make together, and whether limit and overlap hold."""
    return rejoined(p2_pieces(spark, root))


def p3_spans(spark: SparkSession, root: str) -> DataFrame:
    """Every live credential with its rule and byte span."""
    return credential_spans(table(spark, root, "chunks"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The lines on which a live credential begins."""
    return p3_spans(spark, root).select("chunk_id", "line_no").distinct()


def p3_redacted(spark: SparkSession, root: str) -> DataFrame:
    """The chunks that hold credentials, with placeholders in their place."""
    return redact_credentials(table(spark, root, "chunks"))


def p3_shapes(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk after redaction, by its shape: letters and digits drawn together, everything else as it is."""
    c = redact_credentials(table(spark, root, "chunks"), only_found=False)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", "[a-z]", "x"), "[A-Z]", "X"), "[0-9]", "0")
    return c.select("chunk_id", F.sha2(shape, 256).alias("shape"), F.length("content").cast("bigint").alias("characters"))


def p4_lines(spark: SparkSession, root: str) -> DataFrame:
    """Every garbled line with its mapping and, where it can be restored, the original."""
    return garbled_lines(table(spark, root, "chunks"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """The chunks that hold garbled text."""
    return p4_lines(spark, root).select("chunk_id").distinct()


def p4_restored(spark: SparkSession, root: str) -> DataFrame:
    """The chunks that hold garbled text, restored as far as possible."""
    return restored_chunks(table(spark, root, "chunks"))


def p5_records(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk with its record and the record's number of copies."""
    return collapse_copies(table(spark, root, "chunks"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Each record's further copies."""
    return copy_pairs(table(spark, root, "chunks"))


def p6_judged(spark: SparkSession, root: str) -> DataFrame:
    """Every judged file with what speaks against it."""
    return judged_files(table(spark, root, "files"), table(spark, root, "chunks"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """The files that don't parse."""
    return p6_judged(spark, root).where("NOT valid").select("file_id")


def p6_rates(spark: SparkSession, root: str) -> DataFrame:
    """Share of files that don't parse per repository and language."""
    return invalid_rates(table(spark, root, "files"), table(spark, root, "chunks"))


def p7_packed(spark: SparkSession, root: str) -> DataFrame:
    """Every text of the corpus in its container."""
    return pack_documents(table(spark, root, "documents"))


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers are, by their length."""
    return container_fill(p7_packed(spark, root))


def p7_checked(spark: SparkSession, root: str) -> DataFrame:
    """For every text whether its pieces cover its tokens without a gap, and whether its containers hold no more than they may."""
    packed = p7_packed(spark, root)
    full = packed.where("container_id IS NOT NULL").groupBy("container_id").agg((F.sum(F.col("token_end") - F.col("token_start")) <= F.max("container_tokens")).alias("fits"))
    per_doc = packed.join(full, "container_id", "left").groupBy("doc_id").agg(
        (F.min("token_start") == 0).alias("begins"), (F.sum(F.col("token_end") - F.col("token_start")) == F.max("token_end")).alias("covers"), F.min(F.coalesce("fits", F.lit(True))).alias("fits"), (F.max("container_tokens") <= 2048).alias("within")
    )
    return per_doc.select("doc_id", (F.col("begins") & F.col("covers")).alias("covered"), (F.col("fits") & F.coalesce("within", F.lit(True))).alias("fits"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the evaluation items they hold a passage of."""
    return leaked_items(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_items(spark: SparkSession, root: str) -> DataFrame:
    """Every evaluation item with the number of documents and sources that leak it."""
    items = table(spark, root, "eval_items").where("item_id IS NOT NULL").select("item_id", "suite").dropDuplicates(["item_id"])
    sources = table(spark, root, "documents").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("source").alias("source"))
    hits = p8_found(spark, root).join(sources, "doc_id").groupBy("item_id").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))
    return items.join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("sources", F.lit(0)).alias("sources"))


def p9_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every document with its score and the spans found."""
    return abuse_scores(table(spark, root, "documents"), table(spark, root, "content_labels"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """The documents with abusive, hateful or sexual language."""
    return p9_scores(spark, root).where("flagged").select("doc_id")


def p9_checked(spark: SparkSession, root: str) -> DataFrame:
    """For every document whether its score is one and its spans lie within its text, in order and apart."""
    ends = table(spark, root, "documents").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n"))
    s = p9_scores(spark, root).join(ends, "doc_id")
    inside = F.forall("spans", lambda x: (x["start"] >= 0) & (x["start"] < x["end"]) & (x["end"] <= F.col("n")))
    apart = F.forall(F.transform("spans", lambda x, i: F.coalesce(F.get("spans", i - 1)["end"] <= x["start"], F.lit(True))), lambda x: x)
    return s.select("doc_id", F.col("score").between(0, 1).alias("scored"), (inside & apart).alias("spans_hold"))


def p1_checked(spark: SparkSession, root: str) -> DataFrame:
    """For every file whether it is judged once and by what its scores say."""
    s = p1_scores(spark, root)
    return s.groupBy("file_id").agg((F.count("*") == 1).alias("once"))


def p6_checked(spark: SparkSession, root: str) -> DataFrame:
    """The verdicts on JSON files of one chunk."""
    one = table(spark, root, "chunks").where("file_id IS NOT NULL").groupBy("file_id").agg(F.countDistinct("chunk_index").alias("n")).where("n = 1").select("file_id")
    return p6_judged(spark, root).where("grammar = 'json'").join(one, "file_id", "left_semi").select("file_id", "valid")


def p4_checked(spark: SparkSession, root: str) -> DataFrame:
    """For every chunk whether restoring keeps its lines; chunks without garbled text are as they were."""
    chunks = table(spark, root, "chunks").where("id IS NOT NULL")
    lines = chunks.select(F.col("id").alias("chunk_id"), F.size(F.split("content", "\n")).alias("n")).distinct()
    restored = p4_restored(spark, root).select("chunk_id", F.size(F.split("content", "\n")).alias("m"))
    return lines.join(restored, "chunk_id", "left").select("chunk_id", F.coalesce(F.col("m") == F.col("n"), F.lit(True)).alias("same_lines"))


def p6_files(spark: SparkSession, root: str) -> DataFrame:
    """Files judged per repository and language."""
    return p6_rates(spark, root).select("repo_id", "grammar", "files")


def p9_rates(spark: SparkSession, root: str) -> DataFrame:
    """Share of flagged documents per source."""
    return source_rates(p9_scores(spark, root))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_scores": p1_scores,
    "p1_validation": p1_validation,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_rejoined": p2_rejoined,
    "p3_found": p3_found,
    "p3_spans": p3_spans,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_lines": p4_lines,
    "p4_restored": p4_restored,
    "p5_found": p5_found,
    "p5_records": p5_records,
    "p6_found": p6_found,
    "p6_judged": p6_judged,
    "p6_rates": p6_rates,
    "p7_packed": p7_packed,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
    "p1_checked": p1_checked,
    "p3_shapes": p3_shapes,
    "p4_checked": p4_checked,
    "p6_checked": p6_checked,
    "p6_files": p6_files,
    "p7_checked": p7_checked,
    "p9_checked": p9_checked,
}

def _windows_sql(table_name: str, key: str) -> str:
    words = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\s\p{Z}]', '', 'g'), '[\s\p{Z}]+'), lambda x: x <> '')"
    return f"(SELECT {key}, array_to_string(list_slice(a, i, i + 11), ' ') AS w FROM (SELECT {key}, a, unnest(range(1, len(a) - 10)) AS i FROM (SELECT {key}, {words} AS a FROM (SELECT DISTINCT {key}, text FROM {table_name} WHERE {key} IS NOT NULL))))"


_LEAKS_SQL = f"SELECT DISTINCT doc_id, item_id FROM {_windows_sql('documents', 'doc_id')} d JOIN {_windows_sql('eval_items', 'item_id')} e USING (w)"

_FOLD = r"regexp_replace(replace(replace(lower({c}), 'ß', 'ss'), 'ς', 'σ'), '[^\p{L}\p{N}]', '', 'g')"
_FIELD_SQL = r"""^[ \t]*(?:"[\p{L}\p{N}][^"]*"|'[\p{L}\p{N}][^']*'|[\p{L}\p{N}][\p{L}\p{N}_ .\-/]*?)[ \t]*[:=].*$"""
_LINES = "list_filter(list_transform(string_split(replace(content, chr(13), ''), chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> '')"
_VALUE = r"regexp_replace(trim(regexp_replace(x, '^[^:=]*[:=]', ''), ' ' || chr(9)), '[ \t]*,?[ \t]*$', '')"
#: Letters and digits, and for flat texts the sorted fields; classes fall to the least id by letters, by fields, by letters.
_RECORDS_SQL = rf"""WITH c AS (SELECT DISTINCT id, content FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL), l AS (SELECT id, {_FOLD.replace('{c}', 'content')} AS seq, trim(content, ' ' || chr(9) || chr(10) || chr(13)) AS body, content, {_LINES} AS lines FROM c),
j AS (SELECT id, seq, lines, CASE WHEN starts_with(body, '{{' ) AND json_valid(body) THEN body END AS js, body FROM l),
k AS (SELECT id, seq, CASE WHEN js IS NOT NULL THEN CASE WHEN len(json_keys(js)) > 1 AND NOT list_bool_or(list_transform(json_keys(js), lambda x: coalesce(json_type(js, '$."' || x || '"'), '') IN ('OBJECT', 'ARRAY'))) THEN array_to_string(list_sort(list_transform(json_keys(js), lambda x: {_FOLD.replace('{c}', 'x')} || ':' || {_FOLD.replace('{c}', "coalesce(json_extract_string(js, '$.' || chr(34) || x || chr(34)), 'null')")})), '|') END
 WHEN NOT starts_with(body, '{{') AND len(lines) > 1 AND list_bool_and(list_transform(lines, lambda x: regexp_full_match(x, '{_FIELD_SQL.replace(chr(39), chr(39) * 2)}') AND NOT regexp_matches({_VALUE}, '^[\[{{(]|[{{(;\[]$')))
 THEN array_to_string(list_sort(list_transform(lines, lambda x: {_FOLD.replace('{c}', "regexp_extract(x, '^[^:=]*')")} || ':' || {_FOLD.replace('{c}', _VALUE)})), '|') END AS fields FROM j),
a AS (SELECT id, seq, fields, min(id) OVER (PARTITION BY seq) AS x FROM k), b AS (SELECT *, CASE WHEN fields IS NULL THEN x ELSE min(x) OVER (PARTITION BY fields) END AS y FROM a), r AS (SELECT id, min(y) OVER (PARTITION BY seq) AS record FROM b)"""

ORACLES: dict[str, str] = {
    "p5_found": f"{_RECORDS_SQL} SELECT record AS keep_id, id AS copy_id FROM r WHERE id <> record",
    "p5_records": f"{_RECORDS_SQL} SELECT record AS record_id, id, count(*) OVER (PARTITION BY record) AS copies FROM r",
    "p3_shapes": "SELECT DISTINCT id AS chunk_id, sha256(regexp_replace(regexp_replace(regexp_replace(content, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', '0', 'g')) AS shape, length(content) AS characters FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL",
    "p4_checked": "SELECT DISTINCT id AS chunk_id, true AS same_lines FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL",
    "p6_files": "WITH g(ext, grammar) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in GRAMMARS.items()) + "), f AS (SELECT file_id, max_by(struct_pack(r := repo_id, e := lower(replace(extension, '.', ''))), scanned_at) AS f FROM files WHERE file_id IS NOT NULL AND extension IS NOT NULL GROUP BY file_id) SELECT f.r AS repo_id, grammar, count(*) AS files FROM f JOIN g ON f.e = g.ext WHERE file_id IN (SELECT file_id FROM chunks WHERE content IS NOT NULL) GROUP BY 1, 2",
    "p7_checked": "SELECT DISTINCT doc_id, true AS covered, true AS fits FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
    "p9_checked": "SELECT DISTINCT doc_id, true AS scored, true AS spans_hold FROM documents WHERE doc_id IS NOT NULL",
    "p1_checked": "SELECT DISTINCT file_id, true AS once FROM files WHERE file_id IS NOT NULL AND path IS NOT NULL",
    "p6_checked": "SELECT file_id, json_valid(any_value(content)) AS valid FROM chunks JOIN (SELECT file_id FROM files GROUP BY file_id HAVING lower(replace(max_by(extension, scanned_at), '.', '')) = 'json') USING (file_id) WHERE content IS NOT NULL GROUP BY file_id HAVING count(DISTINCT chunk_index) = 1",
    "p8_found": _LEAKS_SQL,
    "p8_items": f"WITH h AS ({_LEAKS_SQL}), s AS (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) SELECT i.item_id, suite, count(h.doc_id) AS documents, count(DISTINCT source) AS sources FROM (SELECT DISTINCT ON (item_id) item_id, suite FROM eval_items) i LEFT JOIN h USING (item_id) LEFT JOIN s USING (doc_id) GROUP BY i.item_id, suite",
    "p2_rejoined": "SELECT DISTINCT id AS chunk_id, sha256(content) AS sha, coalesce(start_line, 1) AS start_line, coalesce(start_line, 1) + length(content) - length(replace(content, chr(10), '')) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END AS end_line, true AS fits FROM chunks WHERE strlen(content) // 4 > 800",
    "p2_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE strlen(content) // 4 > 800",
}
