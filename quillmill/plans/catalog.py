"""Registry of the core queries and the SQL that checks them. Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import account, budget, classify, graph, impact, redact, retrieve, scope, split, store
from ..session import spread, table
from ..sources import remotes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TASK = "importer skips cached bucket retries"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The words of a text in DuckDB: a break is put where a capital follows a small letter or digit.
def words_sql(c: str) -> str:
    return rf"list_filter(string_split_regex(lower(regexp_replace({c}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2)"


def _one_file(spark: SparkSession, root: str) -> DataFrame:
    """Each file once, by its last scan."""
    f = table(spark, root, "files").where("path IS NOT NULL")
    return f.groupBy("path").agg(F.max_by(F.struct(*[c for c in f.columns if c != "path"]), F.struct("scanned_at", "ingested_at")).alias("f")).select("path", "f.*")


def _one_chunk(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Each chunk once."""
    return table(spark, root, "chunks").where("id IS NOT NULL").select("id", *columns).dropDuplicates(["id"])


def _per_chunk(spark: SparkSession, root: str, **values) -> DataFrame:
    """What is computed from each chunk, once for each id: texts are read where they lie, only the results are shuffled."""
    chunks = spread(table(spark, root, "chunks").where("id IS NOT NULL"))
    return chunks.select("id", *[v.alias(k) for k, v in values.items()]).dropDuplicates(["id"])


ONE_FILE = "(SELECT path, max_by(struct_pack(repo_id := repo_id, language := language, extension := extension, size_bytes := size_bytes, priority := priority, tags := tags, is_readme := is_readme, is_config := is_config, is_doc := is_doc, file_id := file_id, content_hash := content_hash, token_estimate := token_estimate), struct_pack(s := scanned_at, i := ingested_at)) AS f FROM files GROUP BY path)"
ONE_CHUNK = "(SELECT DISTINCT ON (id) * FROM chunks)"
REL = "substr(path, strpos(path, '/') + 1)"


def _relative(path: str = "path"):
    return F.expr(f"substring({path}, instr({path}, '/') + 1)")


# ---- ranking by words ------------------------------------------------------------------------------------------------

_TASK_LIST = "[" + ", ".join(f"'{w}'" for w in retrieve.task_words(TASK)) + "]"
BM25_SQL = f"""
WITH d AS (SELECT doc_id AS id, {words_sql("text")} AS w FROM documents), c AS (SELECT count(*) AS n, greatest(avg(len(w)), 1.0) AS a FROM d),
q AS (SELECT word, count(*) AS qn FROM (SELECT unnest({_TASK_LIST}) AS word) GROUP BY word),
tf AS (SELECT id, len(w) AS l, word, count(*) AS tf FROM (SELECT id, w, unnest(w) AS word FROM d) JOIN q USING (word) GROUP BY id, l, word),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word)
SELECT id AS doc_id, round(sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * l / a))), 6) AS score
FROM tf JOIN df USING (word) JOIN q USING (word), c GROUP BY id"""


@query(BM25_SQL)
def bm25_scores(spark: SparkSession, root: str) -> DataFrame:
    """Score of every document that holds a word of the task."""
    return retrieve.bm25(table(spark, root, "documents"), "doc_id", "text", TASK).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("score"))


@query(f"SELECT * FROM ({BM25_SQL}) ORDER BY score DESC, doc_id LIMIT 20")
def bm25_top20(spark: SparkSession, root: str) -> DataFrame:
    """The twenty best documents for the task."""
    return bm25_scores(spark, root).orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"""
WITH d AS (SELECT doc_id, {words_sql("text")} AS w FROM documents), c AS (SELECT count(*) AS n, greatest(avg(len(w)), 1.0) AS a FROM d),
q AS (SELECT item_id, word, count(*) AS qn FROM (SELECT item_id, unnest({words_sql("text")}) AS word FROM eval_items) GROUP BY ALL),
tf AS (SELECT doc_id, len(w) AS l, word, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
s AS (SELECT item_id, doc_id, round(sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score FROM tf JOIN df USING (word) JOIN q USING (word), c GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def bm25_multi_task(spark: SparkSession, root: str) -> DataFrame:
    """The five best documents for each evaluation item, all tasks in one pass."""
    scored = retrieve.bm25_many(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "text")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return scored.select(F.col("task").alias("item_id"), F.col("id").alias("doc_id"), F.round("bm25", 6).alias("score")).withColumn("rank", F.row_number().over(order).cast("bigint")).where("rank <= 5")


@query(f"SELECT word, count(DISTINCT doc_id) AS documents, count(*) AS uses FROM (SELECT doc_id, unnest({words_sql('text')}) AS word FROM documents) GROUP BY word")
def term_df(spark: SparkSession, root: str) -> DataFrame:
    """In how many documents each word stands, and how often."""
    one = table(spark, root, "documents").select("doc_id", F.explode(X.words("text")).alias("word"))
    return one.groupBy("word", "doc_id").agg(F.count("*").alias("n")).groupBy("word").agg(F.count("*").alias("documents"), F.sum("n").alias("uses"))


@query(f"SELECT count(*) AS documents, round(greatest(avg(len({words_sql('text')})), 1.0), 6) AS average FROM documents")
def avg_doc_len(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").agg(F.count("*").alias("documents"), F.round(F.greatest(F.avg(F.size(X.words("text"))), F.lit(1.0)), 6).alias("average"))


_SYMBOL_LIST = "list_filter(coalesce(tags, []), lambda t: regexp_matches(t, '^(def|type|impl|class|method|function):'))"


@query(f"""
WITH k AS {ONE_CHUNK}, d AS (SELECT id, {words_sql("content")} AS w FROM k), c AS (SELECT count(*) AS n, greatest(avg(len(w)), 1.0) AS a FROM d),
q AS (SELECT word, count(*) AS qn FROM (SELECT unnest({_TASK_LIST}) AS word) GROUP BY word),
tf AS (SELECT id, len(w) AS l, word, count(*) AS tf FROM (SELECT id, w, unnest(w) AS word FROM d) JOIN q USING (word) GROUP BY id, l, word), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
b AS (SELECT id, sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS b FROM tf JOIN df USING (word) JOIN q USING (word), c GROUP BY id),
o AS (SELECT id, file_path, start_line, CASE WHEN priority IS NULL OR isnan(priority) THEN 0 ELSE greatest(0, least(1, priority)) END AS p,
  len(list_filter({_TASK_LIST}, lambda t: list_contains({words_sql("file_path")}, t))) / {len(retrieve.task_words(TASK))} AS po,
  len(list_filter({_TASK_LIST}, lambda t: list_contains(flatten(list_transform({_SYMBOL_LIST}, lambda s: {words_sql("substr(s, strpos(s, ':') + 1)")})), t))) / {len(retrieve.task_words(TASK))} AS so FROM k)
SELECT id, file_path AS path, start_line, round(0.70 * coalesce(b, 0) / (SELECT max(b) FROM b) + 0.20 * p + 0.10 * greatest(po, so), 6) AS score,
 concat_ws(',', CASE WHEN po > 0 THEN 'exact_path_match' END, CASE WHEN so > 0 THEN 'symbol_definition' END, CASE WHEN coalesce(b, 0) > 0 THEN 'task_match' END) AS reasons
FROM o LEFT JOIN b USING (id) WHERE coalesce(b, 0) > 0 OR po > 0 OR so > 0""")
def seed_scores(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk the task speaks of, with its score and why."""
    chunks = table(spark, root, "chunks").where("id IS NOT NULL").select("id", "file_path", "start_line", "content", "priority", "tags")
    return retrieve.seeds(chunks, TASK).withColumn("reasons", F.array_join("reasons", ","))


@query()
def retrieval_plan(spark: SparkSession, root: str) -> DataFrame:
    """Seeds and their support over the import graph."""
    chunks = table(spark, root, "chunks").where("id IS NOT NULL").select("id", "file_path", "start_line", "content", "priority", "tags")
    edges = table(spark, root, "imports").select(F.col("source_path").alias("src"), F.col("target_path").alias("dst"))
    return retrieve.plan(chunks, _one_file(spark, root), edges, TASK)


# ---- scalars, ladders ------------------------------------------------------------------------------------------------


@query("SELECT coalesce(lang, '?') AS lang, count(*) AS documents, CAST(sum(strlen(text) // 4) AS BIGINT) AS tokens, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def token_estimate_by_lang(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    return d.groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("documents"), F.sum(X.token_estimate("text")).alias("tokens"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))


@query(f"SELECT id, sha256(content) AS sha, substr(sha256(file_path), 1, 16) AS file, substr(sha256(file_path || ':' || start_line || '-' || end_line || ':' || substr(content, 1, 1000)), 1, 16) AS place FROM {ONE_CHUNK}")
def content_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints of a chunk's text, file and place."""
    return _per_chunk(spark, root, sha=X.fingerprint("content"), file=X.fingerprint("file_path", 16), place=X.chunk_id("file_path", "start_line", "end_line", "content"))


_LANG_VALUES = ", ".join(f"('{e}', '{g}')" for e, g in X.EXTENSION_LANGUAGE.items())


@query(f"""WITH m(e, g) AS (VALUES {_LANG_VALUES}), n AS (SELECT DISTINCT path, lower(regexp_extract(path, '([^/]*)$', 1)) AS b FROM files),
x AS (SELECT path, b, lower(regexp_extract(b, '^.+(\\.[^.]+)$', 1)) AS e FROM n)
SELECT path, coalesce(g, CASE WHEN b = 'dockerfile' THEN 'dockerfile' WHEN b = 'makefile' THEN 'makefile' WHEN b = 'rakefile' THEN 'ruby' WHEN x.e = '' AND b LIKE '%rc' THEN 'shell' ELSE 'text' END) AS language FROM x LEFT JOIN m ON x.e = m.e""")
def extension_language_map(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files").select("path").distinct().select("path", X.language_of("path").alias("language"))


@query(f"SELECT coalesce(f.language, '?') AS language, count(*) AS files, CAST(sum(coalesce(f.size_bytes, 0)) AS BIGINT) AS bytes FROM {ONE_FILE} GROUP BY 1")
def language_counts(spark: SparkSession, root: str) -> DataFrame:
    return _one_file(spark, root).groupBy(F.coalesce("language", F.lit("?")).alias("language")).agg(F.count("*").alias("files"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"))


@query(f"""WITH r AS (SELECT coalesce(f.language, '?') AS language, path, CASE WHEN f.priority IS NULL OR isnan(f.priority) THEN 0 ELSE f.priority END AS p FROM {ONE_FILE})
SELECT language, path, row_number() OVER (PARTITION BY language ORDER BY p DESC, path) AS rank FROM r QUALIFY rank <= 10""")
def top_files_per_language(spark: SparkSession, root: str) -> DataFrame:
    """The ten files of each language that matter most."""
    p = F.when(F.col("priority").isNull() | F.isnan("priority"), 0.0).otherwise(F.col("priority"))
    f = _one_file(spark, root).select(F.coalesce("language", F.lit("?")).alias("language"), "path", p.alias("p"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy(F.desc("p"), "path")).cast("bigint")).where("rank <= 10").drop("p")


def _sql_any(column: str, values: tuple[str, ...], op: str) -> str:
    return "(" + " OR ".join({"starts": f"starts_with({column}, '{v}')", "has": f"contains({column}, '{v}')"}[op] for v in values) + ")"


def _sql_in(column: str, values) -> str:
    return f"{column} IN ({', '.join(chr(39) + v + chr(39) for v in values)})"


_W = classify.WEIGHTS
_SIGNALS_SQL = f"""(SELECT path, rel, lower(rel) AS low, regexp_extract(rel, '([^/]*)$', 1) AS original, lower(regexp_extract(rel, '([^/]*)$', 1)) AS name FROM (SELECT DISTINCT path, {REL} AS rel FROM files))"""
_CONTRIB = "(starts_with(low, '.github/pull_request_template') OR starts_with(low, '.github/issue_template/') OR " + " OR ".join(f"starts_with(name, '{p}') OR contains(low, '/{p}')" for p in classify.CONTRIBUTION_PREFIXES) + ")"
_DOC = f"({_sql_in('rel', classify.IMPORTANT_DOCS)} OR {_sql_in('name', [d.lower() for d in classify.IMPORTANT_DOCS])})"
_GEN = f"({_sql_any('name', classify.MINIFIED_MARKS, 'has')} OR {_sql_any('low', classify.GENERATED_DIRS, 'has')})"
_CONF = f"(rel = 'project.godot' OR name LIKE '%.godot' OR name LIKE '%.cfg' OR {_sql_in('rel', classify.CONFIG_FILES)} OR {_sql_in('name', classify.CONFIG_FILES)})"
_TEST = f"({_sql_any('low', classify.TEST_DIRS, 'starts')} OR contains(low, 'test_') OR contains(name, '_test') OR contains(name, '.test.') OR contains(name, '.spec.'))"


@query(f"""SELECT path, CASE WHEN starts_with(name, 'readme') THEN {_W['readme']} WHEN {_CONTRIB} THEN {_W['contribution_doc']} WHEN {_DOC} THEN {_W['main_doc']} WHEN {_sql_any('low', classify.VENDOR_DIRS, 'has')} THEN {_W['vendored']}
 WHEN {_sql_in('name', classify.LOCK_FILES)} THEN {_W['lock_file']} WHEN {_GEN} THEN {_W['generated']} WHEN starts_with(low, '.github/workflows/') OR {_CONF} THEN {_W['config']} WHEN {_sql_in('name', classify.ENTRYPOINTS)} THEN {_W['entrypoint']}
 WHEN {_TEST} THEN {_W['test']} WHEN {_sql_any('low', classify.EXAMPLE_DIRS, 'starts')} THEN {_W['example']} WHEN {_sql_any('low', classify.CORE_DIRS, 'starts')} THEN {_W['core_source']} WHEN {_sql_any('name', classify.API_MARKS, 'has')} THEN {_W['api_definition']} ELSE {_W['default']} END::DOUBLE AS priority,
 concat_ws(',', CASE WHEN {_CONF} THEN 'config' END, CASE WHEN {_CONTRIB} THEN 'contribution' END, CASE WHEN {_sql_in('name', classify.ENTRYPOINTS)} THEN 'entrypoint' END, CASE WHEN {_GEN} THEN 'generated' END, CASE WHEN {_sql_in('name', classify.LOCK_FILES)} THEN 'lock-file' END,
 CASE WHEN starts_with(name, 'readme') THEN 'readme' END, CASE WHEN {_TEST} THEN 'test' END, CASE WHEN starts_with(low, '.github/workflows/') THEN 'workflow' END) AS tags FROM {_SIGNALS_SQL}""")
def rank_ladder(spark: SparkSession, root: str) -> DataFrame:
    """Priority and tags of every file by its path within the repository."""
    f = table(spark, root, "files").select("path").distinct().withColumn("rel", _relative())
    return classify.rank_files(f, "rel").select("path", F.col("rank_priority").alias("priority"), F.array_join("rank_tags", ",").alias("tags"))


_EXTENSIONS = (".py", ".js", ".mjs", ".ts", ".go", ".rs", ".java", ".c", ".h", ".md", ".json", ".toml", ".yaml", ".yml", ".txt", ".sql", ".css")


@query(f"""WITH t AS (SELECT file_path AS path, arg_min(content, chunk_index) AS text FROM chunks WHERE chunk_index = 0 GROUP BY file_path),
x AS (SELECT path, f.size_bytes AS size, coalesce(text, '') AS text, lower(regexp_extract(path, '([^/]*)$', 1)) AS name FROM {ONE_FILE} LEFT JOIN t USING (path)),
y AS (SELECT *, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext, len(regexp_extract_all(substr(text, 1, 8192), '[\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F]')) AS control, split_part(text, chr(10), 1) AS line FROM x)
SELECT path, CASE WHEN regexp_matches(path, '/tests/.*') THEN 'skipped_glob' WHEN NOT {_sql_in('ext', _EXTENSIONS)} THEN 'skipped_extension' WHEN size > 65536 THEN 'skipped_size'
 WHEN text <> '' AND control >= 0.30 * greatest(length(substr(text, 1, 8192)), 1) THEN 'skipped_binary' WHEN {_sql_any('name', classify.MINIFIED_MARKS, 'has')} OR (ext <> '.json' AND strlen(line) > 5000) THEN 'skipped_minified' ELSE 'included_full' END AS reason FROM y""")
def disposition_ladder(spark: SparkSession, root: str) -> DataFrame:
    """Why each file is or isn't taken in; one row for each file."""
    head = table(spark, root, "chunks").where("chunk_index = 0").groupBy(F.col("file_path").alias("path")).agg(F.min("content").alias("text"))
    f = _one_file(spark, root).select("path", "size_bytes").join(head, "path", "left")
    return f.select("path", classify.disposition("path", "size_bytes", "text", _EXTENSIONS, "/tests/.*", 65536).alias("reason"))


@query(f"SELECT path, CASE WHEN f.is_readme THEN 'readme' WHEN f.is_config THEN 'config' WHEN f.is_doc THEN 'documentation' WHEN list_contains(f.tags, 'test') THEN 'test' ELSE 'source' END AS classification FROM {ONE_FILE}")
def classification_ladder(spark: SparkSession, root: str) -> DataFrame:
    return _one_file(spark, root).select("path", classify.classification("is_readme", "is_config", "is_doc", "tags").alias("classification"))


@query("""SELECT repo_id, CASE WHEN url IS NULL OR trim(url) = '' THEN 'invalid' WHEN contains(url, '?') OR contains(url, '#') THEN 'invalid'
 WHEN regexp_matches(url, '^https://([^/@]*@)?github\\.com/[^/\\\\]+/[^/\\\\]+/?$') THEN 'github' WHEN regexp_matches(url, '^https://([^/@]*@)?(huggingface\\.co|hf\\.co)/[^/\\\\]+/[^\\\\]+$') THEN 'huggingface'
 WHEN regexp_matches(url, '^https://[^/:\\\\]+/.+') THEN 'unsupported' ELSE 'invalid' END AS kind, regexp_replace(url, '^([a-z][a-z0-9+.\\-]*://)[^/@\\s]*@', '\\1') AS clean_url FROM repos""")
def url_classify(spark: SparkSession, root: str) -> DataFrame:
    """Where each repository can be fetched from, and its address without credentials."""
    return table(spark, root, "repos").select("repo_id", remotes.remote_kind("url").alias("kind"), X.strip_url_credentials("url").alias("clean_url"))


# ---- redaction -------------------------------------------------------------------------------------------------------


def _rules_sql(c: str) -> str:
    for _, pattern, replacement in redact.RULES:
        import re

        c = f"regexp_replace({c}, '{pattern.replace(chr(39), chr(39) * 2)}', '{re.sub(r'[$](\d)', r'\\\1', replacement)}', 'g')"
    return c


@query(f"SELECT id, sha256({_rules_sql('content')}) AS sha, ({_rules_sql('content')}) <> content AS changed FROM {ONE_CHUNK}")
def redact_rules_text(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk after all rules, as a fingerprint."""
    c = _per_chunk(spark, root, sha=F.sha2(redact.redact_text_column("content"), 256), own=F.sha2("content", 256))
    return c.select("id", "sha", (F.col("sha") != F.col("own")).alias("changed"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS rule, CAST(sum(len(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2)}'))) AS BIGINT) AS hits FROM {ONE_CHUNK}" for n, p, _ in redact.RULES))
def rule_hits(spark: SparkSession, root: str) -> DataFrame:
    """How often each rule alone would hit."""
    c = _per_chunk(spark, root, **{n: F.regexp_count("content", F.lit(p)) for n, p, _ in redact.RULES})
    sums = c.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(n) for n, _, _ in redact.RULES])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("hits")) for n, _, _ in redact.RULES])).alias("r")).select("r.*")


@query()
def redact_tracked(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk that redaction changes, with its occurrences."""
    out = redact.redact_tracked(table(spark, root, "chunks").where("id IS NOT NULL"), path_col="file_path")
    return out.where(F.size("counts") > 0).select("id", F.sha2("content", 256).alias("sha"), F.size("occurrences").cast("bigint").alias("occurrences"), F.to_json("counts").alias("counts")).dropDuplicates(["id"])


_TOKEN = r"[A-Za-z0-9+/=_-]{20,}"


@query(f"SELECT token, count(*) AS uses, round(list_aggregate(string_split(token, ''), 'entropy'), 6) AS entropy, regexp_matches(token, '{redact.SAFE_VALUE}') AS safe FROM (SELECT unnest(regexp_extract_all(content, '{_TOKEN}')) AS token FROM {ONE_CHUNK}) GROUP BY token")
def entropy_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Long tokens with their entropy, and whether they are of a kind that is never a secret."""
    tokens = _per_chunk(spark, root, tokens=F.regexp_extract_all("content", F.lit(_TOKEN), F.lit(0))).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    return tokens.select("token", "uses", F.round(X.entropy("token"), 6).alias("entropy"), redact.is_safe_value("token").alias("safe"))


@query("""WITH o AS (SELECT DISTINCT c.file_path AS path, coalesce(lower(o.rule), '?') AS rule, o.chunk_id, o.start_byte AS s, o.end_byte AS e FROM redaction_occurrences o JOIN (SELECT DISTINCT id, file_path FROM chunks) c ON c.id = o.chunk_id)
SELECT rule, count(*) AS occurrences, count(DISTINCT path) AS paths, count(DISTINCT chunk_id) AS chunks FROM o GROUP BY rule""")
def redaction_accounting(spark: SparkSession, root: str) -> DataFrame:
    """Earlier replacements in chunks that still exist, by rule."""
    o = table(spark, root, "redaction_occurrences").select("chunk_id", F.coalesce(F.lower("rule"), F.lit("?")).alias("rule"), F.col("start_byte").alias("s"), F.col("end_byte").alias("e"))
    c = table(spark, root, "chunks").select(F.col("id").alias("chunk_id"), F.col("file_path").alias("path")).distinct()
    return o.join(c, "chunk_id").distinct().groupBy("rule").agg(F.count("*").alias("occurrences"), F.countDistinct("path").alias("paths"), F.countDistinct("chunk_id").alias("chunks"))


@query("""WITH o AS (SELECT DISTINCT c.file_path AS path, coalesce(lower(o.rule), '?') AS rule, c.byte_start + o.start_byte AS s, c.byte_start + o.end_byte AS e FROM redaction_occurrences o JOIN (SELECT DISTINCT id, file_path, byte_start FROM chunks WHERE byte_start IS NOT NULL) c ON c.id = o.chunk_id),
p AS (SELECT DISTINCT file_path AS path, byte_start AS a, byte_end AS b FROM chunks WHERE byte_start < byte_end), h AS (SELECT DISTINCT o.* FROM o JOIN p ON o.path = p.path AND CASE WHEN o.s = o.e THEN p.a <= o.s AND o.s <= p.b ELSE p.a < o.e AND p.b > o.s END)
SELECT rule, count(*) AS occurrences, count(DISTINCT path) AS paths FROM h GROUP BY rule""")
def span_overlap_join(spark: SparkSession, root: str) -> DataFrame:
    """Occurrences, placed in their files, that an emitted span holds."""
    c = table(spark, root, "chunks").select(F.col("id").alias("chunk_id"), F.col("file_path").alias("path"), "byte_start", "byte_end").distinct()
    o = table(spark, root, "redaction_occurrences").join(c.where("byte_start IS NOT NULL"), "chunk_id")
    placed = o.select("path", F.coalesce(F.lower("rule"), F.lit("?")).alias("rule"), (F.col("byte_start") + F.col("start_byte")).alias("start"), (F.col("byte_start") + F.col("end_byte")).alias("end"))
    return account.occurrences_in_chunks(c.select("path", F.col("byte_start").alias("start"), F.col("byte_end").alias("end")).distinct(), placed)


# ---- splitting -------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT doc_id AS id, generate_subscripts(a, 1) AS line, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM (SELECT DISTINCT doc_id, text FROM documents)))
SELECT id, line, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start,
 CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + strlen(t) AS BIGINT) AS byte_end FROM l""")
def line_byte_offsets(spark: SparkSession, root: str) -> DataFrame:
    """Where each line of each document lies."""
    return split.line_offsets(table(spark, root, "documents").dropDuplicates(["doc_id", "text"]), "doc_id", "text")


@query(r"""WITH l AS (SELECT doc_id AS id, generate_subscripts(a, 1) AS line, unnest(a) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM (SELECT DISTINCT doc_id, text FROM documents))),
m AS (SELECT *, regexp_matches(t, '^\s*#{1,6}[ \t]')::INT AS h FROM l), s AS (SELECT *, sum(h) OVER (PARTITION BY id ORDER BY line) + (1 - first_value(h) OVER (PARTITION BY id ORDER BY line)) AS section FROM m)
SELECT id, CAST(section AS BIGINT) AS section, min(line) AS start_line, max(line) AS end_line, max(CASE WHEN line = f THEN head END) AS heading, sha256(string_agg(t, chr(10) ORDER BY line)) AS sha
FROM (SELECT *, min(line) OVER (PARTITION BY id, section) AS f, CASE WHEN h = 1 THEN substr(trim(regexp_replace(trim(t), '^#+', '')), 1, 30) END AS head FROM s) GROUP BY id, section""")
def section_split(spark: SparkSession, root: str) -> DataFrame:
    """The sections that headings begin in each document."""
    s = split.sections_by_window(table(spark, root, "documents").dropDuplicates(["doc_id", "text"]), "doc_id", "text")
    return s.select("id", "section", "start_line", "end_line", "heading", F.sha2("content", 256).alias("sha"))


@query()
def split_documents(spark: SparkSession, root: str) -> DataFrame:
    """Each document split by the splitter of its kind, small neighbours merged, pieces enriched."""
    kind = F.when(F.col("doc_kind").isin("readme", "guide", "changelog"), "markdown").otherwise("text")
    d = table(spark, root, "documents").dropDuplicates(["doc_id"]).select(F.concat(F.coalesce("source", F.lit("?")), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("path"), kind.alias("language"), "text")
    pieces = split.enrich(split.split_files(d, text_col="text"))
    return pieces.select("path", "id", "chunk_index", "chunks_in_file", "start_line", "end_line", "token_estimate", "content_sha256", F.array_join("tags", ",").alias("tags"))


@query("""SELECT file_path AS path, id, row_number() OVER (PARTITION BY file_path ORDER BY start_line, end_line, id) - 1 AS chunk_index, count(*) OVER (PARTITION BY file_path) AS chunks_in_file,
 CASE WHEN row_number() OVER (PARTITION BY file_path ORDER BY start_line, end_line, id) = 1 THEN 1 ELSE 0 END AS is_first FROM """ + ONE_CHUNK)
def chunk_positions(spark: SparkSession, root: str) -> DataFrame:
    """Each chunk's place in its file, and whether it is the first."""
    w = Window.partitionBy("file_path")
    c = _one_chunk(spark, root, "file_path", "start_line", "end_line")
    index = F.row_number().over(w.orderBy("start_line", "end_line", "id")) - 1
    return c.select(F.col("file_path").alias("path"), "id", index.cast("bigint").alias("chunk_index"), F.count("*").over(w).alias("chunks_in_file"), (index == 0).cast("int").alias("is_first"))


@query("SELECT key, json_type(props, '$.' || key) AS kind, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) GROUP BY ALL")
def json_schema_summary(spark: SparkSession, root: str) -> DataFrame:
    """Names and kinds of the fields of the events' JSON."""
    e = table(spark, root, "events").where("props IS NOT NULL").select("props", F.explode(F.json_object_keys("props")).alias("key"))
    v = e.select("key", F.from_json("props", "map<string,string>")[F.col("key")].alias("v"))
    kind = F.when(F.col("v").isNull(), "NULL").when(F.col("v").rlike(r"^\d+$"), "UBIGINT").when(F.col("v").rlike(r"^-\d+$"), "BIGINT").when(F.col("v").rlike(r"^-?\d+\.\d+"), "DOUBLE").when(F.col("v").isin("true", "false"), "BOOLEAN").otherwise("VARCHAR")
    return v.groupBy("key", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT split_part(t, ':', 2) AS name, split_part(t, ':', 1) AS kind, id AS chunk_id FROM (SELECT id, unnest(tags) AS t FROM {ONE_CHUNK}) WHERE regexp_matches(t, '^(def|type|impl|class|method|function):.')")
def symbols_of_chunks(spark: SparkSession, root: str) -> DataFrame:
    return store.symbol_rows(_one_chunk(spark, root, "tags"))


@query("""SELECT path, array_to_string(list_sort(list_distinct(flatten(list(coalesce(tags, []))))), ',') AS tags FROM files GROUP BY path""")
def tags_union(spark: SparkSession, root: str) -> DataFrame:
    """The tags of all scans of a file together."""
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>"))))))
    return table(spark, root, "files").groupBy("path").agg(F.array_join(tags, ",").alias("tags"))


# ---- graphs ----------------------------------------------------------------------------------------------------------


def _edges(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "imports").select(F.col("source_path").alias("src"), F.col("target_path").alias("dst")).distinct()


@query("SELECT target_path AS dst, count(DISTINCT source_path) AS incoming FROM imports GROUP BY 1")
def incoming_counts(spark: SparkSession, root: str) -> DataFrame:
    return graph.incoming(_edges(spark, root))


_BOTH = "(SELECT DISTINCT source_path AS a, target_path AS b, 'static_dependency' AS reason, 0.65 AS step FROM imports UNION SELECT DISTINCT target_path, source_path, 'static_importer', 0.55 FROM imports)"


@query(f"""WITH e AS {_BOTH}, s AS (SELECT DISTINCT source_path AS start FROM imports), o AS (SELECT start, b AS path, 1 AS depth, reason, step FROM s JOIN e ON start = a),
t AS (SELECT start, b AS path, 2 AS depth, e.reason, e.step FROM (SELECT DISTINCT start, path AS mid FROM o WHERE path <> start) JOIN e ON mid = a)
SELECT start, path, CAST(min(depth) AS BIGINT) AS depth, reason, round(CAST(any_value(step) AS DOUBLE) ** min(depth), 9) AS decay FROM (SELECT * FROM o UNION ALL SELECT * FROM t) GROUP BY start, path, reason""")
def two_hop_neighbors(spark: SparkSession, root: str) -> DataFrame:
    """What lies within two imports of each importing file, either way."""
    e = _edges(spark, root)
    return retrieve.neighbours(e.select(F.col("src").alias("path")), e)


@query("""WITH RECURSIVE r(start, node, distance) AS (SELECT DISTINCT source_path, source_path, 0 FROM imports UNION SELECT start, i.target_path, distance + 1 FROM r JOIN imports i ON i.source_path = node WHERE distance < 6)
SELECT start, node, CAST(min(distance) AS BIGINT) AS distance FROM r GROUP BY start, node""")
def bounded_bfs(spark: SparkSession, root: str) -> DataFrame:
    """Distance of everything within six imports of each importing file."""
    e = _edges(spark, root)
    return graph.distances(e.select(F.col("src").alias("node")), e, most_hops=6)


@query()
def extracted_imports(spark: SparkSession, root: str) -> DataFrame:
    """Imports read from the files' own text and resolved to files."""
    f = table(spark, root, "chunks").where("content IS NOT NULL").dropDuplicates(["id"])
    whole = f.groupBy("file_path").agg(F.any_value("language", True).alias("language"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda r: r["content"]), "\n").alias("content"))
    return graph.import_edges(whole, "file_path")


_STEM = "lower(regexp_replace(regexp_replace(regexp_replace({p}, '^.*/', ''), '^(.+)\\.[^.]*$', '\\1'), '(_test)+$', ''))"
_ISTEST = "(regexp_matches(lower({p}), '(^|/)tests?(/|$)') OR contains(lower({p}), '_test.') OR contains(lower({p}), '.test.'))"


@query(f"""WITH f AS (SELECT DISTINCT path, split_part(path, '/', 1) AS repo, regexp_replace({_STEM.format(p='path')}, '^test_', '') AS core, {_ISTEST.format(p='path')} AS test FROM files)
SELECT a.path AS source, b.path AS test FROM f a JOIN f b ON a.repo = b.repo AND a.core = b.core WHERE NOT a.test AND b.test AND a.core <> ''""")
def stem_related(spark: SparkSession, root: str) -> DataFrame:
    """Tests and the sources they are named after, within a repository: joined by repository and stem, never all pairs."""
    core = F.regexp_replace(retrieve.path_stem("path"), "^test_", "")
    f = table(spark, root, "files").select("path").distinct().select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("repo"), core.alias("core"), retrieve.is_test_path("path").alias("is_test")).where("core <> ''")
    tests = f.where("is_test").select(F.col("path").alias("test"), "repo", "core")
    return f.where("NOT is_test").join(tests, ["repo", "core"]).select(F.col("path").alias("source"), "test")


# ---- budgets, accounting ---------------------------------------------------------------------------------------------


@query(f"""WITH f AS (SELECT path, coalesce(f.size_bytes, 0) AS size_bytes, CASE WHEN f.priority IS NULL OR isnan(f.priority) THEN 0 ELSE f.priority END AS priority FROM {ONE_FILE})
SELECT path, size_bytes, sum(size_bytes) OVER (ORDER BY priority DESC, path ROWS UNBOUNDED PRECEDING) <= (SELECT sum(size_bytes) / 2 FROM f) AS kept FROM f""")
def byte_budget_prefix(spark: SparkSession, root: str) -> DataFrame:
    """Which files are within half of all bytes, the most important first."""
    p = F.when(F.col("priority").isNull() | F.isnan("priority"), 0.0).otherwise(F.col("priority"))
    f = _one_file(spark, root).select("path", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), p.alias("priority"))
    half = (f.agg(F.sum("size_bytes")).first()[0] or 0) / 2
    return budget.byte_budget(f, half).select("path", "size_bytes", "kept")


@query()
def two_pool_budget(spark: SparkSession, root: str) -> DataFrame:
    """The chunks that fit twenty thousand tokens, two fifths of them source."""
    c = _one_chunk(spark, root, "file_path", "start_line", "language", "token_estimate", "tags", "priority")
    return budget.token_budget(c, 20_000)


@query("""WITH s AS (SELECT DISTINCT file_path AS key, byte_start AS s, byte_end AS e FROM chunks WHERE byte_end > byte_start), m AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s)
SELECT key AS path, CAST(count(*) FILTER (r IS NULL OR s > r) AS BIGINT) AS islands, CAST(sum(greatest(e - greatest(s, coalesce(r, s)), 0)) AS BIGINT) AS covered FROM m GROUP BY key""")
def interval_union_bytes(spark: SparkSession, root: str) -> DataFrame:
    """Bytes of each file that its chunks cover, overlaps once."""
    c = table(spark, root, "chunks").select("file_path", "byte_start", "byte_end").distinct()
    return account.interval_union(c, "file_path", "byte_start", "byte_end").withColumnRenamed("key", "path")


@query(f"""WITH k AS (SELECT id, file_path, start_line, end_line FROM {ONE_CHUNK}), m AS (SELECT *, greatest(start_line, coalesce(max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1) AS f FROM k)
SELECT file_path AS path, id, f AS first_line, end_line AS last_line FROM m WHERE f <= end_line""")
def overlap_dedupe(spark: SparkSession, root: str) -> DataFrame:
    """The lines that each chunk adds to those before it."""
    return account.overlap_free(_one_chunk(spark, root, "file_path", "start_line", "end_line")).withColumnRenamed("key", "path")


@query(f"""SELECT path, CASE WHEN n IS NULL THEN 'dropped_token_budget' WHEN list_contains(f.tags, 'lock-file') THEN 'included_summary_only' WHEN n > 1 THEN 'included_chunked' ELSE 'included_full' END AS reason
FROM {ONE_FILE} LEFT JOIN (SELECT file_path AS path, count(DISTINCT id) AS n FROM chunks GROUP BY 1) USING (path)""")
def file_dispositions(spark: SparkSession, root: str) -> DataFrame:
    """How each file was taken in."""
    return account.rag_dispositions(_one_file(spark, root), _one_chunk(spark, root, "file_path"))


_PROG = ", ".join(f"'{x}'" for x in X.PROGRAMMING)


@query(f"""SELECT repo_id, count(*) AS chunks, count(DISTINCT file_path) AS files, CAST(coalesce(sum(strlen(content) // 4) FILTER (language IN ({_PROG})), 0) AS BIGINT) AS source_tokens,
 CAST(coalesce(sum(strlen(content) // 4) FILTER (language IS NULL OR language NOT IN ({_PROG})), 0) AS BIGINT) AS context_tokens FROM {ONE_CHUNK} GROUP BY repo_id""")
def source_context_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of source and of context per repository."""
    c = _per_chunk(spark, root, repo_id=F.col("repo_id"), file_path=F.col("file_path"), language=F.col("language"), t=X.token_estimate("content"))
    source = F.coalesce(F.col("language").isin(*X.PROGRAMMING), F.lit(False))
    return c.groupBy("repo_id").agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.coalesce(F.sum(F.when(source, F.col("t"))), F.lit(0)).alias("source_tokens"), F.coalesce(F.sum(F.when(~source, F.col("t"))), F.lit(0)).alias("context_tokens"))


# ---- index, impact ---------------------------------------------------------------------------------------------------

_CUT = "(SELECT quantile_disc(epoch_us(scanned_at), 0.5) FROM files)"


def _snapshots(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """All files as of the last scan, and as of the median time of all scans."""
    f = table(spark, root, "files").where("path IS NOT NULL")
    cut = f.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(scanned_at))").alias("c")).first()["c"]
    last = lambda d: d.groupBy("path").agg(F.max_by("content_hash", F.struct("scanned_at", "ingested_at")).alias("content_hash"))
    return last(f), last(f.where(F.unix_micros("scanned_at") <= F.lit(int(cut or 0))))


_SIDES = f"""a AS (SELECT path, max_by(content_hash, struct_pack(s := scanned_at, i := ingested_at)) AS h FROM files GROUP BY path),
b AS (SELECT path, max_by(content_hash, struct_pack(s := scanned_at, i := ingested_at)) AS h FROM files WHERE epoch_us(scanned_at) <= {_CUT} GROUP BY path)"""


@query(f"WITH {_SIDES} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' WHEN a.h IS DISTINCT FROM b.h THEN 'updated' ELSE 'reused' END AS action FROM a FULL JOIN b ON a.path = b.path")
def index_refresh_plan(spark: SparkSession, root: str) -> DataFrame:
    """What a refresh of an older snapshot has to do: all files as of their last scan against those of the first half of all scans."""
    now, was = _snapshots(spark, root)
    return store.refresh_plan(now, was).withColumnRenamed("key", "path")


@query(f"WITH {_SIDES} SELECT path FROM a WHERE path NOT IN (SELECT path FROM b)")
def removed_paths(spark: SparkSession, root: str) -> DataFrame:
    """What going back to the older snapshot removes."""
    now, was = _snapshots(spark, root)
    return store.refresh_plan(was, now).where("action = 'removed'").select(F.col("key").alias("path"))


@query("""WITH s AS (SELECT DISTINCT c.file_path AS path, CASE WHEN c.chunk_index % 2 = 0 THEN 'old' ELSE 'new' END AS side, s.kind, s.name, c.start_line AS a, c.end_line AS b FROM symbols s JOIN (SELECT DISTINCT id, file_path, chunk_index, start_line, end_line FROM chunks) c ON c.id = s.chunk_id),
l AS (SELECT DISTINCT file_path AS path, CASE WHEN chunk_index % 2 = 0 THEN 'old' ELSE 'new' END AS side, start_line AS line FROM chunks), t AS (SELECT * FROM s WHERE EXISTS (SELECT 1 FROM l WHERE l.path = s.path AND l.side = s.side AND l.line BETWEEN s.a AND s.b)),
k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY path, side, kind, name ORDER BY a DESC, b DESC) = 1), o AS (SELECT * FROM k WHERE side = 'old'), n AS (SELECT * FROM k WHERE side = 'new')
SELECT coalesce(o.path, n.path) AS path, coalesce(o.kind, n.kind) AS kind, coalesce(o.name, n.name) AS name, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS status,
 coalesce(o.a, -1) AS old_start_line, coalesce(o.b, -1) AS old_end_line, coalesce(n.a, -1) AS new_start_line, coalesce(n.b, -1) AS new_end_line FROM o FULL JOIN n ON o.path = n.path AND o.kind = n.kind AND o.name = n.name""")
def symbol_diff_outer(spark: SparkSession, root: str) -> DataFrame:
    """Symbols of even chunks as the old side against those of odd chunks as the new one."""
    c = table(spark, root, "chunks").select(F.col("id").alias("chunk_id"), F.col("file_path").alias("path"), F.when(F.col("chunk_index") % 2 == 0, "old").otherwise("new").alias("side"), "start_line", "end_line").distinct()
    s = table(spark, root, "symbols").join(c, "chunk_id").select("path", "side", "kind", "name", F.col("start_line").alias("start"), F.col("end_line").alias("end")).distinct()
    changes = impact.symbol_changes(s, c.select("path", "side", F.col("start_line").alias("line")).distinct())
    return changes.fillna(-1, ["old_start_line", "old_end_line", "new_start_line", "new_end_line"])


@query("""WITH n(name) AS (SELECT unnest(['importer', 'cached', 'retry', 'snapshot', 'quorum'])) SELECT DISTINCT doc_id AS id, name FROM documents, n WHERE contains(lower(text), name)""")
def reference_mentions(spark: SparkSession, root: str) -> DataFrame:
    """Documents that speak of a name in a list."""
    return impact.mentions(table(spark, root, "documents"), ["importer", "cached", "retry", "snapshot", "quorum"], "doc_id", "text").distinct()


@query("SELECT DISTINCT path, CASE WHEN regexp_matches(lower(path), '(^|/)(tests?|specs?)(/|$)|_test\\.|\\.test\\.|_spec\\.|\\.spec\\.') THEN 'test' WHEN " + _sql_in("lower(regexp_extract(path, '([^/]*)$', 1))", impact.CONFIG_NAMES) + " OR starts_with(lower(path), '.github/workflows/') THEN 'config' WHEN regexp_matches(lower(path), '\\.(md|rst|adoc)$') OR starts_with(lower(path), 'docs/') THEN 'documentation' ELSE 'source' END AS kind FROM files")
def impact_path_kinds(spark: SparkSession, root: str) -> DataFrame:
    """What kind of change a changed path is."""
    p = table(spark, root, "files").select("path").distinct()
    return p.select("path", F.when(impact.is_test_path("path"), "test").when(impact.is_config_path("path"), "config").when(impact.is_documentation_path("path"), "documentation").otherwise("source").alias("kind"))


@query()
def related_to_changes(spark: SparkSession, root: str) -> DataFrame:
    """Files related to those scanned after the median time."""
    now, was = _snapshots(spark, root)
    changed = store.refresh_plan(now, was).where("action IN ('added', 'updated')").select(F.col("key").alias("path"))
    return impact.related_files(changed, _edges(spark, root))


@query()
def chunks_jsonl(spark: SparkSession, root: str) -> DataFrame:
    """Each chunk as a line of JSON, keys in alphabetical order."""
    from ..operators.render import jsonl

    return jsonl(_one_chunk(spark, root, *[c for c in table(spark, root, "chunks").columns if c not in ("id", "indexed_at", "ingested_at")]))


# ---- lists, scopes and artifacts ---------------------------------------------------------------------------------------

_REACH = "WITH RECURSIVE e AS (SELECT DISTINCT source_path AS a, target_path AS b FROM imports), s AS ({starts}), {name}(node, distance) AS (SELECT node, 0 FROM s UNION SELECT {to}, distance + 1 FROM {name} JOIN e ON {frm} = node WHERE distance < {hops})"
_RESCANNED = "SELECT path AS node FROM files GROUP BY path HAVING count(DISTINCT scanned_at) > 1"
_REVIEW_TEST = r"regexp_matches(lower({p}), '(^|/)(tests?|specs?)(/|$)|_test\.|\.test\.|_spec\.|\.spec\.')"


@query(f"""{_REACH.format(starts=_RESCANNED, name='o', to='b', frm='a', hops=8)}, i(node, distance) AS (SELECT node, 0 FROM s UNION SELECT a, distance + 1 FROM i JOIN e ON b = node WHERE distance < 8),
r AS (SELECT node AS path, 'dependency' AS relation, distance FROM o WHERE distance > 0 UNION ALL SELECT node, CASE WHEN {_REVIEW_TEST.format(p='node')} THEN 'test' ELSE 'caller' END, distance FROM i WHERE distance > 0)
SELECT path, relation, CAST(min(distance) AS BIGINT) AS distance FROM r WHERE path NOT IN (SELECT node FROM s) GROUP BY path, relation ORDER BY path, relation LIMIT 128""")
def related_to_rescans(spark: SparkSession, root: str) -> DataFrame:
    """Files related to those that were scanned again, nearest first of each relation, cut as a report is."""
    f = table(spark, root, "files").groupBy("path").agg(F.countDistinct("scanned_at").alias("n")).where("n > 1").select("path")
    return impact.related_files(f, _edges(spark, root))


def _module_rows(language: str, pattern: str) -> str:
    return f"SELECT id, '{language}' AS language, unnest(regexp_extract_all(content, '{pattern}', 1)) AS module FROM {ONE_CHUNK} WHERE language = '{language}'"


@query(f"""WITH m AS ({_module_rows('go', '(?m)^import "([^"]+)"')} UNION ALL {_module_rows('rust', '(?m)^use ((?:crate|self|super)(?:::[a-z_]+)+);')})
SELECT language, module, count(DISTINCT id) AS chunks FROM m GROUP BY language, module""")
def imported_modules(spark: SparkSession, root: str) -> DataFrame:
    """What Go and Rust chunks import, read by the lexers of their languages."""
    c = table(spark, root, "chunks").where("id IS NOT NULL AND content IS NOT NULL AND language IN ('go', 'rust')").select("id", "language", "content")
    rows = c.mapInArrow(graph.module_rows, "id string, language string, module string").distinct()
    return rows.groupBy("language", "module").agg(F.count("*").alias("chunks"))


@query(f"""WITH f AS (SELECT DISTINCT path, {_STEM.format(p='path')} AS s, {_ISTEST.format(p='path')} AS t FROM files), e AS (SELECT * FROM f WHERE {_sql_in("lower(regexp_extract(path, '([^/]*)$', 1))", classify.ENTRYPOINTS)})
SELECT e.path AS start, f.path FROM e JOIN f ON e.t <> f.t AND e.s <> '' AND f.s <> '' AND (contains(e.s, f.s) OR contains(f.s, e.s))""")
def tests_of_entrypoints(spark: SparkSession, root: str) -> DataFrame:
    """Tests whose stem contains, or is contained in, that of an entry point, and the other way round."""
    f = table(spark, root, "files").select("path").distinct()
    return retrieve.related_tests(f.where(F.lower(F.substring_index("path", "/", -1)).isin(*classify.ENTRYPOINTS)), f)


_ENTRY = "(SELECT min(source_path) FROM imports)"


@query(f"""{_REACH.format(starts=f'SELECT {_ENTRY} AS node', name='o', to='b', frm='a', hops=16)}, c AS (SELECT {_ENTRY} AS path, 'selected' AS reason, 1 AS k UNION ALL SELECT node, 'outbound_dependency', 3 FROM o WHERE distance > 0 UNION ALL SELECT a, 'caller', 4 FROM e WHERE b = {_ENTRY}
UNION ALL SELECT f.path, 'related_test', 5 FROM (SELECT DISTINCT path, {_STEM.format(p='path')} AS s, {_ISTEST.format(p='path')} AS t FROM files) f, (SELECT {_STEM.format(p=_ENTRY)} AS s, {_ISTEST.format(p=_ENTRY)} AS t) q WHERE f.t <> q.t AND f.s <> '' AND q.s <> '' AND (contains(f.s, q.s) OR contains(q.s, f.s)))
SELECT path, arg_min(reason, k) AS reason FROM c WHERE path IN (SELECT path FROM files) GROUP BY path""")
def focus_on_file(spark: SparkSession, root: str) -> DataFrame:
    """The scope of the first importing file: itself, what it depends on, its callers and its tests, by the first reason."""
    entry = table(spark, root, "imports").agg(F.min("source_path")).first()[0] or ""
    return graph.file_scope(entry, _edges(spark, root), table(spark, root, "files"))


_FOLDER = "regexp_replace({p}, '/[^/]*$', '')"


@query(f"""WITH d AS (SELECT {_FOLDER.format(p=_ENTRY)} AS f), e AS (SELECT DISTINCT source_path AS a, target_path AS b FROM imports), m AS (SELECT DISTINCT path FROM files, d WHERE starts_with(path, f || '/')),
c AS (SELECT path, 'selected' AS reason, 1 AS k FROM m UNION ALL SELECT b, 'outbound_dependency', 3 FROM e WHERE a IN (SELECT path FROM m) UNION ALL SELECT a, 'caller', 4 FROM e WHERE b IN (SELECT path FROM m))
SELECT path, arg_min(reason, k) AS reason FROM c WHERE path IN (SELECT path FROM files) GROUP BY path""")
def focus_on_folder(spark: SparkSession, root: str) -> DataFrame:
    """The scope of a folder: its files, what they import, who imports them."""
    entry = table(spark, root, "imports").agg(F.min("source_path")).first()[0] or ""
    return graph.folder_scope(entry.rsplit("/", 1)[0], _edges(spark, root), table(spark, root, "files"))


@query("""WITH RECURSIVE r(start, node, distance) AS (SELECT DISTINCT source_path, source_path, 0 FROM imports UNION SELECT start, i.target_path, distance + 1 FROM r JOIN imports i ON i.source_path = node WHERE distance < 6),
n AS (SELECT start, node, min(distance) AS distance FROM r GROUP BY start, node HAVING min(distance) > 0)
SELECT start, node, CAST(distance AS BIGINT) AS distance, count(*) OVER (PARTITION BY start) > 3 AS truncated FROM n QUALIFY row_number() OVER (PARTITION BY start ORDER BY distance, node) <= 3""")
def nearest_three(spark: SparkSession, root: str) -> DataFrame:
    """The three nearest files that each importing file reaches, and whether there are more."""
    e = _edges(spark, root)
    return graph.distances(e.select(F.col("src").alias("node")), e, most_hops=6, most_nodes=3)


@query(f"""SELECT id, file_path AS path, start_line, end_line, CASE WHEN priority IS NULL OR isnan(priority) OR isinf(priority) THEN NULL ELSE round(priority, 3) END AS priority, language AS lang, sha256(content) AS sha, array_to_string(list_sort(coalesce(tags, [])), ',') AS role,
 len({_SYMBOL_LIST}) AS symbols FROM {ONE_CHUNK}""")
def jsonl_fields(spark: SparkSession, root: str) -> DataFrame:
    """The fields of each chunk's line of JSON, read back from the line."""
    from ..operators.render import jsonl

    names = [c for c in table(spark, root, "chunks").columns if c not in ("indexed_at", "ingested_at")]
    lines = jsonl(table(spark, root, "chunks").where("id IS NOT NULL").select(*names)).select("id", "line")
    read = F.from_json("line", "path string, start_line bigint, end_line bigint, priority double, lang string, content string, role string, symbols array<string>")
    r = lines.select("id", read.alias("r")).select("id", "r.path", "r.start_line", "r.end_line", "r.priority", "r.lang", F.sha2("r.content", 256).alias("sha"), "r.role", F.size("r.symbols").cast("bigint").alias("symbols"))
    return r.dropDuplicates(["id"])


@query("""WITH p AS (SELECT DISTINCT string_split(path, '/') AS p FROM files), r AS (SELECT array_to_string(p[:l], '/') AS path, l AS level, l < len(p) AS is_dir FROM (SELECT p, unnest(range(1, least(4, len(p)) + 1)) AS l FROM p))
SELECT path, level, bool_or(is_dir) AS is_dir, count(*) AS files FROM r GROUP BY path, level""")
def directory_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every folder and file to four levels, with the files below it."""
    return scope.tree_rows(table(spark, root, "files").where("path IS NOT NULL")).drop("sort_key")


@query("SELECT doc_id, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1) AS fence FROM documents")
def fence_lengths(spark: SparkSession, root: str) -> DataFrame:
    """How long a fence must be around each document."""
    from ..operators.render import fence

    return table(spark, root, "documents").select("doc_id", F.length(fence("text")).cast("bigint").alias("fence"))


@query(f"""WITH t AS (SELECT file_path AS path, arg_min(content, chunk_index) AS text FROM chunks WHERE chunk_index = 0 GROUP BY file_path), s AS (SELECT s.*, coalesce(text, '') AS text FROM {_SIGNALS_SQL} s LEFT JOIN t USING (path))
SELECT path, {_GEN} OR contains(lower(substr(text, 1, 2000)), 'generated') OR contains(lower(substr(text, 1, 2000)), 'do not edit') OR (NOT ends_with(name, '.json') AND strlen(split_part(text, chr(10), 1)) > 1000) AS generated FROM s""")
def generated_files(spark: SparkSession, root: str) -> DataFrame:
    """Whether a file counts as generated by its name, its folder or the beginning of its text."""
    head = table(spark, root, "chunks").where("chunk_index = 0").groupBy(F.col("file_path").alias("path")).agg(F.min("content").alias("text"))
    f = table(spark, root, "files").select("path").distinct().withColumn("rel", _relative()).join(head, "path", "left")
    return f.select("path", classify.rank_signals("rel", "text")["generated"].alias("generated"))


@query(f"SELECT file_path AS path, count(*) AS chunks, CAST(sum(strlen(content) // 4) AS BIGINT) AS tokens, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM {ONE_CHUNK} GROUP BY file_path")
def tokens_per_file(spark: SparkSession, root: str) -> DataFrame:
    c = _per_chunk(spark, root, path=F.col("file_path"), t=X.token_estimate("content"), b=F.octet_length("content").cast("bigint"))
    return c.groupBy("path").agg(F.count("*").alias("chunks"), F.sum("t").alias("tokens"), F.sum("b").alias("bytes"))


@query(f"SELECT reason, count(*) AS files, CAST(sum(coalesce(f.size_bytes, 0)) AS BIGINT) AS bytes FROM ({ORACLES['disposition_ladder']}) JOIN {ONE_FILE} USING (path) GROUP BY reason")
def bytes_by_reason(spark: SparkSession, root: str) -> DataFrame:
    """Files and bytes by why they are or aren't taken in."""
    sizes = _one_file(spark, root).select("path", F.coalesce("size_bytes", F.lit(0)).alias("size"))
    return disposition_ladder(spark, root).join(sizes, "path").groupBy("reason").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"SELECT reason, count(*) AS applications, count(DISTINCT path) AS files FROM ({ORACLES['two_hop_neighbors']}) GROUP BY reason")
def relation_counts(spark: SparkSession, root: str) -> DataFrame:
    """How often each relation of the import graph applies, and to how many files."""
    return two_hop_neighbors(spark, root).groupBy("reason").agg(F.count("*").alias("applications"), F.countDistinct("path").alias("files"))


@query(f"SELECT id, path, start_line, score, reasons FROM ({ORACLES['seed_scores']}) ORDER BY score DESC, path, start_line, id LIMIT 64")
def best_seeds(spark: SparkSession, root: str) -> DataFrame:
    """The seeds that a plan starts from: the sixty-four of the highest scores."""
    return seed_scores(spark, root).orderBy(F.desc("score"), "path", "start_line", "id").limit(retrieve.MAX_SEEDS)


@query(f"SELECT path FROM {ONE_FILE} WHERE coalesce(f.is_readme, false) OR coalesce(f.is_config, false) OR list_contains(coalesce(f.tags, []), 'entrypoint')")
def repository_anchors(spark: SparkSession, root: str) -> DataFrame:
    f = _one_file(spark, root)
    return f.where(F.coalesce("is_readme", F.lit(False)) | F.coalesce("is_config", F.lit(False)) | F.coalesce(F.array_contains("tags", "entrypoint"), F.lit(False))).select("path")


@query("""SELECT chunk_id, kind, name, count(*) OVER (PARTITION BY chunk_id) > 2 AS truncated FROM (SELECT DISTINCT chunk_id, kind, name FROM symbols) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY kind, name) <= 2""")
def capped_symbols(spark: SparkSession, root: str) -> DataFrame:
    """The first two symbols of each chunk, and whether there were more."""
    s = table(spark, root, "symbols").select("chunk_id", "kind", "name").distinct()
    return impact.capped(s, ["chunk_id"], [F.asc("kind"), F.asc("name")], 2)


_FOCUS_LANGUAGES = ("python", "javascript", "typescript", "go", "rust", "java", "c")


@query(f"""WITH s AS (SELECT DISTINCT path, regexp_replace(path, '/?[^/]*$', '') AS folder FROM files WHERE {_sql_in('language', _FOCUS_LANGUAGES)}), o AS (SELECT source_path AS path, count(DISTINCT target_path) AS n FROM imports GROUP BY 1), i AS (SELECT target_path AS path, count(DISTINCT source_path) AS n FROM imports GROUP BY 1)
SELECT folder AS path, 'module' AS kind, CAST(sum(coalesce(o.n, 0)) AS BIGINT) AS imports, CAST(sum(coalesce(i.n, 0)) AS BIGINT) AS used_by FROM s LEFT JOIN o USING (path) LEFT JOIN i USING (path) GROUP BY folder HAVING count(*) >= 2""")
def focus_folders(spark: SparkSession, root: str) -> DataFrame:
    """What one may focus on: folders of two or more sources with their imports either way."""
    return scope.focus_candidates(table(spark, root, "files"), _edges(spark, root), _FOCUS_LANGUAGES)


@query(f"SELECT id, sha256({_rules_sql('content')}) AS sha, true AS spans_hold FROM {ONE_CHUNK}")
def tracked_rules(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk after the tracked rules, as a fingerprint, and whether each recorded span holds its replacement."""
    fast = redact.Redaction(mode="fast", structure_safe=False)
    out = redact.redact_tracked(table(spark, root, "chunks").where("id IS NOT NULL"), language_col=None, config=fast)
    raw = F.encode("content", "UTF-8")
    holds = F.forall("occurrences", lambda o: F.substring(raw, o["start_byte"].cast("int") + 1, (o["end_byte"] - o["start_byte"]).cast("int")) == F.encode(o["replacement"], "UTF-8"))
    return out.select("id", F.sha2("content", 256).alias("sha"), holds.alias("spans_hold")).dropDuplicates(["id"])


@query(f"""SELECT id, len(list_filter(string_split(content, chr(10)), lambda x: {" OR ".join(f"starts_with(ltrim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), '{d}')" for d in split.DEFINITIONS['python'])})) AS definitions FROM {ONE_CHUNK} WHERE language = 'python'""")
def definition_lines(spark: SparkSession, root: str) -> DataFrame:
    """How many lines of each Python chunk begin a definition, nested ones included: where code is cut."""
    begins = lambda x: F.ltrim(F.translate(x, "\t\r\x0b\x0c", "    "))
    marks = F.filter(F.split("content", "\n"), lambda x: reduce(or_, [begins(x).startswith(d) for d in split.DEFINITIONS["python"]]))
    c = table(spark, root, "chunks").where("id IS NOT NULL AND language = 'python'").select("id", F.size(marks).cast("bigint").alias("definitions"))
    return c.dropDuplicates(["id"])


@query(f"SELECT id FROM ({ORACLES['seed_scores']})")
def plan_seeds(spark: SparkSession, root: str) -> DataFrame:
    """The chunks that a plan takes for themselves: every one that the task speaks of."""
    return retrieval_plan(spark, root).where("depth = 0").select("id")


@query("SELECT DISTINCT coalesce(source, '?') || '/' || doc_id || '.txt' AS path, true AS holds FROM documents WHERE text <> ''")
def split_holds(spark: SparkSession, root: str) -> DataFrame:
    """For every document whether each of its pieces is what its lines say."""
    d = table(spark, root, "documents").select(F.concat(F.coalesce("source", F.lit("?")), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("path"), F.when(F.col("doc_kind").isin("readme", "guide", "changelog"), "markdown").otherwise("text").alias("language"), "text")
    raw = F.encode("text", "UTF-8")
    pieces = split.split_files(d, text_col="text").select("path", "byte_start", "byte_end", F.encode("content", "UTF-8").alias("piece"))
    held = pieces.join(d.select("path", raw.alias("raw")), "path").select("path", (F.substring(F.col("raw"), (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int")) == F.col("piece")).alias("holds"))
    return held.groupBy("path").agg(F.min("holds").alias("holds"))


@query("SELECT true AS within, true AS has_source, true AS chosen_once")
def two_pool_holds(spark: SparkSession, root: str) -> DataFrame:
    """Whether the chunks chosen fit the limit, hold source, and are each chosen once."""
    c = _one_chunk(spark, root, "token_estimate", "language")
    kept = two_pool_budget(spark, root).join(c, "id")
    tokens = F.greatest(F.coalesce("token_estimate", F.lit(0)), F.lit(0))
    return kept.agg((F.sum(tokens) <= 20_000).alias("within"), (F.count_if(F.col("language").isin(*X.PROGRAMMING)) > 0).alias("has_source"), (F.count("*") == F.countDistinct("id")).alias("chosen_once"))


ORACLES["related_to_changes"] = ORACLES["related_to_rescans"].replace(_RESCANNED, f"SELECT path AS node FROM ({ORACLES['index_refresh_plan']}) WHERE action IN ('added', 'updated')")
