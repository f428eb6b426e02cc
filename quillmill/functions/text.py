"""Scalar column functions: estimates, fingerprints, paths, languages, words, entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by extension. Fixed values.
LANGUAGES = {
    "python": ".py .pyi .pyx", "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .tsx", "go": ".go", "java": ".java", "kotlin": ".kt .kts", "rust": ".rs", "c": ".c .h", "cpp": ".cpp .hpp .cc .cxx",
    "csharp": ".cs", "ruby": ".rb", "php": ".php", "swift": ".swift", "scala": ".scala", "bash": ".sh .bash", "zsh": ".zsh", "markdown": ".md", "restructuredtext": ".rst", "asciidoc": ".adoc", "text": ".txt",
    "yaml": ".yaml .yml", "toml": ".toml", "json": ".json", "jsonl": ".jsonl", "csv": ".csv", "gdscript": ".gd", "godot_scene": ".tscn", "godot_resource": ".tres", "godot_shader": ".gdshader",
    "godot_shader_include": ".gdshaderinc", "godot_project": ".godot", "godot_uid": ".uid", "godot_import": ".import", "godot_binary_resource": ".res .scn", "image_asset": ".png .jpg .jpeg .webp .svg",
    "model_asset": ".glb .gltf .blend .fbx .obj", "audio_asset": ".wav .ogg .mp3 .flac", "ini": ".ini .cfg", "html": ".html", "css": ".css", "scss": ".scss", "less": ".less", "vue": ".vue", "svelte": ".svelte",
    "sql": ".sql", "dockerfile": ".dockerfile", "graphql": ".graphql", "protobuf": ".proto",
}
EXTENSION_LANGUAGE = {e: language for language, extensions in LANGUAGES.items() for e in extensions.split()}
#: Languages whose chunks are source. Fixed values.
PROGRAMMING = ("python", "javascript", "typescript", "go", "java", "kotlin", "rust", "c", "cpp", "csharp", "ruby", "php", "swift", "scala", "gdscript", "svelte", "vue")
SYMBOL_KINDS = ("def", "type", "impl", "class", "method", "function")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_estimate(text: Column | str) -> Column:
    """Tokens of a text: its UTF-8 bytes by four, rounded down."""
    return F.floor(F.octet_length(col(text)) / 4).cast("bigint")


def fingerprint(text: Column | str, digits: int = 64) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, digits)


def chunk_id(path: Column | str, start: Column | str, end: Column | str, text: Column | str) -> Column:
    """Identity of a chunk: its place and its first thousand characters."""
    return fingerprint(F.concat(col(path), F.lit(":"), col(start).cast("string"), F.lit("-"), col(end).cast("string"), F.lit(":"), F.substring(col(text), 1, 1000)), 16)


def base_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def extension_of(path: Column | str) -> Column:
    """Lower-cased extension with its dot; empty for names without one or that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def language_of(path: Column | str) -> Column:
    """Language by extension, else by file name, else text."""
    name, ext = F.lower(base_name(path)), extension_of(path)
    known = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv])
    return F.coalesce(
        F.try_element_at(known, ext),
        F.when(name == "dockerfile", "dockerfile").when(name == "makefile", "makefile").when(name == "rakefile", "ruby").when((ext == "") & name.endswith("rc"), "shell").otherwise("text"),
    )


def words(text: Column | str) -> Column:
    """Search words: split at anything but letters and digits and where a capital follows, lower case, two characters or more."""
    parts = F.split(col(text), r"[^\p{IsAlphabetic}\p{N}]+|(?<=[\p{IsLowercase}\p{N}])(?=\p{IsUppercase})")
    return F.filter(F.transform(parts, F.lower), lambda w: F.char_length(w) >= 2)


def entropy(text: Column | str) -> Column:
    """Shannon entropy of the characters in bits; empty texts have none."""
    n = F.char_length(col(text))
    one = lambda ch: (n - F.char_length(F.replace(col(text), ch, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(col(text), "")), F.lit(0.0), lambda acc, ch: acc - F.when(ch == "", 0.0).otherwise(one(ch) * F.log2(one(ch))))


def strip_url_credentials(url: Column | str) -> Column:
    return F.regexp_replace(col(url), r"^([a-z][a-z0-9+.\-]*://)[^/@\s]*@", "$1")


def clamped_priority(priority: Column | str) -> Column:
    """Priority within 0 and 1; missing and NaN count as 0."""
    c = col(priority)
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def symbols_of(tags: Column | str) -> Column:
    """Names in tags of the form ``kind:name``."""
    kept = F.filter(F.coalesce(col(tags), F.array().cast("array<string>")), lambda t: F.split(t, ":", 2)[0].isin(*SYMBOL_KINDS) & (F.instr(t, ":") > 0))
    return F.transform(kept, lambda t: F.split(t, ":", 2)[1])
