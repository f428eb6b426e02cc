"""Rule-based redaction: ordered patterns, an entropy pass, a long-token pass, with every replacement tracked."""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PROGRAMMING, col
from ..session import spread

#: (name, pattern, replacement) in the order of use, specific before generic. Fixed values.
RULES: tuple[tuple[str, str, str], ...] = (
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b", "[AWS_ACCESS_KEY_REDACTED]"),
    ("aws_secret_key", r"(?i)(aws[_\-]?secret[_\-]?(?:access[_\-]?)?key)['\"]?\s*[:=]\s*['\"]?([A-Za-z0-9/+=]{40})['\"]?", "$1=[AWS_SECRET_REDACTED]"),
    ("github_token", r"\bghp_[A-Za-z0-9]{36}\b", "[GITHUB_TOKEN_REDACTED]"),
    ("github_oauth", r"\bgho_[A-Za-z0-9]{36}\b", "[GITHUB_OAUTH_REDACTED]"),
    ("github_app_token", r"\bghu_[A-Za-z0-9]{36}\b", "[GITHUB_APP_TOKEN_REDACTED]"),
    ("github_refresh_token", r"\bghr_[A-Za-z0-9]{36}\b", "[GITHUB_REFRESH_TOKEN_REDACTED]"),
    ("gitlab_token", r"\bglpat-[A-Za-z0-9\-_]{20,}\b", "[GITLAB_TOKEN_REDACTED]"),
    ("slack_token", r"\bxox[baprs]-[0-9A-Za-z\-]{10,}\b", "[SLACK_TOKEN_REDACTED]"),
    ("slack_webhook", r"https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+", "[SLACK_WEBHOOK_REDACTED]"),
    ("stripe_key", r"\bsk_live_[A-Za-z0-9]{24,}\b", "[STRIPE_SECRET_KEY_REDACTED]"),
    ("stripe_test_key", r"\bsk_test_[A-Za-z0-9]{24,}\b", "[STRIPE_TEST_KEY_REDACTED]"),
    ("twilio_api_key", r"\bSK[0-9a-fA-F]{32}\b", "[TWILIO_KEY_REDACTED]"),
    ("sendgrid_key", r"\bSG\.[A-Za-z0-9\-_]{22,}\.[A-Za-z0-9\-_]{22,}\b", "[SENDGRID_KEY_REDACTED]"),
    ("mailchimp_key", r"\b[a-f0-9]{32}-us[0-9]{1,2}\b", "[MAILCHIMP_KEY_REDACTED]"),
    ("google_api_key", r"\bAIza[0-9A-Za-z\-_]{35}\b", "[GOOGLE_API_KEY_REDACTED]"),
    ("google_oauth", r"\b[0-9]+-[a-z0-9_]{32}\.apps\.googleusercontent\.com\b", "[GOOGLE_OAUTH_REDACTED]"),
    ("firebase_key", r"\bAAAA[A-Za-z0-9_-]{7,}:[A-Za-z0-9_-]{140,}\b", "[FIREBASE_KEY_REDACTED]"),
    ("heroku_api_key", r"(?i)(heroku[_\-]?api[_\-]?key)['\"]?\s*[:=]\s*['\"]?([a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12})['\"]?", "$1=[HEROKU_KEY_REDACTED]"),
    ("npm_token", r"\bnpm_[A-Za-z0-9]{36}\b", "[NPM_TOKEN_REDACTED]"),
    ("pypi_token", r"\bpypi-[A-Za-z0-9\-_]{50,}\b", "[PYPI_TOKEN_REDACTED]"),
    ("openai_key", r"\bsk-[A-Za-z0-9]{20,}\b", "[REDACTED_OPENAI_KEY]"),
    ("private_key_header", r"-----BEGIN\s+(?:RSA\s+|DSA\s+|EC\s+|OPENSSH\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(?:RSA\s+|DSA\s+|EC\s+|OPENSSH\s+)?PRIVATE\s+KEY-----", "[PRIVATE_KEY_REDACTED]"),
    ("jwt_token", r"\beyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\b", "[JWT_TOKEN_REDACTED]"),
    ("connection_string", r"((?:postgres|mysql|mongodb|redis|amqp)(?:ql)?://[^:]+:)([^@]+)(@)", "$1[PASSWORD_REDACTED]$3"),
    ("url_auth", r"\b(https?://[^\s/:@<>\"']+:)([^\s/@<>\"']+)(@[^\s<>\"']+)", "$1[PASSWORD_REDACTED]$3"),
    ("url_credential", r"(?i)([?&;](?:api[_-]?key|access[_-]?token|auth[_-]?token|id[_-]?token|token|session(?:id)?|jsessionid|signature|x-amz-signature|credential|password)=)([^&#\s<>\"']{16,})", "$1[URL_CREDENTIAL_REDACTED]"),
    ("auth_bearer", r"(?i)(Authorization:\s*Bearer\s+)([A-Za-z0-9\-_./+=]{20,})", "$1[BEARER_TOKEN_REDACTED]"),
    ("auth_basic", r"(?i)(Authorization:\s*Basic\s+)([A-Za-z0-9+/=]{20,})", "$1[BASIC_AUTH_REDACTED]"),
    ("x_api_key_header", r"(?i)(X-API-Key:\s*)([A-Za-z0-9\-_./+=]{16,})", "$1[API_KEY_REDACTED]"),
    ("generic_secret", r"(?i)((?:api[_\-]?key|apikey|secret[_\-]?key|secretkey|auth[_\-]?token|authtoken|access[_\-]?token|accesstoken|password|passwd|pwd|credentials?|bearer))(['\"]?\s*[:=]\s*['\"]?)([A-Za-z0-9\-_./+=]{16,})(['\"]?)", "$1$2[SECRET_REDACTED]$4"),
    ("env_secret", r"(?i)(export\s+(?:API_KEY|SECRET_KEY|AUTH_TOKEN|ACCESS_TOKEN|PASSWORD|DATABASE_URL|PRIVATE_KEY)[=])([^\s\n]+)", "$1[SECRET_REDACTED]"),
)
#: What a text (in lower case) must hold for a rule to be worth trying. Rules not named are always tried.
NEEDED = {
    "aws_access_key": ("akia",), "aws_secret_key": ("secret",), "github_token": ("ghp_",), "github_oauth": ("gho_",), "github_app_token": ("ghu_",), "github_refresh_token": ("ghr_",), "gitlab_token": ("glpat-",), "slack_token": ("xox",), "slack_webhook": ("hooks.slack.com",),
    "stripe_key": ("sk_live_",), "stripe_test_key": ("sk_test_",), "twilio_api_key": ("sk",), "sendgrid_key": ("sg.",), "mailchimp_key": ("-us",), "google_api_key": ("aiza",), "google_oauth": (".apps.googleusercontent.com",), "firebase_key": ("aaaa",), "heroku_api_key": ("heroku",),
    "npm_token": ("npm_",), "pypi_token": ("pypi-",), "openai_key": ("sk-",), "private_key_header": ("-----begin",), "jwt_token": ("eyj",), "connection_string": ("://",), "url_auth": ("://",), "url_credential": ("=",), "auth_bearer": ("bearer",), "auth_basic": ("basic",),
    "x_api_key_header": ("x-api-key",), "generic_secret": ("key", "token", "passw", "pwd", "credential", "bearer"), "env_secret": ("export",),
}
#: Values no pass touches: UUIDs, digests, versions, integrity hashes. Fixed values.
SAFE_VALUE = r"^(?:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32}|v?\d+\.\d+\.\d+(?:-[\w.]+)?(?:\+[\w.]+)?|sha(?:256|384|512)-[A-Za-z0-9+/=]+)$"
#: An unquoted reference in code. Fixed value.
CODE_REFERENCE = re.compile(r"[_A-Za-z][_A-Za-z0-9]*(?:\.[_A-Za-z][_A-Za-z0-9]*)*")


def redact_text_column(text: Column | str, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The text after every rule, inside the JVM; for where neither spans nor counts are asked for."""
    out = col(text)
    for _, pattern, replacement in rules:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    return out


def is_safe_value(value: Column | str) -> Column:
    return col(value).rlike(SAFE_VALUE)


@dataclass(frozen=True)
class Redaction:
    """What a redaction does. ``mode`` is fast (rules), standard (and entropy), paranoid (and long tokens) or structure-safe."""

    mode: str = "standard"
    custom: tuple[tuple[str, str, str], ...] = ()
    allow: frozenset[str] = frozenset()
    min_length: int = 20
    threshold: float | None = None
    structure_safe: bool = True
    keep_on_broken_structure: bool = False
    safe_files: str | None = None
    skip_files: str | None = None
    rules: tuple[tuple[str, str, str], ...] = field(default=RULES)


def shannon(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in map(value.count, set(value))) if n else 0.0


class Redactor:
    """Rewrites a text and keeps where each replacement lies in the result (characters), whatever is replaced after it."""

    def __init__(self, config: Redaction = Redaction()) -> None:
        self.config = config
        self.rules = []
        for name, pattern, replacement in (*config.rules, *config.custom):
            try:
                self.rules.append((name, re.compile(pattern), re.sub(r"\$\{?(\d)\}?", r"\\g<\1>", replacement)))
            except re.error:
                continue  # a custom rule that doesn't compile is left out
        self.token = re.compile(rf"\b[A-Za-z0-9+/=_-]{{{config.min_length},}}\b")
        self.long_token = re.compile(r"\b[A-Za-z0-9+/=_-]{32,}\b")
        self.safe = re.compile(SAFE_VALUE)
        self.threshold = config.threshold if config.threshold is not None else 3.5 if config.mode == "paranoid" else 4.5

    @staticmethod
    def _replace(text: str, spans: list[tuple], name: str, pattern: re.Pattern, make: Callable[[re.Match], str | None]) -> tuple[str, list[tuple], int]:
        out, new, last, moved, shift, count = [], [], 0, [], 0, 0
        edits = []
        for m in pattern.finditer(text):
            value = make(m)
            if value is None:
                continue
            out += (text[last : m.start()], value)
            edits.append((m.start(), m.end(), len(value)))
            new.append((name, m.start() + shift, m.start() + shift + len(value), value))
            shift += len(value) - (m.end() - m.start())
            last = m.end()
            count += 1
        if not count:
            return text, spans, 0
        for s in spans:
            if any(a < s[2] and b > s[1] for a, b, _ in edits):
                continue  # swallowed by a later replacement
            d = sum(n - (b - a) for a, b, n in edits if b <= s[1])
            moved.append((s[0], s[1] + d, s[2] + d, s[3]))
        return "".join(out) + text[last:], sorted(moved + new, key=lambda s: s[1]), count

    def redact(self, text: str, language: str = "", path: str = "") -> tuple[str, dict[str, int], list[tuple]]:
        counts: dict[str, int] = {}
        spans: list[tuple] = []
        if self.config.skip_files and re.search(self.config.skip_files, path):
            return text, counts, spans  # a file on the allow-list
        out, low = text, text.lower()
        for name, pattern, replacement in self.rules:
            if (needed := NEEDED.get(name)) and not any(k in low for k in needed):
                continue

            def make(m: re.Match, replacement: str = replacement, name: str = name) -> str | None:
                if name == "generic_secret" and language in PROGRAMMING and not m[4] and m[2].rstrip()[-1:] not in "\"'" and CODE_REFERENCE.fullmatch(m[3]):
                    return None
                return m.expand(replacement)

            out, spans, n = self._replace(out, spans, name, pattern, make)
            if n:
                counts[name] = counts.get(name, 0) + n
        safe = self.config.structure_safe or self.config.mode == "structure-safe"
        if safe and language == "python" and out != text and _parses(text) and not _parses(out):
            if not self.config.keep_on_broken_structure:
                return text, {"structure_safe_reverted": 1}, []
        ruled = (out, dict(counts), spans)
        if self.config.mode in ("standard", "paranoid", "structure-safe"):
            out, spans, n = self._replace(out, spans, "entropy_detected", self.token, lambda m: None if self._exempt(m, out) or shannon(m[0]) < self.threshold else "[HIGH_ENTROPY_REDACTED]")
            if n:
                counts["entropy_detected"] = n
        if self.config.mode == "paranoid" and not (self.config.safe_files and re.search(self.config.safe_files, path)):
            out, spans, n = self._replace(out, spans, "paranoid_redacted", self.long_token, lambda m: None if self._known(m[0]) else "[LONG_TOKEN_REDACTED]")
            if n:
                counts["paranoid_redacted"] = n
        if safe and language == "python" and out != ruled[0] and _parses(ruled[0]) and not _parses(out):
            return ruled
        return out, counts, spans

    def _exempt(self, m: re.Match, text: str) -> bool:
        return self._known(m[0]) or _within_address(text, m.start())

    def _known(self, token: str) -> bool:
        return token in self.config.allow or self.safe.match(token) is not None or "REDACTED" in token


_ENDS_ADDRESS = re.compile(r"[\s\"'()\[\]<>]")


def _within_address(text: str, at: int) -> bool:
    """Whether a web address begins before a place and no white space, quote or bracket ends it before that."""
    begin = max(text.rfind("http://", 0, at), text.rfind("https://", 0, at))
    return begin >= 0 and _ENDS_ADDRESS.search(text, begin, at) is None


def _parses(text: str) -> bool:
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


_SPAN = pa.list_(pa.struct([("rule", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("replacement", pa.string())]))


def _tracker(config: Redaction) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redactor = Redactor(config)
        for batch in batches:
            texts, spans, counts = [], [], []
            for text, language, path in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                out, n, found = redactor.redact(text, language or "", path or "")
                at = lambda i, out=out: i if out.isascii() else len(out[:i].encode())
                texts.append(out)
                spans.append([{"rule": r, "start_byte": at(a), "end_byte": at(b), "replacement": v} for r, a, b, v in found])
                counts.append(list(n.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, _SPAN), pa.array(counts, pa.map_(pa.string(), pa.int32()))], ["id", "content", "occurrences", "counts"])

    return run


def redact_tracked(rows: DataFrame, id_col: str = "id", text_col: str = "content", language_col: str | None = "language", path_col: str | None = None, config: Redaction = Redaction()) -> DataFrame:
    """``id, content, occurrences, counts``: the redacted text, each replacement's byte span in it, and counts by rule. No shuffle."""
    lit = F.lit("").alias
    narrow = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(language_col).alias("l") if language_col else lit("l"), F.col(path_col).alias("p") if path_col else lit("p"))
    return spread(narrow).mapInArrow(_tracker(config), "id string, content string, occurrences array<struct<rule:string,start_byte:bigint,end_byte:bigint,replacement:string>>, counts map<string,int>")


def redact_values(value: object, redactor: Redactor | None = None) -> object:
    """A JSON value with every text in it redacted, keys left as they are."""
    redactor = redactor or Redactor(Redaction(structure_safe=False))
    if isinstance(value, str):
        return redactor.redact(value)[0]
    if isinstance(value, dict):
        return {k: redact_values(v, redactor) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_values(v, redactor) for v in value]
    return value
