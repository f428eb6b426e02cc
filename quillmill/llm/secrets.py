"""Credentials embedded in source code (problem 3).

A keyword automaton scans each chunk once; only the lines around its hits are looked at further. Issuer formats are matched
by regular expressions and validated by their structure (decoded JWT headers, Basic pairs, alphabets and lengths); other
values count by the name they are assigned to and by their own look. Placeholders, references, paths, numbers, digests,
public keys and the markers of an earlier redaction are ruled out. A value put together from several literals is joined
first and counts on the line of its first literal. Matches are replaced by placeholders of the same length and the same
alphabet, character class by character class, so that the code keeps its shape and still parses.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Prefixes and formats the issuers document.
ISSUERS: tuple[tuple[str, str, str], ...] = (
    ("aws_access_key", "AKIA", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("aws_access_key", "ASIA", r"(?<![A-Za-z0-9])ASIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("github_token", "ghp_", r"(?<![A-Za-z0-9_])ghp_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    ("github_oauth", "gho_", r"(?<![A-Za-z0-9_])gho_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    ("github_app_token", "ghs_", r"(?<![A-Za-z0-9_])ghs_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    ("github_app_token", "ghu_", r"(?<![A-Za-z0-9_])ghu_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    ("github_refresh_token", "ghr_", r"(?<![A-Za-z0-9_])ghr_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    ("github_token", "github_pat_", r"(?<![A-Za-z0-9_])github_pat_[A-Za-z0-9_]{22,}"),
    ("gitlab_token", "glpat-", r"(?<![A-Za-z0-9_])glpat-[A-Za-z0-9_\-]{20}(?![A-Za-z0-9_\-])"),
    ("slack_token", "xox", r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9\-]{10,}"),
    ("slack_webhook", "hooks.slack.com", r"https://hooks\.slack\.com/services/T[A-Za-z0-9]+/B[A-Za-z0-9]+/[A-Za-z0-9]{16,}"),
    ("stripe_key", "sk_live_", r"(?<![A-Za-z0-9_])sk_live_[A-Za-z0-9]{16,}"),
    ("stripe_test_key", "sk_test_", r"(?<![A-Za-z0-9_])sk_test_[A-Za-z0-9]{16,}"),
    ("stripe_key", "rk_live_", r"(?<![A-Za-z0-9_])rk_live_[A-Za-z0-9]{16,}"),
    ("stripe_test_key", "rk_test_", r"(?<![A-Za-z0-9_])rk_test_[A-Za-z0-9]{16,}"),
    ("sendgrid_key", "SG.", r"(?<![A-Za-z0-9_])SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}"),
    ("google_api_key", "AIza", r"(?<![A-Za-z0-9_])AIza[A-Za-z0-9_\-]{35}(?![A-Za-z0-9_\-])"),
    ("google_oauth", "ya29.", r"(?<![A-Za-z0-9_])ya29\.[A-Za-z0-9_\-]{20,}"),
    ("npm_token", "npm_", r"(?<![A-Za-z0-9_])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    ("pypi_token", "pypi-", r"(?<![A-Za-z0-9_])pypi-AgE[A-Za-z0-9_\-]{40,}"),
    ("openai_key", "sk-", r"(?<![A-Za-z0-9_])sk-(?:proj-)?[A-Za-z0-9_\-]{20,}"),
    ("twilio_api_key", "SK", r"(?<![A-Za-z0-9])SK[0-9a-f]{32}(?![A-Za-z0-9])"),
    ("jwt_token", "eyJ", r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,}"),
    ("auth_bearer", "earer ", r"(?i:\bbearer) +(?P<v>[A-Za-z0-9_\-.=+/~]{16,})"),
    ("auth_basic", "asic ", r"(?i:\bbasic) +(?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])"),
    ("x_api_key_header", "pi-", r"(?i:x-api-key)[\"']?\s*[:=]\s*[\"']?(?P<v>[A-Za-z0-9_\-]{16,})"),
    ("connection_string", "://", r"\b(?:postgres(?:ql)?|mysql|mariadb|redis|rediss|mongodb(?:\+srv)?|amqps?|mssql|sqlserver|ldap)://[^\s:/@\"'`]*:(?P<v>[^\s@\"'`/]{3,})@[^\s\"'`]"),
    ("url_auth", "://", r"\b[a-z][a-z0-9+.\-]*://[^\s:/@\"'`]+:(?P<v>[^\s@\"'`/]{3,})@[^\s\"'`]"),
    ("url_credential", "://", r"://[^\s\"'`]*[?&](?:access_token|api_key|apikey|key|token|secret|password|sessionid|sig)=(?P<v>[^\s&\"'`]{12,})"),
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Names that a secret is assigned to, in the languages of the corpus. Fixed values.
NAME_WORDS = (
    "password", "passwd", "passphrase", "passwort", "kennwort", "contrasena", "contraseña", "clave", "motdepasse", "mot_de_passe", "mdp", "senha", "pwd", "pass",
    "secret", "secreto", "geheimnis", "token", "apikey", "api_key", "accesskey", "access_key", "authkey", "auth_key", "privatekey", "private_key", "signingkey", "signing_key",
    "encryptionkey", "encryption_key", "credential", "credentials", "schluessel", "auth", "key", "login",
)
#: Compounds of "token" that speak of lexers and limiters are no secrets.
_NAME = re.compile(r"passw(?:or[dt])?|passwd|passphrase|passcode|kennwort|contrase[nñ]a|clave|mot_?de_?passe|\bmdp\b|senha|pwd|(?:^|_)pass(?!ag|ed|eng|er|es|ing|ion|iv|port|through|able|é)|secret|geheim|token(?!s?_?(?:streams?|i[sz]|ring|bucket|sets?|lists?|types?|counts?|pool|filter|buffer|reader|writer|scanner|parser|kinds?)(?:$|_|e))|api_?key|access_?key|auth_?key|private_?key|signing_?key|encryption_?key|credential|(?:^|_)(?:auth|login|key|cle|schl[uü]e?ssel|llave)(?:$|_)|_key(?:$|_)", re.I)
#: Names that hold a secret's place, size, age or public half instead of the secret.
_NOT_NAME = re.compile(r"(?:^|_)(?:limit|count|size|length|len|file|path|dir|url|uri|ttl|expir\w*|timeout|name|type|id|ids|format|prefix|suffix|header|hash|digest|checksum|sha\d*|md5|policy|reset|hint|field|label|column|public|pub|min|max|index|stream|kind|mode|rotation|days|source|env|var|ref|store|manager|provider|class|test)(?:_?[a-z]{6,})?$|public|tokeni[sz]er|tokens$|keyboard|keyword|monkey|foreign_?key|primary_?key", re.I)
_MARKER = re.compile(r"\[[A-Z0-9_]*REDACTED[A-Z0-9_]*\]|<redacted>|\*{3,}|REDACTED", re.I)
_PLACEHOLDER = re.compile(
    r"x{4,}|X{4,}|\*{3,}|\.{3,}|your[_\- ]|_here$|example|sample|dummy|placeholder|change[_\- ]?me|replace[_\- ]?me|insert[_\- ]|todo|<[^>]*>|\$\{|\$\(|\{\{|%\(|\$[A-Z_]{2,}|0{8,}|1234567|abcdef(?:gh|123)|foobar|lorem", re.I
)
_REFERENCE = re.compile(r"(?:os\.environ|process\.env|getenv|globalThis|env\[|secrets?\.|vault|config\.|settings\.|self\.|this\.|args\.|System\.)|\(\)$", re.I)
_PATH = re.compile(r"^(?:\.{0,2}/|~/|[A-Za-z]:\\|[\w.\-]+/[\w.\-/]*\.\w{1,6}$|arn:|file:|https?://)")
_LITERAL = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
#: name, then = or : (with a type, an arrow or a default call between), then a literal or a bare value.
_ASSIGNED = re.compile(
    rf"(?P<name>[A-Za-z_\u00c0-\u024f][\w\-.\u00c0-\u024f]*)[\"'`]?(?:\]|\))?\s*(?::\s*&?(?:'static\s+)?\w+(?:\[\])?\s*=|:=|=>|=|:|,|\bto\b|\bis\b)\s*(?:\w[\w.]*\s*(?:\|\||\?\?|\bor\b)\s*)?[\(\[]?\s*(?P<value>{_LITERAL}|[^\s\"'`,;(){{}}\[\]<>#]+)"
)
_DEFINE = re.compile(rf"#define\s+(?P<name>\w+)\s+(?P<value>{_LITERAL})")
_FLAG = re.compile(rf"--(?P<name>[a-z][a-z\-]*)[ =](?P<value>{_LITERAL}|\S+)")
_TAIL = re.compile(r"(?P<value>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)\s*;?\s*(?://|#|--|/\*)\s*(?P<name>[A-Za-z_]\w*)\s*(?:\*/)?\s*$")
_PROSE = re.compile(r"(?:\b(?P<name>(?:[A-Za-z]+[_\-])?(?:password|passphrase|passwort|secret|token|pwd|kennwort|contraseña|clave|mot de passe|api[ _]key|pass))\b)\s*(?:/|is|was|ist|war|es|era|est|était|=|:)\s*(?P<value>\S+)", re.I)
_JOINED = re.compile(r"[\"'`][ \t]*(?:\+|\.\.|\\|\.)?[ \t]*\r?\n?[ \t]*(?:\+|\.)?[ \t]*[\"'`]")
_OPEN_JOIN = re.compile(r"[\"'`][ \t]*(?:\+|\.\.|\\)[ \t]*\r?$")
_COMMENT_LINE = re.compile(r"^\s*(?://|#|--|/\*|\*|;|<!--)")


class Found(NamedTuple):
    """A credential: its rule, its place in the text (characters), and where its parts lie if it has several literals."""

    rule: str
    start: int
    end: int


#: What the names of ``_NAME`` and the prose forms hold, a word for each of its alternatives. Fixed values.
_NAME_KEYWORDS = (
    "passw", "passphrase", "passcode", "kennwort", "contrasena", "contraseña", "clave", "mot_de_passe", "motdepasse", "motde_passe", "mot_depasse", "mot de passe", "mdp", "senha", "pwd", "pass", "secret", "geheim", "token",
    "apikey", "api_key", "api key", "accesskey", "authkey", "privatekey", "signingkey", "encryptionkey", "credential", "auth", "login", "key", "cle", "schlussel", "schlüssel", "schluessel", "schlüessel", "llave",
)
_KEYWORDS = sorted({key.lower() for _, key, _ in ISSUERS} | {"-----begin"} | set(_NAME_KEYWORDS))
_ANY_NAME = re.compile("|".join(map(re.escape, _NAME_KEYWORDS)))
_RULES = [(rule, key.lower(), re.compile(pattern)) for rule, key, pattern in ISSUERS]
_automaton = None


def _hits(text: str) -> Iterator[int]:
    """Ends of the keywords in a lower-cased text."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for k in _KEYWORDS:
            _automaton.add_word(k, k)
        _automaton.make_automaton()
    for end, word in _automaton.iter(text):
        yield end


def _classes(value: str) -> int:
    return sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))


def _is_reference(value: str) -> bool:
    return bool(_PLACEHOLDER.search(value) or _MARKER.search(value) or _REFERENCE.search(value) or _PATH.match(value))


def valid_jwt(value: str) -> bool:
    """Whether the first part decodes to a JSON object that names an algorithm or type."""
    try:
        head = value.split(".", 1)[0]
        parsed = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(parsed, dict) and ("alg" in parsed or "typ" in parsed)


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(rule: str, value: str) -> bool | None:
    """Whether the checksum that some issuers put into a token's last six characters is right; None where there is none.

    It tells a token that was issued from one made up; it doesn't decide what is found, as test keys count.
    """
    if not re.fullmatch(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}", value):
        return None
    n, out = zlib.crc32(value[4:34].encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = _BASE62[k] + out
    return out == value[34:]


def _decoded(value: str) -> str | None:
    try:
        raw = base64.b64decode(value, validate=True).decode("ascii")
    except (ValueError, binascii.Error):
        return None
    return raw if raw.isprintable() else None


def _valid(rule: str, value: str) -> bool:
    if _MARKER.search(value):
        return False
    if not re.search(r"[^xX0\W_]", _KEEP_PREFIX.sub("", value, count=1)):
        return False  # one of our own placeholders
    if rule == "jwt_token":
        return valid_jwt(value)
    if rule == "auth_basic":
        pair = _decoded(value)
        return pair is not None and ":" in pair and not _is_reference(pair.split(":", 1)[1])
    if rule in ("connection_string", "url_auth", "url_credential"):
        return not _is_reference(value) and value.lower() not in ("password", "pass", "secret", "user", "pw", "token")
    if rule == "auth_bearer":
        return not _is_reference(value) and (_classes(value) >= 2 or len(value) >= 24) and bool(re.search(r"\d", value))
    if re.search(r"(.)\1{7,}", value) or re.search(r"x{6,}|X{6,}|EXAMPLE|example", value):
        return False
    return rule != "openai_key" or bool(re.search(r"\d", value) and re.search(r"[A-Z]", value))


_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_WORDY = re.compile(r"[a-z]+(?:[ _\-.][a-z]+)*|[A-Z]+(?:[_\-][A-Z]+)*", re.I)
_STRONG_NAME = re.compile(r"passw|passphrase|passcode|kennwort|contrase|clave|mot_?de_?passe|mdp|senha|pwd|secret|geheim|(?:^|_)pass(?:$|_)", re.I)


def looks_secret(name: str, value: str) -> bool:
    """Whether a value assigned to a name that speaks of a secret looks like one."""
    if len(value) < 8 or any(c.isspace() for c in value):
        return False
    if re.fullmatch(r"[A-Za-z0-9/+]{40}", value) and _classes(value) >= 3 and re.search(r"aws|secret|access", name, re.I):
        return True  # the form of a cloud provider's secret key, which may begin like a path
    if _is_reference(value) or not re.search(r"[^xX0\W_]", _KEEP_PREFIX.sub("", value, count=1)):
        return False
    if len(value) >= 20 and re.fullmatch(r"[A-Za-z0-9_\-+/=]+", value) and len(re.findall(r"[a-z][A-Z]", value)) >= 4 and not re.fullmatch(r"(?:[A-Z]?[a-z]{2,})+", value):
        return True
    if re.fullmatch(r"[\d.,:\-/_]+|v?\d+\.\d+[\w.\-]*", value) or _WORDY.fullmatch(value):
        return False
    if value.startswith(("ssh-", "AAAA", "MII", "sha256-", "sha512-", "sha1-", "sha256:", "urn:", "@", "#", "$", "&")) or "://" in value:
        return False
    if re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", value, re.I):
        return False
    if re.fullmatch(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+(?:\(.*)?|[A-Za-z_]\w*\(.*", value):
        return bool(_STRONG_NAME.search(name)) and bool(re.search(r"\d", value)) and _classes(value) >= 4
    if _HEX.fullmatch(value):
        return len(value) >= 32 and bool(re.search(r"token|secret|api_?key|auth", name, re.I)) and bool(re.search(r"\d", value)) and bool(re.search(r"[a-fA-F]", value))
    if _classes(value) >= 3 and re.search(r"\d|[^A-Za-z0-9_\-.]", value):
        return True
    return len(value) >= 16 and _classes(value) >= 2 and bool(re.search(r"\d", value)) and not re.fullmatch(r"[a-z]+[_\-]?\d{1,6}|[a-z]+(?:[_\-][a-z0-9]+)+", value)


def _rule_of(name: str) -> str:
    low = name.lower()
    if "aws_secret" in low or "awssecret" in low:
        return "aws_secret_key"
    if re.fullmatch(r"[A-Z][A-Z0-9_]*", name):
        return "env_secret"
    return "generic_secret"


def _is_name(name: str) -> bool:
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return bool(_NAME.search(name)) and not _NOT_NAME.search(name)


_NEXT_LITERAL = re.compile(r"\n[ \t]*(?:\+|\.)?[ \t]*[\"'`]")


def _goes_on(text: str, a: int, b: int) -> bool:
    """Whether the statement that ends at the line break ``b`` goes on in the next line."""
    while b > a and text[b - 1].isspace():
        b -= 1
    if b == a:
        return False
    if text[b - 1] in "(=+\\" or text.startswith("..", b - 2) and b - 2 >= a:
        return True
    return text[b - 1] in "\"'`" and _NEXT_LITERAL.match(text, text.find("\n", b)) is not None


def find_credentials(text: str) -> list[Found]:
    """Credentials of a text in order of their place, none within another."""
    low = text.lower() if text.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    regions: list[list[int]] = []
    done = -1
    for end in _hits(low):
        if end <= done:
            continue
        a = text.rfind("\n", 0, end) + 1
        b = text.find("\n", end)
        b = len(text) if b < 0 else b
        # A value may go on in the next lines: literals joined by operators, or in brackets.
        while b < len(text) and _goes_on(text, a, b):
            nxt = text.find("\n", b + 1)
            b = len(text) if nxt < 0 else nxt
        done = b
        if regions and a <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], b)
        else:
            regions.append([a, b])
    found: list[Found] = []
    for a, b in regions:
        found += _search_region(text[a:b], a)
    found = [f for f in found if f.rule != "private_key_header" or re.search(r"[^xX0\W_]|\A[\W_]*\Z", re.sub(r"\\n|-----END.*", "", text[f.end :], flags=re.S))]
    found.sort(key=lambda f: (f.start, -f.end))
    out: list[Found] = []
    for f in found:
        if not out or f.start >= out[-1].end:
            out.append(f)
    return out


def _joined(region: str) -> tuple[str, list[int]]:
    """The region with literals that are put together joined into one, and the place of each of its characters."""
    if not _JOINED.search(region):
        return region, []
    pieces, where, last = [], [], 0
    for m in _JOINED.finditer(region):
        if m.group()[0] != m.group()[-1]:
            continue
        between = m.group()[1:-1]
        if not between.strip(" \t\r\n") and "\n" not in between:
            continue  # an empty literal or neighbours, not a joint
        pieces.append(region[last : m.start()])
        where += range(last, m.start())
        last = m.end()
    pieces.append(region[last:])
    where += range(last, len(region))
    return "".join(pieces), where


def _search_region(region: str, base: int) -> list[Found]:
    text, where = _joined(region)
    at = (lambda i: where[i]) if where else (lambda i: i)
    low, out, taken = text.lower(), [], []

    def add(rule: str, s: int, e: int) -> None:
        if e > s and not any(s < y and e > x for x, y in taken):
            taken.append((s, e))
            out.append(Found(rule, base + at(s), base + at(e - 1) + 1))

    for m in PEM.finditer(text):
        add("private_key_header", m.start(), m.end())
    for rule, key, pattern in _RULES:
        if key in low:
            for m in pattern.finditer(text):
                group = "v" if "v" in pattern.groupindex else 0
                if _valid(rule, m.group(group)):
                    add(rule, m.start(group), m.end(group))
    if not _ANY_NAME.search(low):
        return out
    for pattern in (_DEFINE, _FLAG, _TAIL, _ASSIGNED, _PROSE):
        pos = 0
        while m := pattern.search(text, pos):
            pos = m.start("value") if pattern is _ASSIGNED else m.end()
            if pos <= m.start():
                pos = m.start() + 1
            name, value, s = m["name"], m["value"], m.start("value")
            if value[:1] in "\"'`" and len(value) > 1 and value[-1] == value[0]:
                value, s = value[1:-1], s + 1
            elif pattern is _PROSE:
                value = value.strip("\"'`").rstrip(",;")
                if value.endswith(("*/", "-->")):
                    value = value[: -2 if value.endswith("*/") else -3]
            elif pattern is _ASSIGNED and value[-1:] in ".":
                value = value[:-1]
            if pattern is _PROSE or _is_name(name):
                if looks_secret(name, value):
                    add(_rule_of(name), s, s + len(value))
    # INSERT ... VALUES ('name', 'value') and quoted pairs.
    for m in re.finditer(rf"(?P<name>{_LITERAL})\s*,\s*(?P<value>{_LITERAL})", text):
        if _is_name(m["name"][1:-1]) and looks_secret(m["name"], m["value"][1:-1]):
            add(_rule_of(m["name"][1:-1]), m.start("value") + 1, m.end("value") - 1)
    for m in re.finditer(r"`(?P<name>[\w\-]+)` (?:to|=|as|auf|a|à) `(?P<value>[^`\n]+)`", text):
        if _is_name(m["name"]) and looks_secret(m["name"], m["value"]):
            add(_rule_of(m["name"]), m.start("value"), m.end("value"))
    return out


def placeholder(value: str) -> str:
    """Same length, same alphabet: letters become x or X, digits 0, everything else stays."""
    return "".join("0" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in value)


_KEEP_PREFIX = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[a-z]-|[sr]k_(?:live|test)_|SG\.|AIza|npm_|pypi-|sk-(?:proj-)?|ya29\.)?")


def redact_text(text: str, found: list[Found]) -> str:
    """The text with every credential replaced; its length, its lines and its syntax stay. Bodies of private keys too."""
    if not found:
        return text
    out, last = [], 0
    for f in found:
        if f.start < last:
            continue
        out.append(text[last : f.start])
        if f.rule == "private_key_header":
            end = text.find("-----END", f.end)
            end = len(text) if end < 0 else end
            out.append(text[f.start : f.end])
            # The body: only lines of the key's alphabet, so that code after a truncated key stays.
            body = text[f.end : end]
            stop = 0
            for line in re.finditer(r"[^\n]*\n?", body):
                stripped = line.group().strip().strip("\"'`+\\,n ")
                if line.group() and stripped and not re.fullmatch(r"[A-Za-z0-9+/=\\ :,\-]*", stripped):
                    break
                stop = line.end()
                if not line.group():
                    break
            key = re.sub(r"\\n|[A-Za-z0-9+/=]{16,}", lambda m: m.group() if m.group() == "\\n" else placeholder(m.group()), body[:stop])
            out.append(key)
            last = f.end + stop
            continue
        value = text[f.start : f.end]
        if "\n" in value or re.search(r"[\"'`]\s*\+", value):  # several literals: only what lies in them
            parts = re.split(r"([\"'`][ \t]*(?:\+|\.\.|\\|\.)?[ \t]*\r?\n?[ \t]*(?:\+|\.)?[ \t]*[\"'`])", value)
            keep = _KEEP_PREFIX.match(parts[0]).end()
            out.append("".join(p if i % 2 else (p[:keep] + placeholder(p[keep:]) if i == 0 else placeholder(p)) for i, p in enumerate(parts)))
        else:
            keep = _KEEP_PREFIX.match(value).end()
            out.append(value[:keep] + placeholder(value[keep:]))
        last = f.end
    out.append(text[last:])
    return "".join(out)


_SPANS = "chunk_id string, line_no bigint, rule string, start_byte bigint, end_byte bigint, checksum boolean"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], [], [], []]
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for f in find_credentials(text):
                before = text[: f.start]
                start = len(before.encode())
                for column, value in zip(rows, (key, before.count("\n") + 1, f.rule, start, start + len(text[f.start : f.end].encode()), checksum(f.rule, text[f.start : f.end]))):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()))], ["chunk_id", "line_no", "rule", "start_byte", "end_byte", "checksum"])


def _redactor(only_found: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, texts = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = find_credentials(text)
                if found or not only_found:
                    keys.append(key)
                    counts.append(len(found))
                    texts.append(redact_text(text, found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], ["chunk_id", "credentials", "content"])

    return run


def _rows(chunks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(chunks.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("chunk_id"), F.col(text_col).alias("text")))


def credential_spans(chunks: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``chunk_id, line_no, rule, start_byte, end_byte, checksum`` of every credential; ``checksum`` tells whether a token that
    carries one was really issued.

    Defined results: null ids or texts give no row; a chunk delivered twice gives its spans once; a text without credentials
    gives no row; extra columns are ignored; an empty table gives an empty result. Bytes are those of the UTF-8 text, the end
    exclusive; lines count from 1 and end at a line feed.
    """
    return _rows(chunks, id_col, text_col).mapInArrow(_scan, _SPANS).distinct()


def redact_credentials(chunks: DataFrame, id_col: str = "id", text_col: str = "content", only_found: bool = True) -> DataFrame:
    """``chunk_id, credentials, content`` with placeholders in the credentials' place: of the chunks that hold some, or of all."""
    rows = _rows(chunks, id_col, text_col).mapInArrow(_redactor(only_found), "chunk_id string, credentials bigint, content string")
    return rows.dropDuplicates(["chunk_id", "content"])
