"""Source files that do not parse (problem 6).

Each file's text is put together from its chunks and lexed by one regular expression of its language. The lexer yields
DataFrame rows of two kinds: the file's distinct pairs of adjacent token classes, which are anti-joined against the pairs
that the language's grammar permits (a table generated from the categories below), and the brackets that their own line
doesn't close, over which windows validate the nesting: the running depth never falls below zero and ends at zero, and on
each level every closing bracket is of the kind of the opening one before it. Productions of a statement that a pair can't
show (separators inside brackets, what may begin a statement at the margin, where a line break ends a statement) are looked
at while lexing, where the tokens are in order at hand. Python, JSON and TOML have exact parsers, which judge those files.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed, parts_for

#: Extension to grammar. Fixed values.
GRAMMARS = {"py": "python", "json": "json", "toml": "toml", "js": "js", "mjs": "js", "ts": "ts", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c"}

# ---- exact parsers -------------------------------------------------------------------------------------------------


def _reject(constant: str) -> None:
    raise ValueError(constant)


def exact_error(grammar: str, text: str) -> str | None:
    """What the exact parser of the language says against a text, or None."""
    try:
        if grammar == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text.removeprefix("﻿"))
        elif grammar == "json":
            json.loads(text, parse_constant=_reject)
        else:
            tomllib.loads(text)
    except (RecursionError, MemoryError):
        return deep_json_error(text) if grammar == "json" else None if balanced(text) else "brackets are not closed"
    except (SyntaxError, ValueError) as e:
        return type(e).__name__ + ": " + str(e).split("(", 1)[0].strip()[:80]
    return None


_JSON_TOKEN = re.compile(r"[ \t\r\n]*(?:(?P<mark>[{}\[\],:])|(?P<text>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<value>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|(?P<end>\Z)|(?P<bad>[\s\S]))")


def deep_json_error(text: str) -> str | None:
    """What speaks against a JSON text however deep it is: its tokens against a stack of open objects and arrays."""
    stack: list[str] = []
    want = "value"  # value, first (value or ]), key, firstkey (key or }), colon, comma
    for m in _JSON_TOKEN.finditer(text):
        kind, token = m.lastgroup, m.group(m.lastgroup)
        if kind == "end":
            return None if want == "comma" and not stack else "the text ends early"
        if want == "comma" and not stack or kind == "bad":
            return "what can't stand here"
        if want in ("value", "first") and (kind in ("text", "value") or token in ("{", "[")):
            if token in ("{", "["):
                stack.append(token)
                want = "firstkey" if token == "{" else "first"
            else:
                want = "comma"
        elif token == "]" and want in ("first", "comma") and stack[-1:] == ["["] or token == "}" and want in ("firstkey", "comma") and stack[-1:] == ["{"]:
            stack.pop()
            want = "comma"
        elif want in ("key", "firstkey") and kind == "text":
            want = "colon"
        elif want == "colon" and token == ":":
            want = "value"
        elif want == "comma" and token == ",":
            want = "key" if stack[-1] == "{" else "value"
        else:
            return "what can't stand here"
    return "the text ends early"


def balanced(text: str) -> bool:
    """Whether the brackets of a text close each other, literals and comments left out."""
    stack = []
    for m in re.finditer(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|#[^\n]*|[()\[\]{}]", text):
        c = m.group()
        if c in "([{":
            stack.append(c)
        elif c in ")]}" and (not stack or stack.pop() != {")": "(", "]": "[", "}": "{"}[c]):
            return False
    return not stack


# ---- lexers --------------------------------------------------------------------------------------------------------

_BLOCK_COMMENT = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
_DQ = r"\"(?:[^\"\\\n]|\\[\s\S])*\""
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.(?!\.)(?:\d[\d_]*)?)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)"
_IDENT = r"[^\W\d][\w]*"
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"

#: Suffix of a number, comment and string forms, identifiers, operators (longest first). Fixed values.
_FORMS = {
    "js": dict(strings=f"{_DQ}|{_SQ}|{_TEMPLATE}", ident=r"[#@]?(?:[^\W\d]|\$)[\w$]*", suffix=r"n?", ops=r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%=<>!~?:;,.(){}\[\]&|^]", line="//"),
    "go": dict(strings=rf"{_DQ}|'(?:[^'\\\n]|\\.[0-7a-fA-F]*)'|`[^`]*`", ident=_IDENT, suffix=r"i?", ops=r"\.\.\.|&\^=|<<=|>>=|&\^|:=|<-|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%=<>!~:;,.(){}\[\]&|^]", line="//"),
    "rust": dict(strings=r"b?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'", ident=rf"r#{_IDENT}|{_IDENT}", suffix=r"(?:_?(?:[iu](?:8|16|32|64|128|size)|f32|f64))?", ops=r"\.\.\.|\.\.=|<<=|>>=|::|->|=>|\.\.|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%=<>!?:;,.(){}\[\]&|^@#$~]", line="//"),
    "java": dict(strings=rf"\"\"\"[\s\S]*?\"\"\"|{_DQ}|'(?:[^'\\\n]|\\u[0-9a-fA-F]{{4}}|\\[0-7]{{1,3}}|\\.)'", ident=r"(?:[^\W\d]|\$)[\w$]*", suffix=r"[lLfFdD]?", ops=r">>>=|\.\.\.|<<=|>>=|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%=<>!~?:;,.(){}\[\]&|^@]", line="//"),
    "c": dict(strings=rf"(?:u8|[LuU])?{_DQ}|[LuU]?'(?:[^'\\\n]|\\[0-7xa-fA-F]+|\\.)+'", ident=r"(?:[^\W\d]|\$)[\w$]*", suffix=r"(?:[uUlLfF]{0,3})", ops=r"\.\.\.|<<=|>>=|->|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|##|[-+*/%=<>!~?:;,.(){}\[\]&|^#]", line="//"),
}
_FORMS["ts"] = _FORMS["js"]

#: Reserved words, and words that are reserved in places only. Fixed values.
_WORDS = {
    "js": "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield null true false",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    "java": "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while null true false",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool",
}
_WORDS["ts"] = _WORDS["js"] + " enum"
_CONTEXTUAL = {
    "js": "async await get set static of from as let target meta",
    "ts": "async await get set static of from as let target meta type interface namespace declare abstract readonly private public protected implements keyof is infer asserts module override satisfies unique global out any accessor require",
    "go": "",
    "rust": "union macro_rules auto default raw box",
    "java": "record sealed permits non var yield module open opens requires exports provides with uses to when",
    "c": "",
}
RESERVED = {k: frozenset(v.split()) for k, v in _WORDS.items()}
CONTEXTUAL = {k: frozenset(v.split()) for k, v in _CONTEXTUAL.items()}


@lru_cache(maxsize=None)
def _lexer(grammar: str) -> re.Pattern[str]:
    f = _FORMS[grammar]
    parts = []
    if grammar == "c":
        parts.append(r"(?P<pre>#[ \t]*[a-z]+\b(?:[^\n\\]|\\[\s\S])*)")
    if grammar in ("js", "ts"):
        parts.append(r"(?P<bang>\A#![^\n]*)")
    parts += [
        r"(?P<bad><{5,}|={5,}|>{5,}|/\*)",
        rf"(?P<str>{f['strings']})",
        *([r"(?P<life>'[^\W\d]\w*)"] if grammar == "rust" else []),
        rf"(?P<num>{_NUMBER}{f['suffix']}(?![\w$]))",
        rf"(?P<id>{f['ident']})",
        rf"(?P<op>{f['ops']})",
        r"(?P<eof>\Z)",
        r"(?P<bad2>[\s\S])",
    ]
    return re.compile(rf"(?P<skip>(?:[\s﻿]+|{f['line']}[^\n]*|{_BLOCK_COMMENT})*+)(?:" + "|".join(parts) + ")")


_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*")

_OPERAND_END = frozenset({"id", "num", "str", "tpl", "re", ")c", ")g", ")f", "]", "}o", "this", "super", "null", "true", "false", "self", "Self", "crate", "ctx", "++"})
_CONTROL = {"js": {"if", "for", "while", "switch", "catch", "with"}, "java": {"if", "for", "while", "switch", "catch", "synchronized", "try"}, "c": {"if", "for", "while", "switch"}, "go": set(), "rust": set()}
_CONTROL["ts"] = _CONTROL["js"]
_LITERAL_BEFORE = frozenset("= ( (k (c (g (f [ , : ? return && || ?? ... [i += => := {o yield default + case in of typeof !".split())
_TYPE_WORDS = frozenset("boolean byte char double float int long short void String".split())


def lex(grammar: str, text: str) -> tuple[set[tuple[str, str, bool]], list[tuple[int, str]], str | None]:
    """The distinct pairs of adjacent token classes (first, second, whether a line break that counts lies between), the brackets
    that their line doesn't close, with their place, and the first breach of a statement production, or None. Lexing ends at
    a bracket that closes nothing or another kind: the windows over the brackets tell."""
    reserved, contextual, control = RESERVED[grammar], CONTEXTUAL[grammar], _CONTROL[grammar]
    script = grammar in ("js", "ts")
    breaks = script or grammar == "go"
    pairs: set[tuple[str, str, bool]] = set()
    left: list[tuple[int, str]] = []
    line_from = 0  # brackets of the line begin here
    stack: list[str] = []
    prev, prev2 = "BOF", "BOF"
    ids = 0  # identifiers in a row
    line_words: set[str] = set()
    pos = 0
    match = _lexer(grammar).match
    regex_at = _JS_REGEX.match
    paren_from: list[str] = []
    statement_start = True
    while True:
        m = match(text, pos)
        kind = m.lastgroup
        if kind == "eof":
            break
        start = m.end("skip")
        newline = text.find("\n", pos, start) >= 0 or pos == 0
        pos = m.end()
        token = text[start:pos]
        if kind == "h":
            kind = "str"
        if kind == "id":
            c = token if token in reserved else "ctx" if token in contextual else "id"
            if token in _TYPE_WORDS and grammar == "java":
                c = "id" if token == "String" else token
        elif kind == "op":
            c = token
        elif kind == "num" or kind == "life":
            c = kind
        elif kind == "str":
            c = "tpl" if token[0] == "`" and script else "str"
        elif kind in ("pre", "bang"):
            if not newline:
                return pairs, left, "a directive within a line"
            if stack and stack[-1][0] in "([" and re.match(r"#[ \t]*include", token):
                return pairs, left, "a directive inside brackets"
            continue
        elif token == "/*":
            return pairs, left, "a comment is not closed"
        else:
            return pairs, left, f"{token[:8]!r} can't stand here"
        inner = stack[-1] if stack else ""
        # A regular expression stands where an operand must.
        if c in ("/", "/=") and script and prev not in _OPERAND_END and prev != "}b" and (r := regex_at(text, start)):
            pos, c = r.end(), "re"
        counts = newline and breaks and (not inner or inner[0] == "{" and (inner != "{o" or grammar == "go"))
        if newline:
            line_words.clear()
        if c in ("func", "class", "interface", "type", "struct", "if", "for", "switch", "select", "else", "case", "enum", "namespace", "module", "map", "default"):
            line_words.add(c)
        if grammar == "go" and counts and not inner and (prev in _OPERAND_END or prev == "}b") and token not in _GO_ITEMS:
            return pairs, left, f"{token[:20]} at the margin"
        if newline:
            line_from = len(left)
        # Brackets, by what they are.
        if token in _BRACKETS and kind == "op":
            if len(left) > line_from and token in ")]}" and left[-1][1] == _OPENS.get(token):
                left.pop()
            else:
                left.append((start, token))
        if c == "(":
            c = "(k" if prev in control or (prev == "ctx" and prev2 == "for" and script) else "(f" if grammar == "go" and "func" in line_words else "(c" if prev in _OPERAND_END or prev in ("}b", ">", ">>", "!", "?", "function", "import", "catch", "fn", "?.") and not (prev == "!" and script) else "(g"
            if grammar == "java" and prev2 == "@":
                c = "(k"
            stack.append(c)
            paren_from.append(prev)
        elif c == "[":
            stack.append("[")
        elif c == "{":
            if inner and inner[0] in "([" and prev in ("id", "num", "str") and (grammar == "c" or script and "class" not in line_words and not (counts or newline) or grammar == "java" and inner == "(k" and "new" not in line_words):
                return pairs, left, "a block begins before its brackets are closed"
            literal = script and (prev in _LITERAL_BEFORE and prev != "=>" or (prev == "(g"))
            if grammar == "go":
                literal = prev in ("id", "]", "}o", "{o", ",", ":", "}b", "map", "(c", "(g") and not (line_words & {"if", "for", "switch", "select", "func", "interface", "struct"} and not (inner and inner[0] in "([" or prev in ("]", "map"))) and prev not in ("struct", "interface")
                if prev in ("struct", "interface"):
                    literal = False
            if grammar == "c":
                literal = prev in ("=", ",", "{o", ")g")
            if grammar == "java":
                literal = prev in ("=", "]", ",", "{o")
            c = "{o" if literal else "{b"
            stack.append(c)
        elif c == ")" or c == "]" or c == "}":
            if not inner or inner[0] != {")": "(", "]": "[", "}": "{"}[c]:
                return pairs, left, None
            stack.pop()
            if c == ")":
                c = ")" + inner[1]
                paren_from.pop()
            elif c == "}":
                c = "}" + inner[1]
        elif c == ";":
            if inner and (inner[0] == "(" and inner != "(k" or inner[0] == "[" and grammar != "rust" or inner == "{o" and grammar != "rust" and not (grammar == "ts")):
                return pairs, left, "; inside brackets"
        # Statement productions at the margin.
        if not stack or (len(stack) == 1 and c[0] in "({[" and c[-1] in "bcgkofi["):
            if statement_start and (reason := _margin(grammar, c, token)):
                return pairs, left, reason
        if prev == "?" and prev2 == "<" and c not in ("extends", "super", ">", ",", ">>") or prev == "@" and c == "@":
            return pairs, left, "a marker of a template or patch"
        # Identifiers in a row.
        if c == "id":
            ids = ids + 1 if prev == "id" and not counts else 1
            if ids >= 3 and grammar in ("go", "java", "c") and not (grammar == "c" and newline):
                return pairs, left, "three names in a row"
        if c == ":" and prev == "str" and prev2 == "{b" and script:
            return pairs, left, "a field outside an object"
        if grammar == "go" and newline and inner == "{o" and prev in _OPERAND_END and c not in ("}o",) and not (prev == "}o" and c == "}o"):
            return pairs, left, "a line of a literal ends without a comma"
        pairs.add((prev, c, counts))
        statement_start = c == ";" or c in ("}b", "}o")
        if grammar == "go" and not stack:
            statement_start = False
        prev2, prev = prev, c
    pairs.add((prev, "EOF", False))
    return pairs, left, None


_BRACKETS = frozenset("()[]{}")
_OPENS = {")": "(", "]": "[", "}": "{"}
_GO_ITEMS = frozenset("func type var const import package ) ] } ;".split())
_RUST_ITEMS = frozenset("pub fn struct enum impl use mod const static type trait extern unsafe async macro_rules union crate self super".split())
_JAVA_ITEMS = frozenset("package import class interface enum record public protected private abstract final static strictfp sealed non module open synchronized".split())


def _margin(grammar: str, c: str, token: str) -> str | None:
    """What can't begin a statement outside every bracket."""
    if grammar == "rust" and c not in ("#", ";", "id", "str", "}b", "}o") and token not in _RUST_ITEMS and c[0] not in ")}]":
        return f"{token[:20]} at the margin"
    if grammar == "java" and token not in _JAVA_ITEMS and c not in ("@", ";") and c[0] not in ")}]":
        return f"{token[:20]} at the margin"
    if grammar == "c" and token in ("return", "if", "for", "while", "switch", "case", "break", "continue", "else", "do", "goto") or grammar == "c" and c in ("num", "str", "(g", "(c", "[", "=", "+", "-", ".", "<", ">", "!", "@"):
        return f"{token[:20]} at the margin"
    return None


# ---- permitted pairs -----------------------------------------------------------------------------------------------

_BINARY = frozenset("/ % == != === !== <= >= && ?? += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= << instanceof &^ &^= := in".split())
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= :=".split())
_CLOSERS = frozenset(") )c )g )k )f ] }o }b ,".split())
_OPENERS = frozenset("( (c (g (k (f [ {o {b".split())
_PLAIN = frozenset({"id", "num", "str", "tpl", "re"})


def permitted(grammar: str, a: str, b: str, newline: bool) -> bool:
    """Whether the grammar lets token class ``b`` follow ``a``, with a line break that may end a statement between or not."""
    script = grammar in ("js", "ts")
    word = RESERVED[grammar]
    if a == "BOF":
        if grammar == "go":
            return b in ("package", "EOF")
        return b not in _BINARY and b not in _CLOSERS and b not in ("<", ">", "=", "|", ":", "?", "^", "=>", "->", "::", ".", "@@") and not (grammar == "c" and b in ("(g", "[", "num", "str", "-", "+", "!", "{b", "@", "*"))
    if b == "EOF":
        return a not in _BINARY and a not in ("=", "(", ",", ".", "+", "-", "!", "=>", "->", ":", "?") or a == "?" and grammar == "rust"
    # A member access is followed by a name.
    if a in (".", "?."):
        return b in ("id", "ctx") or b in word or (b == "num" and grammar == "rust") or (b == "(g" or b == "(f" or b == "(c") and grammar == "go" or b == "[" and a == "?." or b in ("(c", "(g") and a == "?." or b == "..." or b == "*" and grammar == "java" or b == "<" and grammar in ("java",) or b in ("this", "class", "new", "super")
    # A statement can't begin with an operator that needs a left side.
    if a in (";", "{b", "}b", ")k") and b in ("<", ">", "%", "==", "!=", "===", "=", "<=", ">=", "&&", "||", "?", ":", ".", ",", "=>", "->", "^", "|", ">>", "<<"):
        if a == "}b":  # a function, class or block that is an operand
            return b not in ("<", "%", "<<", ">>", "->", "^")
        if grammar == "rust" and b in ("||", "|", "<"):
            return True
        if grammar in ("ts", "java") and b in ("<", "|") or grammar == "java" and b == ":":
            return b != "<" or a != ";" or grammar == "ts"
        if a == ")k":
            return b in (",", ".", "->") and grammar == "java" or b in (".",) and grammar == "java"
        return False
    if a in _ASSIGN or a in _BINARY or a in ("||", "=>", "instanceof"):
        if b in _CLOSERS or b == ";" or (b in _BINARY and b not in ("in",)) or b in (".", "?.", ":", "?", "=", "==", ">"):
            if grammar == "rust" and (a == "||" or b == "?" or (a == "=" and b in ("..",)) or a == "=>" and b in ("..",)):
                return True
            if grammar == "go" and b == ":" or a == "&&" and grammar == "rust":
                return True
            if grammar == "ts" and a == "=>" and b == ")g":
                return False
            return b == "=" and a == "<<"
        return True
    if a in ("+", "-", "!", "~") and (b in _CLOSERS or b == ";" or b in ("=", "/", "%", "==", "*", ".", "?", ":", "&&", "||", "<", ">", "<=", ">=")):
        if a == "!" and grammar == "ts" or a == "!" and grammar == "rust" or a in ("+", "-") and grammar == "ts" and b in ("?",):
            return True
        if a == "-" and b in ("*", "<", ".") or a == "!" and b in ("*", "<"):
            return grammar in ("go", "rust", "c")
        if a == "+" and b in ("*", ".") and grammar in ("c", "go"):
            return b == "*"
        return False
    if a in ("(c", "(g", "(k", "(f", "[", "{o", "{b", ",") and (b in ("/", "%", "==", "!=", "===", "<=", ">=", "&&", "=", "+=", ">", "->", "=>", "?", "^", ";", ",", ".") or b == ":"):
        if b == ";":
            return a in ("(k", "{b") or (a == "{o" and grammar == "ts")
        if b == ",":
            return script and a in ("[", ",")
        if b == "&&" and grammar == "rust" or b == "?" and grammar in ("java",) or b == ":" and grammar == "go" and a == "[":
            return True
        if b == "." and grammar == "c" and a in ("{o", ",", "{b"):
            return True
        if b == "=>" or b == ">" and grammar in ("ts", "java", "rust"):
            return b == ">" and a == ","
        return False
    if a == "," and b in (")c", ")g", ")k", ")f"):
        return grammar in ("js", "ts", "go", "rust")
    if a == "," and b == "]":
        return True
    if a == "<" and b in ("?", "%", "=", "/", "<", "}b", "}o", ";", ")c", ")g", "]", ",", ".") and not (grammar == "java" and b == "?") and not (grammar == "rust" and b in ("<",)):
        return False
    if a in ("{b", "{o") and b in ("%", "]", ")c"):
        return False
    if a == "?" and grammar in ("js", "java", "c") and (b in _CLOSERS or b == ";" or b in ("?", "=", "%", ">")):
        return grammar == "java" and b in (">", ",")
    if a == ":" and (b in (")c", ")g", ")k", "%", "=", "==", ";", ",")):
        return grammar == "c" and b == ";" or grammar in ("js", "ts", "java") and b == ";" or grammar == "go" and b == "="
    # What must follow a word.
    if a in ("if", "while", "switch") and grammar in ("js", "ts", "java", "c"):
        return b == "(k"
    if a == "for" and grammar in ("js", "ts", "java", "c"):
        return b == "(k" or (b == "ctx" and script)
    if a == "catch" and grammar in ("js", "ts", "java"):
        return b in ("(k", "{b") or b in ("(c", "(g")
    if a == "function":
        return b in ("id", "ctx", "(c", "(g", "*")
    if a == "class" and grammar != "c":
        return b in ("id", "ctx", "{b", "{o", "extends") or (grammar == "java" and b in (")c", ")g", ";", ",", ")k", "."))
    if a == "func":
        return b in ("id", "(f", "(g", "(c")
    if a == "fn":
        return b in ("id", "(c", "(g", "ctx")
    if a in ("struct", "enum", "trait", "mod") and grammar == "rust":
        return b in ("id", "ctx")
    if a == "impl":
        return b in ("id", "<", "dyn", "for", "?", "crate", "super", "self", "!", "fn", "life", "(g", "&", "[", "unsafe", "const")
    if a == "let" and grammar == "rust":
        return b in ("id", "mut", "(g", "&", "ref", "[", "ctx", "Self", "self", "str", "num", "box", "crate")
    if a == "package":
        return b in ("id", "ctx")
    if a == "import":
        return b in ("id", "ctx", "str", "{b", "{o", "*", "(c", "(g", "(f", "static", ".") if grammar != "java" else b in ("id", "ctx", "static")
    if a == "const" and script:
        return b in ("id", "ctx", "{b", "{o", "[", "enum")
    if a == "var" and grammar in ("js", "ts"):
        return b in ("id", "ctx", "{b", "{o", "[")
    if a == "return":
        return b not in _BINARY and b not in (")c", ")g", "]", ",", ".", ":", "?", "=", ">", "=>", "<") or (grammar in ("rust", "ts") and b in ("<", ",", ")c"))
    if a == "else":
        return b in ("{b", "{o", "if") or grammar in ("js", "ts", "java", "c") and (b in _PLAIN or b in word or b in ("ctx", "(g", "(c", ";", "*", "++", "--", "["))
    if a in ("new",):
        return b in ("id", "ctx", "(g", "(c", "function", "class", "this", ".", "[") or b in word or grammar in ("c", "go", "rust")
    if a in ("break", "continue") and not newline:
        return b in (";", "id", "ctx", "}b", "life") or grammar == "rust" or b in _PLAIN and grammar == "rust"
    # Two operands without an operator between.
    ends = a in _PLAIN or a in (")c", "]", "this", "null", "true", "false", "}o", "nil")
    starts = b in _PLAIN or b in ("this", "null", "true", "false", "function", "new", "{o")
    starts_word = b in ("return", "if", "for", "while", "const", "let", "var", "class", "throw", "switch", "try", "import", "export", "fn", "func", "struct", "pub", "package", "def", "do", "break", "continue", "case", "int", "static", "char", "public", "private", "void", "final", "typedef", "boolean", "long", "double", "go", "defer", "use", "impl", "mod", "match", "loop", "enum", "type", "unsigned", "const")
    if ends and (starts or starts_word):
        if newline:
            return True
        if b == "tpl" and a in ("id", "]", ")c", "tpl"):
            return True
        if a == "id" and b == "id":
            return grammar in ("go", "java", "c")
        if a == "id" and grammar == "ts" and b in ("function",):
            return False
        if grammar == "go":
            if a == "id" and b in ("struct", "func", "map", "interface", "chan", "str"):
                return True
            if a == "]" and b in ("id", "func", "struct", "map", "interface", "chan"):
                return True
            if a in ("id", "}o", ")c", ")f") and b == "if" or b == "{o":
                return b == "{o"
            return False
        if grammar == "c":
            if a == "str" and b in ("str", "id") or a == "id" and b in ("str",):
                return True
            if a == "id" and (b in ("const", "static", "int", "char", "void", "struct", "long", "double", "unsigned", "enum", "return", "if", "for", "while", "switch", "do", "break", "continue")):
                return True  # macros
            return False
        if grammar == "java":
            if a == "id" and b in ("class", "static", "final", "public", "private", "void", "int", "boolean", "long", "double", "char", "new", "enum", "this"):
                return True  # after an annotation
            if a == "]" and b == "id" or a == "]" and b == "{o":
                return True
            return False
        if grammar == "rust":
            if b == "{o" or a == "]" and b in ("pub", "fn", "struct", "enum", "impl", "use", "mod", "const", "static", "type", "let", "match", "unsafe", "if", "for", "while", "loop", "return"):
                return True  # after an attribute
            if b in ("if",) and a in ("id", "num", "str", ")c", "true", "false", "]", "}o"):
                return True  # a guard of a match arm
            if b == "for" and a in ("id", ">", "]", ")c"):
                return True  # impl Trait for Type
            return False
        if grammar == "ts" and b in ("id", "{o") and a in ("id",):
            return b == "{o"
        if script and b == "{o":
            return False
        return False
    return True


@lru_cache(maxsize=None)
def _classes(grammar: str) -> tuple[str, ...]:
    ops = "... == != === !== <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** => -> :: := <- .. ..= + - * / % = < > ! ~ ? : ; , . & | ^ @ # $ ## >>> &^ <<= >>= >>>= **= &&= ||= ??= &^=".split()
    return tuple(dict.fromkeys(["BOF", "EOF", "id", "ctx", "num", "str", "tpl", "re", "life", "(c", "(g", "(k", "(f", ")c", ")g", ")k", ")f", "[", "]", "{b", "{o", "}b", "}o", *ops, *sorted(RESERVED[grammar])]))


def permitted_pairs(spark: SparkSession) -> DataFrame:
    """``grammar, first, second, line_break``: every pair the grammars permit. Its size is set by the grammars alone."""
    rows = [(g, a, b, n) for g in RESERVED for a in _classes(g) for b in _classes(g) for n in (False, True) if permitted(g, a, b, n)]
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(rows, columns=["grammar", "first", "second", "line_break"]), "grammar string, first string, second string, line_break boolean")


# ---- the operator --------------------------------------------------------------------------------------------------


def assemble(pieces: list[dict]) -> str:
    """A file's text from its chunks, which may share lines and be delivered twice."""
    if len(pieces) == 1:
        return pieces[0]["content"]
    lines: list[str] = []
    seen = set()
    for p in sorted(pieces, key=lambda p: (p["start_line"] or 1, p["chunk_index"] or 0)):
        if (key := (p["start_line"], p["chunk_index"])) in seen:
            continue
        seen.add(key)
        new = p["content"].split("\n")
        have = len(lines) - ((p["start_line"] or 1) - 1)
        lines += new[max(0, have) :]
    return "\n".join(lines)


_STAGE = "file_id string, repo_id bigint, language string, grammar string, reason string, first string, second string, line_break boolean, at bigint, bracket string"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _STAGE.split(", ")]
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string())
    for whole in batches:
        for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
            out: list[list] = [[] for _ in names]
            for file_id, repo, language, grammar, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                text = assemble(pieces)
                rows: list[tuple] = []
                nothing = (None,) * 6
                if grammar in ("python", "json", "toml"):
                    rows.append((exact_error(grammar, text), *nothing[1:]))
                else:
                    pairs, left, reason = lex(grammar, text)
                    rows.append((reason, *nothing[1:]))
                    if reason is None:  # one breach is enough
                        rows += [(None, *p, None, None) for p in pairs if not _common(grammar, *p)]
                        rows += [(*nothing[:4], at, bracket) for at, bracket in left]
                for r in rows:
                    for column, value in zip(out, (file_id, repo, language, grammar, *r)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


@lru_cache(maxsize=None)
def _common(grammar: str, a: str, b: str, newline: bool) -> bool:
    """Pairs of names, literals, brackets and commas that every file has; they are permitted and need no row."""
    return a in ("id", "(c", ")c", ",", ";", "{b", "}b", "=", ".", "str", "num", ":") and permitted(grammar, a, b, newline)


def judged_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file_id, repo_id, language, grammar, valid, reason`` for every file of a known grammar that has chunks.

    Defined results: null ids, extensions or contents give no row; a file scanned or a chunk delivered again counts once (the
    last scan names the extension); a file without chunks is not judged; an empty text is valid except as JSON; extra
    columns are ignored; empty tables give an empty result.
    """
    spark = files.sparkSession
    ext = F.regexp_replace(F.lower("extension"), r"^\.", "")
    kinds = F.create_map(*[F.lit(x) for kv in GRAMMARS.items() for x in kv])
    claimed = files.where("file_id IS NOT NULL AND extension IS NOT NULL").groupBy("file_id").agg(
        F.max_by(F.struct(F.col("repo_id").cast("bigint").alias("repo_id"), "language", kinds[ext].alias("grammar")), F.struct("scanned_at", "extension")).alias("f")
    )
    claimed = claimed.where("f.grammar IS NOT NULL").select("file_id", "f.*")
    # Few bytes of text make much work: partitions by the bytes stored, not to be coalesced.
    narrow = chunks.where("file_id IS NOT NULL AND content IS NOT NULL").select("file_id", "start_line", "chunk_index", "content").repartition(parts_for(chunks), "file_id")
    pieces = narrow.groupBy("file_id").agg(F.collect_list(F.struct("start_line", "chunk_index", "content")).alias("pieces"))
    whole = pieces.join(claimed, "file_id").select("file_id", "repo_id", "language", "grammar", "pieces")
    judged = checkpointed(whole.mapInArrow(_judge, _STAGE))
    # The anti-join: pairs of a file that no rule of its grammar permits. The table's size is set by the grammars.
    known = F.broadcast(permitted_pairs(spark).withColumn("permitted", F.lit(True)))
    marked = judged.where("bracket IS NULL").join(known, ["grammar", "first", "second", "line_break"], "left")
    bad_pair = F.when(F.col("first").isNotNull() & F.col("permitted").isNull(), F.concat(F.col("first"), F.lit(" before "), F.col("second")))
    per_file = marked.groupBy("file_id").agg(
        F.any_value("repo_id").alias("repo_id"), F.any_value("language").alias("language"), F.any_value("grammar").alias("grammar"), F.coalesce(F.min("reason"), F.min(bad_pair)).alias("reason")
    )
    per_file = per_file.join(nesting_errors(judged.where("bracket IS NOT NULL").select("file_id", "at", "bracket")), "file_id", "left")
    reason = F.coalesce("reason", "nesting")
    return per_file.select("file_id", "repo_id", "language", "grammar", reason.isNull().alias("valid"), reason.alias("reason"))


def nesting_errors(brackets: DataFrame) -> DataFrame:
    """``file_id, nesting`` of the files whose brackets (file_id, at, bracket) don't close each other.

    Two windows over one shuffle: the running depth, then on each level of a file what opened last.
    """
    opens = F.col("bracket").isin("(", "[", "{")
    rows = brackets.withColumn("step", F.when(opens, 1).otherwise(-1))
    rows = rows.withColumn("depth", F.sum("step").over(Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("level", F.when(opens, F.col("depth")).otherwise(F.col("depth") + 1))
    before = F.lag("bracket").over(Window.partitionBy("file_id", "level").orderBy("at"))
    fits = F.when(opens, True).otherwise(F.coalesce(F.translate("bracket", ")]}", "([{") == before, F.lit(False)))
    per_file = rows.withColumn("fits", fits).groupBy("file_id").agg(F.sum("step").alias("open"), F.min("depth").alias("least"), F.min("fits").alias("fits"))
    said = F.when(F.col("least") < 0, "a bracket closes nothing").when(~F.col("fits"), "a bracket closes one of another kind").when(F.col("open") > 0, "a bracket is not closed")
    return per_file.select("file_id", said.alias("nesting")).where("nesting IS NOT NULL")


def invalid_rates(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``repo_id, grammar, files, invalid, rate``: files judged and found invalid per repository and language."""
    return judged_files(files, chunks).groupBy("repo_id", "grammar").agg(
        F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.round(F.count_if(~F.col("valid")) / F.count("*"), 6).alias("rate")
    )


def lex_errors(grammar: str, text: str) -> tuple[set[tuple[str, str, bool]], str | None]:
    """Pairs and the first breach of a single text, its brackets checked with a stack: for small texts and for tests of the windows."""
    pairs, left, reason = lex(grammar, text)
    stack: list[str] = []
    for _, c in left:
        if c in "([{":
            stack.append(c)
        elif not stack or stack.pop() != _OPENS[c]:
            return pairs, reason or "a bracket closes nothing or another kind"
    return pairs, reason or ("a bracket is not closed" if stack else None)
