"""Garbled text from wrong character encoding (problem 4).

A wrong decoding is a substitution cipher: the bytes of a text written in one encoding are shown as the letters of another.
The family of ciphers is known (every pair of a true and a mistaken code page), which one was used in a source is not. Each
hypothesis gives a byte-to-letter mapping. Within a line every stretch of unusual characters is mapped back under every
hypothesis and scored against bigrams of letters of the languages; expectation-maximization over the lines of a source then
learns how likely each mapping is in that source (E: share of each mapping in each line; M: their mean per source), and the
likeliest mapping, if it is likelier than that the line is as it should be, is applied with ``translate`` (single-byte pairs) or by its byte sequences (multi-byte pairs).

Only lines that some hypothesis explains better than the text as it stands leave the first stage, so that what is shuffled
follows the garbled lines and not the corpus; the maximization is a DataFrame aggregation, never a group in one task.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread
from .joins import salted_join

#: The first article of the Universal Declaration of Human Rights and everyday words, for letter bigrams.
SAMPLES = {
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Ошибка чтения файла. Неверный ключ для записи. Проверка завершена успешно. Сессия уже закрыта, соединение прервано, память исчерпана, запрос отклонен, пользователь не найден, настройки сохранены, объект удален",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Ελέγξτε το αρχείο πριν από την έξοδο, σφάλμα ανάγνωσης, η σύνδεση έκλεισε",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. שגיאה בקריאת הקובץ, המפתח שגוי, החיבור נסגר, המשתמש לא נמצא, ההגדרות נשמרו",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. خطأ في قراءة الملف، المفتاح غير صحيح، تم إغلاق الاتصال، المستخدم غير موجود، تم حفظ الإعدادات",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ ข้อผิดพลาดในการอ่านไฟล์ ไม่พบผู้ใช้ บันทึกการตั้งค่าแล้ว",
}
#: The commonest Chinese characters, simplified and traditional.
_COMMON_HAN = frozenset("的一是不了在人有我他这这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日军者意无力它与长把机十民第公此已工使情明性知全三又关点正业外将两高间由问很最重并物手应战向头文体政美相见被利什二等产或新己制身果加西斯月话合回特代内信表化老给世位次度门任常先海通教儿原东声提立及比员解水名真论处走义各入几口认条平系气题活尔更别打女变四神总何电数安少报才结反受目太量再感建务做接必场件计管期市直德资命山金指克许统区保至队形社便空决治展马科司五基眼书非则听白却界达光放强即像难且权思王象完设式色路记南品住告类求据程北边死张该交规万取拉格望觉术领共确传师观清今切院让识候带导争运文字读取失败错误密钥用户连接关闭設定檔案讀錯誤連線關閉鍵無法開啟這個們來為國說時會對過發後裡種經現當動還進樣開從實軍與長機關點業將兩間問並應戰頭體")
_CYRILLIC_OR_GREEK = re.compile(r"[Ͱ-ϿЀ-ӿא-ת؀-ۿก-๛]")  # and the other scripts of the samples

_HIGH = re.compile(r"[^\x00-\x7f]+")
_HIGH_ANY = re.compile(r"[^\x00-\x7f]")


@lru_cache(maxsize=None)
def _encode_map(page: str) -> dict[str, int]:
    """Character to byte under the mistaken code page; bytes it leaves undefined show as C1 controls."""
    out = {}
    for b in range(256):
        try:
            ch = bytes([b]).decode(page)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
    if page in ("cp1252", "cp1250", "cp1251"):
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


def to_bytes(text: str, page: str) -> bytes | None:
    """The bytes that the mistaken code page shows as this text, or None."""
    if page in _WIDE:
        try:
            return text.encode(page)
        except UnicodeEncodeError:
            return None
    table = _encode_map(page)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


#: Mistaken code pages that show two bytes as one character.
_WIDE = ("gbk", "big5", "cp932", "cp949")

#: (name, true encoding, mistaken code page). Fixed values.
MULTI_BYTE = tuple((f"utf-8 read as {p}", "utf-8", p) for p in ("cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp1253", "cp1254", "koi8-r", "cp866", "iso8859-15", "cp1256", "cp1255", "cp1257", "cp1258", "cp852"))
WIDE = tuple((f"utf-8 read as {p}", "utf-8", p) for p in _WIDE)
EAST_ASIAN = tuple((f"{t} read as {p}", t, p) for t in ("cp932", "euc_jp") for p in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp1250"))
CHINESE_KOREAN = tuple((f"{t} read as {p}", t, p) for t in ("gbk", "big5", "cp949") for p in ("cp1252", "latin-1"))
SINGLE_BYTE = tuple((f"{t} read as {p}", t, p) for t, p in (
    ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"), ("iso8859-5", "cp1252"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("koi8-r", "cp866"), ("cp866", "koi8-r"), ("iso8859-5", "cp1251"), ("cp1251", "iso8859-5"), ("cp1251", "mac_roman"), ("cp1251", "cp1250"), ("cp1251", "cp437"), ("mac_cyrillic", "cp1251"), ("cp1253", "cp1252"), ("cp1253", "cp1251"),
    ("cp1255", "cp1252"), ("cp1255", "cp1251"), ("cp1256", "cp1252"), ("cp1256", "cp1251"), ("iso8859-6", "latin-1"), ("cp874", "cp1252"), ("cp874", "cp1251"),
))
#: Latin letters of one code page read as another: told by the letters' neighbours. (true, mistaken)
LATIN = tuple((f"{t} read as {p}", t, p) for t, p in (("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("cp1252", "cp1250"), ("cp850", "cp437")))


@lru_cache(maxsize=1)
def letter_model() -> tuple[dict[str, float], float]:
    """Log probability of each bigram of letters, lower case, over the sample languages, and that of an unseen one."""
    counts, firsts = Counter(), Counter()
    for text in SAMPLES.values():
        for word in re.findall(r"(?:[^\W\d_]|[\u0e31-\u0e4e])+", text.lower()):
            for a, b in zip(" " + word, word + " "):
                counts[a + b] += 1
                firsts[a] += 1
    return {k: math.log((n + 0.05) / (firsts[k[0]] + 2)) for k, n in counts.items()}, math.log(0.05 / 60)


def _word_score(word: str) -> float:
    """Mean log probability of a word's bigrams, less for letters that change case within it."""
    model, unseen = letter_model()
    low = word.lower()
    total = sum(model.get(a + b, unseen) for a, b in zip(" " + low, low + " "))
    odd = sum(1 for a, b in zip(word, word[1:]) if a.islower() and b.isupper())
    return (total - 3 * odd) / (len(word) + 1)


def _plausible(ch: str) -> bool:
    """Whether a character can be what a UTF-8 sequence of ordinary text stands for."""
    c = ord(ch)
    return (
        0xA0 <= c <= 0x17F
        or c in (0x218, 0x219, 0x21A, 0x21B, 0x192, 0x2C6, 0x2DC, 0xFEFF)
        or 0x386 <= c <= 0x3CE
        or 0x400 <= c <= 0x45F
        or c in (0x490, 0x491)
        or 0x5D0 <= c <= 0x5EA
        or 0x620 <= c <= 0x64A
        or 0x1EA0 <= c <= 0x1EF9
        or 0x2010 <= c <= 0x203A
        or 0x20A0 <= c <= 0x20BF
        or 0x2100 <= c <= 0x2300
        or 0x2500 <= c <= 0x25FF
        or 0x2600 <= c <= 0x27BF
        or 0x3000 <= c <= 0x30FF
        or 0x4E00 <= c <= 0x9FFF
        or 0xAC00 <= c <= 0xD7A3
        or 0xFF01 <= c <= 0xFF5E
        or 0x1F300 <= c <= 0x1FAFF
    )


def _undo_multi_byte(text: str, page: str) -> tuple[str, int, int]:
    """Text with every garbled stretch decoded, the number of sequences undone and of unusual characters left alone."""
    done = left = 0

    def undo(m: re.Match[str]) -> str:
        nonlocal done, left
        run = m.group()
        raw = to_bytes(run, page)
        if raw is not None:
            try:
                fixed = raw.decode("utf-8")
            except UnicodeDecodeError:
                fixed = None
            if fixed is not None and all(map(_plausible, fixed)):
                done += len(fixed)
                return fixed
        left += len(run)
        return run

    return _HIGH.sub(undo, text), done, left


#: Code pages under which a sequence of ordinary text shows as signs that don't stand together in a text.
_TELLING = ("cp1252", "latin-1", "cp1254", "iso8859-15", "cp1250", "mac_roman", "cp437", "cp850")


@lru_cache(maxsize=None)
def _whole_sequence(page: str) -> re.Pattern[str]:
    """A UTF-8 sequence of two to four bytes as a mistaken code page shows it."""
    shown: dict[int, str] = {}
    for ch, b in _encode_map(page).items():
        shown[b] = shown.get(b, "") + re.escape(ch)
    pick = lambda a, b: "[" + "".join(shown.get(i, "") for i in range(a, b)) + "]"
    more = pick(0x80, 0xC0)
    return re.compile(f"{pick(0xF0, 0xF5)}{more}{{3}}|{pick(0xE0, 0xF0)}{more}{{2}}|{pick(0xC2, 0xE0)}{more}")


def _undo_sequences(text: str, page: str) -> tuple[str, int]:
    """Text with each garbled sequence decoded that speaks for itself, whatever stands elsewhere on the line; and how many."""
    done = 0

    def undo(m: re.Match[str]) -> str:
        nonlocal done
        run, before, after = m.group(), text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        raw = to_bytes(run, page)
        try:
            fixed = (raw or b"\xff").decode("utf-8")
        except UnicodeDecodeError:
            return run
        if not _plausible(fixed) or not any(unicodedata.category(c)[0] in "SPCNZ" for c in run[1:]):
            return run
        if len(run) == 2:
            # A capital before a closing quotation mark, or a sign beside another, may be meant.
            if before.isupper() or not (fixed.isalpha() and (before.isalpha() or after.isalpha()) or run[0] == "Â" and not fixed.isalpha()):
                return run
            if run[1] in "»”’›" and not after.isalpha():
                return run
        elif not fixed.isalpha() and not unicodedata.category(run[0])[0] == "L":
            return run
        done += 1
        return fixed

    pattern = _whole_sequence(page)
    # Letters beside a sequence in the same run make it a text of another code page.
    spoilt = [(r.start(), r.end()) for r in _HIGH.finditer(text) if any(map(str.isalpha, pattern.sub("", r.group())))]
    fixed = pattern.sub(lambda m: m.group() if any(a <= m.start() < b for a, b in spoilt) else undo(m), text)
    return fixed, done


_KANA = re.compile(r"[ぁ-ゖァ-ヺーｦ-ﾟ]")
_JAPANESE = re.compile(r"[　-ヿ一-鿿＀-￯]")


def _undo_east_asian(text: str, true: str, page: str) -> tuple[str, int, int]:
    raw = to_bytes(text, page)
    if raw is None:
        return text, 0, 1
    try:
        fixed = raw.decode(true)
    except UnicodeDecodeError:
        return text, 0, 1
    high = _HIGH_ANY.findall(fixed)
    kana = len(_KANA.findall(fixed))
    if len(high) < 4 or len(_JAPANESE.findall(fixed)) < len(high) or kana * 3 < len(high):
        return text, 0, 1
    # One character between small letters is an accented letter of a word.
    if re.search(r"[a-z][^\x00-\x7f][a-z]", fixed):
        return text, 0, 1
    # Half-width kana alone are what Latin letters turn into.
    if sum(0xFF66 <= ord(c) <= 0xFF9F for c in high) * 2 > len(high):
        return text, 0, 1
    return fixed, len(high), 0


def _undo_wide(text: str, page: str) -> tuple[str, int]:
    """Text with the runs decoded whose characters, written in a two-byte code page, are UTF-8; and how many sequences."""
    done = 0

    def undo(m: re.Match[str]) -> str:
        nonlocal done
        run = m.group()
        raw = to_bytes(run, page)
        glued = (m.start() and text[m.start() - 1].isalpha()) or text[m.end() : m.end() + 1].isalpha()
        if raw is None or len(run) < 4 and not glued:
            return run
        try:
            fixed = raw.decode("utf-8")
        except UnicodeDecodeError:
            return run
        if all(map(_plausible, fixed)) and all(c.isalpha() or unicodedata.category(c)[0] in "PZ" for c in fixed):
            done += len(fixed)
            return fixed
        return run

    return _HIGH.sub(undo, text), done


def _undo_chinese_korean(text: str, true: str, page: str) -> tuple[str, float]:
    """The text between the first and the last unusual character decoded, and a score if it is ordinary Chinese or Korean."""
    m = re.search(r"[^\x00-\x7f].*[^\x00-\x7f][\x40-\x7e]?", text)
    for part in (m.group(), m.group()[:-1]) if m else ():
        raw = to_bytes(part, page)
        if raw is None:
            continue
        try:
            fixed = raw.decode(true)
        except UnicodeDecodeError:
            continue
        high = _HIGH_ANY.findall(fixed)
        han = [c for c in high if "一" <= c <= "鿿"]
        if true == "cp949":
            share = sum("가" <= c <= "힣" for c in high) / max(1, len(high))
            likely = len(high) >= 3 and share > 0.9 and not re.search(r"[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]", part)
        else:
            share = sum(c in _COMMON_HAN for c in han) / max(1, len(han))
            likely = len(han) >= 3 and share >= 0.4 and all(c in han or "\u3000" <= c <= "\u303f" or "\uff01" <= c <= "\uff5e" for c in high)
        if likely:
            return text[: m.start()] + fixed + text[m.start() + len(part) :], 2.0 + 4.0 * share
    return text, 0.0


@lru_cache(maxsize=None)
def translation(true: str, page: str) -> dict[int, str]:
    """The mapping of shown to meant characters of a single-byte pair, for ``str.translate``."""
    out = {}
    for ch, b in _encode_map(page).items():
        if b >= 0x80:
            try:
                out[ord(ch)] = bytes([b]).decode(true)
            except UnicodeDecodeError:
                pass
    return out


_LETTERS = re.compile(r"[^\W\d_]+")
_WORDISH = re.compile(r"[^\x00-\x7f\ufeff‐-›]*[^\x00-\x7f\xa0\ufeff‐-›][^\x00-\x7f\ufeff‐-›]*")


_GLUED = re.compile(r"[A-Za-z][^\x00-\x7f\xa0\ufeff‐-›]|[^\x00-\x7f\xa0\ufeff‐-›][A-Za-z]")


def _gain_single_byte(text: str, true: str, page: str) -> tuple[str, float]:
    """The text mapped back, and by how much its words fit the languages better than as they stand (log, per bigram)."""
    runs = [r for r in _WORDISH.findall(text) if len(r) > 1]
    if sum(map(len, runs)) < 5 or max(map(len, runs)) < 4 or _GLUED.search(text):
        return text, 0.0  # too little to tell, or the accented letters of a word of ASCII letters
    table = translation(true, page)
    gain = weight = 0.0
    for run in runs:
        fixed = run.translate(table)
        word = fixed.strip("«»„“”… \xa0")
        if not word or not all(_CYRILLIC_OR_GREEK.match(c) for c in word):
            return text, 0.0
        if unicodedata.name(word[0], "")[:5] != unicodedata.name(word[-1], "")[:5]:
            return text, 0.0
        before = _word_score(run) if any(_CYRILLIC_OR_GREEK.match(c) for c in run) else letter_model()[1] - 1
        gain += (_word_score(word) - before) * len(word)
        weight += len(word)
    whole = _HIGH_ANY.sub(lambda m: m.group().translate(table), text)
    if not all(_CYRILLIC_OR_GREEK.match(c) or c in "«»№—–…" for c in _HIGH_ANY.findall(whole)):  # some of it is as it should be
        whole = _WORDISH.sub(lambda m: m.group().translate(table) if len(m.group()) > 1 else m.group(), text)
    return whole, gain / weight


#: The letters beside which the accented letters of western languages stand, and words with them.
_LATIN_OK = re.compile(r"^[a-zA-ZàâäáãåæçèéêëíìîïñóòôöõøœßúùûüýÿÀÂÄÁÃÅÆÇÈÉÊËÍÌÎÏÑÓÒÔÖÕØŒÚÙÛÜÝąćęłńóśźżĄĆĘŁŃÓŚŹŻčďěňřšťůžČĎĚŇŘŠŤŮŽőűŐŰ¿¡]+$")


def _gain_latin(text: str, true: str, page: str) -> tuple[str, float]:
    """Latin letters shown as symbols or foreign letters inside words: mapped back where every such word becomes a plain one."""
    table = translation(true, page)
    words = [w for w in re.findall(r"[^\s\"'`.,;:()\[\]{}<>=/\\*+\-|&!?#%@_0-9]+", text) if _HIGH_ANY.search(w)]
    words = [w for w in words if re.search(r"[A-Za-z]", w)]
    if not words:
        return text, 0.0
    odd = 0
    for w in words:
        high = _HIGH_ANY.findall(w)
        fixed = "".join(table.get(ord(c), c) for c in w)
        if not _LATIN_OK.match(fixed) or len(high) > 0.5 * len(w):
            return text, 0.0
        # As shown, the character can't stand in a word: a symbol, a letter of another script, a capital among small ones.
        for i, c in enumerate(w):
            if ord(c) < 0x80:
                continue
            if c in _SIGNS and (c == "’" or not (w[i - 1 : i].islower() and w[i + 1 : i + 2].islower())):
                return text, 0.0
            script = unicodedata.category(c)
            foreign = _CYRILLIC_OR_GREEK.match(c) is not None
            inner_capital = script == "Lu" and i > 0 and (w[i - 1].islower() or ord(w[i - 1]) < 0x80) and not w.isupper() and (i + 1 >= len(w) or w[i + 1].islower())
            if foreign or script[0] in "SC" or script in ("No", "Po", "Pi", "Pf", "Ps", "Pe", "Lm", "Lo") or inner_capital:
                odd += 1
            elif c in table and table[ord(c)] == c:
                continue
    total = sum(len(_HIGH_ANY.findall(w)) for w in words)
    # Fixed letters must be small ones unless the word is written in capitals or begins with it.
    for w in words:
        fixed = "".join(table.get(ord(c), c) for c in w)
        for i, c in enumerate(fixed):
            if ord(c) > 0x7F and c.isupper() and i > 0 and not fixed.isupper():
                return text, 0.0
    return ("".join(table.get(ord(c), c) for c in text), 1.0 + odd / total) if odd * 2 >= total and odd else (text, 0.0)


#: Signs that ordinary text has beside words.
_SIGNS = frozenset("°±§€£©®™…–—“”„‘’‚«»·•†‡×÷µ¹²³ªº\xa0\ufeff")


def _replacement(text: str) -> bool:
    """Whether replacement characters stand where a letter or a whole word was."""
    return "��" in text or any((i and text[i - 1].isalpha()) or (i + 1 < len(text) and text[i + 1].isalpha()) for i, c in enumerate(text) if c == "�")


@lru_cache(maxsize=None)
def _sequence(page: str) -> re.Pattern[str]:
    """What begins a UTF-8 sequence under a mistaken code page."""
    shown = {b: ch for ch, b in _encode_map(page).items()}
    pick = lambda a, b: "[" + "".join(re.escape(shown[i]) for i in range(a, b) if i in shown) + "]"
    return re.compile(pick(0xC2, 0xF5) + pick(0x80, 0xC0))


@lru_cache(maxsize=1)
def _shown_by_any() -> re.Pattern[str]:
    """A character that some mistaken code page shows for a byte of a letter, or a replacement character."""
    chars = {ch for _, _, page in (*MULTI_BYTE, *EAST_ASIAN, *SINGLE_BYTE, *LATIN) for ch, b in _encode_map(page).items() if b >= 0x80}
    return re.compile("[" + re.escape("".join(sorted(chars | {"�"}))) + "ｦ-ﾟ\u2e80-\u9fff\uac00-\ud7a3]")


_CLEAN_WEST = re.compile(r"(?:[\x00-\x7f]|[ßàáâãäåæçèéêëìíîïñòóôõöøùúûüýœ¿¡](?![^\x00-\x7f]))*\Z")  # accented letters one at a time


def candidates(line: str, least: float = 1.0) -> list[tuple[str, str | None, float]]:
    """(mapping, restored line, score above the line as it stands) for each hypothesis that explains the line better, by more
    than ``least`` where letters are compared."""
    out: list[tuple[str, str | None, float]] = []
    if not _shown_by_any().search(line) or _CLEAN_WEST.match(line):
        return out
    for name, _, page in MULTI_BYTE:
        if not _sequence(page).search(line):
            continue
        fixed, done, left = _undo_multi_byte(line, page)
        if done and done > left // 2 and (left == 0 or done >= 2) and not _box_drawing(line, page):
            rounds = name
            for _ in range(3):  # garbled more than once
                again, more, _ = _undo_multi_byte(fixed, page)
                if not more:
                    break
                fixed, rounds = again, rounds + ", again"
            out.append((rounds, fixed, 8.0 + done - 2.0 * left - 0.01 * len(_HIGH_ANY.findall(fixed))))
        elif page in _TELLING and not _box_drawing(line, page):
            fixed, done = _undo_sequences(line, page)
            if done:
                out.append((name, fixed, 6.0 + done))
    if not out:
        for name, _, page in WIDE:
            fixed, done = _undo_wide(line, page)
            if done:
                out.append((name, fixed, 4.0 + done))
    if not out:
        for name, true, page in EAST_ASIAN:
            fixed, done, _ = _undo_east_asian(line, true, page)
            if not done:  # code before and behind the text may hold what doesn't fit
                m = re.search(r"[^\x00-\x7f].*[^\x00-\x7f]", line)
                if m:
                    inner, done, _ = _undo_east_asian(m.group(), true, page)
                    fixed = line[: m.start()] + inner + line[m.end() :]
            if done:
                out.append((name, fixed, 6.0 + done * 0.1))
        for name, true, page in CHINESE_KOREAN:
            fixed, gain = _undo_chinese_korean(line, true, page)
            if gain:
                out.append((name, fixed, gain))
        for name, true, page in SINGLE_BYTE:
            fixed, gain = _gain_single_byte(line, true, page)
            if gain > least:
                out.append((name, fixed, gain))
        if not out:
            for name, true, page in LATIN:
                fixed, gain = _gain_latin(line, true, page)
                if gain > 0:
                    out.append((name, fixed, gain))
    if not out and len(stretches := _stretches(line)) > 1:
        # What is right elsewhere on the line says nothing against a stretch that is not.
        names: dict[str, float] = {}
        fixes: dict[str, dict[int, str]] = {}
        for i, part in enumerate(stretches):
            for name, fixed, gain in () if part.isascii() else candidates(part, least):
                if fixed is not None:
                    names[name] = max(gain, names.get(name, gain))
                    fixes.setdefault(name, {})[i] = fixed
        out += [(name, "".join(fixes[name].get(i, part) for i, part in enumerate(stretches)), gain) for name, gain in names.items()]
    if "�" in line and _replacement(line):
        out.append(("lost on decoding", None, 20.0))
    return out


_BREAK = re.compile(r"([\"`<>{}\[\];|]+|[\x00-\x7f]{24,})")


def _stretches(line: str) -> list[str]:
    """The line cut at delimiters of literals and at long runs of ASCII, where more than one of the parts is not ASCII."""
    parts = _BREAK.split(line)
    return parts if sum(not p.isascii() for p in parts) > 1 else [line]


def _box_drawing(line: str, page: str) -> bool:
    """Lines of box drawing characters are drawings, not text read as a DOS code page."""
    return page in ("cp437", "cp850", "cp866", "koi8-r") and not re.search(r"[A-Za-z][^\x00-\x7f]|[^\x00-\x7f][A-Za-z]", line) and bool(re.search(r"[─━═]{2}|^\W*[│├└┌][─ ]", line))


#: The hypothesis that a line is as it should be, the score it has, and the least gain for which a line is looked at at all:
#: between them a line comes out only if other lines of its source speak for the mapping.
AS_IT_STANDS, LEAST, WEAK = "as it stands", 1.0, 0.4

_STAGE = "source bigint, chunk_id string, line_no bigint, mapping string, restored string, garbled string, score double"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], [], [], [], []]
        memo: dict[str, list[tuple[str, str | None, float]]] = {}
        for source, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for n, line in enumerate(text.split("\n"), 1):
                if line.isascii():
                    continue
                if (found := memo.get(line)) is None:
                    if len(memo) > 5000:
                        memo.clear()
                    found = candidates(line, WEAK)
                    memo[line] = found = [*found, (AS_IT_STANDS, None, LEAST)] if found else found
                for mapping, restored, score in found:
                    for column, value in zip(rows, (source, key, n, mapping, restored, line, score)):
                        column.append(value)
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["source", "chunk_id", "line_no", "mapping", "restored", "garbled", "score"])


def garbled_lines(chunks: DataFrame, id_col: str = "id", text_col: str = "content", source_col: str | None = "repo_id", rounds: int = 2) -> DataFrame:
    """``chunk_id, line_no, mapping, garbled, restored``: each garbled line, with the original where it can be restored.

    Defined results: null ids or texts and texts of ASCII only give no row; a null source is a source of its own; a chunk
    delivered twice gives its lines once; ``restored`` is null where the bytes are lost; extra columns are ignored; an empty
    table gives an empty result.
    """
    source = F.col(source_col).cast("bigint") if source_col else F.lit(0).cast("bigint")
    rows = chunks.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"[^\x00-\x7F]")).select(source.alias("source"), F.col(id_col).cast("string").alias("chunk_id"), F.col(text_col).alias("text"))
    proposed = checkpointed(spread(rows).mapInArrow(_propose, _STAGE).dropDuplicates(["chunk_id", "line_no", "mapping", "garbled"]).withColumn("source", F.coalesce("source", F.lit(-1))))
    line = ["source", "chunk_id", "line_no", "garbled"]
    weighted = proposed.withColumn("prior", F.lit(1.0))
    for _ in range(rounds):
        # E: the share of each mapping in the line; M: the mapping's share in its source.
        shares = weighted.withColumn("w", F.exp(F.least("score", F.lit(50.0))) * F.col("prior"))
        shares = shares.join(shares.groupBy(*line).agg(F.sum("w").alias("_all")), line).withColumn("share", F.col("w") / F.col("_all"))
        prior = shares.groupBy("source", "mapping").agg((F.sum("share") + 0.1).alias("prior"))
        weighted = salted_join(proposed, prior, ["source", "mapping"], spread_by="chunk_id")
    best = weighted.groupBy("chunk_id", "line_no", "garbled").agg(F.max_by(F.struct("mapping", "restored"), F.struct(F.round(F.col("score") + F.log("prior"), 9), F.col("mapping"))).alias("b"))
    best = best.where(F.col("b.mapping") != AS_IT_STANDS)
    return best.select("chunk_id", "line_no", F.col("b.mapping").alias("mapping"), "garbled", F.col("b.restored").alias("restored"))


def restored_chunks(chunks: DataFrame, id_col: str = "id", text_col: str = "content", source_col: str | None = "repo_id") -> DataFrame:
    """``chunk_id, garbled_lines, lost_lines, content``: every chunk with garbled text, its content with what could be restored."""
    lines = garbled_lines(chunks, id_col, text_col, source_col)
    fixes = lines.groupBy("chunk_id").agg(
        F.count("*").alias("garbled_lines"),
        F.sum(F.col("restored").isNull().cast("bigint")).alias("lost_lines"),
        F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("restored").isNotNull(), F.struct("garbled", "restored"))))).alias("_fixes"),
    )
    texts = chunks.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"[^\x00-\x7F]")).select(F.col(id_col).cast("string").alias("chunk_id"), F.col(text_col).alias("_text")).dropDuplicates(["chunk_id"])
    joined = texts.join(fixes, "chunk_id")
    content = F.array_join(F.transform(F.split("_text", "\n"), lambda x: F.coalesce(F.element_at("_fixes", x), x)), "\n")
    return joined.select("chunk_id", "garbled_lines", "lost_lines", content.alias("content"))
