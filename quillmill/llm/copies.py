"""Duplicates hidden by formatting differences (problem 5).

Two records are the same if their letters and digits are the same in the same order, whatever the case and everything
else. Where a record is only a flat set of named values (a JSON object, or lines ``name: value`` / ``name = value``), the
order of the fields is free too, but each value stays with its name.

Method: code points are streamed through one skip-and-fold lookup table (0 = skip) into two rolling polynomial hashes
modulo 31-bit primes plus the folded length; a batch is hashed as one array, and no canonical string is made. A flat record
gets a second fingerprint, the sum of its mixed field fingerprints, in which the order of the fields has no part. Only
fingerprints are grouped. Rows that collide are then compared with the record's first row by two pointers that skip ahead
block by block; records with a row that differs (a hash collision, or a chain of equal letters and equal fields) are grouped
again by digests of their exact folded text and fields.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, spread
from .joins import filter_words, passes, salted_join

P1, P2 = 2147483647, 2147483629
B1, B2 = 1000003, 92821
STRIDE = 1 << 20  # code points hashed at once

_table: np.ndarray | None = None
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def fold_table() -> np.ndarray:
    """For each code point its folded letter or digit, 0 where it is skipped. Made once per worker, from Unicode's tables."""
    global _table
    if _table is None:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for cp in range(sys.maxunicode + 1):
            ch = chr(cp)
            if ch.isalnum():
                low = ch.lower()
                table[cp] = ord(low[0])
        # Letters whose capitals are written with two letters, and the final sigma.
        table[ord("ς")] = ord("σ")
        table[0x17F], table[0x212A] = ord("s"), ord("k")
        _table = table
    return _table


def _unfold(text: str) -> str:
    """Letters that have no single capital are written out, so that their capitals fold alike."""
    return text.replace("ß", "ss").replace("ẞ", "ss") if "ß" in text or "ẞ" in text else text


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(_unfold(text).encode("utf-32-le", "surrogatepass"), np.uint32)


def _power(which: int, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base, prime = ((B1, P1), (B2, P2))[which]
        size = 1 << max(10, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        out[1] = base
        filled = 2
        while filled < size:  # doubling
            step = min(filled, size - filled)
            lead = np.uint64(int(out[filled - 1]) * base % prime)
            out[filled : filled + step] = out[:step] * lead % np.uint64(prime)
            filled += step
        _powers[which] = have = out
    return have[:n]


def fingerprints(texts: list[str]) -> np.ndarray:
    """(n, 3) array: two polynomial hashes and the number of letters and digits of each text. Linear in the characters."""
    table, out = fold_table(), np.zeros((len(texts), 3), np.uint64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= STRIDE):
            size += len(texts[j])
            j += 1
        _hash_block(texts[i:j], table, out[i:j])
        i = j
    return out


def _hash_block(texts: list[str], table: np.ndarray, out: np.ndarray) -> None:
    texts = [_unfold(t) for t in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    folded = table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not len(folded):
        return
    # Skipped characters are zeros: they add nothing and move no position, so nothing is drawn together.
    ends = np.cumsum(lengths)
    starts = ends - lengths
    kept_before = np.cumsum(folded != 0)
    full = np.flatnonzero(lengths)
    at_start = np.zeros(len(texts), np.int64)
    at_start[full] = np.where(starts[full] > 0, kept_before[starts[full] - 1], 0)
    counts = np.zeros(len(texts), np.int64)
    counts[full] = kept_before[ends[full] - 1] - at_start[full]
    out[:, 2] = counts
    position = np.maximum(kept_before - 1 - np.repeat(at_start, lengths), 0)
    for which, prime in ((0, P1), (1, P2)):
        powers = _power(which, max(1, int(counts.max())))
        terms = folded * powers[position] % np.uint64(prime)
        sums = np.zeros(len(texts), np.uint64)
        sums[full] = np.add.reduceat(terms, starts[full])
        out[:, which] = sums % np.uint64(prime)


_FIELD = re.compile(r"[ \t]*(?P<q>[\"']?)(?P<name>[^\W_][\w .\-/]*?)(?P=q)[ \t]*(?:[:=])[ \t]*(?P<value>.*?)[ \t]*,?[ \t]*\Z")
_SCALAR_OPEN = re.compile(r"[\[{(]")


def flat_fields(text: str) -> list[tuple[str, str]] | None:
    """Names and values if the text is only a flat set of named values, else None. Needs two fields: one has no order."""
    body = text.strip().lstrip("﻿")
    if not body:
        return None
    if body[0] == "{":
        try:
            pairs = json.loads(body, object_pairs_hook=_Pairs, parse_int=str, parse_float=str, parse_constant=str, strict=False)
        except (ValueError, RecursionError):
            return None
        if not isinstance(pairs, _Pairs) or any(isinstance(v, (_Pairs, list)) for _, v in pairs):
            return None
        fields = [(k, "true" if v is True else "false" if v is False else "null" if v is None else v) for k, v in pairs]
        return fields if len(fields) > 1 else None
    fields = []
    for line in body.splitlines():
        line = line.strip()
        if not line:
            continue
        m = _FIELD.match(line)
        if not m or (m["value"][:1] and m["value"][0] in "[{(") or m["value"].endswith(("{", "(", ";", "[")):
            return None
        fields.append((m["name"], m["value"]))
    return fields if len(fields) > 1 else None


class _Pairs(list):
    """A JSON object as its pairs."""


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = re.compile(r"[\s﻿]*")
_LINE = re.compile(r"[^\n\r\v\f\x1c-\x1e\x85\u2028\u2029]*")


def _maybe_flat(text: str) -> bool:
    """Whether the first line that holds anything may be a field."""
    at = _BLANK.match(text).end()
    if text[at : at + 1] == "{":
        return True
    if text[at : at + 1] in "#/<*-[(":  # also an empty text
        return False
    line = _LINE.match(text, at).group().strip()
    return (":" in line or "=" in line) and _FIELD.match(line) is not None


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        with np.errstate(over="ignore"):
            fp = fingerprints(texts)
            seq = _mix(fp[:, 0] << np.uint64(32) | fp[:, 1]) ^ _mix(fp[:, 2] + np.uint64(0x9E3779B97F4A7C15))
            low = (fp[:, 0] << np.uint64(32)) | fp[:, 1]
            field_key: list[str | None] = [None] * len(texts)
            parts, owners = [], []
            for i, text in enumerate(texts):
                if _maybe_flat(text) and (fields := flat_fields(text)):
                    for name, value in fields:
                        parts += (name, value)
                        owners.append(i)
            if owners:
                f = fingerprints(parts)
                one = _mix((f[0::2, 0] << np.uint64(32)) | f[0::2, 1]) * np.uint64(3) + _mix(((f[1::2, 0] << np.uint64(32)) | f[1::2, 1]) ^ (f[1::2, 2] << np.uint64(17)))
                one2 = _mix(one ^ np.uint64(0xD6E8FEB86659FD93))
                one = _mix(one)
                owner = np.array(owners)
                where = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                for k, a, b in zip(owner[where].tolist(), np.add.reduceat(one, where).tolist(), np.add.reduceat(one2, where).tolist()):
                    field_key[k] = f"{a:016x}{b:016x}"
        seq_key = [f"{a:016x}{b:016x}" for a, b in zip(seq.tolist(), low.tolist())]
        yield pa.RecordBatch.from_arrays([ids, pa.array(seq_key, pa.string()), pa.array(field_key, pa.string())], ["id", "seq_key", "field_key"])


def same_by_two_pointers(a: str, b: str, block: int = 4096) -> bool:
    """Whether two texts have the same letters and digits in the same order: two pointers, skipping, a block at a time."""
    table, left, right = fold_table(), _codes(a), _codes(b)
    i = j = 0
    x = y = np.empty(0, np.uint32)
    while True:
        while not len(x) and i < len(left):
            x, i = table[left[i : i + block]], i + block
            x = x[x != 0]
        while not len(y) and j < len(right):
            y, j = table[right[j : j + block]], j + block
            y = y[y != 0]
        n = min(len(x), len(y))
        if not n:
            return len(x) == len(y)
        if not np.array_equal(x[:n], y[:n]):
            return False
        x, y = x[n:], y[n:]


def exact_key(text: str, block: int = 1 << 16) -> bytes:
    """Digest of the letters and digits, block by block, for the rows of a hash collision."""
    table, codes, digest = fold_table(), _codes(text), hashlib.sha256()
    for i in range(0, len(codes), block):
        f = table[codes[i : i + block]]
        digest.update(f[f != 0].tobytes())
    return digest.digest()


def same_record(a: str, b: str) -> bool:
    """Same letters and digits, or the same flat set of named values."""
    if a == b or same_by_two_pointers(a, b):
        return True
    x, y = flat_fields(a), flat_fields(b)
    if not x or not y or len(x) != len(y):
        return False
    key = lambda p: (exact_key(p[0]), exact_key(p[1]))
    return sorted(map(key, x)) == sorted(map(key, y))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the records that hold a row which isn't the same as their first; the rows of a task follow their first."""
    at, first = None, ""
    for batch in batches:
        out = []
        for key, task, is_first, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, task) != at:
                at, first = (key, task), text
            elif text != first and not same_record(text, first):
                out.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["record_key"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seq, fields = [], []
        for text in batch.column(1).to_pylist():
            seq.append(exact_key(text).hex())
            flat = flat_fields(text)
            fields.append(hashlib.sha256(repr(sorted((exact_key(n), exact_key(v)) for n, v in flat)).encode()).hexdigest() if flat else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq, pa.string()), pa.array(fields, pa.string())], ["id", "seq_key", "field_key"])


def record_keys(items: DataFrame, id_col: str = "id", text_col: str = "content", exact: bool = False) -> DataFrame:
    """``id, record_key``: equal keys for equal records, by rolling hashes or by digests. Texts never enter a shuffle here."""
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    hashed = spread(rows).mapInArrow(_exact if exact else _hashed, "id string, seq_key string, field_key string").dropDuplicates(["id", "seq_key"])
    hashed = checkpointed(hashed)
    # Flat records join classes of equal letters through their field sets.
    flat = hashed.where("field_key IS NOT NULL").select("seq_key", "field_key").distinct()
    labels = flat.join(flat.groupBy("field_key").agg(F.min("seq_key").alias("label")), "field_key")
    # Only where one letter sequence has several field sets can classes chain; then labels fall to the least until none moves.
    chained = flat.groupBy("seq_key").count().where("count > 1").limit(1).count() > 0
    while chained:
        by_seq = labels.groupBy("seq_key").agg(F.min("label").alias("m"))
        step = labels.join(by_seq, "seq_key").select("seq_key", "field_key", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        by_field = step.groupBy("field_key").agg(F.min("label").alias("m"))
        step = checkpointed(step.join(by_field, "field_key").select("seq_key", "field_key", "old", F.least("label", "m").alias("label")))
        chained = step.where("label < old").limit(1).count() > 0
        labels = step.select("seq_key", "field_key", "label")
    seq_label = labels.groupBy("seq_key").agg(F.min("label").alias("label"))
    return salted_join(hashed, seq_label, ["seq_key"], "left").select("id", F.coalesce("label", "seq_key").alias("record_key"))


def _members_only(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The texts whose ids may be among the members', told by a Bloom filter of bounded size that is broadcast: hardly any
    other text goes into the join."""
    shared = texts.sparkSession.sparkContext.broadcast(filter_words(members.select(F.xxhash64("id").alias("h")), "h"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = passes(shared.value, np.asarray(batch.column(2)))
            yield batch.filter(pa.array(hit)).select(["id", "text"])

    return texts.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(keep, "id string, text string")


COPIES_A_TASK = 1000


def collapse_copies(items: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``record_id, id, copies``: each id with the least id of its record and the record's number of copies.

    Defined results: null ids or texts give no row; an id delivered again with an equal text counts once; an id delivered
    with different texts belongs to one of their records; records chain (A like B by letters, B like C by fields); texts
    without letters or digits are one record; extra columns are ignored; an empty table gives an empty result.

    Only the texts of records with several rows are shuffled, once: the first one's text is dealt to as many tasks as its
    copies need (``COPIES_A_TASK`` each).
    """
    keys = checkpointed(record_keys(items, id_col, text_col).groupBy("id").agg(F.min("record_key").alias("record_key")))
    classes = keys.groupBy("record_key").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    members = checkpointed(salted_join(keys, classes, ["record_key"]))
    texts = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    member_text = _members_only(texts, members).join(members, "id")
    tasks = F.ceil(F.col("n") / COPIES_A_TASK).cast("int")
    marked = member_text.select("id", "text", "record_key", (F.col("id") == F.col("first_id")).alias("is_first"), F.when(F.col("id") == F.col("first_id"), F.sequence(F.lit(0), tasks - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), tasks).cast("int"))).alias("tasks"))
    dealt = marked.select("text", "record_key", "is_first", F.explode("tasks").alias("task"))
    # The first text of a record comes first among those of its task: one sorted pass compares the others with it.
    ordered = dealt.repartition("record_key", "task").sortWithinPartitions("record_key", "task", F.desc("is_first"))
    doubtful = checkpointed(ordered.select("record_key", "task", "is_first", "text").mapInArrow(_verified, "record_key string").distinct())
    final = keys
    if not doubtful.isEmpty():
        again = keys.join(doubtful, "record_key", "left_semi")
        exact = record_keys(texts.join(again.select("id"), "id", "left_semi"), "id", "text", exact=True).groupBy("id").agg(F.min("record_key").alias("exact"))
        final = checkpointed(keys.join(exact, "id", "left").select("id", F.coalesce("exact", "record_key").alias("record_key")))
    per_record = final.groupBy("record_key").agg(F.min("id").alias("record_id"), F.count("*").alias("copies"))
    return salted_join(final, per_record, ["record_key"]).select("record_id", "id", "copies")


def copy_pairs(items: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``keep_id, copy_id``: the least id of each record with each further one."""
    return collapse_copies(items, id_col, text_col).where("id <> record_id").select(F.col("record_id").alias("keep_id"), F.col("id").alias("copy_id"))
