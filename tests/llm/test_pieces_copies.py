import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillmill.llm.copies import collapse_copies, copy_pairs, fingerprints, flat_fields, same_by_two_pointers, same_record
from quillmill.llm.pieces import rejoined, split_oversized

SCHEMA = "id string, content string, start_line bigint, part string"


def pieces_of(spark, rows, **kw):
    return [r.asDict() for r in split_oversized(spark.createDataFrame(rows, SCHEMA), **kw).orderBy("chunk_id", "piece_index").collect()]


def check(rows, text, first, limit, overlap):
    whole = b""
    lines = text.split("\n")
    for r in rows:
        b = r["content"].encode()
        assert len(b) // 4 <= limit and r["token_estimate"] == len(b) // 4
        assert r["overlap_bytes"] <= overlap * 4 and whole.endswith(b[: r["overlap_bytes"]])
        whole += b[r["overlap_bytes"] :]
        assert r["content"].split("\n")[0] in lines[r["start_line"] - first]
        body = r["content"].removesuffix("\n")
        assert r["end_line"] - r["start_line"] == body.count("\n")
    assert whole == text.encode()


@pytest.mark.parametrize("text", ["x" * 9000, "é" * 5000, "word " * 2000, "".join(f"def f{i}():\n    return {i}\n\n" for i in range(400)), "a\r\nb\r\n\r\n" * 900, "😀" * 1200, "\n" * 4000])
def test_pieces_give_the_text_back(spark, text):
    rows = pieces_of(spark, [("a", text, 5, None)])
    assert len(rows) > 1
    check(rows, text, 5, 800, 120)


def test_pieces_edges(spark):
    assert pieces_of(spark, []) == []
    rows = [("small", "x" * 3203, 1, "p"), (None, "x" * 9000, 1, None), ("null", None, 1, None), ("empty", "", 1, None), ("big", "y" * 3204, None, None), ("big", "y" * 3204, None, None)]
    out = pieces_of(spark, rows)
    assert {r["chunk_id"] for r in out} == {"big"} and out[0]["start_line"] == 1
    assert [r["piece_index"] for r in out] == list(range(len(out)))
    no_overlap = pieces_of(spark, [("a", "line\n" * 3000, 1, None)], overlap_tokens=0)
    assert all(r["overlap_bytes"] == 0 for r in no_overlap)
    with pytest.raises(ValueError):
        split_oversized(spark.createDataFrame([], SCHEMA), overlap_tokens=800)


def test_pieces_prefer_strong_boundaries(spark):
    text = "".join(f"def f{i}():\n" + "    x = 1\n" * 40 + "\n" for i in range(30))
    for r in pieces_of(spark, [("a", text, 1, None)])[1:]:
        assert r["content"].encode()[r["overlap_bytes"] :].startswith(b"def ")


def brute(items):
    ids = sorted(items)
    group = {i: i for i in ids}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if same_record(items[a], items[b]):
            x, y = sorted((find(a), find(b)))
            group[y] = x
    return {(find(i), i) for i in ids if find(i) != i}


def test_copies_match_brute_force(spark):
    rng = random.Random(3)
    items = {}
    base = ["def f(x):\n    return x + 1", "alpha: 1\nbeta: two\ngamma: x y", '{"a": "1", "b": "q"}', "Größe = 5\nÉté = 6", "same", "", "--", "alpha: 12\nbeta: wo"]
    for k in range(70):
        t = rng.choice(base)
        if rng.random() < 0.5:
            t = t.upper() if rng.random() < 0.5 else t.title()
        if rng.random() < 0.5 and "\n" in t and ":" in t:
            lines = t.split("\n")
            rng.shuffle(lines)
            t = "\n\n".join(lines)
        t = t.replace(" ", rng.choice([" ", "  ", "\t", ""])) if rng.random() < 0.4 and ":" not in t else t
        items[f"k{k:03d}"] = t
    items |= {"j1": '{"b": "q", "a": "1"}', "j2": "a = 1\nb = q", "j3": '{"a": "q", "b": "1"}', "chain1": "ab: c\nd: e", "chain2": "a: bc\nd: e", "chain3": "d: e\na: bc", "chain4": "d: e\nab: c"}
    df = spark.createDataFrame([(i, t, 1, None) for i, t in items.items()] + [("k000", items["k000"], 9, "again")], SCHEMA)
    got = {(r["keep_id"], r["copy_id"]) for r in copy_pairs(df).collect()}
    assert got == brute(items)
    counts = collapse_copies(df).groupBy("record_id").agg(F.count("*").alias("n"), F.max("copies").alias("c")).collect()
    assert all(r["n"] == r["c"] for r in counts)


def test_copies_edges(spark):
    assert copy_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "x", 1, None), ("a", None, 1, None), ("b", "q" * 300_000, 1, None), ("c", "Q" * 300_000, 1, None)]
    assert [tuple(r) for r in copy_pairs(spark.createDataFrame(rows, SCHEMA)).collect()] == [("b", "c")]


def test_rejoined(spark):
    text = "".join(f"line {i} é\n" for i in range(3000))
    row = rejoined(split_oversized(spark.createDataFrame([("a", text, 7, None)], SCHEMA))).first()
    assert row["sha"] == hashlib.sha256(text.encode()).hexdigest() and (row["start_line"], row["end_line"], row["fits"]) == (7, 3006, True)


def test_pieces_small_limits_and_early_breaks(spark):
    """Lookback over several short stretches, and a break in the first half rather than a cut within a word."""
    for text in ("ab\n" * 500, "é" * 300, "x" * 100 + "\n" + "y" * 900):
        check(pieces_of(spark, [("a", text, 1, None)], limit_tokens=10, overlap_tokens=8), text, 1, 10, 8)
    out = pieces_of(spark, [("a", "short line\n" + "x" * 8000, 1, None)])
    assert out[0]["content"] == "short line\n"


def test_copies_hot_record_and_late_letters(spark):
    """One record may hold most rows; letters of late planes count; fields behind many blank lines are seen."""
    rows = [(f"h{i:05d}", "Same  Text" if i % 2 else "same-text", 1, None) for i in range(2500)]
    rows += [("x1", "a \U00030005", 1, None), ("x2", "a \U00030006", 1, None), ("f1", "\n" * 420 + "a: 1\nb: 2", 1, None), ("f2", "b: 2\na: 1", 1, None)]
    got = copy_pairs(spark.createDataFrame(rows, SCHEMA)).groupBy("keep_id").count().collect()
    assert {tuple(r) for r in got} == {("h00000", 2499), ("f1", 1)}


def test_fingerprints_and_pointers():
    a, b = "Hello, World 42", "hello world42"
    assert (fingerprints([a])[0] == fingerprints([b, "x"])[0]).all()
    assert same_by_two_pointers("a-" * 10_000, "A " * 10_000, block=7) and not same_by_two_pointers("ab", "abc") and not same_by_two_pointers("ab", "ba")
    assert flat_fields("a: 1\nb = 2") == [("a", "1"), ("b", "2")] and flat_fields('{"a": {"b": 1}, "c": 2}') is None and flat_fields("just text") is None
