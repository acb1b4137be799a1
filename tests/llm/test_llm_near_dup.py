"""Near-duplicates against all pairs."""

import random

import brute
import pytest

from rollbook.llm import near_dup
from rollbook.llm.components import components
from rollbook.operators import skew
from rollbook.session import read_table

SCHEMA = "doc_id long, text string"


def result(spark, rows, width=2, schema=SCHEMA):
    return near_dup.near_duplicates(spark.createDataFrame(rows, schema), width).collect()


def family(seed, copies, length=60, edits=9):
    """A text and copies with up to ``edits`` words changed, some beyond the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(length)]
    out = []
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randrange(edits)):
            text[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_families_equal_all_pairs(spark, monkeypatch, width):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 16)  # several blocks a family
    texts = family(1, 120) + family(2, 30) + family(3, 2) + ["w1 w2", "W1\tw2", "lone"]
    rows = list(enumerate(texts + texts[:20]))
    random.Random(5).shuffle(rows)
    want = brute.near_duplicates(rows, width)
    got = result(spark, rows, width)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_groups_among_many_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(skew, "MAX_HOT", 3)  # too many groups for a broadcast, of which the large ones are hot
    monkeypatch.setattr(skew, "SPREAD", 4)
    rows = list(enumerate(family(1, 60) + family(2, 10)))
    want = brute.near_duplicates(rows, 2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, rows)} == want


def test_small_table(spark, small):
    docs = read_table(spark, small, "documents")
    want = brute.near_duplicates([(r["doc_id"], r["text"]) for r in docs.collect()], 2)
    got = near_dup.near_duplicates(docs, 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [
        (1, None, 0, "x"),
        (2, "", 0, "x"),
        (3, " \t\n", 0, "x"),
        (4, "one", 0, "x"),
        (5, "ONE", 0, "x"),
        (6, long, 0, "x"),
        (7, long + " end", 0, "x"),
        (8, "a b c", 0, "x"),
        (8, "a b c", 0, "x"),
        (9, "two texts here", 0, "x"),
        (9, "one id", 0, "x"),
        (10, "one id", 0, "x"),
        (None, "a b c", 0, "x"),
    ]
    got = result(spark, rows, 2, "doc_id long, text string, component_id long, band string")
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == sorted(
        [
            (1, 0, 1, True),
            (2, 0, 2, True),
            (3, 0, 3, True),
            (4, 1, 4, True),
            (5, 1, 4, False),
            (6, 59_999, 6, True),
            (7, 60_000, 6, False),
            (8, 2, 8, True),
            (9, 1, 9, True),
            (10, 1, 9, False),
            (None, 2, None, True),
        ],
        key=str,
    )
    assert result(spark, [], 2) == []


def test_keep_one_keeps_columns(spark):
    rows = [(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, None, 9), (None, "a b c d e f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = near_dup.keep_one(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 9), (9, 7), (9, 9)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {7: 7, 9: 7}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
