"""Decontamination against all windows."""

import collections
import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa

from rollbook.llm import decontam
from rollbook.session import read_table


def pairs(rows):
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], round(r["similarity"], 9)) for r in rows}


def rounded(want):
    return {k: (n, round(x, 9)) for k, (n, x) in want.items()}


def test_edited_passages_equal_all_windows(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"q{rng.randrange(500)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 20, 45])))) for i in range(16)]
    docs = []
    for d in range(150):
        text = [f"z{rng.randrange(60)}" for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.randrange(3)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((d, ", ".join(text)))
    want = brute.contaminated(docs, items)
    assert len(want) > 30 and any(x < 1 for _, x in want.values())
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert pairs(decontam.contaminated(frame, bench).collect()) == rounded(want)
    assert pairs(decontam.contaminated(frame, bench, limit=200).collect()) == rounded(want)  # many blocks of items
    # the choice of windows by shingles only saves work: fingerprints alone find the same
    assert pairs(decontam.contaminated(frame, bench, skip=False).collect()) == rounded(want)
    kept = {r["doc_id"] for r in decontam.keep_clean(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_small_table(spark, small):
    docs, items = read_table(spark, small, "documents"), read_table(spark, small, "benchmark")
    want = brute.contaminated([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert want and pairs(decontam.contaminated(docs, items).collect()) == rounded(want)


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [
        (1, None, 0),
        (2, "", 0),
        (3, item.upper(), 0),
        (3, "before " + item, 0),
        (4, "z " * 200_000 + item, 0),
        (5, "alpha beta", 0),
        (None, item, 0),
        (6, "one two", 0),
        (7, "Alpha-Beta!", 0),
        (8, "some words alpha beta and more words", 0),
        (9, "beta alpha and more words", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, None, 0), (3, "", 0), (4, "alpha beta", 0)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"], r["start_word"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(3, 1, 0), (4, 1, 200_000), (None, 1, 0), (5, 4, 0), (7, 4, 0), (8, 4, 2)}
    assert sorted((r["doc_id"] for r in decontam.keep_clean(docs, bench).collect())) == [1, 2, 6, 9]
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.keep_clean(docs, bench.limit(0)).count() == len(rows)


def test_stretches_and_shared_weights_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 60)
        span = rng.randrange(1, n + 1)
        run = np.array([rng.randrange(8) for _ in range(n)], np.uint64)
        hits = np.array(sorted(rng.sample(range(n), rng.randrange(n + 1))), np.int64)
        least = rng.randrange(1, span + 1)
        want = [a for a in range(n - span + 1) if sum(a <= h < a + span for h in hits) >= least]
        got = decontam.stretches(hits, least, span, n - span)
        assert [a for low, high in got for a in range(low, high + 1)] == want
        assert all(low > high + 1 for (_, high), (low, _) in zip(got, got[1:], strict=False))
        bag = collections.Counter(rng.randrange(8) for _ in range(rng.randrange(1, 30)))
        values = np.array(sorted(bag), np.uint64)
        first = rng.randrange(n - span + 1)
        last = rng.randrange(first, n - span + 1)
        held = decontam.shared_weights(run, first, last, span, (values, np.array([bag[int(v)] for v in values])))
        assert held.tolist() == [sum((collections.Counter(run[a : a + span].tolist()) & bag).values()) for a in range(first, last + 1)]


def test_fingerprints_roll_and_blocks_find_all_within_the_radius(monkeypatch):
    monkeypatch.setattr(decontam, "CHUNK", 7)
    run = np.random.default_rng(1).integers(0, 1 << 60, 90).astype(np.uint64)
    got = np.concatenate([p for _, p in decontam.fingerprints(run, 3, 70, 20)])
    want = [np.packbits(decontam.signs(run[a : a + 20]).sum(axis=0, dtype=int) > 0) for a in range(3, 71)]
    assert (got == np.array(want)).all()
    runs = [run[a : a + 20] for a in (0, 5, 5, 40, 60)]
    group = decontam._sized(20, [[k] for k in range(5)], runs)
    monkeypatch.setattr(decontam, "PAIRS", 12)
    for radius in (0, 40):
        window, text = decontam.lookup(group, got, radius)
        apart = np.unpackbits(got[:, None] ^ group.prints[None], axis=2).sum(axis=2)
        assert set(zip(window.tolist(), text.tolist(), strict=True)) == set(zip(*np.nonzero(apart <= radius), strict=True))


def test_long_items_in_long_repeated_texts_take_linear_memory():
    rng = random.Random(9)
    item = " ".join(f"w{rng.randrange(5000)}" for _ in range(20_000))
    index = decontam.index_items([1, 2], pa.array([item, "z " * 3000], pa.large_string()))
    texts = pa.array([f"a b {item} c d {item}", "z " * 30_000], pa.large_string())
    tracemalloc.start()
    found = list(decontam.matches(index, texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r, i, s) for r, i, s, _, _ in found] == [(0, 1, 2), (1, 2, 0)]
    assert found[0][4] == found[1][4] == 1.0 and found[1][3] == 30_000 - 3000 + 1
    assert peak < 150 << 20
