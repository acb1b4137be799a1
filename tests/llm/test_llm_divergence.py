"""Divergence of sources over run-length columns, against its SQL and a plain version."""

import collections
import re

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollbook.llm import divergence
from rollbook.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows, least):
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        found = TERM.findall(lowered(text))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = sorted(s for l, s in counts if l == lang)
        whole = collections.Counter()
        for s in groups:
            whole.update(counts[lang, s])

        def share(held, kept=kept):
            n = sum(held[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (held[t] + 5) // n for t in kept}

        of = {s: share(counts[lang, s]) for s in groups}
        q = share(whole)
        for s in groups:
            pairs = [(sum(abs(of[s][t] - of[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(of[s][t] - q[t], t) for t in kept if counts[lang, s][t] and of[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 50)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(items[:most])]
    return sorted(out)


def result(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_audit_equals_its_sql(spark):
    name, sf = "op12_run_length_divergence", "/root/testdata/sf0.01"
    got, want = oracle.compare(spark, oracle.connect(sf), sf, QUERIES[name], ORACLES[name])
    assert got == want


ODD = [
    (None, "en", "a"),
    ("", "en", "none"),
    ("123 !", "xx", "alone"),
    ("été ÉTÉ naïve", "en", None),
    ("x" * 9000 + " tail", None, "a"),
    ("dup dup", "en", "a"),
    ("dup dup", "en", "a"),
]


@pytest.mark.parametrize("block,tile,stretch,held", [(4096, 64, 1 << 20, 10**6), (4, 2, 64, 20)])
def test_odd_rows_blocks_and_tiles(spark, monkeypatch, block, tile, stretch, held):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "STRETCH", stretch)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "LEAST_DOCS", 2)
    rng = np.random.default_rng(5)
    words = [f"w{'abcdefghij'[k % 10] * (1 + k // 10)}" for k in range(60)]
    rows = ODD + [
        (" ".join(rng.choice(words, 20)) + (" Dup\ttail" if k % 3 else ""), ["en", "fr"][k % 2], f"s{0 if k % 3 else k % 11}")
        for k in range(120)
    ]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, term string")
    got = result(divergence.audit(docs.repartition(3)))
    assert got == plain(rows, 2)
    assert {r[2] for r in got if r[0] == "xx"} == set() and any(r[1] == "none" for r in got)


def test_a_language_without_vocabulary_and_an_empty_table(spark):
    docs = spark.createDataFrame([("a b", "en", "x"), ("c", "en", "y")], "text string, lang string, source string")
    assert result(divergence.audit(docs)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert divergence.audit(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 10**12)), min_size=1, max_size=40))
def test_runs_measure_what_terms_do(pairs):
    a, b = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
    runs = [divergence.Runs(c, int(c.sum()), len(c)) for c in (a, b)]
    p, q = (divergence.shares(c, int(c.sum()), len(c)) for c in (a, b))
    assert runs[0].distance(runs[1], len(a)) == sum(abs(int(x) - int(y)) for x, y in zip(p, q, strict=True))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB é\n1_", max_size=300), st.integers(1, 40))
def test_terms_of_stretches(text, stretch):
    had, divergence.STRETCH = divergence.STRETCH, stretch
    try:
        found = [t.decode() for part in divergence.terms_in(text.encode()) for t in part]
    finally:
        divergence.STRETCH = had
    assert found == TERM.findall(lowered(text))
