"""Licence scans, chat masks, nearest neighbours."""

import hashlib

import brute
import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollbook.llm import ann, bpe, chat, license_scan
from rollbook.llm.queries import ORACLES, QUERIES, TRICKY, byte_bpe
from rollbook.session import read_table

# ---- licences -------------------------------------------------------------------------------------------------------


def test_scan_equals_its_sql(spark, small):
    got, want = oracle.compare(spark, oracle.connect(small), small, QUERIES["op2_license_scan"], ORACLES["op2_license_scan"])
    assert got == want


def test_scan_of_notices(spark):
    import duckdb

    rows = [
        (1, None),
        (2, ""),
        (3, "All Rights Reserved. all rights, reserved"),
        (4, "Under CC-BY-SA and the GNU General\nPublic License"),
        (5, "apache license version 2.0"),
        (6, "é word " * 30_000 + "cc by"),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (7, "general public all rights cc"),
        (None, "MIT License"),
        *((10 + k, notice.replace("[", "").replace("]", "")) for k, (_, notice) in enumerate(license_scan.NOTICES)),
    ]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, hits int, score double")
    frame = license_scan.scan(docs)
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    ref = con.execute(license_scan.scan_sql())
    got = oracle.rows_of(frame.columns, frame.collect())
    want = oracle.rows_of([d[0] for d in ref.description], ref.fetchall())
    assert got == want
    found = {r["doc_id"]: r for r in frame.collect()}
    assert (found[3]["n_base"], found[3]["first_word"], found[3]["last_word"], found[3]["labels"]) == (2, 0, 3, "reserved")
    assert found[4]["base_labels"] == "cc-by,gpl" and found[4]["labels"] == "cc-by,cc-by-sa,gpl"
    assert found[5]["labels"] == "apache-2.0" and found[6]["first_word"] == 60_000 and found[None]["labels"] == "mit"
    for k, (label, _) in enumerate(license_scan.NOTICES):
        assert label in found[10 + k]["labels"].split(",") and found[10 + k]["score"] == 1
    assert license_scan.scan(docs.limit(0)).count() == 0


# ---- chat -----------------------------------------------------------------------------------------------------------


def digests(turns):
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    every = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(every), len(loss), sha(loss)


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(byte_bpe(), chat.CONTROL)


pieces = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "/turn>", "###", " User:", "é", "\U0001d518", "a b", "\n", "<|endoftext|>", ""]), max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "</role>\\"]), pieces.map("".join)), max_size=5))
def test_round_trip(coder, turns):
    rendered, packed, spans = chat.format_piece(coder, turns)
    ids = coder.ids(packed)
    raw = rendered.encode()
    assert chat.parse(coder.decode(ids).decode()) == turns
    offsets = chat.token_offsets(coder, ids)
    masked = [raw[offsets[a] + x : offsets[b] + y] for a, b, x, y in zip(*[iter(spans)] * 4, strict=True)]
    assert [chat.unescape(m.decode()) for m in masked] == [t for r, t in turns if r == "assistant" and t]
    assert all(x == 0 and y == offsets[b + 1] - offsets[b] for a, b, x, y in zip(*[iter(spans)] * 4, strict=True))


def test_small_conversations(spark, small):
    turns = {}
    for r in sorted(read_table(spark, small, "conversations").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    turns[-7] = [("user", TRICKY), ("assistant", TRICKY)]
    got = {r["conv_id"]: r for r in QUERIES["op4_chat_masks"](spark, small).collect()}
    assert got.keys() == turns.keys()
    for c, r in got.items():
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests(turns[c])


def test_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_TURNS", 3)
    monkeypatch.setattr(chat, "PIECE_BYTES", 5000)
    rows = [
        (1, 0, "user", None),
        (1, 1, "assistant", ""),
        (2, 0, None, "x"),
        (2, 0, "assistant", "b"),
        (2, 0, "assistant", "a"),
        (2, 0, "assistant", "a"),
        (2, None, "user", "first"),
        (None, 0, "user", "no id"),
        *((3, k, "assistant" if k % 2 else "user", f"turn {k} é " + "long " * (2000 if k == 5 else 1)) for k in range(40)),
    ]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, piece int, ids string")
    formatted = chat.format_conversations(frame.repartition(3), byte_bpe())
    got = {r["conv_id"]: r for r in chat.read_back(formatted, byte_bpe()).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in (1, 2, 3, None):
        turns = [(r[2], r[3]) for r in sorted((r for r in rows if r[0] == c), key=order)]
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == digests(turns)
        assert got[c]["formatted_chars"] == len(chat.render([(r or "", t or "") for r, t in turns])[0])
    assert len(got) == 4
    assert chat.read_back(chat.format_conversations(frame.limit(0), byte_bpe()), byte_bpe()).count() == 0


# ---- nearest neighbours ---------------------------------------------------------------------------------------------


def test_recall(spark):
    vectors = read_table(spark, "/root/testdata/sf0.1", "embeddings")
    true = brute.nearest([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    got = [tuple(r) for r in QUERIES["op6_kmeans_tree_search"](spark, "/root/testdata/sf0.1").collect()]
    assert len(got) == len(true)
    same = {(q, v) for q, _, v, _ in true} & {(q, v) for q, _, v, _ in got}
    assert len(same) >= 0.9 * len(true)
    exact = {(q, v): s for q, _, v, s in true}
    assert all(abs(exact[q, v] - s) < 1e-12 for q, _, v, s in got if (q, v) in exact)
    ranks = {}
    for q, n, _, _ in got:
        ranks.setdefault(q, []).append(n)
    assert all(sorted(r) == [1, 2, 3, 4, 5] for r in ranks.values())


def test_best_first_visits_every_leaf_nearest_centre_first():
    units = ann.units_of(np.random.default_rng(2).normal(size=(900, 6)))
    tree = ann.fit_tree(units, 40)
    homes = tree.leaf_of(units)
    assert set(homes) <= set(range(tree.leaves)) and tree.leaves > 20
    for unit in units[:20]:
        order = list(tree.best_first(unit))
        assert sorted(order) == list(range(tree.leaves))
    assert np.mean([list(tree.best_first(u)).index(h) for u, h in zip(units[:100], homes[:100], strict=True)]) < 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]),
        (0, [1.0, 0.0]),
        (50, [1.0, 0.0]),
        (1, [2.0, 0.0]),
        *((k, [0.0, 1.0]) for k in range(60, 80)),
        (100, [0.0, 1.0]),
        (2, None),
        (3, []),
        (4, [0.0, 0.0]),
        (5, [nan, 1.0]),
        (6, [inf, 1.0]),
        (7, [None, 1.0]),
        (8, [1.0, 1.0, 1.0]),
        (150, None),
        (None, [1.0, 0.0]),
    ]
    vectors = spark.createDataFrame([(*r, 0, 0.0) for r in rows], "vec_id long, embedding array<double>, leaf int, score double")
    is_query = F.col("vec_id") % 50 == 0
    got = sorted(tuple(r) for r in ann.search(vectors, is_query).collect())
    want = sorted(brute.nearest(rows))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)
    assert [r[2] for r in got if r[0] == 0][:2] == [1, 50] and [r[2] for r in got if r[0] == 100] == [60, 61, 62, 63, 64]
    assert ann.search(vectors.limit(0), is_query).count() == 0
    pair = spark.createDataFrame([(0, [1.0]), (50, [-1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in ann.search(pair, is_query).collect()) == [(0, 1, 50, -1.0), (50, 1, 0, -1.0)]
