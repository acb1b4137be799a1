"""Encoding against the tokenizers library, counts and packing against brute force."""

import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rollbook.llm import bpe, bpe_reuse, packing, piece_counts
from rollbook.llm.queries import byte_bpe
from rollbook.session import read_table

ODD = [
    None,
    "",
    " ",
    "a",
    "x<|endoftext|>y <|endoftext|> z",
    "    a  b\n\n  c \U0001d518\U0001d52b \U0001d7d8 ½ x² ١٢ don't 'LL'll \x1c\x1d a\x85b c",
    "a" * 5000 + " " * 3000 + "b" * 4000,
    "é" * 3000,
    "word " * 4000,
    "\n" * 5000 + "x",
]


@pytest.fixture(scope="module")
def model():
    return bpe.ByteBpe(byte_bpe())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(byte_bpe().decode())


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab E'st \n\té5½中<|end\U0001d518"), max_size=200), cuts=st.sets(st.integers(1, 1500)))
def test_any_cuts_equal_the_library(model, library, text, cuts):
    raw = (text * 7).encode()
    starts = sorted(c for c in cuts if c < len(raw) and raw[c] & 0xC0 != 0x80)
    assert list(model.ids(bpe_reuse.ChunkEncoder(model).encode(raw, starts))) == library_ids(library, text * 7)


def test_documents(spark, small, library):
    docs = read_table(spark, small, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = bpe_reuse.encode_documents(docs, byte_bpe(), tuple(bpe_reuse.OUTPUTS)).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library_ids(library, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_odd_rows(spark, library):
    rows = [(k, t, "clash") for k, t in enumerate(ODD)] + [(1, "", "clash"), (None, "a b", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe_reuse.encode_documents(docs, byte_bpe(), ("n_tokens", "ids_sha256")).collect()
    want = [(d, hashlib.sha256(",".join(map(str, library_ids(library, t))).encode()).hexdigest()) for d, t, _ in rows]
    assert sorted(((r["doc_id"], r["ids_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert bpe_reuse.encode_documents(docs.limit(0), byte_bpe()).count() == 0


def test_shared_chunks_are_encoded_once(model):
    coder = bpe_reuse.ChunkEncoder(model)
    passage = " ".join(f"word{i % 97} and{i}" for i in range(3000))
    list(coder.encode_column(pa.array([passage, "other start " + passage, passage + " other end"])))
    assert coder.reused > 1.5 * coder.made


def test_vocabulary_that_is_not_plain_is_refused():
    with pytest.raises(ValueError):
        bpe.vocabulary(byte_bpe().replace(b'"normalizer":null', b'"normalizer":{"type":"NFC"}').replace(b'"normalizer": null', b'"normalizer": {"type": "NFC"}'))


# ---- counts ---------------------------------------------------------------------------------------------------------


def naive(entries, word):
    n = at = 0
    while at < len(word):
        at += next((k for k in range(len(word) - at, 1, -1) if word[at : at + k] in entries), 1)
        n += 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=20), st.binary(max_size=40))
def test_automaton_equals_longest_match(entries, word):
    word = bytes(x % 3 for x in word)
    assert piece_counts.Automaton(entries).count(word) == naive(entries, word)


def test_counts(spark, small):
    rows = [(k, t, 0) for k, t in enumerate(ODD[:6])] + [(1, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    entries, split = bpe.vocabulary(byte_bpe())[0], bpe.split_patterns()
    for table in (docs, read_table(spark, small, "documents").limit(40)):
        texts = [(r["doc_id"], split(r["text"] or "")) for r in table.collect()]
        want = [(d, len(w), sum(naive(entries, x.encode()) for x in w)) for d, w in texts]
        assert sorted(map(tuple, piece_counts.count_pieces(table, byte_bpe()).collect())) == sorted(want)
    assert piece_counts.count_pieces(docs.limit(0), byte_bpe()).count() == 0


# ---- packing --------------------------------------------------------------------------------------------------------


def plain_best_fit(lengths, size):
    rows, room = [], []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [r for r in range(len(rows)) if room[r] >= lengths[k]]
        if not fits:
            rows.append([])
            room.append(size)
            fits = [len(rows) - 1]
        row = min(fits, key=lambda r: room[r])
        rows[row].append(k)
        room[row] -= lengths[k]
    return sorted(size - r for r in room)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 13), max_size=60))
def test_best_fit(lengths):
    rows = packing.best_fit_decreasing(lengths, 13)
    assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
    assert sorted(sum(lengths[k] for k in r) for r in rows) == plain_best_fit(lengths, 13)


def test_packing_is_lossless(spark, model):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(100 + k, f"text {k} " * (k % 40), "x") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3)
    packed = packing.pack(docs, byte_bpe(), sequence=64, pool=500).collect()
    assert len({(r["shard"], r["row"]) for r in packed}) == len(packed)
    pieces = defaultdict(dict)
    for r in packed:
        assert len(r["ids"]) == 128 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64
        assert r["position_resets"] == r["cu_seqlens"][:-1] and len(r["doc_ids"]) == len(r["position_resets"])
        assert set(model.ids(bytes(r["ids"][2 * r["n_tokens"] :]))) <= {50256}
    for r in packing.segments(spark.createDataFrame(packed)).collect():
        pieces[r["doc_id"]][r["doc_offset"]] = bytes(r["ids"])
    for doc_id, text, _ in rows:
        ids = model.ids(b"".join(v for _, v in sorted(pieces[doc_id].items())))
        assert ids[-1] == 50256 and model.decode(ids[:-1]).decode() == (text or "")
    assert packing.pack(docs.limit(0), byte_bpe()).count() == 0
