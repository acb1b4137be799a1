"""Alignment of two tokenizers' tokens, against a walk over both token lists."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rollbook.llm import alignment
from rollbook.llm.bpe import byte_alphabet
from rollbook.llm.queries import QUERIES, byte_bpe, piece_bpe
from rollbook.session import read_table

COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.fixture(scope="module")
def tools():
    return alignment.Tokenizers(byte_bpe(), piece_bpe())


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), byte_alphabet()


def spans(libraries, text):
    """(id, start, end) of the A and of the B tokens; none where their bytes are not the text's."""
    a, b, letters = libraries
    if not text:
        return [], []
    found = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    pieces = [(i, b.id_to_piece(i)) for i in b.encode(text, num_threads=1)]
    pieces = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
    out = []
    for tokens in (found, pieces):
        if b"".join(t for _, t in tokens) != (" " + text).encode():
            return [], []
        at, own = 0, []
        for i, t in tokens:
            own.append((i, at, at + len(t)))
            at += len(t)
        out.append(own)
    return out


def plain(libraries, rows):
    per, counts = [], collections.Counter()
    for d, text in rows:
        a, b = spans(libraries, text)
        links, j = [], 0
        for i, start, end in a:
            while j and b[j - 1][2] > start:
                j -= 1
            while j < len(b) and b[j][1] < end:
                if b[j][2] > start:
                    links.append((i, b[j][0]))
                j += 1
        groups, x, y = [], 0, 0
        for cut in sorted({e for *_, e in a} & {e for *_, e in b}):
            own = ([], [])
            while x < len(a) and a[x][2] <= cut:
                own[0].append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= cut:
                own[1].append(str(b[y][0]))
                y += 1
            groups.append("|".join(map(",".join, own)))
        counts.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        per.append((d, len(a), len(b), len(groups), links, digest))
    highest = collections.Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return sorted(
        ((d, n, m, g, len(own), sum(counts[p] == highest[p[1]] for p in own), sum(counts[p] for p in own), s) for d, n, m, g, own, s in per),
        key=repr,
    )


def result(frame):
    assert frame.columns == COLUMNS
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_query_equals_the_walk(spark, small, libraries):
    rows = [tuple(r) for r in read_table(spark, small, "documents").select("doc_id", "text").collect()]
    assert result(QUERIES["op13_arrow_alignment"](spark, small)) == plain(libraries, rows)


ODD = [
    (1, None),
    (2, ""),
    (None, "no id"),
    (3, "é ﬁ Ａ \xa0 x"),
    (4, "▁ is no blank"),
    (5, "decomposed é"),
    (6, "a\0b \n\n\r\n\t x  y   z "),
    (7, "<|endoftext|> <s> <unk> <0x0A> </s>"),
    (8, "中文 \U0001f600 mixed"),
    (9, "x"),
    (9, "x"),
    (9, " "),
    (10, "unbroken" * 3000),
    (11, "a long text, " * 4000 + "▁"),
    (12, "a long text; and more. " * 4000),
]


@pytest.mark.parametrize("segment,frequent", [(1 << 19, 1 << 20), (2000, 40), (500, 0)])
def test_odd_texts_segments_and_rare_pairs(spark, monkeypatch, libraries, segment, frequent):
    monkeypatch.setattr(alignment, "SEGMENT", segment)
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    docs = spark.createDataFrame([(*r, 1, "x") for r in ODD], "doc_id long, text string, row int, codes string")
    got = result(alignment.align(docs.repartition(3), byte_bpe(), piece_bpe()))
    assert got == plain(libraries, ODD)
    none = [r for r in got if r[0] in (1, 2, 4, 11)]
    assert all(r[1:] == (0, 0, 0, 0, 0, 0, "") for r in none) and len(none) == 4


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, byte_bpe(), piece_bpe()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .é\n▁́中'9", max_size=60), max_size=6))
def test_any_texts(tools, libraries, texts):
    had, alignment.SEGMENT = alignment.SEGMENT, 16
    try:
        got = alignment.align_texts(tools, texts)
    finally:
        alignment.SEGMENT = had
    want = [plain(libraries, [(0, t)])[0] for t in texts]
    assert [(*r[:5],) for r in got] == [(*w[1:5], w[7]) for w in want]
