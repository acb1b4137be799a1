"""Chat formatting with loss masks aligned to token offsets.

A turn is rendered as its role's mark, its text and the end mark. Marks are tokens of
their own. In texts (and in roles without a mark of their own) a backslash is doubled
and a control string gets a backslash after its first character, so no text holds a
control string and dropping escapes gives it back. A conversation is rendered as a
whole and encoded once; the byte offsets of its tokens come with the ids. The spans of
the turns' texts and the spans of the tokens are both sorted, so a binary search gives
the tokens that a span meets; the loss mask holds those of assistant texts, cut to the
span. read_back() takes the conversation apart again from ids and mask alone.

A conversation is rendered in pieces of PIECE_TURNS turns, so that one of any length is
spread over tasks; as an end mark is a token of its own, the pieces' ids joined are the
ids of the whole. Reading back streams over the pieces in order with constant memory
(a digest of a whole conversation has to).

Results for odd rows: null texts and null roles are empty ones; turns come by turn
(null first), then by role and text, so ties and repeated rows have a fixed order and
all count; rows without conv_id are one conversation; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.bpe import ByteBpe
from rollbook.llm.common import in_batches, per_process, text_of

PIECE_TURNS = 1024
#: Bytes of rendered text that are encoded at once.
PIECE_BYTES = 4 << 20

MARKS = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:"}
OTHER, OTHER_END, END = "### Role:", "</role>", "</turn>"
CONTROL = (*MARKS.values(), OTHER, OTHER_END, END)
#: Control strings in the widest sense: also what the tokenizer itself would take for a token.
ESCAPED = re.compile("|".join(map(re.escape, (*CONTROL, "<|endoftext|>"))))
UNESCAPED = re.compile(r"\\(.)", re.S)
_marks = re.compile("(" + "|".join(map(re.escape, CONTROL)) + ")")


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\") if "\\" in text else text
    return ESCAPED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The rendered (role, text) turns, and the span in characters and the role of each text."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = MARKS.get(role) or f"{OTHER}{escape(role)}{OTHER_END}"
        body = escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body), role))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered conversation."""
    names = {mark: role for role, mark in MARKS.items()}
    fields = _marks.split(rendered)  # texts and marks in turn
    turns, k = [], 1
    while k < len(fields):
        if fields[k] == OTHER:
            role, k = unescape(fields[k + 1]), k + 2
        else:
            role = names[fields[k]]
        turns.append((role, unescape(fields[k + 1])))
        k += 4
    return turns


def token_offsets(bpe: ByteBpe, ids) -> np.ndarray:
    """Where each token starts in the bytes of the text, and the end of the last."""
    return np.concatenate([[0], np.cumsum(bpe.sizes[np.asarray(ids, np.int64)])]).astype(np.int64)


def mask_spans(offsets: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """For each non-empty span of bytes: first and last token it meets, bytes of the first before it, bytes of it in the last."""
    out = []
    starts, ends = offsets[:-1], offsets[1:]
    for low, high in spans:
        if low < high:
            first, last = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(starts, high, "left")) - 1
            out.append((first, last, int(low - starts[first]), int(high - starts[last])))
    return out


def format_piece(bpe: ByteBpe, turns: list[tuple[str, str]]) -> tuple[str, bytes, list]:
    """Rendered text, packed ids, and the loss mask as flat numbers, four for each assistant text."""
    rendered, spans = render(turns)
    packed = bpe.encode(rendered)
    offsets = token_offsets(bpe, bpe.ids(packed))
    if rendered.isascii():
        places = np.arange(len(rendered) + 1)
    else:
        codes = np.frombuffer(rendered.encode("utf-32-le"), np.uint32)
        places = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
    own = [(int(places[a]), int(places[b])) for a, b, role in spans if role == "assistant"]
    return rendered, packed, [x for span in mask_spans(offsets, own) for x in span]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    """(key, row) stream of sorted batches whose first ``keys`` columns are the key."""
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        yield from zip(zip(*columns[:keys], strict=True), zip(*columns[keys:], strict=True), strict=True)


def _coder(key: str, content: bytes) -> ByteBpe:
    return per_process(f"chat-{key}", lambda: ByteBpe(content, CONTROL))


def format_conversations(conversations: DataFrame, content: bytes) -> DataFrame:
    """conv_id, piece, part, n_turns, formatted, ids and loss_spans; pieces and parts in order make the conversation.

    loss_spans holds four numbers for each assistant text: its first and last token in the
    part, the bytes of the first that stand before it, and its bytes in the last.
    """
    shipped = conversations.sparkSession.sparkContext.broadcast(content)
    key = hashlib.sha256(content).hexdigest()
    names = ["conv_id", "piece", "part", "n_turns", "formatted", "ids", "loss_spans"]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.binary(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(key, shipped.value)
        out: list[tuple] = []
        turns: list[tuple[str, str]] = []
        now, part, size = None, 0, 0

        def close() -> None:
            out.append((*now, part, len(turns), *format_piece(bpe, turns)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
            )

        held = 0
        for group, (role, text) in _grouped(batches, 2):
            if turns and (group != now or size > PIECE_BYTES):
                close()
                held += size
                part = part + 1 if group == now else 0
                turns, size = [], 0
                if held > PIECE_BYTES or len(out) >= 4096:
                    yield batch_of(out)
                    out, held = [], 0
            elif group != now:
                part = 0
            now = group
            turns.append((role, text))
            size += len(text) + 32
        if turns:
            close()
        if out:
            yield batch_of(out)

    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.coalesce(F.floor(F.col("turn").cast("long") / PIECE_TURNS), F.lit(-(1 << 60))).cast("long").alias("piece"),
        F.col("turn").cast("long"),
        text_of("role").alias("role"),
        text_of().alias("text"),
    )
    dealt = rows.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "turn", "role", "text")
    schema = "conv_id long, piece long, part long, n_turns long, formatted string, ids binary, loss_spans array<int>"
    return dealt.select("conv_id", "piece", "role", "text").transform(in_batches, run, schema)


def read_back(formatted: DataFrame, content: bytes) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the ids and masks alone."""
    shipped = formatted.sparkSession.sparkContext.broadcast(content)
    key = hashlib.sha256(content).hexdigest()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(key, shipped.value)
        out: list[tuple] = []
        now, state = None, None

        def close() -> None:
            n, turns, chars, loss, whole = state
            out.append((now[0], n, turns.hexdigest(), chars, loss.hexdigest(), whole))

        for group, (packed, spans) in _grouped(batches, 1):
            if state is not None and group != now:
                close()
                state = None
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            now = group
            state = state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            ids = bpe.ids(packed)
            text = bpe.decode(ids).decode()
            state[4] += len(text)
            for role, body in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
            for k in range(0, len(spans), 4):
                first, last, before, inside = spans[k : k + 4]
                head = bpe.decode(ids[first:last])
                body = unescape((head + bpe.decode(ids[last : last + 1])[:inside])[before:].decode())
                state[2] += len(body)
                state[3].update(body.encode())
        if state is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "part")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.select("conv_id", "ids", "loss_spans").transform(in_batches, run, schema)
