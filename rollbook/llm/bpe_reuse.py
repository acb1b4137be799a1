"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts a text into chunks wherever the
content says so, so that passages which documents share give equal chunks at any
offset. A chunk is encoded once while a worker keeps it. Chunks cut words in two;
each join is repaired by encoding the text around it anew, widened until both ends
stand where the old and the new encoding agree: between a character that is no
white space and white space after it. No word of the split pattern goes on there
and none looks behind it, so equality holds for the whole text.

Results for odd rows: a null or empty text has no tokens; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.bpe import ByteBpe
from rollbook.llm.common import BLOCK, in_batches, per_process, string_bytes, text_of

#: A cut for one in 512 positions, and no chunk below 128 bytes but the last of a text.
CUT_BITS, LEAST_CHUNK = 9, 128
#: Bytes of chunks that a worker keeps; past it the cache starts anew.
CACHED_BYTES = 16 << 20

_gear = np.random.default_rng(20260101).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Positions where the rolling hash of the 32 bytes before is 0 in its top bits, at starts of characters."""
    found, at = [], 0
    while at < len(raw):
        part = raw[max(0, at - 32) : at + BLOCK]
        h = _gear[part]
        for step in (1, 2, 4, 8, 16):  # hash of 2, 4 .. 32 bytes from two halves
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        hits = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1 + max(0, at - 32)
        found.append(hits[(hits > at) & (hits <= at + BLOCK)])
        at += BLOCK
    hits = np.concatenate(found) if found else np.zeros(0, np.int64)
    hits = hits[hits < len(raw)]
    return hits[raw[hits] & 0xC0 != 0x80]


class ChunkEncoder:
    """Encodes texts chunk by chunk; equal chunks are encoded once while they are kept."""

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.chunks, self.held, self.made, self.reused = bpe, {}, 0, 0, 0

    def chunk(self, raw: bytes) -> tuple[str, bytes, str] | str:
        """Text up to the first agreed position, ids from there to the last one, and the text after; or no position: all text."""
        if (known := self.chunks.get(raw)) is not None:
            self.reused += 1
            return known
        text = raw.decode("utf-8", "replace")
        first = self.bpe.first_gap.search(text)
        if first is None:
            out = text
        else:
            start, end = first.start() + 1, self.bpe.last_gap.match(text).start(1)
            out = text[:start], self.bpe.encode(text[start:end]), text[end:]
        if self.held > CACHED_BYTES:
            self.chunks.clear()
            self.held = 0
        self.chunks[raw] = out
        self.held += 3 * len(raw) + 200
        self.made += 1
        return out

    def encode(self, raw: bytes, cuts: list[int]) -> bytes:
        """Packed ids of a text in UTF-8 whose chunks end at ``cuts`` (ascending, without the ends)."""
        out, open_text, at = [], [], 0
        for cut in [*cuts, len(raw)]:
            if cut - at < LEAST_CHUNK and cut < len(raw):
                continue
            got = self.chunk(raw[at:cut])
            at = cut
            if isinstance(got, str):  # not agreed yet: widen
                open_text.append(got)
                continue
            head, ids, open_head = got
            out += [self.bpe.encode("".join([*open_text, head])), ids]
            open_text = [open_head]
        out.append(self.bpe.encode("".join(open_text)))
        return b"".join(out)

    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """Packed ids of each text of a column without nulls."""
        raw, offsets = string_bytes(column)
        hits = cut_points(raw)
        whole = raw.tobytes()
        low, high = np.searchsorted(hits, offsets[:-1], "right"), np.searchsorted(hits, offsets[1:], "left")
        for k in range(len(column)):
            a, b = int(offsets[k]), int(offsets[k + 1])
            yield self.encode(whole[a:b], (hits[low[k] : high[k]] - a).tolist())


OUTPUTS = {
    "n_tokens": ("long", lambda bpe, ids: len(ids)),
    "ids": ("binary", lambda bpe, ids: ids.tobytes()),
    "decoded": ("string", lambda bpe, ids: bpe.decode(ids).decode("utf-8", "replace")),
    "ids_sha256": ("string", lambda bpe, ids: bpe.digest(ids)),
    "decoded_sha256": (
        "string",
        lambda bpe, ids: hashlib.sha256(bpe.decode(ids).decode("utf-8", "replace").encode()).hexdigest(),
    ),
}
ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def encode_documents(docs: DataFrame, content: bytes, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the ``outputs`` of each text: number of tokens, packed ids, decoded text, or digests of these.

    ``content`` is the text of a tokenizer.json, which goes to the executors as one
    broadcast (a fixed file of some MB). No shuffle: a text is encoded where it is read.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(content)
    key = f"bpe-{hashlib.sha256(content).hexdigest()}"
    makers = [OUTPUTS[o] for o in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = per_process(f"{key}-chunks", lambda: ChunkEncoder(per_process(key, lambda: ByteBpe(shipped.value))))
        for batch in batches:
            rows: list[list] = [[] for _ in makers]
            for packed in coder.encode_column(batch.column(1)):
                ids = coder.bpe.ids(packed)
                for row, (_, make) in zip(rows, makers, strict=True):
                    row.append(make(coder.bpe, ids))
            columns = [pa.array(r, ARROW[kind]) for r, (kind, _) in zip(rows, makers, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", *outputs])

    schema = "doc_id long, " + ", ".join(f"{o} {OUTPUTS[o][0]}" for o in outputs)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(in_batches, run, schema)
