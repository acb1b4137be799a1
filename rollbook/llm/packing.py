"""Token-id output: best-fit-decreasing packing into fixed rows of ids.

Each document's ids, with an end token after them, fill rows of SEQUENCE ids. What is
longer is split: its full pieces are rows of their own, only the rest is packed. The
rests wait in a pool of bounded size; a full pool is packed longest first, each into
the open row with the least room that still takes it. That row is found in a segment
tree over the amounts of room. A row comes out as its id matrix line (little-endian,
padded), the cumulative lengths of its segments, the places where positions start
at 0 again, and for each segment the document and the offset in it, so that all
documents can be put together again.

Packing happens where a text is read: no shuffle, the memory of one pool a task, and
the same rows when a lost task runs again over the same split.

Results for odd rows: null and empty texts give a segment of the end token alone;
repeated rows give segments of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.bpe import ByteBpe
from rollbook.llm.common import in_batches, per_process, text_of

#: Ids in a row, and ids that wait in a pool.
SEQUENCE, POOL = 2048, 1 << 22
END = "<|endoftext|>"


class Rooms:
    """Open rows by their room: a segment tree over 0..size that finds the least room of at least n."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.held = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.held[node] += by
            node >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A row with the least room that is ``least`` or more, and its room."""
        node = self.base + least
        if not self.held[node]:
            while node > 1 and (node & 1 or not self.held[node + 1]):  # up to a right neighbour that holds rows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.held[2 * node] else 2 * node + 1
        room = node - self.base
        self._change(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of indexes into ``lengths`` (1 to ``size`` each): longest first, ties in order, each into the tightest row."""
    rooms, rows = Rooms(size), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = rooms.take(lengths[k])
        if found is None:
            found = len(rows), size
            rows.append([])
        row, room = found
        rows[row].append(k)
        if room > lengths[k]:
            rooms.put(row, room - lengths[k])
    return rows


def pack(docs: DataFrame, content: bytes, sequence: int = SEQUENCE, pool: int = POOL) -> DataFrame:
    """Packed rows: shard, row, ids, n_tokens, cu_seqlens, position_resets, doc_ids and doc_offsets.

    ``content`` is the text of a tokenizer.json with END among its added tokens; END also fills the rows up.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(content)
    key = f"bpe-{hashlib.sha256(content).hexdigest()}"
    names = ["shard", "row", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"]
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.int32(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_process(key, lambda: ByteBpe(shipped.value))
        end = np.array([bpe.added[END]], bpe.kind).tobytes()
        width, shard = len(end), TaskContext.get().partitionId()
        waiting: list[tuple[bytes, int | None, int]] = []
        held = made = 0
        out: list[tuple] = []

        def line(segments: list[tuple[bytes, int | None, int]]) -> tuple:
            nonlocal made
            ids = b"".join(s[0] for s in segments)
            ends = np.cumsum([0] + [len(s[0]) // width for s in segments]).tolist()
            made += 1
            filled = ids + end * (sequence - ends[-1])
            return shard, made - 1, filled, ends[-1], ends, ends[:-1], [s[1] for s in segments], [s[2] for s in segments]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def packed() -> list[tuple]:
            rows = best_fit_decreasing([len(w[0]) // width for w in waiting], sequence)
            return [line([waiting[k] for k in row]) for row in rows]

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = bpe.encode(text) + end
                full = len(ids) // width // sequence * sequence
                for at in range(0, full, sequence):
                    out.append(line([(ids[at * width : (at + sequence) * width], doc_id, at)]))
                    if len(out) >= 2048:
                        yield batch_of(out)
                        out = []
                if rest := ids[full * width :]:
                    waiting.append((rest, doc_id, full))
                    held += len(rest) // width
                if held >= pool:
                    yield batch_of(out + packed())
                    waiting, held, out = [], 0, []
        yield batch_of(out + packed())

    schema = (
        "shard int, row long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, "
        "doc_ids array<long>, doc_offsets array<long>"
    )
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(in_batches, run, schema)


def segments(packed: DataFrame, id_bytes: int = 2) -> DataFrame:
    """The segments of packed rows: doc_id, doc_offset and ids, from which documents come together again by offset."""
    one = F.explode(F.arrays_zip("doc_ids", "doc_offsets", "position_resets", F.slice("cu_seqlens", 2, F.size("doc_ids")).alias("ends")))
    return packed.select("ids", one.alias("s")).select(
        F.col("s.doc_ids").alias("doc_id"),
        F.col("s.doc_offsets").alias("doc_offset"),
        F.expr(f"substring(ids, s.position_resets * {id_bytes} + 1, (s.ends - s.position_resets) * {id_bytes})").alias("ids"),
    )
