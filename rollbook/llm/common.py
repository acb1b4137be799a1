"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.session import scratch_dir

#: Bytes of text whose words are found at once; bounds the arrays that word_runs makes.
BLOCK = 1 << 19
#: Bytes of rows that travel between Spark and a Python worker at once (or one row, if that is longer).
BATCH_BYTES = 8 << 20
U64 = np.uint64
GOLDEN, MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def per_process(key: str, build: Callable):
    """What a Python worker keeps between tasks (vocabularies, caches), built on first use."""
    name = "_rollbook_llm_worker"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


def stored_once(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here."""
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, so that long texts don't fill a worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x + GOLDEN
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_space = np.ones(256, dtype=bool)
_space[[32, 9, 10, 11, 12, 13]] = False
#: Words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing): which bytes belong to them.
SPACED_WORDS = _space
PLAIN_WORDS = np.zeros(256, dtype=bool)
PLAIN_WORDS[48:58] = PLAIN_WORDS[97:123] = PLAIN_WORDS[128:] = True

_weights = np.cumprod(np.full(4096, 0x5851F42D4C957F2D | 1, dtype=U64))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and where each text starts (one more offset at the end)."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column: pa.Array, limit: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Stretches of rows with at most ``limit`` bytes of text, or one row."""
    _, offsets = string_bytes(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, len(column))
        at = end


def word_runs(column: pa.Array, in_word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, row, length in bytes) arrays of the lower-cased words of a string column, block by block, in order.

    Blocks end where a word ends, so a text of any length needs the arrays of one
    block only. Texts are separated even where no byte stands between them.
    """
    raw, offsets = string_bytes(column)
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw):  # move on to a byte that no word holds, or to the end of the text
            stop = min(len(raw), end + BLOCK)
            gaps = np.flatnonzero(~in_word[LOWER[raw[end:stop]]])
            edge = offsets[np.searchsorted(offsets, end)]
            found = end + gaps[0] if len(gaps) else stop
            if edge <= found:
                end = int(edge)
                break
            end = int(found)
            if len(gaps):
                break
        low = LOWER[raw[at:end]]
        inside = in_word[low]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        if len(starts):
            place = np.flatnonzero(inside)
            owner = np.cumsum((inside & ~before)[place]) - 1
            depth = place - starts[owner]
            value = (low[place].astype(U64) + U64(1)) * MIX_A
            value ^= value >> U64(29)
            value *= _weights[depth & 4095] + (depth >> 12).astype(U64)
            first = np.searchsorted(owner, np.arange(len(starts)))
            lengths = np.diff(np.append(first, len(place))).astype(U64)
            hashes = mix(np.add.reduceat(value, first) ^ (lengths * GOLDEN))
            yield hashes, np.searchsorted(offsets, starts + at, side="right") - 1, lengths
        at = end


def words_of(column: pa.Array, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of a string column: their hashes, for each text where its words start (one more at the end), and their lengths."""
    parts = list(word_runs(column, in_word))
    hashes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U64)
    rows = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    lengths = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, U64)
    return hashes, np.searchsorted(rows, np.arange(len(column) + 1)), lengths


def distinct_counts(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many different values each stretch holds."""
    out = np.zeros(len(bounds) - 1, np.int64)
    for k in np.flatnonzero(np.diff(bounds)):
        part = np.sort(values[bounds[k] : bounds[k + 1]])
        out[k] = 1 + np.count_nonzero(part[1:] != part[:-1])
    return out


def shingles_of(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``width`` words for each text, in order; a shorter text gives its whole sequence as one.

    Returns their hashes and for each text where its shingles start.
    """
    counts = np.diff(bounds)
    n = len(hashes)
    run = np.zeros(max(0, n - width + 1), U64)
    for k in range(width):
        run = run * MIX_B + hashes[k : k + len(run)] * GOLDEN
    run = mix(run + U64(width))
    many = np.maximum(counts - width + 1, (counts > 0).astype(counts.dtype))
    out = np.zeros(int(many.sum()), U64)
    to = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(counts)), many)
    source = bounds[owner] + (np.arange(len(out)) - to[owner])
    full = counts[owner] >= width
    out[full] = run[source[full]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = int(counts[i])
        for w in hashes[bounds[i] : bounds[i + 1]].tolist():
            h = h * int(MIX_B) + w * int(GOLDEN)
        out[to[i]] = mix(np.array([h % (1 << 64)], U64))[0]
    return out, to
