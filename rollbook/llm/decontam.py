"""Decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact verification.

A window is a stretch of a document with as many words as an item has (a shorter
document is one window as a whole). A window contaminates a document if the weighted
Jaccard similarity of its shingles to the item's (weights: how often each occurs) is at
least 0.8. Shingles have five words; for an item of fewer words, as many as it has. The
way there:

1. Each window gets a 128-bit SimHash, rolled on from the one before. Windows with too
   few shingles that any item holds cannot reach the threshold and are passed over
   (``skip=False`` takes them too, with the same result).
2. Fingerprints of items of that size are indexed by sixteen blocks of eight bits. Two
   fingerprints within RADIUS differ by at most RADIUS / 16 bits in one of the blocks, so
   looking up the neighbourhood of each of a window's blocks finds every item within the
   radius. Where the threshold allows no difference, the radius is 0.
3. Fingerprints within the radius are candidates; the exact weighted similarity decides.

The benchmark is the stated query set: it goes to the executors in blocks of bounded
size, one scan of the documents for each block, whatever its size; a worker holds the
index of one block. Memory is linear in the longest text and the block of items.

Results for odd rows: null or empty texts and items match nothing; very long texts and
items are compared whole; an item longer than a document can still be near it, down to
0.8; of windows that are equally near the first is named; repeated items with the same
text give one row an item; rows that share a doc_id give a row for each pair of id and
item with the best of them; rows without doc_id or item_id are compared too and keep the
null; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import PLAIN_WORDS, U64, in_batches, mix, per_process, shingles_of, text_of, text_slices, words_of

WIDTH, PERCENT = 5, 80
BITS, BLOCK_BITS, RADIUS = 128, 8, 40
BLOCKS, VALUES = BITS // BLOCK_BITS, 1 << BLOCK_BITS
#: Bytes of item texts that are shipped and compared at once.
ITEM_BYTES = 4 << 20
#: Shingles whose votes are held at once, and windows times items that are looked up at once.
CHUNK, PAIRS = 4096, 1 << 20

ONES = np.array([bin(v).count("1") for v in range(VALUES)], np.uint8)


@dataclass
class Sized:
    """Items with equally many shingles, by the blocks of their fingerprints."""

    size: int
    ids: list[list]  # for each text the items that have it
    bags: list  # for each text its distinct shingles and how often each occurs
    prints: np.ndarray  # fingerprints in bytes
    order: np.ndarray  # block after block, its texts by the block's value
    ends: np.ndarray  # for each block and value where its texts begin in order, one more after each block


@dataclass
class Items:
    """Index of the items of a block whose shingles have ``width`` words."""

    width: int
    keys: np.ndarray  # distinct shingles, ascending
    seen: np.ndarray  # low bits of the keys
    sized: list[Sized]  # by size


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 and -1 for each bit of each shingle's hash."""
    words = np.column_stack([mix(shingles + U64(k + 1)) for k in range(BITS // 64)])
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def total_votes(run: np.ndarray) -> np.ndarray:
    """Votes of a whole stretch of shingles."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(run), CHUNK):
        votes += signs(run[at : at + CHUNK]).sum(axis=0, dtype=np.int64)
    return votes


def least_shared(size: int, span: int) -> int:
    """Shared weight that the threshold asks for."""
    return -(-PERCENT * (size + span) // (100 + PERCENT))


def _sized(size: int, ids: list[list], runs: list[np.ndarray]) -> Sized:
    prints = np.array([np.packbits(total_votes(run) > 0) for run in runs], np.uint8).reshape(len(runs), BLOCKS)
    order = np.argsort(prints, axis=0, kind="stable").T
    ends = [np.searchsorted(prints[order[b], b], np.arange(VALUES + 1)) + b * len(runs) for b in range(BLOCKS)]
    return Sized(size, ids, [np.unique(run, return_counts=True) for run in runs], prints, order.ravel(), np.concatenate(ends))


def index_items(ids: list, texts: pa.Array) -> list[Items]:
    """For each width of shingles the index of the items that have it; items without words are in none."""
    owners: dict[str, list] = {}
    for item, text in zip(ids, texts.to_pylist(), strict=True):
        owners.setdefault(text, []).append(item)
    words, bounds, _ = words_of(pa.array(list(owners), pa.large_string()), PLAIN_WORDS)
    counts, held = np.diff(bounds), list(owners.values())
    out = []
    for width in range(1, WIDTH + 1):
        chosen = np.flatnonzero(counts >= WIDTH if width == WIDTH else counts == width).tolist()
        if not chosen:
            continue
        runs, at = shingles_of(words, bounds, width)
        by_size: dict[int, list[int]] = {}
        for k in chosen:
            by_size.setdefault(int(at[k + 1] - at[k]), []).append(k)
        sized = [_sized(s, [held[k] for k in own], [runs[at[k] : at[k + 1]] for k in own]) for s, own in sorted(by_size.items())]
        keys = np.unique(np.concatenate([values for group in sized for values, _ in group.bags]))
        seen = np.zeros(1 << 20, bool)
        seen[(keys & U64((1 << 20) - 1)).astype(np.int64)] = True
        out.append(Items(width, keys, seen, sized))
    return out


def stretches(hits: np.ndarray, least: int, span: int, last: int) -> list[tuple[int, int]]:
    """First and last start, up to ``last``, of windows of ``span`` places that hold ``least`` of the places ``hits``."""
    if len(hits) < least:
        return []
    low = np.maximum(hits[least - 1 :] - span + 1, 0)
    high = np.minimum(hits[: len(hits) - least + 1], last)
    some = np.flatnonzero(low <= high)
    low, high = low[some], high[some]  # both ascend, so neighbours meet or stand apart
    if not len(low):
        return []
    cut = np.flatnonzero(low[1:] > high[:-1] + 1) + 1
    return list(zip(low[np.append(0, cut)].tolist(), high[np.append(cut - 1, len(high) - 1)].tolist(), strict=True))


def fingerprints(run: np.ndarray, first: int, last: int, span: int) -> Iterator[tuple[int, np.ndarray]]:
    """Starts and SimHashes of the windows from ``first`` to ``last``, a chunk at a time, each rolled on from the one before."""
    votes = total_votes(run[first : first + span])
    for start in range(first, last + 1, CHUNK):
        end = min(last + 1, start + CHUNK)
        moves = signs(run[start + span : end + span]).astype(np.int64)
        steps = np.zeros((end - start + 1, BITS), np.int64)
        steps[1 : len(moves) + 1] = moves
        steps[1:] -= signs(run[start:end])
        steps[0] = votes
        steps = np.cumsum(steps, axis=0)
        votes = steps[-1]
        yield start, np.packbits(steps[:-1] > 0, axis=1)


def lookup(group: Sized, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (window, text) of fingerprints within the radius."""
    masks = np.flatnonzero(ONES <= radius // BLOCKS).astype(np.uint8)
    step = max(1, min(CHUNK // BLOCKS, PAIRS // len(group.bags)))
    rows = np.arange(BLOCKS)[:, None, None] * (VALUES + 1)
    found = []
    for at in range(0, len(prints), step):
        own = prints[at : at + step]
        cells = ((own.T[:, :, None] ^ masks) + rows).ravel()  # by block, window and mask
        begin = group.ends[cells]
        many = group.ends[cells + 1] - begin
        some = np.flatnonzero(many)
        begin, many = begin[some], many[some]
        place = np.arange(many.sum()) + np.repeat(begin - np.cumsum(many) + many, many)
        near = np.zeros((len(own), len(group.bags)), bool)
        near[np.repeat(some // len(masks) % len(own), many), group.order[place]] = True
        window, text = np.nonzero(near)
        close = ONES[own[window] ^ group.prints[text]].sum(axis=1, dtype=np.int64) <= radius
        found.append((window[close] + at, text[close]))
    return np.concatenate([w for w, _ in found]), np.concatenate([t for _, t in found])


def shared_weights(run: np.ndarray, first: int, last: int, span: int, bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weight that each window from ``first`` to ``last`` shares with a bag of shingles.

    An occurrence counts in the windows that hold it but not as many earlier ones as
    the bag has: a range of starts, so one running sum gives all windows.
    """
    values, counts = bag
    part = run[first : last + span]
    place = np.minimum(np.searchsorted(values, part), len(values) - 1)
    at = np.flatnonzero(values[place] == part)
    at = at[np.argsort(place[at], kind="stable")]
    owner = place[at]
    before = np.arange(len(at)) - counts[owner]
    known = before >= np.searchsorted(owner, owner)
    low = np.where(known, at[np.maximum(before, 0)] + 1, 0)
    low = np.maximum(low, at - span + 1)
    high = np.minimum(at, last - first)
    some = low <= high
    many = last - first + 2
    return np.cumsum(np.bincount(low[some], minlength=many) - np.bincount(high[some] + 1, minlength=many))[:-1]


def _near(group: Sized, run: np.ndarray, hits: np.ndarray | None) -> Iterator[tuple[int, int, int, float]]:
    """(text, start of the best window, windows near, similarity) of a document; all windows where ``hits`` is None."""
    span, size = min(group.size, len(run)), group.size
    least = least_shared(size, span)
    if least > span:
        return
    radius = 0 if least == size else RADIUS
    best: dict[int, tuple[int, int, int]] = {}
    for first, last in [(0, len(run) - span)] if hits is None else stretches(hits, least, span, len(run) - span):
        chosen: dict[int, list[np.ndarray]] = {}
        for start, prints in fingerprints(run, first, last, span):
            window, text = lookup(group, prints, radius)
            order = np.argsort(text, kind="stable")
            window, text = window[order] + start, text[order]
            for own in np.split(np.arange(len(text)), np.flatnonzero(np.diff(text)) + 1):
                if len(own):
                    chosen.setdefault(int(text[own[0]]), []).append(window[own])
        for text, parts in chosen.items():
            starts = np.concatenate(parts)
            shared = shared_weights(run, int(starts[0]), int(starts[-1]), span, group.bags[text])[starts - starts[0]]
            good = np.flatnonzero(shared >= least)
            if len(good):
                top = good[np.argmax(shared[good])]
                same, place, windows = best.get(text, (-1, -1, 0))
                if shared[top] > same:
                    same, place = int(shared[top]), int(starts[top])
                best[text] = same, place, windows + len(good)
    for text, (same, place, windows) in best.items():
        yield text, place, windows, same / (size + span - same)


def matches(index: list[Items], texts: pa.Array, skip: bool = True) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, item, word where the best window starts, windows near the item, similarity) of a column without nulls."""
    if not index:
        return
    for a, b in text_slices(texts):
        words, bounds, _ = words_of(texts.slice(a, b - a), PLAIN_WORDS)
        for items in index:
            runs, at = shingles_of(words, bounds, items.width)
            held = np.flatnonzero(items.seen[(runs & U64((1 << 20) - 1)).astype(np.int64)])
            held = held[items.keys[np.minimum(np.searchsorted(items.keys, runs[held]), len(items.keys) - 1)] == runs[held]]
            edges = np.searchsorted(held, at)
            for row in np.flatnonzero(np.diff(edges) if skip else np.diff(at)).tolist():
                run, hits = runs[at[row] : at[row + 1]], held[edges[row] : edges[row + 1]] - at[row]
                for group in items.sized:
                    if least_shared(group.size, min(group.size, len(run))) > (len(hits) if skip else len(run)):
                        break  # sizes ascend, and so does what they ask for
                    for text, start, windows, similarity in _near(group, run, hits if skip else None):
                        for item in group.ids[text]:
                            yield a + row, item, start, windows, similarity


def item_blocks(benchmark: DataFrame, limit: int = ITEM_BYTES) -> Iterator[tuple[str, list, list]]:
    """A name, the ids and the texts of the items, ``limit`` bytes of text at a time; the driver holds one block."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), text_of().alias("text")).distinct()
    for row in rows.toLocalIterator():
        if held and held + len(row["text"]) > limit:
            yield f"items-{uuid.uuid4().hex}", ids, texts
            ids, texts, held = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"])
    if ids:
        yield f"items-{uuid.uuid4().hex}", ids, texts


def _index(block: tuple[str, list, list]) -> list[Items]:
    """The index of a block of items, made once in each worker; it takes the place of the one before."""
    name, ids, texts = block
    kept = per_process("decontam-items", dict)
    if name not in kept:
        kept.clear()
        kept[name] = index_items(ids, pa.array(texts, pa.large_string()))
    return kept[name]


HITS = "doc_id long, item_id long, start_word long, n_windows long, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame, limit: int = ITEM_BYTES, skip: bool = True) -> DataFrame:
    """One row for each document and item near it: best window, windows near the item, similarity of the best."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = None
    for block in item_blocks(benchmark, limit):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, index = batch.column(0).to_pylist(), _index(shipped.value)
                rows = [(ids[r], *hit) for r, *hit in matches(index, batch.column(1), skip)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "item_id", "start_word", "n_windows", "similarity"],
                )

        hits = docs.transform(in_batches, run, HITS)
        found = hits if found is None else found.union(hits)
    if found is None:
        return spark.createDataFrame([], HITS)
    best = F.max_by(F.struct("start_word", "n_windows", "similarity"), F.struct("similarity", -F.col("start_word"), "n_windows"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, limit: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no window near an item. No shuffle."""
    spark = docs.sparkSession
    place, schema = docs.columns.index("text"), docs.schema
    for block in item_blocks(benchmark, limit):
        shipped = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in matches(_index(shipped.value), batch.column(place).fill_null("")):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.transform(in_batches, run, schema)
    return docs
