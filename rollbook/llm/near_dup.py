"""Near-duplicate documents: many universal hash minima with banding.

Each text becomes the set of its distinct word shingles. Exact copies of a set are
one class from the start. Of each set the minima of ROWS * BANDS universal hash
functions are taken; classes that agree in all minima of a band meet in a bucket.
A pair of similarity 0.8 misses every band with a probability of 5e-6.

No bucket is expanded into its pairs, and texts move once:

1. Signatures make a graph of likely pairs. In each bucket all members are compared
   with one centre. In buckets that then still hold several components of that graph
   all members outside the largest are compared with all others, block by block, from
   which a spanning forest of the likely pairs comes out.
2. The edges so found are verified on the full sets; verified links give components.
3. A component of likely pairs that still holds several components of links has, for
   certain, all links that are left. All its documents outside its largest component
   are compared with all others on the full sets, block by block, from which again a
   spanning forest comes out.

Components come from alternating large-star and small-star throughout. Links are lost
only where two documents meet in no bucket or their signatures differ by far more
than chance.

Results for odd rows: a null or empty text, or one without words, has an empty set
and is linked with nothing; a text with fewer words than a shingle has its whole
sequence as one; rows that share a doc_id are one document (if their texts differ,
the one with the smallest set counts); rows without doc_id are kept, unlinked, with
a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import (
    GOLDEN,
    MIX_A,
    MIX_B,
    SPACED_WORDS,
    U64,
    in_batches,
    mix,
    shingles_of,
    stored_once,
    text_of,
    text_slices,
    words_of,
)
from rollbook.llm.components import components
from rollbook.operators.skew import checked_lookup

#: Minima in a band, and bands.
ROWS, BANDS = 6, 40
#: Similarity in hundredths that links two documents.
PERCENT = 80
#: How far below it an estimate from signatures may lie: over five standard deviations.
MARGIN = 0.15
#: Documents, and their shingles, of one side of a comparison in blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 18

_seeds = np.random.default_rng(20260102)
FACTORS = _seeds.integers(0, 1 << 63, ROWS * BANDS, dtype=U64) * U64(2) + U64(1)
SHIFTS = _seeds.integers(0, 1 << 63, ROWS * BANDS, dtype=U64)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, and where each text's begin (one more at the end)."""
    words, bounds, _ = words_of(column, SPACED_WORDS)
    runs, at = shingles_of(words, bounds, width)
    sets = [np.unique(runs[at[k] : at[k + 1]]) for k in range(len(column))]
    return np.concatenate(sets) if sets else runs, np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minima of each universal hash function over each non-empty stretch: one row a function."""
    out = np.empty((len(FACTORS), len(bounds) - 1), U64)
    at = 0
    while at < len(bounds) - 1:  # stretches whose values stay in the processor's cache
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 16384, "right")) - 1)
        part, starts = values[bounds[at] : bounds[end]], bounds[at:end] - bounds[at]
        for k, (factor, shift) in enumerate(zip(FACTORS, SHIFTS, strict=True)):
            out[k, at:end] = np.minimum.reduceat(part * factor + shift, starts)
        at = end
    return out


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, two sums that tell sets apart, the band keys and the signature of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in text_slices(texts):
                values, bounds = shingle_sets(texts.slice(a, b - a), width)
                sizes = np.diff(bounds)
                filled = np.flatnonzero(sizes)
                sums = np.zeros((2, b - a), U64)
                keys = np.zeros((b - a, BANDS), U64)
                signs = np.zeros((b - a, ROWS * BANDS), np.uint8)
                if len(filled):
                    starts = bounds[filled]
                    sums[0, filled] = np.add.reduceat(mix(values), starts)
                    sums[1, filled] = np.add.reduceat(mix(values ^ MIX_A), starts)
                    low = minima(values, np.append(starts, len(values)))
                    for band in range(BANDS):
                        key = np.full(len(filled), U64(band + 1))
                        for k in range(band * ROWS, (band + 1) * ROWS):
                            key = mix(key * MIX_B + low[k])
                        keys[filled, band] = key
                    signs[filled] = (mix(low) & U64(0xFF)).astype(np.uint8).T
                steps = np.arange(b - a + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.array(sizes),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.ListArray.from_arrays(steps * BANDS, keys.ravel().view(np.int64)),
                        pa.array([s.tobytes() for s in signs], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "sum1", "sum2", "bands", "signature"],
                )

    schema = "doc_id long, n_shingles long, sum1 long, sum2 long, bands array<long>, signature binary"
    return docs.transform(in_batches, run, schema)


#: Equal bytes of two signatures, as a share, below which a pair is not likely.
LEAST_ESTIMATE = PERCENT / 100 - MARGIN


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _likely(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures and sizes don't rule the similarity out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (_signs(batch.column(k)) for k in (2, 3))
            near = (left == right).mean(axis=1) >= LEAST_ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(near))

    one = signatures.select(F.col("doc_id").alias("a"), F.col("signature").alias("s"), F.col("n_shingles").alias("m"))
    two = signatures.select(F.col("doc_id").alias("b"), F.col("signature").alias("t"), F.col("n_shingles").alias("n"))
    fits = f"100 * least(m, n) >= {PERCENT} * greatest(m, n)"
    return pairs.join(one, "a").join(two, "b").filter(fits).select("a", "b", "s", "t").transform(in_batches, run, "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, one = None, None  # rows come by a: its set is made once
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            lefts = batch.column(0).to_pylist()
            for start, stop in text_slices(batch.column(3)):
                values, bounds = shingle_sets(batch.column(3).slice(start, stop - start), width)
                for k in range(start, stop):
                    if lefts[k] != known or one is None:
                        known, one = lefts[k], shingle_sets(batch.column(2).slice(k, 1), width)[0]
                    other = values[bounds[k - start] : bounds[k - start + 1]]
                    both = np.searchsorted(one, other)
                    same = int(np.count_nonzero(one[np.minimum(both, len(one) - 1)] == other)) if len(one) else 0
                    keep[k] = same > 0 and 100 * same >= PERCENT * (len(one) + len(other) - same)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    right = pairs.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("t")), "b")
    both = right.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("s")), "a")
    return both.select("a", "b", "s", "t").transform(in_batches, run, "a long, b long")


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (grp, doc, ...) with the columns of ``groups``, a stored table with one row a group.

    The groups are counted: few are broadcast, of many only the hot ones, so that rows
    of a large group stay where they are.
    """
    key = F.col("grp").cast("string")
    found = checked_lookup(rows.withColumn("grp", key), groups.withColumn("grp", key), "grp", F.col("doc"), groups.count())
    return found.withColumn("grp", F.col("grp").cast("long"))


def _open(groups: DataFrame, members: DataFrame) -> DataFrame:
    """grp, doc and component of the groups of three or more (grp, doc) that hold several components; a stored table."""
    spark = groups.sparkSession
    named = (
        groups.join(members.select(F.col("node").alias("doc"), "component"), "doc", "left")
        .withColumn("component", F.coalesce("component", "doc"))
        .select("grp", "doc", "component")
    )
    several = (
        named.groupBy("grp")
        .agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("n > 2 and low < high")
    )
    several = stored_once(spark, several.select("grp", F.lit(True).alias("several")), "several")
    return stored_once(spark, _with_groups(named, several).filter("several").drop("several"), "open")


def _blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grp, doc, component, ...) rows dealt to blocks: each document outside the largest component of its group
    meets all others of the group in one block i, j, in bounded blocks."""
    sized = rows.join(sizes, "doc")
    each = sized.groupBy("grp", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    largest = each.groupBy("grp").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.sum("m").alias("m")
    )
    most = each.groupBy("grp").agg(F.max(F.struct("n", "component", "m")).alias("x"))
    shape = largest.join(most, "grp").select(
        "grp",
        "largest",
        F.greatest(F.lit(1), parts_of("x.n", "x.m")).alias("main_parts"),
        F.greatest(F.lit(1), parts_of("n - x.n", "m - x.m")).alias("rest_parts"),
    )
    main = F.col("component") == F.col("largest")
    own = F.pmod(F.xxhash64("doc"), F.when(main, F.col("main_parts")).otherwise(F.col("rest_parts"))).cast("int")
    rest = F.sequence(F.lit(0), F.col("rest_parts") - 1)
    every = F.sequence(-F.col("main_parts"), F.col("rest_parts") - 1)  # main blocks have negative numbers
    return (
        _with_groups(sized, stored_once(rows.sparkSession, shape, "shape"))
        .withColumn("part", F.when(main, -own - 1).otherwise(own))
        .withColumn("other", F.explode(F.when(main, rest).otherwise(every)))
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .drop("largest", "main_parts", "rest_parts", "other")
    )


def parts_of(n: str, m: str) -> Column:
    """Blocks for n documents with m shingles in all."""
    return F.ceil(F.greatest(F.expr(n) / BLOCK_ROWS, F.expr(m) / BLOCK_SHINGLES)).cast("int")


def spanning(count: int, component: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[list, list]:
    """Of pairs of row numbers those that join what neither component nor an earlier pair has joined."""
    _, group = np.unique(component, return_inverse=True)
    parent = list(range(count + 1))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left, right = [], []
    for one, two in pairs:
        for a, b in zip(one.tolist(), two.tolist(), strict=True):
            x, y = root(int(group[a])), root(int(group[b]))
            if x != y:
                parent[x] = y
                left.append(a)
                right.append(b)
    return left, right


def _apart(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of a block's two sides, and the component of each row."""
    part = table.column("part").to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    return np.flatnonzero(part == i), np.flatnonzero(part == j), table.column("component").to_numpy()


def _likely_blocks(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """A spanning forest of the likely pairs from different components of a group."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        one, two, component = _apart(table)
        doc, size = table.column("doc").to_numpy(), table.column("n_shingles").to_numpy()
        signs = _signs(table.column("signature").combine_chunks())

        def pairs():
            for a in one.tolist():
                fits = (component[two] != component[a]) & (
                    100 * np.minimum(size[two], size[a]) >= PERCENT * np.maximum(size[two], size[a])
                )
                near = two[fits]
                near = near[(signs[near] == signs[a]).mean(axis=1) >= LEAST_ESTIMATE] if len(near) else near
                yield np.full(len(near), a), near

        left, right = spanning(len(doc), component, pairs())
        return pa.table({"a": pa.array(doc[left], pa.int64()), "b": pa.array(doc[right], pa.int64())})

    side = signatures.select(F.col("doc_id").alias("doc"), "signature", "n_shingles")
    return _blocks(rows, side).groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def shared_counts(values: np.ndarray, owner: np.ndarray, one: np.ndarray, two: np.ndarray, count: int) -> np.ndarray:
    """How many values each row of ``one`` has in common with each of ``two``; values are distinct within an owner."""
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    place = np.cumsum(new) - 1
    common = np.bincount(place) > 1 if len(place) else np.zeros(0, bool)
    kept = common[place]
    place, owner = (np.cumsum(common) - 1)[place[kept]], owner[kept]
    out = np.zeros((len(one), len(two)), np.float32)
    total = int(common.sum())
    for at in range(0, total, 4096):
        low, high = np.searchsorted(place, [at, at + 4096])
        held = np.zeros((count, min(4096, total - at)), np.float32)
        held[owner[low:high], place[low:high] - at] = 1
        out += held[one] @ held[two].T
    return np.rint(out).astype(np.int64)


def _linked_blocks(rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """A spanning forest of the links between different components of a group."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        one, two, component = _apart(table)
        doc = table.column("doc").to_numpy()
        column = table.column("text").combine_chunks()
        values, bounds = shingle_sets(column, width)
        size = np.diff(bounds)
        shared = shared_counts(values, np.repeat(np.arange(len(doc)), size), one, two, len(doc))
        linked = 100 * shared >= PERCENT * (size[one][:, None] + size[two][None, :] - shared)
        linked &= component[one][:, None] != component[two][None, :]
        a, b = np.nonzero(linked)
        left, right = spanning(len(doc), component, [(one[a], two[b])])
        return pa.table({"a": pa.array(doc[left], pa.int64()), "b": pa.array(doc[right], pa.int64())})

    return _blocks(rows, texts).groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _widened(likely: DataFrame, buckets: DataFrame, signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Likely pairs with those of blocks added, and the components they make."""
    spark = likely.sparkSession
    families = stored_once(spark, components(likely), "families")
    rows = _open(buckets, families)
    last = stored_once(spark, _likely_blocks(rows, signatures), "likely")
    if not last.isEmpty():
        likely = likely.union(last)
        families = stored_once(spark, components(likely), "families")
    return likely, families


def near_duplicates(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, one row a document."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    marks = stored_once(spark, fingerprints(docs, width), "fingerprints")
    named = marks.filter("doc_id is not null")
    if not named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        least = F.min_by(F.struct("n_shingles", "sum1", "sum2", "bands", "signature"), F.struct("n_shingles", "sum1", "sum2"))
        named = stored_once(spark, named.groupBy("doc_id").agg(least.alias("x")).select("doc_id", "x.*"), "fingerprints")
        one_text = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_set("text").alias("texts"))
        docs = _same_text(one_text, named, width)
    sets = named.filter("n_shingles > 0")
    classes = stored_once(
        spark, sets.groupBy("n_shingles", "sum1", "sum2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes"
    )
    firsts = sets.join(classes.select(F.col("first").alias("doc_id")), "doc_id")
    signatures = stored_once(spark, firsts.select("doc_id", "n_shingles", "bands", "signature"), "signatures")
    every = signatures.select(F.explode("bands").alias("band"), F.col("doc_id").alias("doc"))
    centres = every.groupBy("band").agg(F.min("doc").alias("centre"), F.count("*").alias("n")).filter("n > 1")
    buckets = stored_once(spark, every.join(centres, "band").select(F.col("band").alias("grp"), "doc", "centre"), "buckets")
    signatures = signatures.drop("bands")

    pairs = buckets.filter("doc != centre").select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct()
    buckets = buckets.select("grp", "doc")
    likely = stored_once(spark, _likely(pairs, signatures), "likely")
    likely, families = _widened(likely, buckets, signatures)
    wanted = families.select(F.col("node").alias("doc"))
    texts = docs.select(F.col("doc_id").alias("doc"), "text").join(wanted, "doc", "left_semi")
    texts = texts.join(signatures.select(F.col("doc_id").alias("doc"), "n_shingles"), "doc")
    texts = stored_once(spark, texts, "texts")
    links = stored_once(spark, _linked(likely, texts.select("doc", "text"), width), "links")
    members = stored_once(spark, components(links), "members")
    rows = _open(families.select(F.col("component").alias("grp"), F.col("node").alias("doc")), members)
    last = stored_once(spark, _linked_blocks(rows, texts, width), "links")
    if not last.isEmpty():
        members = stored_once(spark, components(links.union(last)), "members")

    of_class = classes.join(members.withColumnRenamed("node", "first"), "first", "left").select(
        "n_shingles", "sum1", "sum2", F.coalesce("component", "first").alias("component_id")
    )
    found = (
        sets.select("doc_id", "n_shingles", "sum1", "sum2")
        .join(of_class, ["n_shingles", "sum1", "sum2"])
        .select("doc_id", "n_shingles", "component_id")
    )
    empty = named.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    nameless = marks.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.union(empty).union(nameless).withColumn("kept", kept)


def _same_text(texts: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """Of documents with several texts, the one whose set was taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0), []
            for k, (size, sum1) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = batch.column(1).slice(k, 1).flatten()
                values, bounds = shingle_sets(own, width)
                for j, text in enumerate(own.to_pylist()):
                    part = values[bounds[j] : bounds[j + 1]]
                    total = int(np.add.reduce(mix(part)).view(np.int64)) if len(part) else 0
                    if len(part) == size and total == sum1:
                        break
                out.append(text)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], names=["doc_id", "text"])

    return texts.join(named.select("doc_id", "n_shingles", "sum1"), "doc_id").transform(in_batches, run, "doc_id long, text string")


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs``, with all columns, without those that another document of their component stands for."""
    found = near_duplicates(docs, width)
    dropped = found.filter("not kept").select(F.col("doc_id").alias("dropped_doc_id"))
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["dropped_doc_id"], "left_anti")
