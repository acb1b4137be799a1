"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted to a bounded sample of unit vectors; its leaves hold all vectors. A
query walks it with a priority queue: the node whose centre is nearest comes next, so
leaves come out best first. How many leaves are visited is calibrated: for a bounded
set of calibration queries the true neighbours are found in all rows by brute force, and
visits are widened until the share of true neighbours in the visited leaves reaches the
wanted recall. A query whose visited leaves hold too few vectors goes on to further ones.

Equal vectors are one entry with the few smallest of their ids that can matter, so copies
neither fill a leaf nor repeat a search. Entries of a leaf and queries that visit it meet
in blocks of bounded size; each block gives the best few entries of each query. The sampled
vectors give every query a floor, the score of its best few among them: a block returns nothing
below it, and those sampled vectors themselves count as found.

Results for odd rows: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without vec_id or with another number of components
than the smallest vec_id's; of rows that share a vec_id the smallest vector counts;
ties go to the smaller vec_id; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.common import in_batches, stored_once

#: Vectors that the tree is fitted to, and calibration queries: the bounds of both.
SAMPLE, CALIBRATION = 20_000, 256
#: Vectors a leaf is meant for, children of a node, and the least sampled vectors of a leaf.
LEAF, BRANCHES, LEAST = 192, 8, 8
#: Recall that calibration asks for.
RECALL = 0.97
#: Entries and queries of a leaf that one task compares.
BLOCK_ENTRIES, BLOCK_QUERIES = 2048, 2048


@dataclass
class Tree:
    """Nodes with a centre each; children of a node, or the number of its leaf."""

    centres: np.ndarray
    children: list
    leaf: list
    leaves: int

    def leaf_of(self, units: np.ndarray) -> np.ndarray:
        """The leaf that each unit vector belongs to, by the nearest child at each level."""
        out = np.empty(len(units), np.int64)
        waiting = [(0, np.arange(len(units)))]
        while waiting:
            node, rows = waiting.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = np.array(self.children[node])
            near = _nearest(units[rows], self.centres[kids])
            waiting += [(int(kid), rows[near == k]) for k, kid in enumerate(kids)]
        return out

    def best_first(self, unit: np.ndarray) -> Iterator[int]:
        """Leaves in the order in which a priority queue over the nodes' distances reaches them."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            kids = self.children[node]
            for kid, far in zip(kids, np.square(self.centres[kids] - unit).sum(axis=1).tolist(), strict=True):
                heapq.heappush(queue, (far, kid))


def _nearest(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin(np.square(centres).sum(axis=1) - 2 * (units @ centres.T), axis=1)


def _kmeans(units: np.ndarray, k: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = units[random.choice(len(units), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(units, centres)
        for c in range(k):
            if (mine := own == c).any():
                centres[c] = units[mine].mean(axis=0)
    return centres


def fit_tree(units: np.ndarray, leaves: int, seed: int = 20260104) -> Tree:
    """A tree of about ``leaves`` leaves: the fullest leaf is split by k-means until there are enough."""
    random = np.random.default_rng(seed)
    centres = [units.mean(axis=0) if len(units) else np.zeros(0)]
    children: list[list[int]] = [[]]
    full = [(-len(units), 0, np.arange(len(units)))]
    count = 1
    while full and count < leaves:
        size, node, rows = heapq.heappop(full)
        k = min(BRANCHES, leaves - count + 1, -size // LEAST)
        if k < 2:
            continue
        found = _kmeans(units[rows], k, random)
        own = _nearest(units[rows], found)
        groups = [rows[own == c] for c in range(k)]
        if max(len(g) for g in groups) == len(rows):
            continue  # nothing to tell apart
        for c, group in zip(found, groups, strict=True):
            if len(group):
                children[node].append(len(centres))
                heapq.heappush(full, (-len(group), len(centres), group))
                centres.append(c)
                children.append([])
        count += len(children[node]) - 1
    leaf, number = [], 0
    for kids in children:
        leaf.append(-1 if kids else number)
        number += not kids
    return Tree(np.array(centres), children, leaf, number)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as doubles."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def units_of(rows: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True) if rows.size else rows
    return rows / np.sqrt(np.square(rows).sum(axis=1, keepdims=True)) if rows.size else rows


def _cosines(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Cosines of a vector and each row, each from the two vectors alone, so equal pairs give equal values."""
    one = one / np.abs(one).max()
    many = many / np.abs(many).max(axis=1, keepdims=True)
    return (many * one).sum(axis=1) / (np.sqrt((one * one).sum()) * np.sqrt((many * many).sum(axis=1)))


def entries_of(vectors: DataFrame, k: int) -> DataFrame:
    """entry (its smallest id), ids (the k + 1 smallest that share the vector) and vec of each different vector."""
    sound = "size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    rows = (
        vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
        .filter(f"vec_id is not null and embedding is not null and {sound}")
        .filter("exists(embedding, x -> x != 0)")
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("vec"))
    )
    first = Window.partitionBy("vec").orderBy("vec_id")
    return (
        rows.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= k + 1)
        .groupBy("vec")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
        .select(F.get("ids", F.lit(0)).alias("entry"), "ids", "vec")
    )


def _top_of_block(k: int):
    """For each query of a block its best ``k`` + 1 ids among the block's entries, those below the query's floor left out."""

    def compare(queries: pa.Table, entries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(queries) and len(entries):
            ids = entries.column("ids").to_pylist()
            rows = _matrix(entries.column("vec").combine_chunks())
            asked = _matrix(queries.column("vec").combine_chunks())
            near = units_of(asked) @ units_of(rows).T
            few = min(k + 1, len(ids))
            floors = queries.column("floor").to_pylist()
            for q, query in enumerate(queries.column("query").to_pylist()):
                least = max(np.partition(near[q], -few)[-few], floors[q]) - 1e-9  # what rounding could have put below
                best = np.flatnonzero(near[q] >= least)
                if not len(best):
                    continue
                scored = zip(_cosines(asked[q], rows[best]).tolist(), best.tolist(), strict=True)
                pairs = ((-s, i, query) for s, e in scored for i in ids[e])
                out += [(q_, i, -s) for s, i, q_ in heapq.nsmallest(k + 1, pairs)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table(
            {
                "query": pa.array(columns[0], pa.int64()),
                "vec_id": pa.array(columns[1], pa.int64()),
                "score": pa.array(columns[2], pa.float64()),
            }
        )

    return compare


FOUND = "query long, vec_id long, score double"


def _best(found: DataFrame, k: int, query: str = "query") -> DataFrame:
    order = Window.partitionBy(query).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _floors(units: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` + 1st best score of each query among the sampled vectors: nothing below it is among its best."""
    if len(sample) <= k:
        return np.full(len(units), -np.inf)
    parts = [units[at : at + 256] @ sample.T for at in range(0, len(units), 256)]
    return np.concatenate([np.partition(p, -(k + 1), axis=1)[:, -(k + 1)] for p in parts]) if parts else np.zeros(0)


def fit(entries: DataFrame, total: int, k: int, sample: int = SAMPLE, calibration: int = CALIBRATION, recall: float = RECALL):
    """The tree, how many leaves a query has to visit to reach ``recall``, and the sampled entries.

    The calibration queries are not among the vectors that the tree is fitted to (unless there is one vector only). The calibration queries are compared with all entries where these are read; each
    task returns the best few of each query.
    """
    spark = entries.sparkSession
    rows = entries.select("entry", "ids", "vec").orderBy(F.xxhash64("entry"), "entry").limit(sample + calibration).collect()
    data = np.array([r["vec"] for r in rows])
    cut = max(1, min(calibration, len(rows) // 4))
    tree = fit_tree(units_of(data[cut:] if len(data) > 1 else data), max(1, min(total // LEAF, sample // LEAST)))
    asked = list(zip([r["entry"] for r in rows[:cut]], data[:cut], strict=True))
    queries = spark.sparkContext.broadcast(asked)  # at most ``calibration`` vectors

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([q for q, _ in queries.value])
        want = units_of(np.array([v for _, v in queries.value]))
        best: list[list] = [[] for _ in ids]
        for batch in batches:
            own, units = batch.column(0).to_numpy(), units_of(_matrix(batch.column(1)))
            near = want @ units.T
            for q in range(len(ids)):
                few = np.argpartition(-near[q], min(k, len(own) - 1))[: k + 1]
                best[q] = heapq.nlargest(k + 1, best[q] + [(float(near[q, e]), int(own[e])) for e in few])
        out = [(int(ids[q]), e, s) for q in range(len(ids)) for s, e in best[q]]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            names=["query", "vec_id", "score"],
        )

    true = _best(entries.select("entry", "vec").transform(in_batches, nearest, FOUND).filter("query != vec_id"), k)
    found = true.join(entries.select(F.col("entry").alias("vec_id"), "vec"), "vec_id").select("query", "vec").collect()
    homes = tree.leaf_of(units_of(np.array([r["vec"] for r in found]))) if found else []
    order = {q: {leaf: n for n, leaf in enumerate(tree.best_first(units_of(v[None])[0]))} for q, v in asked}
    needed = sorted(order[r["query"]][int(leaf)] + 1 for r, leaf in zip(found, homes, strict=True))
    visits = needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] if needed else 1
    return tree, visits, pa.table({"ids": pa.array([r["ids"] for r in rows], pa.list_(pa.int64())), "vec": pa.array(list(data), pa.list_(pa.float64()))})


def search(vectors: DataFrame, is_query: Column, k: int = 5, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each row that is a query."""
    spark = vectors.sparkSession
    entries = stored_once(spark, entries_of(vectors, k), "entries")
    size = entries.agg(F.count("*").alias("n"), F.min(F.struct("entry", F.size("vec").alias("d"))).alias("x")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries = entries.filter(F.size("vec") == size["x"]["d"])
    tree, visits, sampled = fit(entries, size["n"], k, sample, recall=recall)
    shipped = spark.sparkContext.broadcast((tree.centres, tree.children, tree.leaf, tree.leaves))
    known = spark.sparkContext.broadcast(sampled)  # at most SAMPLE + CALIBRATION vectors

    def with_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree(*shipped.value)
        for batch in batches:
            leaf = pa.array(own.leaf_of(units_of(_matrix(batch.column(2)))) if batch.num_rows else [], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, leaf], names=["entry", "ids", "vec", "leaf"])

    indexed = entries.transform(in_batches, with_leaf, "entry long, ids array<long>, vec array<double>, leaf long")
    indexed = stored_once(spark, indexed, "leaves")
    held = [0] * tree.leaves
    for r in indexed.groupBy("leaf").agg(F.count("*").alias("n")).collect():  # a row a leaf
        held[r["leaf"]] = r["n"]

    # every query row with the entry of its vector; an entry is searched once
    asked = (
        vectors.filter(is_query)
        .select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vec"))
        .groupBy("query_id")
        .agg(F.min("vec").alias("vec"))
        .join(entries.select("entry", "vec"), "vec")
        .select("query_id", F.col("entry").alias("query"))
    )
    asked = stored_once(spark, asked, "asked")
    searched = asked.select("query").distinct().join(entries.select(F.col("entry").alias("query"), "vec"), "query")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, near = Tree(*shipped.value), units_of(_matrix(known.value.column("vec").combine_chunks()))
        for batch in batches:
            rows, leaves = [], []
            units = units_of(_matrix(batch.column(1)))
            batch = batch.append_column("floor", pa.array(_floors(units, near, k), pa.float64()))
            for row, unit in enumerate(units):
                seen = 0
                for n, leaf in enumerate(own.best_first(unit)):
                    if n >= visits and seen > k:
                        break
                    seen += held[leaf]
                    if held[leaf]:
                        rows.append(row)
                        leaves.append(leaf)
            for at in range(0, len(rows), 4096):
                part = batch.take(pa.array(rows[at : at + 4096], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(leaves[at : at + 4096], pa.int64())], names=["query", "vec", "floor", "leaf"]
                )

    def among_sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = _top_of_block(k)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = pa.Table.from_batches([batch.slice(at, 256)])
                part = part.append_column("floor", pa.array([-np.inf] * len(part), pa.float64()))
                yield from compare(part, known.value).to_batches()

    visited = searched.select("query", "vec").transform(in_batches, visit, "query long, vec array<double>, floor double, leaf long")
    visited = stored_once(spark, visited, "visits")
    # how many blocks a leaf's entries and its queries are dealt to: a row a leaf
    asking = visited.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("sides"))
    filled = indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK_ENTRIES).cast("int").alias("parts"))
    shape = asking.join(filled, "leaf")
    one = (
        visited.join(shape, "leaf")
        .withColumn("side", F.pmod(F.xxhash64("query"), F.col("sides")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("leaf", "side", "part", "query", "vec", "floor")
    )
    two = (
        indexed.join(shape, "leaf")
        .withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int"))
        .withColumn("side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        .select("leaf", "side", "part", "ids", "vec")
    )
    keys = ("leaf", "side", "part")
    found = one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(_top_of_block(k), FOUND)
    # the sampled entries that gave a query its floor are found for certain, whatever leaves it visits
    found = found.unionByName(searched.select("query", "vec").transform(in_batches, among_sampled, FOUND))
    found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    best = _best(found, k + 1).drop("rank")
    return (
        _best(asked.join(best, "query").filter("vec_id != query_id"), k, "query_id")
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )

