"""Shards of near equal bytes by sampled splitters, in DataFrame functions only.

Records are ordered by the digest of their text, so that equal texts stand together,
then by doc_id. Size-weighted samples of these keys give splitters at quantiles; the splitters
cut the order into ranges, which are counted exactly. Overfull ranges, those that hold more
than one of ``parts`` equal parts of all bytes or rows, are sampled again and subdivided.
A running sum within each range, added to the exact total of the ranges before it, is a
record's place among all bytes, and that gives its shard: eight equal stretches of bytes
for eight shards. So the sample decides only how the work is dealt, never the result.

A group of equal texts goes to one shard, where its middle byte lies. Only a group that
holds more than one part of the bytes or rows is cut, between records (there are at most
twice as many such groups as parts). Shards differ from equal sizes by at most one part,
1/128 of a shard, and the largest record, at each end.

The texts are read once; what is sampled, counted and sorted is a table of keys. Every
range is sorted on its own; the driver gets a few rows for each range and the samples, about
sixteen for each part.

Results for odd rows: a null text has the size and checksum of an empty one and is of its
group; a null doc_id sorts first; very long texts are records like all others (only their
sizes move); ties are broken by doc_id; rows that are repeated whole get slots of their own; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.common import stored_once, text_of

#: Parts a shard at least, and rows a part at most: what counts as overfull.
PARTS, PART_ROWS = 128, 1 << 20
#: Draws for each splitter, and splitters for each part.
DRAWS, SPLITTERS = 8, 2
#: Times that overfull ranges are sampled again, each time with twice the draws.
ROUNDS = 8

KEY = ("digest", "has_id", "id", "row")
KEY_SQL = "struct<digest: string, has_id: int, id: bigint, row: bigint>"


class Ranges(NamedTuple):
    """Splitters, how many bytes and rows lie before each range, the groups that are cut, and all bytes."""

    splitters: list[tuple]
    bytes_before: list[int]
    rows_before: list[int]
    cut: list[str]
    total: int


def key_columns() -> list[Column]:
    """doc_id, size, checksum and key of a record; ``row`` tells repeated rows apart once it is stored."""
    text = text_of()
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
        F.col("doc_id").isNotNull().cast("int").alias("has_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    ]


def literal(values: list, kind: str) -> Column:
    """A constant array of numbers or keys, folded once when the query is planned."""
    rows = [dict(zip(KEY, v, strict=True)) for v in values] if kind == KEY_SQL else values
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def range_of(splitters: list[tuple]) -> Column:
    """How many splitters are at or below a record's key: a binary search of as many steps as their number has bits."""
    if not splitters:
        return F.lit(0)
    sorted_keys, key = literal(splitters, KEY_SQL), F.struct(*KEY)
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]

    def narrowed(at: Column, step: Column) -> Column:
        return F.when(F.get(sorted_keys, at + step - 1) <= key, at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), narrowed)


def draw(records: DataFrame, expected: float, rows: int, total: int, seed: int) -> list[tuple]:
    """Keys drawn by size: ``expected`` draws if ``records`` were all, in order of their keys.

    A record's weight is its share of the bytes and of the rows, half each, so that
    neither bytes nor rows heap up between two draws; a record of great weight is drawn more than once.
    """
    weight = (F.col("size") / F.lit(total) + F.lit(1.0 / rows)) / 2
    chance = F.shiftrightunsigned(F.xxhash64("row", F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = records.select(*KEY, F.floor(weight * expected + chance).alias("draws")).where("draws > 0")
    found = sorted((tuple(r[k] for k in KEY), r["draws"]) for r in drawn.collect())  # about ``expected`` at most
    return [key for key, times in found for _ in range(min(times, DRAWS))]


def group_start(digest: str) -> tuple:
    """Before every key of the group."""
    return digest, -1, 0, 0


def sampled_ranges(records: DataFrame, shards: int) -> Ranges:
    """Ranges none of which is overfull, unless a single record or group that stays whole is."""
    rows, total = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not rows:
        return Ranges([], [0], [0], [], 0)
    parts = part_count(rows, shards)
    wanted = DRAWS * SPLITTERS * parts
    splitters = sorted({group_start(key[0]) for key in draw(records, wanted, rows, total, 0)[DRAWS::DRAWS]})
    cut: set[str] = set()
    for attempt in range(1, ROUNDS + 2):
        ranged = records.withColumn("range", range_of(splitters))
        counted = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
        held = {r["range"]: (r["bytes"], r["rows"]) for r in counted}  # a row for each range
        over = [k for k, (b, n) in held.items() if n > 1 and (b * parts > total or n * parts > rows)]
        if not over or attempt > ROUNDS:
            break
        full = ranged.where(F.array_contains(literal(sorted(over), "int"), F.col("range")))
        if attempt == 1:  # a group stands in one range still
            large = full.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
            large = large.where((F.col("bytes") * parts > total) | (F.col("rows") * parts > rows))
            cut = {r["digest"] for r in large.collect()}  # at most 2 * parts
        more = draw(full, wanted << attempt, rows, total, attempt)
        fresh = {key if key[0] in cut else group_start(key[0]) for key in more[DRAWS // 2 :: DRAWS]}
        grown = sorted({*splitters, *fresh, *map(group_start, cut)})
        if len(grown) == len(splitters):
            break
        splitters = grown
    sizes = [held.get(k, (0, 0)) for k in range(len(splitters) + 1)]
    before = [list(accumulate((s[i] for s in sizes), initial=0)) for i in (0, 1)]
    return Ranges(splitters, *before, sorted(cut), total)


def part_count(rows: int, shards: int) -> int:
    return max(PARTS * shards, -(-rows // PART_ROWS))


def placed(records: DataFrame, ranges: Ranges, shards: int) -> DataFrame:
    """Each record with its shard and its rank among all."""
    rows = records.withColumn("range", range_of(ranges.splitters))
    whole = Window.partitionBy("range")
    order = whole.orderBy(*KEY)
    group = Window.partitionBy("range", "digest")
    rows = rows.withColumns(
        {
            "before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
            "nth": F.row_number().over(order),
        }
    ).withColumns({"group_before": F.min("before").over(group), "group_size": F.sum("size").over(group)})
    own, of_group = 2 * F.col("before") + F.col("size"), 2 * F.col("group_before") + F.col("group_size")
    middle = F.when(F.col("digest").isin(ranges.cut), own).otherwise(of_group) if ranges.cut else of_group
    middle = 2 * F.get(literal(ranges.bytes_before, "bigint"), F.col("range")) + middle
    rows = rows.withColumn("middle", middle)
    shard = F.expr(f"least({shards - 1}, (middle * {shards}) div {2 * max(1, ranges.total)})").cast("int")
    rank = F.get(literal(ranges.rows_before, "bigint"), F.col("range")) + F.col("nth") - 1
    return rows.select("doc_id", "size", "text_crc32", *KEY, shard.alias("shard"), rank.alias("rank"))


def shard_records(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; slots count a shard's rows in key order."""
    out = _placed_once(stored_once(docs.sparkSession, docs.select(*key_columns()), "keys"), shards)
    firsts = out.groupBy("shard").agg(F.min("rank").alias("first")).collect()  # a row for each shard
    first = [next((r["first"] for r in firsts if r["shard"] == k), 0) for k in range(shards)]
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - F.get(literal(first, "bigint"), F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _placed_once(records: DataFrame, shards: int) -> DataFrame:
    return stored_once(records.sparkSession, placed(records, sampled_ranges(records, shards), shards), "placed")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> DataFrame:
    """Write every row whole under ``path``/shard=k and return what was written.

    The first key of each shard is a splitter of its own: rows find their shard by these
    few keys, without a join. If ``docs`` has a column ``shard``, the folders' column is ``shard_``.
    """
    spark, name = docs.sparkSession, "shard"
    while name in map(str.lower, docs.columns):
        name += "_"
    held = stored_once(spark, docs.select(F.struct("*").alias("record"), *key_columns()), "records")
    out = _placed_once(held.drop("record"), shards)
    firsts = out.groupBy("shard").agg(F.min(F.struct(*KEY)).alias("key")).orderBy("shard").collect()
    numbers = [r["shard"] for r in firsts]
    at = range_of([tuple(r["key"]) for r in firsts]) - 1
    rows = held.withColumn("to_shard", F.get(literal(numbers or [0], "int"), at))
    dealt = rows.repartitionByRange("to_shard", *KEY).select("record.*", F.col("to_shard").alias(name))
    dealt.write.partitionBy(name).parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


# ---- the same in the SQL of the comparison --------------------------------------------------------------------------

CRC_POLYNOMIAL = 0xEDB88320  # of the common 32-bit checksum, reflected


def _crc_table() -> list[int]:
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (CRC_POLYNOMIAL if c & 1 else 0) for c in table]
    return table


def shards_sql(shards: int = 8) -> str:
    """The result from one global order, without ranges."""
    octets = "list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::bigint)"
    step = f"lambda a, b: xor(a >> 8, {_crc_table()}[xor(a & 255, b) + 1])"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], {octets}), {step}))"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents),
k as (select doc_id, md5(t) as digest, octet_length(encode(t)) + 1 as size, {crc} as text_crc32 from d),
o as (select *, sum(size) over (order by digest, doc_id nulls first rows unbounded preceding) - size as before_it,
    row_number() over (order by digest, doc_id nulls first) as rank_, sum(size) over () as total, count(*) over () as n from k),
g as (select *, min(before_it) over (partition by digest) as group_before, sum(size) over (partition by digest) as group_size,
    count(*) over (partition by digest) as group_rows, greatest({PARTS * shards}, -(-n // {PART_ROWS})) as parts from o),
s as (select *, least({shards - 1}, (case when group_size * parts > total or group_rows * parts > n
    then 2 * before_it + size else 2 * group_before + group_size end * {shards}) // (2 * total)) as shard from g)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'bytes' as law, shard::int as shard,
    (row_number() over (partition by shard order by rank_) - 1)::bigint as slot, null::int as grown_shard from s"""
