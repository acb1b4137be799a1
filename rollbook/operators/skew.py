"""Hot keys, chunked running aggregates and lookups that stay balanced under skew.

A key counts as hot when it holds more than 1/65536 of the rows, so there are
fewer than 65536 hot keys whatever the data: that is the size bound behind
every broadcast in this module.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.operators import position
from rollbook.session import materialized

MAX_HOT = 65536
MAX_CHUNKS = 4096
CHUNK_ROWS = 1 << 20
SPREAD = 1024


def hot_keys(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """Keys with more than ``min_rows`` rows and more than 1/65536 of all rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("hot_rows"))
    total = counts.agg(F.sum("hot_rows")).scalar()
    return counts.where((F.col("hot_rows") > min_rows) & (F.col("hot_rows") * MAX_HOT > total))


def counted_hot(df: DataFrame, key: str, min_rows: int) -> DataFrame | None:
    """``hot_keys``, counted now in one pass: ``None`` if there are none, else a table of fewer than 65536 rows."""
    large = df.groupBy(key).agg(F.count(F.lit(1)).alias("hot_rows")).where(F.col("hot_rows") > min_rows)
    found = large.orderBy(F.desc("hot_rows")).limit(MAX_HOT).collect()
    if not found:
        return None
    total = df.count()
    rows = [(r[key],) for r in found if r["hot_rows"] * MAX_HOT > total]
    return df.sparkSession.createDataFrame(rows, df.select(key).schema) if rows else None


def split_hot(
    df: DataFrame, key: str, order: str, width: int = CHUNK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """``split_counted`` with a table on both sides."""
    cold, hot = split_counted(df, key, order, width)
    return cold, df.sparkSession.createDataFrame([], cold.schema) if hot is None else hot


def split_counted(
    df: DataFrame, key: str, order: str, width: int = CHUNK_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys (``chunk`` 0) and of hot keys (chunks from 1 on, which follow ``order``).

    Keys are counted at once. Without hot keys the second side is an empty table (``None`` from
    ``split_counted``) and the plan has one scan of ``df``; with some, the rows are written once, marked,
    and both sides read that.

    ``order`` is unique per row. Its values are cut into cells of ``width`` / 2 numbers (of a
    position in the stream of blocks: output indexes within a transaction), and cells of a key go to one chunk while their rows, counted, are at most ``width``: a hot key
    of n rows has at most 1 + 2 n / width chunks, however sparse its values are. Cells are
    counted up in two levels.
    """
    hot = counted_hot(df, key, width)
    zero = F.lit(0).cast("long")
    if hot is None:
        return df.withColumn("chunk", zero), None
    listed = F.broadcast(hot.withColumn("is_hot", F.lit(True)))
    marked = materialized(df.join(listed, key, "left").select(*df.columns, F.coalesce("is_hot", F.lit(False)).alias("is_hot")), "marked")
    cold_rows = marked.where(~F.col("is_hot")).drop("is_hot").withColumn("chunk", zero)
    half = max(1, width // 2)
    at = F.col(order)
    if dict(df.dtypes)[order] == "string":
        part, number, span = position.part_of(at), position.index_of(at), position.number_of(position.block_of(at))
    else:
        part, number, span = F.lit(""), at, at / half
    cell = F.struct(part.alias("part"), F.floor(number / half).alias("place"))
    hot_rows = marked.where("is_hot").withColumns({"cell": cell, "span": F.floor(span / max(2, width))})
    cells = hot_rows.groupBy(key, "cell").agg(F.count(F.lit(1)).alias("size"), F.min("span").alias("chunk"))
    placed = running(
        cells, [key], ["cell"], {"earlier": ("sum", F.col("size"))}, exclusive=True
    )
    chunk = (1 + F.floor(F.col("earlier") / half)).cast("long")
    placed = placed.select(key, "cell", chunk.alias("chunk"))
    return cold_rows, hot_rows.join(placed, [key, "cell"]).select(*df.columns, "chunk")


def with_chunks(df: DataFrame, column: str, width: int) -> DataFrame:
    """Add ``chunk``, which follows ``column`` and holds about ``width`` rows each, however sparse its values are.

    There are at most 4096 chunks; their edges are quantiles, found in one scan.
    """
    count = min(MAX_CHUNKS, -(-df.count() // width))
    shares = [i / count for i in range(1, count)]
    edges = sorted(set(df.approxQuantile(column, shares, 1 / (4 * count)))) if shares else []
    if not edges:
        return df.withColumn("chunk", F.lit(0).cast("long"))
    found = Bucketizer(
        splits=[float("-inf"), *edges, float("inf")], inputCol="chunk_at", outputCol="chunk_found"
    ).transform(df.withColumn("chunk_at", F.col(column).cast("double")))
    return found.withColumn("chunk", F.col("chunk_found").cast("long")).drop("chunk_at", "chunk_found")


Specs = dict[str, tuple[str, Column]]  # output column -> (max, min, sum or last; value)


def _window(keys: list[str], order: list[str], descending: bool, end: int):
    ordering = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    return Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, end)


def _scan(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return getattr(F, kind)(value).over(window)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    specs: Specs,
    descending: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Running aggregates per key over ``order`` in two levels.

    ``df`` carries a ``chunk`` column that follows the order. Each (keys, chunk)
    group is scanned on its own; one summary row per chunk carries the result
    over to the later chunks. No task sees a whole hot key.
    """
    inside = _window([*keys, "chunk"], order, descending, -1 if exclusive else 0)
    earlier = _window(keys, ["chunk"], descending, -1)
    position = F.struct(*[F.col(c) for c in order])

    def total(kind: str, value: Column) -> Column:
        if kind == "last":
            pick = F.min_by if descending else F.max_by
            return pick(value, F.when(value.isNotNull(), position))
        return getattr(F, kind)(value)

    based = df.withColumns({f"v_{out}": value for out, (_, value) in specs.items()})
    local = based.withColumns(
        {f"in_{out}": _scan(kind, F.col(f"v_{out}"), inside) for out, (kind, _) in specs.items()}
    )
    totals = based.groupBy(*keys, "chunk").agg(
        *[total(kind, F.col(f"v_{out}")).alias(f"t_{out}") for out, (kind, _) in specs.items()]
    )
    carry = totals.select(
        *keys,
        "chunk",
        *[_scan(kind, F.col(f"t_{out}"), earlier).alias(f"c_{out}") for out, (kind, _) in specs.items()],
    )
    joined = local.join(carry, [*keys, "chunk"], "left")
    combine = {
        "max": F.greatest,
        "min": F.least,
        "last": F.coalesce,
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    }
    result = {
        out: combine[kind](F.col(f"in_{out}"), F.col(f"c_{out}")) for out, (kind, _) in specs.items()
    }
    return joined.select(*df.columns, *[value.alias(out) for out, value in result.items()])


def running_pair(
    pair: tuple[DataFrame, DataFrame | None], keys: list[str], order: list[str], specs: Specs
) -> tuple[DataFrame, DataFrame | None]:
    """Exclusive running aggregates for the two sides of ``split_hot``: a plain window for
    ordinary keys, two levels for hot ones."""
    cold, hot = pair
    before = _window(keys, order, False, -1)
    plain = {out: _scan(kind, value, before) for out, (kind, value) in specs.items()}
    plain = {
        out: F.coalesce(value, F.lit(0)) if specs[out][0] == "sum" else value
        for out, value in plain.items()
    }
    return cold.withColumns(plain), None if hot is None else running(hot, keys, order, specs, exclusive=True)


def checked_lookup(left: DataFrame, right: DataFrame, key: str, spread_by: Column, rows: int) -> DataFrame:
    """Left join to ``right`` (unique on ``key``, of ``rows`` rows, counted before): a broadcast if these are
    fewer than hot keys could be, else ``spread_lookup``."""
    if rows <= MAX_HOT:
        return left.join(F.broadcast(right), key, "left")
    return spread_lookup(left, right, key, spread_by)


def checked_filter(left: DataFrame, keys: DataFrame, key: str, spread_by: Column, rows: int, keep: bool = True) -> DataFrame:
    """Rows of ``left`` whose key is (or is not) among ``keys``, unique and counted before."""
    if rows <= MAX_HOT:
        return left.join(F.broadcast(keys.select(key)), key, "left_semi" if keep else "left_anti").select(*left.columns)
    return spread_filter(left, keys, key, spread_by, keep)


def spread_filter(
    left: DataFrame, keys: DataFrame, key: str, spread_by: Column, keep: bool = True
) -> DataFrame:
    """Rows of ``left`` whose key is (or is not) among ``keys`` (unique), balanced under hot keys."""
    flagged = spread_lookup(left, keys.select(key, F.lit(True).alias("is_listed")), key, spread_by)
    listed = F.col("is_listed").isNotNull()
    return flagged.where(listed if keep else ~listed).drop("is_listed")


def spread_lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: Column,
    weight: str | None = None,
) -> DataFrame:
    """Left join to ``right``, which is unique on ``key``, balanced under hot keys.

    Hot keys are counted in ``left``, or come from ``weight``, a column of ``right``
    with the number of left rows behind each key (then every key of ``left`` is in
    ``right``). Their rows get their match, or nulls where there is none, by broadcast
    of fewer than 65536 keys with their payload, and pass the shuffle join under
    harmless spread keys. So do rows without a key, which match nothing. ``right``
    should hold what is asked, not whole documents: its hot rows are broadcast.
    """
    payload = [c for c in right.columns if c not in (key, weight)]
    if weight is None:
        hot = F.broadcast(hot_keys(left.where(F.col(key).isNotNull()), key, SPREAD).select(key))
        found = right.join(hot, key, "left_semi")
        heavy = hot.join(found, key, "left")
    else:
        heavy = right.where(
            (F.col(weight) > SPREAD) & (F.col(weight) * MAX_HOT > right.agg(F.sum(weight)).scalar())
        )
    heavy = heavy.select(
        F.col(key).alias("hot_key"), *[F.col(c).alias(f"hot_{c}") for c in payload]
    )
    other = right.select(F.col(key).alias("lookup_key"), *payload)
    spread_key = F.concat(
        F.lit("\u0000hot"), F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("string")
    )
    apart = F.col("hot_key").isNotNull() | F.col(key).isNull()
    marked = left.join(F.broadcast(heavy), F.col(key) == F.col("hot_key"), "left").withColumn(
        "spread_key", F.when(apart, spread_key).otherwise(F.col(key))
    )
    return marked.join(other, F.col("spread_key") == F.col("lookup_key"), "left").select(
        *left.columns, *[F.coalesce(F.col(f"hot_{c}"), F.col(c)).alias(c) for c in payload]
    )
