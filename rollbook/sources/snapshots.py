"""Snapshots: a Parquet folder per slot with a one-row manifest written last.

The manifest holds a fingerprint of each table (rows and an order-free sum of row
hashes), observed while the table is written. A snapshot is restored only if its tables still
have it, so missing, cut and damaged files alike lead to the fallback. ``load`` copies a
snapshot to where its user works and observes the fingerprint of the copy: one pass.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions import scalars as S
from rollbook.session import drop_folder

SCHEMA_VERSION = 48

MANIFEST_SCHEMA = (
    "path string, slot long, hash string, schema_version int, is_remote boolean, fingerprint string, "
    "tables string, position string"
)
TABLES = ("registry", "history")


UNREADABLE = (PySparkException, Py4JJavaError)  # missing or damaged files


def _prints(rows: DataFrame) -> list[Column]:
    """Number of rows and the sum of their hashes: one scan, whatever the order of rows and files."""
    texts = [
        F.to_json(F.struct(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in rows.schema
    ]
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*texts).cast("decimal(38,0)")).alias("h")]


def _as_text(found) -> str:
    return f"{found['n']}:{int(found['h'] or 0)}"


def fingerprint(rows: DataFrame) -> str:
    return _as_text(rows.agg(*_prints(rows)).first())


def write_observed(rows: DataFrame, path: str) -> str:
    """Write a table and return the fingerprint of what was written, without a second scan."""
    seen = Observation()
    rows.observe(seen, *_prints(rows)).write.mode("overwrite").parquet(path)
    return _as_text(seen.get)


def stored_fingerprint(spark: SparkSession, path: str, tables: tuple[str, ...] = TABLES) -> str:
    return ",".join(fingerprint(spark.read.parquet(f"{path}/{table}")) for table in tables)


def prune(registry: DataFrame, cutoff: int) -> DataFrame:
    """Drop owner-labelled and virtual rows and rows created or updated at or after a slot."""
    return registry.where(
        ~(
            F.col("hex").startswith(S.LABEL_OWNER)
            | F.col("hex").startswith(S.LABEL_VIRTUAL)
            | (F.col("created_slot") >= cutoff)
            | (F.col("updated_slot") >= cutoff)
        )
    )


def write(
    registry: DataFrame,
    history: DataFrame,
    base: str,
    slot: int,
    block_hash: str,
    is_remote: bool = False,
    version: int = SCHEMA_VERSION,
    more: dict[str, DataFrame] | None = None,
    position: str | None = None,
) -> str:
    """Write one snapshot; nothing is written before the first block. The manifest goes
    last, so a job that dies half-way leaves no snapshot that could be chosen.

    ``more`` are further tables, ``position`` is the place in the source up to which rows are in it.
    """
    if slot == 0:
        raise ValueError("no snapshot before the first block")
    path = f"{base}/slot={slot}"
    tables = {"registry": registry, "history": history} | (more or {})
    prints = [write_observed(rows, f"{path}/{table}") for table, rows in tables.items()]
    line = (path, slot, block_hash, version, is_remote, ",".join(prints), ",".join(tables), position)
    manifest = registry.sparkSession.createDataFrame([line], MANIFEST_SCHEMA)
    manifest.write.mode("append").parquet(f"{base}/manifest")
    return path


def due(spark: SparkSession, base: str, slot: int, period: int) -> bool:
    """Whether the newest snapshot is at least ``period`` slots old, or there is none."""
    try:
        newest = read_manifest(spark, base).agg(F.max("slot")).first()[0]
    except UNREADABLE:  # nothing was written yet
        return slot > 0
    return slot > 0 and (newest is None or slot - newest >= period or slot < newest)


def drop_old(spark: SparkSession, base: str, keep: int = 2) -> None:
    """Remove the tables of all snapshots but those that would be tried; the manifest keeps their lines."""
    kept = {path for path, *_ in candidates(spark, base, keep)}
    done = read_manifest(spark, base).select("path").distinct().where(~F.col("path").isin(list(kept) or [""]))
    for row in done.orderBy(F.length("path").desc(), F.col("path").desc()).limit(100).collect():
        drop_folder(spark, row["path"])


def read_manifest(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/manifest")


def read_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of a JSON snapshot export; compressed files are read by extension and
    broken lines are set aside in ``_corrupt``."""
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )


def usable(manifest: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    return manifest.where(F.col("schema_version") == version)


def ranked(manifest: DataFrame, group: list[str]) -> DataFrame:
    """Usable snapshots per group in the order they should be tried: newest slot first, remote wins ties."""
    order = Window.partitionBy(*group).orderBy(F.col("slot").desc(), F.col("is_remote").desc())
    return usable(manifest).withColumn("attempt", F.row_number().over(order))


def candidates(spark: SparkSession, base: str, most: int = 2) -> list[tuple]:
    """(path, fingerprint, tables, slot, position) of snapshots to try, best first: by default the first and one fallback."""
    order = (F.col("slot").desc(), F.col("is_remote").desc())
    try:
        best = usable(read_manifest(spark, base)).orderBy(*order).limit(most).collect()
    except UNREADABLE:  # no snapshot was ever written here
        return []
    return [(r["path"], r["fingerprint"], tuple((r["tables"] or ",".join(TABLES)).split(",")), r["slot"], r["position"]) for r in best]


def restore(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame] | None:
    """Registry and history of the best sound snapshot, else ``None`` (start from genesis).

    Rollups are not stored: they are derived again from the registry.
    """
    for path, expected, tables, _, _ in candidates(spark, base):
        try:
            if stored_fingerprint(spark, path, tables) == expected:
                return tuple(spark.read.parquet(f"{path}/{table}") for table in TABLES)
            warnings.warn(f"snapshot {path} is not what was written", stacklevel=2)
        except UNREADABLE as broken:  # take the fallback
            warnings.warn(f"snapshot {path} cannot be read: {type(broken).__name__}", stacklevel=2)
    return None


def load(spark: SparkSession, base: str, place: Callable[[str], str]) -> tuple[int, str | None] | None:
    """Copy the best sound snapshot's tables to ``place(table)``; its slot and position, or ``None``.

    The fingerprint is that of the copy, taken while it is written. A damaged snapshot
    is found out by it, and the next one overwrites what was copied.
    """
    for path, expected, tables, slot, position in candidates(spark, base):
        try:
            prints = [write_observed(spark.read.parquet(f"{path}/{table}"), place(table)) for table in tables]
            if ",".join(prints) == expected:
                return slot, position
            warnings.warn(f"snapshot {path} is not what was written", stacklevel=2)
        except UNREADABLE as broken:  # take the fallback
            warnings.warn(f"snapshot {path} cannot be read: {type(broken).__name__}", stacklevel=2)
    return None


def resume_from(ledger: DataFrame, manifest: DataFrame, genesis: int = 0) -> DataFrame:
    """Ledger rows after the chosen snapshot's slot, or after the network's start."""
    start = usable(manifest).agg(F.coalesce(F.max("slot"), F.lit(genesis)))
    return ledger.where(F.col("slot") > start.scalar())
