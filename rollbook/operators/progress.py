"""Late blocks, scan progress and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.operators.skew import CHUNK_ROWS, running, with_chunks

CAUGHT_UP_SLOTS = 120

# Status answers, worst first.
WAITING = "waiting_on_cardano_node"
SOURCE_BEHIND = "ogmios_behind"
STORAGE_BEHIND = "storage_behind"
CURRENT = "current"


def late_blocks(ledger: DataFrame, width: int = CHUNK_ROWS) -> DataFrame:
    """Rows whose slot is below the slot of the row that arrived just before."""
    rows = with_chunks(ledger.select("seq", "slot"), "seq", width)
    seen = running(rows, [], ["seq"], {"previous": ("last", F.col("slot"))}, exclusive=True)
    return seen.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.sum(F.when(F.col("slot") < F.col("previous"), 1).otherwise(0)).alias("late_blocks"),
    )


def metrics(ledger: DataFrame, batch: Column) -> DataFrame:
    """One metrics row per batch of arrivals."""
    at = F.struct("slot", "seq")
    return ledger.groupBy(batch.alias("batch")).agg(
        F.count(F.lit(1)).alias("events"),
        F.min("slot").alias("first_slot"),
        F.max("slot").alias("last_slot"),
        F.max_by("slot", "seq").alias("current_slot"),
        F.max_by("utxo", "seq").alias("current_hash"),
        F.max_by("utxo", at).alias("tip_hash"),
    )


def percent(first: Column, last: Column, current: Column) -> Column:
    share = (current - first) / (last - first) * 100
    return F.when(current == 0, "0.00").otherwise(F.format_string("%.2f", share))


def caught_up(last: Column, current: Column, tip_hash: Column, current_hash: Column) -> Column:
    return (last - current < CAUGHT_UP_SLOTS) & (tip_hash == current_hash)


def status(is_caught_up: Column, network_sync: Column, connected: Column) -> Column:
    return (
        F.when(~connected, WAITING)
        .when(network_sync < 1, SOURCE_BEHIND)
        .when(~is_caught_up, STORAGE_BEHIND)
        .otherwise(CURRENT)
    )
