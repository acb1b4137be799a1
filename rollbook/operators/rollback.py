"""Rollbacks as data: cancelled rows, history retention, rewind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators import position
from rollbook.operators.skew import CHUNK_ROWS, running, spread_lookup, with_chunks

TWELVE_HOURS = 43200  # slots


def canonical(ledger: DataFrame, controls: DataFrame, width: int = CHUNK_ROWS) -> DataFrame:
    """Ledger rows no later control row cancels.

    A control row (``bseq, bslot``) cancels rows that arrived up to ``bseq`` with a
    slot above ``bslot``. So a row stays iff its slot is at most the smallest
    ``bslot`` among the controls from its arrival on: a running minimum from the
    end, scanned per chunk of arrival order. No pairing of rows with controls.

    In the stream of blocks (``seq`` is a position) control rows stand at ends of blocks, so
    the rows of a block share their fate: blocks are scanned, and rows look theirs up.
    """
    if dict(ledger.dtypes)["seq"] == "string":
        return _canonical_blocks(ledger, controls, width)
    scanned = _allowed(ledger, controls, width)
    keep = F.col("allowed").isNull() | (F.col("slot") <= F.col("allowed"))
    return scanned.where(keep).select(*ledger.columns)


def cancelled(rows: DataFrame, controls: DataFrame, width: int = CHUNK_ROWS) -> DataFrame:
    """Rows (``seq, slot, ...``) that a control row cancels: what ``canonical`` leaves out."""
    if dict(rows.dtypes)["seq"] == "string":
        found = _with_block_limits(rows, controls, width)
    else:
        found = _allowed(rows, controls, width)
    return found.where(F.col("slot") > F.col("allowed")).select(*rows.columns)


def _allowed(ledger: DataFrame, controls: DataFrame, width: int) -> DataFrame:
    """Rows with the greatest slot that later control rows leave, null without any."""
    marks = controls.select(
        F.col("bseq").alias("seq"), F.col("bslot").alias("limit"), F.lit(1).alias("is_mark")
    )
    rows = ledger.withColumns({"limit": F.lit(None).cast("long"), "is_mark": F.lit(0)})
    both = with_chunks(rows.unionByName(marks, allowMissingColumns=True), "seq", width)
    # descending (seq, is_mark): a mark comes before the row of the same arrival
    scanned = running(
        both, [], ["seq", "is_mark"], {"allowed": ("min", F.col("limit"))}, descending=True
    )
    return scanned.where(F.col("is_mark") == 0)


def _with_block_limits(ledger: DataFrame, controls: DataFrame, width: int) -> DataFrame:
    rows = ledger.withColumn("block", position.block_of(F.col("seq")))
    blocks = rows.select("block").distinct().withColumn("seq", position.number_of(F.col("block")))
    marks = controls.select(position.number_of(position.block_of(F.col("bseq"))).alias("bseq"), "bslot")
    allowed = _allowed(blocks, marks, width).where(F.col("allowed").isNotNull()).select("block", "allowed")
    return spread_lookup(rows, allowed, "block", F.col("seq"))


def _canonical_blocks(ledger: DataFrame, controls: DataFrame, width: int) -> DataFrame:
    found = _with_block_limits(ledger, controls, width)
    return found.where(F.col("allowed").isNull() | (F.col("slot") <= F.col("allowed"))).select(*ledger.columns)


def retained(history: DataFrame, slots: int = TWELVE_HOURS) -> DataFrame:
    newest = history.agg(F.max("slot")).scalar()
    return history.where(F.col("slot") >= newest - slots)


def rewind(state: DataFrame, history: DataFrame, target) -> DataFrame:
    """Registry as of slot ``target`` with the action taken per asset.

    The earliest undone change of an asset holds the state to go back to; it is
    found by a mergeable aggregate, so a hot asset costs one partial row per task.
    """
    fields = [f.name for f in history.schema["old"].dataType]
    undo = (
        history.where(F.col("slot") > target)
        .groupBy("name")
        .agg(F.min_by(F.struct("old"), F.struct("slot", "seq")).alias("undo"))
    )
    now = state.select("name", F.struct(*fields).alias("now"))
    both = now.join(undo, "name", "full_outer")
    back = F.col("undo.old")
    action = (
        F.when(F.col("undo").isNull(), "keep")
        .when(F.col("now").isNull() & back.isNotNull(), "create")
        .when(F.col("now").isNotNull() & back.isNull(), "delete")
        .when(F.col("now").isNotNull(), "update")
    )
    final = F.when(F.col("undo").isNull(), F.col("now")).otherwise(back)
    return both.select("name", action.alias("action"), final.alias("state")).where(
        F.col("action").isNotNull()
    )
