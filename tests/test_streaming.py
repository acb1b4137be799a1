import re

import pytest
from ledgers import SCHEMA, random_ledger
from pyspark.sql import functions as F

from rollbook.operators import fold, holders, rollback
from rollbook.plans.ledger_queries import default_events
from rollbook.session import scratch_dir
from rollbook.sources import snapshots
from rollbook.streaming.registry_stream import ROLLBACK, RegistryStream

STATE = "amount updated created life utxo holder lovelace datum reference_seq settings_seq".split()


def states(df):
    return {r["name"]: tuple(r[f] for f in STATE) for r in df.collect()}


def batches(df, n, total):
    step = -(-total // n)
    return [df.where(F.floor(F.col("seq") / step) == i) for i in range(n)]


@pytest.mark.parametrize("n, width", [(1, 1 << 20), (3, 8)])
def test_batches_with_rollbacks_equal_one_fold(spark, n, width):
    rows = random_ledger(240, 8, 21)
    marks = [(60, 350), (61, 500), (150, 1200), (239, 2300)]
    ledger = spark.createDataFrame(rows, SCHEMA)
    control = spark.createDataFrame(marks, "bseq long, bslot long")
    mixed = ledger.unionByName(
        control.select(F.col("bseq").alias("seq"), F.col("bslot").alias("slot"), F.lit(ROLLBACK).alias("kind")),
        allowMissingColumns=True,
    )
    stream = RegistryStream(spark, scratch_dir(spark, "registry"), width, compact_every=2)
    for i, batch in enumerate(batches(mixed, n, 240)):
        stream.process(batch, i)
    stream.process(batches(mixed, n, 240)[-1], n - 1)  # a batch that is run again changes nothing
    folded = fold.annotate(rollback.canonical(ledger, control), detail=True)
    want = fold.current_state(folded)
    assert states(stream.registry()) == states(want)
    saves = lambda df: {r["name"]: r["last_saved_seq"] for r in df.collect()}
    assert saves(stream.registry()) == saves(want)
    picked = holders.manual_defaults(holders.held(want), default_events(folded))
    assert sorted(map(tuple, stream.holder_table().collect())) == sorted(map(tuple, picked.collect()))
    snapshots_dir = scratch_dir(spark, "snapshots")
    stream.snapshot(snapshots_dir, slot=2390, block_hash="h")
    restored, history = snapshots.restore(spark, snapshots_dir)
    assert states(restored) == states(want)
    assert {"slot", "name", "old", "new", "changed"} <= set(history.columns)


@pytest.mark.parametrize("n, seed", [(3, 9)])
def test_any_order_of_arrival_gives_one_result(spark, n, seed):
    rows = random_ledger(200, 6, seed)
    marks = [(60, 350), (61, 500), (150, 1200), (199, 1900)]
    ledger = spark.createDataFrame(rows, SCHEMA)
    control = spark.createDataFrame(marks, "bseq long, bslot long")
    mixed = ledger.unionByName(
        control.select(F.col("bseq").alias("seq"), F.col("bslot").alias("slot"), F.lit(ROLLBACK).alias("kind")),
        allowMissingColumns=True,
    )
    stream = RegistryStream(spark, scratch_dir(spark, "registry"), 16, compact_every=3)
    for i in range(n):
        stream.process(mixed.where(F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(n)) == i), i)
    want = fold.annotate(rollback.canonical(ledger, control), whole=True)
    assert states(stream.registry()) == states(fold.current_state(want))
    saved = {r["name"]: r["last_saved_seq"] for r in fold.current_state(want).collect()}
    assert {r["name"]: r["last_saved_seq"] for r in stream.registry().collect()} == saved
    log = {(r["slot"], r["seq"], r["name"], r["old"], r["new"]) for r in rollback.retained(fold.change_log(want)).collect()}
    assert {(r["slot"], r["seq"], r["name"], r["old"], r["new"]) for r in stream.history().collect()} == log
    figures = stream._read("metrics").drop("batch_id").collect()
    assert sum(r["events"] for r in figures) == 200 and {r["batch"] for r in figures} == set(range(n))


def test_history_after_a_rollback(spark):
    stream = RegistryStream(spark, scratch_dir(spark, "registry"))
    event = lambda seq, slot, kind: (seq, "a", slot, kind, "h", f"u{seq}", 1, False, None)
    batch = [event(0, 10, "mint"), event(1, 20, "transfer"), (1, None, 15, ROLLBACK, *[None] * 5), event(2, 18, "transfer")]
    for i, row in enumerate(batch):
        stream.process(spark.createDataFrame([row], SCHEMA), i)
    assert sorted((r["slot"], r["seq"]) for r in stream.history().collect()) == [(10, 0), (18, 2)]
    stream.process(spark.createDataFrame([event(3, 30, "reference")], SCHEMA), 4)  # has no datum
    assert [r["last_saved_seq"] for r in stream.registry().collect()] == [2]
    assert [(r["seq"], r["reason"]) for r in stream.quarantine().collect()] == [(3, "no_datum")]


def test_reset_leaves_nothing(spark):
    stream = RegistryStream(spark, scratch_dir(spark, "registry"))
    stream.process(spark.createDataFrame(random_ledger(30, 3, 1), SCHEMA), 0)
    assert stream.registry().count() > 0
    stream.reset()
    assert stream.registry().count() == 0 and stream.ledger(9).count() == 0


@pytest.mark.parametrize("n, seed", [(2, 4)])
def test_quarantine_holds_the_rejected_rows_of_the_canonical_fold(spark, n, seed):
    marks = [(60, 350), (150, 1200)]
    ledger = spark.createDataFrame(random_ledger(200, 6, seed), SCHEMA)
    control = spark.createDataFrame(marks, "bseq long, bslot long")
    mixed = ledger.unionByName(
        control.select(F.col("bseq").alias("seq"), F.col("bslot").alias("slot"), F.lit(ROLLBACK).alias("kind")),
        allowMissingColumns=True,
    )
    stream = RegistryStream(spark, scratch_dir(spark, "registry"), 16)
    for i in range(n):
        stream.process(mixed.where(F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(n)) == i), i)
    want = fold.annotate(rollback.canonical(ledger, control), detail=True).where(~F.col("saved"))
    reason = F.when(F.col("op") == fold.REJECT, "no_datum").otherwise("no_asset").alias("reason")
    rejected = sorted((r["seq"], r["name"], r["reason"]) for r in want.select("seq", "name", reason).collect())
    assert len(rejected) > 5
    assert sorted((r["seq"], r["name"], r["reason"]) for r in stream.quarantine().collect()) == rejected


def event(name, seq, slot, kind, pick=False):
    return (seq, name, slot, kind, "h", f"u{seq}", 1, pick, "{}" if kind == "reference" else None)


def back_to(slot, seq):
    return (seq, None, slot, ROLLBACK, *[None] * 5)


@pytest.mark.parametrize("compact_every", [1, 50])  # other tests compact every 2 and 3
def test_the_log_does_not_depend_on_compaction(spark, compact_every):
    """Entries that a compaction put aside come back into the window when a rollback lowers the newest slot."""
    stream = RegistryStream(spark, scratch_dir(spark, "registry"), compact_every=compact_every)
    sent = [
        [event("a", 0, 10, "mint"), event("a", 1, 20, "transfer"), event("b", 2, 15, "mint"), event("b", 3, 16, "reference", True)],
        [event("c", 4, 100_000, "mint")],
        [back_to(50, 4)],
        [back_to(15, 5), event("b", 6, 17, "transfer")],
    ]
    logs = []
    for i, rows in enumerate(sent):
        stream.process(spark.createDataFrame(rows, SCHEMA), i)
        if i > 1:
            logs.append(sorted((r["slot"], r["seq"]) for r in stream.history().collect()))
            defaults = [(r["default_handle"], r["manually_set"]) for r in stream.holder_table().collect()]
    assert logs == [[(10, 0), (15, 2), (16, 3), (20, 1)], [(10, 0), (15, 2), (17, 6)]]
    assert defaults == [("a", False)]
    assert sorted((r["name"], r["last_saved_seq"], r["utxo"]) for r in stream.registry().collect()) == [("a", 0, "u0"), ("b", 6, "u6")]


def test_a_rollback_reads_what_it_needs_only(spark):
    stream = RegistryStream(spark, scratch_dir(spark, "registry"), compact_every=2)
    for i in range(5):
        stream.process(spark.createDataFrame([event("a", 2 * i, 10 * i, "mint"), event("b", 2 * i + 1, 10 * i, "mint")], SCHEMA), i)
    files = lambda df: {r[0] for r in df.select(F.input_file_name()).distinct().collect()}
    folders = lambda df: sorted({int(f.split("batch_id=")[1].split("/")[0]) for f in files(df) if "batch_id=" in f})
    assert folders(stream._ledger_from(4, 7)) == [3, 4]
    # entries from a slot on: batches below theirs are not listed
    assert re.search(r"batch_id#\d+L? >= 4", stream.journal(5, from_slot=40)._jdf.queryExecution().optimizedPlan().toString())
    left = {int(f.split("=")[1]) for f in _names(spark, f"{stream.base}/delta")}
    assert left <= {-1, 2, 3, 4}  # folders below the compaction before the last are gone
    assert _names(spark, f"{stream.base}/compact") == ["upto=1", "upto=3"]


def _names(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().getName() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where))


def test_a_stream_goes_on_from_a_snapshot(spark):
    base = scratch_dir(spark, "resume")
    first = RegistryStream(spark, f"{base}/first", snapshots_to=f"{base}/snapshots", snapshot_slots=5)
    sent = [
        [event("a", 0, 100_000, "mint"), event("b", 1, 100_001, "mint"), event("a", 2, 100_020, "transfer")],
        [event("b", 3, 100_010, "transfer"), event("a", 4, 100_003, "reference", True)],
        [back_to(100_015, 5), event("c", 6, 100_030, "mint")],
    ]
    for i, rows in enumerate(sent[:2]):
        first.process(spark.createDataFrame(rows, SCHEMA), i)
    assert [r["slot"] for r in snapshots.read_manifest(spark, f"{base}/snapshots").orderBy("slot").collect()] == [100_010, 100_020]
    again = RegistryStream(spark, f"{base}/again", compact_every=1)
    assert again.resume(f"{base}/snapshots") == (100_020, 2)
    for i, rows in enumerate(sent[1:]):
        again.process(spark.createDataFrame(rows, SCHEMA), i)
    first.process(spark.createDataFrame(sent[2], SCHEMA), 2)
    assert states(again.registry()) == states(first.registry())
    assert {r["name"]: r["last_saved_seq"] for r in again.registry().collect()} == {"a": 4, "b": 3, "c": 6}
    assert sorted(map(tuple, again.holder_table().collect())) == sorted(map(tuple, first.holder_table().collect()))
    log = lambda s: sorted((r["slot"], r["seq"], r["name"], r["changed"]) for r in s.history().collect())
    assert log(again) == log(first) and len(log(first)) == 5
    with pytest.raises(ValueError, match="older one"):
        again.process(spark.createDataFrame([back_to(10, 9)], SCHEMA), 2)
    assert RegistryStream(spark, f"{base}/none").resume(scratch_dir(spark, "nothing")) is None
