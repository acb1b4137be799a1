import random

import pytest
from ledgers import SCHEMA, flat, random_ledger, walk
from pyspark.sql import functions as F

from rollbook.operators import fold, progress, rollback

STATE = "amount updated created life utxo holder lovelace datum reference_seq settings_seq".split()


def states(df):
    return {r["name"]: tuple(r[f] for f in STATE) for r in df.collect()}


@pytest.mark.parametrize("width", [4, 37, 1 << 20])
def test_canonical_equals_pairwise_check(spark, width):
    rows = random_ledger(300, 5, 3)
    rnd = random.Random(9)
    marks = [(s, s * 10 - rnd.randrange(50, 500)) for s in sorted(rnd.sample(range(300), 6))]
    ledger = spark.createDataFrame(rows, SCHEMA)
    got = rollback.canonical(ledger, spark.createDataFrame(marks, "bseq long, bslot long"), width)
    want = {r[0] for r in rows if not any(b >= r[0] and p < r[2] for b, p in marks)}
    assert {r["seq"] for r in got.collect()} == want
    assert got.columns == ledger.columns


def test_no_controls_keep_everything(spark):
    ledger = spark.createDataFrame(random_ledger(50, 3, 1), SCHEMA)
    none = spark.createDataFrame([], "bseq long, bslot long")
    assert rollback.canonical(ledger, none).count() == 50


def test_rewind_equals_fold_of_the_canonical_chain_without_late_rows(spark):
    rows = random_ledger(300, 6, 11, late=0.0)
    ledger = spark.createDataFrame(rows, SCHEMA)
    annotated = fold.annotate(ledger, detail=True)
    target = 1700
    back = rollback.rewind(fold.current_state(annotated), fold.change_log(annotated), target)
    got = {
        r["name"]: tuple(r["state"][f] for f in STATE)
        for r in back.collect()
        if r["action"] != "delete"
    }
    kept = ledger.where(F.col("slot") <= target)
    assert got == states(fold.current_state(fold.annotate(kept, detail=True)))


def test_two_changes_in_one_slot_rewind_to_the_earliest(spark):
    rows = [
        (0, "a", 1, "mint", "s", "u0", 1, False, None),
        (1, "a", 5, "transfer", "s", "u1", 1, False, None),
        (2, "a", 5, "transfer", "s", "u2", 1, False, None),
    ]
    annotated = fold.annotate(spark.createDataFrame(rows, SCHEMA), detail=True)
    back = rollback.rewind(fold.current_state(annotated), fold.change_log(annotated), 3).collect()
    assert [(r["action"], r["state"]["utxo"]) for r in back] == [("update", "u0")]


def test_retention(spark):
    history = spark.createDataFrame([(s,) for s in (0, 10, 90, 100)], "slot long")
    assert sorted(r[0] for r in rollback.retained(history, 90).collect()) == [10, 90, 100]


@pytest.mark.parametrize("width", [3, 1 << 20])
def test_late_blocks(spark, width):
    slots = [5, 7, 6, 6, 9, 8, 10, 1]
    df = spark.createDataFrame(list(enumerate(slots)), "seq long, slot long")
    row = progress.late_blocks(df, width).first()
    assert (row["blocks"], row["late_blocks"]) == (8, 3)


def test_status_precedence(spark):
    rows = [(True, 1.0, True), (False, 1.0, True), (False, 0.5, True), (False, 0.5, False)]
    df = spark.createDataFrame(rows, "c boolean, s double, k boolean")
    got = [r[0] for r in df.select(progress.status(F.col("c"), F.col("s"), F.col("k"))).collect()]
    assert got == ["current", "storage_behind", "ogmios_behind", "waiting_on_cardano_node"]


def test_walk_is_what_states_means():
    rows = random_ledger(20, 2, 1)
    assert all(len(flat(s[2])) == len(STATE) for s in walk(rows).values())
