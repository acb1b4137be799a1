import random

import pytest
from ledgers import SCHEMA, random_ledger, walk
from pyspark.sql import functions as F

from rollbook.operators import fold, holders, skew

FIELDS = "name string, holder string, og_number int, created_slot long, holder_type string, known_owner_name string"


def best(rows):
    def key(r):
        name, _, og, created = r
        return (0, og, 0, 0, "") if og else (1, 0, len(name), created, name)

    return min(rows, key=key)[0]


def registry(spark, rows):
    return spark.createDataFrame([(*r, "wallet", "") for r in rows], FIELDS)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("longname", "s", 5, 1), ("ab", "s", 0, 1), ("other", "s", 3, 9)], "other"),
        ([("abc", "s", 0, 9), ("ab", "s", 0, 10)], "ab"),
        ([("abc", "s", 0, 9), ("abd", "s", 0, 3)], "abd"),
        ([("abd", "s", 0, 3), ("abc", "s", 0, 3)], "abc"),
        ([("a1b", "s", 0, 3), ("a_b", "s", 0, 3)], "a_b"),
    ],
)
def test_best_asset(spark, rows, want):
    got = holders.holder_rollup(registry(spark, rows)).collect()
    assert [(r["default_handle"], r["total_handles"]) for r in got] == [(want, len(rows))]


def test_incremental_rollup_equals_recompute(spark):
    rnd = random.Random(4)
    before = {f"n{i}{'x' * (i % 5)}": (f"s{rnd.randrange(40)}", rnd.randrange(3), i) for i in range(1000)}
    after = dict(before)
    for i in range(1000):
        name = rnd.choice(list(after)) if i % 3 else f"m{i}"
        if i % 3 == 2:
            after.pop(name)
        else:
            after[name] = (f"s{rnd.randrange(45)}", rnd.randrange(3), i)
    as_df = lambda d: registry(spark, [(n, *v) for n, v in d.items()])
    old, new = as_df(before), as_df(after)
    touched = holders.touched_holders(old, new)
    got = holders.refreshed_rollup(holders.holder_rollup(old), new, touched)
    full = holders.holder_rollup(new)
    key = lambda r: r["holder"]
    assert sorted(got.collect(), key=key) == sorted(full.collect(), key=key)


def literal_defaults(rows, states):
    """Holder bookkeeping done event by event."""
    assets, book = {}, {}
    for seq, name, slot, kind, *_ , is_default, _ in rows:
        accepted, saved, state = states[seq]
        if not saved:
            continue
        old, new = assets.get(name), state
        if old and old["holder"] in book:
            b = book[old["holder"]]
            b["has"].discard(name)
            if b["manual"] == name:
                b["manual"] = None
            if not b["has"]:
                del book[old["holder"]]
        if new and new["holder"]:
            b = book.setdefault(new["holder"], {"has": set(), "manual": None})
            b["has"].add(name)
            if kind == "reference" and accepted and is_default:
                b["manual"] = name
        elif new is None or not new["holder"]:
            pass
        assets[name] = new
    return assets, book


def test_manual_default_equals_event_by_event(spark):
    for seed in range(4):
        rows = random_ledger(500, 12, seed)
        states = walk(rows)
        assets, book = literal_defaults(rows, states)
        annotated = fold.annotate(spark.createDataFrame(rows, SCHEMA), detail=True)
        held = fold.current_state(annotated).where(F.col("holder") != "").select(
            "name",
            "holder",
            F.col("created").alias("created_slot"),
            F.lit(0).alias("og_number"),
            F.lit("").alias("holder_type"),
            F.lit("").alias("known_owner_name"),
            "last_saved_seq",
        )
        events = annotated.where(
            (F.col("kind") == "reference") & F.col("accepted") & F.col("is_default") & (F.col("new_holder") != "")
        ).select(F.col("new_holder").alias("holder"), "name", "seq")
        got = {r["holder"]: r for r in holders.manual_defaults(held, events).collect()}
        assert set(got) == set(book)
        for holder, b in book.items():
            if b["manual"]:
                want = b["manual"]
            else:
                want = best([(n, holder, 0, assets[n]["created"]) for n in b["has"]])
            r = got[holder]
            assert (r["total_handles"], r["manually_set"], r["default_handle"]) == (
                len(b["has"]), b["manual"] is not None, want,
            ), (seed, holder)


def test_spread_lookup_with_hot_keys(spark, monkeypatch):
    """A third of the rows on one key: same result as a plain join."""
    monkeypatch.setattr(skew, "SPREAD", 4)
    left = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
    )
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("v")).where(F.col("k") != "k7")
    want = sorted(left.join(right.drop("n"), "k", "left").select("id", "k", "v").collect())
    assert sorted(skew.spread_lookup(left, right, "k", F.col("id"), weight="n").collect()) == want
    assert sorted(skew.spread_lookup(left, right.drop("n"), "k", F.col("id")).collect()) == want


@pytest.mark.parametrize("width", [3, 50, 1 << 20])
def test_running_equals_window(spark, width):
    from pyspark.sql import Window

    rnd = random.Random(1)
    rows = [(i, "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(9)}", rnd.randrange(100)) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, k string, v long")
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    value = F.when(F.col("v") % 3 > 0, F.col("v"))
    specs = {"m": ("max", value), "s": ("sum", value), "l": ("last", value)}
    want = df.withColumns(
        {
            "m": F.max(value).over(w),
            "s": F.coalesce(F.sum(value).over(w), F.lit(0)),
            "l": F.last(value, ignorenulls=True).over(w),
        }
    )
    cold, hot = skew.running_pair(skew.split_hot(df, "k", "seq", width), ["k"], ["seq"], specs)
    got = cold.unionByName(hot).select("seq", "k", "v", "m", "s", "l")
    assert sorted(got.collect()) == sorted(want.collect())
