import random

import pytest
from ledgers import SCHEMA, flat, random_ledger, walk

from rollbook.operators import fold

STATE = "amount updated created life utxo holder lovelace datum reference_seq settings_seq".split()


@pytest.mark.parametrize("width", [1 << 20, 64, 7, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_annotate_equals_walk_for_any_chunk_width(spark, width, seed):
    rows = random_ledger(600, 8, seed)
    want = walk(rows)
    ledger = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), SCHEMA)
    got = fold.annotate(ledger.repartition(5), width=width, detail=True).collect()
    assert len(got) == len(rows)
    for r in got:
        accepted, saved, state = want[r["seq"]]
        assert (r["accepted"], r["saved"]) == (accepted, saved), r
        assert tuple(r[f"new_{f}"] for f in STATE) == flat(state), r


CODES = {"mint": 0, "transfer": 1, "reference": 2, "virtual": 3, "settings": 4, "burn": 5}


def chunked(rows, width):
    """The rows of one asset as the summaries get them, and their chunks."""
    import pyarrow as pa

    cols = {f: [] for f in ("name", "chunk", "before_top", *fold.Event._fields)}
    top, tops = None, {}
    for seq, _, slot, kind, holder, utxo, lovelace, _, datum in rows:
        op = CODES[kind]
        if 2 <= op <= 4 and datum is None:
            op = fold.REJECT
        chunk = 1 + seq // width
        tops.setdefault(chunk, top)
        if op not in (fold.BURN, fold.REJECT):
            top = slot if top is None else max(top, slot)
        for c, v in zip(cols, ("n0", chunk, tops[chunk], op, slot, seq, utxo, holder, lovelace, datum, 1, None, None)):
            cols[c].append(v)
    kinds = {c: pa.string() for c in ("name", "utxo", "holder", "datum", "built", "script")}
    return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in cols.items()}), sorted(tops)


def mixed(rows, seed, burns):
    """The same rows with another share of burns, mints most of the rest."""
    rnd = random.Random(seed)
    kind = lambda: "burn" if rnd.random() < burns else rnd.choice(["mint", "mint", "mint", "transfer", "virtual", "settings"])
    return [(*r[:3], kind(), *r[4:]) for r in rows]


def test_summaries_chain_on_many_ledgers():
    """Summarise and chain without Spark, on many small ledgers with lots of late rows."""
    import pyarrow as pa

    for seed in range(240):
        rows = random_ledger(60 if seed % 4 else 400, 1, seed, late=(0.5, 0.1, 0.9)[seed % 3], repeat=0.5)
        if seed % 2:
            rows = mixed(rows, seed, (0.1, 0.3, 0.45, 0.6)[seed // 2 % 4])
        want = walk(rows)
        width = 1 + seed % 9 if seed % 4 else 20 + seed
        table, chunks = chunked(rows, width)
        # batch borders must not matter
        ops = list(fold._summarise(iter(table.to_batches(max_chunksize=5))))
        states = pa.Table.from_batches(list(fold._chain(iter(ops)))).to_pylist()
        assert [s["chunk"] for s in states] == chunks
        for s in states:
            first = (s["chunk"] - 1) * width
            before = want[first - 1][2] if first else None
            assert tuple(s[f"in_{f}"] for f in STATE) == flat(before), (seed, s)


@pytest.mark.parametrize("late", [0.0, 0.09, 0.3])
@pytest.mark.parametrize("burns", [0.1, 0.25, 0.5])
def test_a_chunk_reaches_the_chain_as_a_few_rows(late, burns):
    """However long the chunks are: what one task chains for an asset is bounded by their number."""
    for width in (1000, 8000):
        table, chunks = chunked(mixed(random_ledger(16_000, 1, 3, late=late), 4, burns), width)
        ops = sum(b.num_rows for b in fold._summarise(iter(table.to_batches())))
        assert ops <= 12 * len(chunks)


def test_current_state_and_log(spark):
    rows = random_ledger(400, 6, 5)
    want = walk(rows)
    annotated = fold.annotate(spark.createDataFrame(rows, SCHEMA), width=16, detail=True)
    last = {}
    for seq, name, *_ in rows:
        last[name] = want[seq][2]
    state = {r["name"]: tuple(r[f] for f in STATE) for r in fold.current_state(annotated).collect()}
    assert state == {n: flat(a) for n, a in last.items() if a}
    log = fold.change_log(annotated).collect()
    for r in log:
        assert r["changed"]
        assert (r["new"] is None) == (want[r["seq"]][2] is None)
    before = {}
    expected = set()
    for seq, name, *_ in rows:
        if before.get(name) != want[seq][2]:
            expected.add(seq)
        before[name] = want[seq][2]
    assert {r["seq"] for r in log} == expected


def test_out_of_order_last_slot_wins(spark):
    rows = [
        (i, "a", slot, "transfer", "s", f"u{i}", 1, False, None)
        for i, slot in enumerate((144718140, 144711632, 144718597))
    ]
    state = fold.current_state(fold.annotate(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(r["utxo"], r["updated"]) for r in state] == [("u2", 144718597)]


def test_reference_before_mint_is_not_live_and_not_a_double_mint(spark):
    rows = [
        (0, "a", 5, "reference", "s", "r#1", 1, False, "d"),
        (1, "a", 6, "mint", "s", "m#0", 1, False, None),
    ]
    got = fold.annotate(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()
    assert [(r["new_utxo"], r["new_amount"]) for r in got] == [("", 1), ("m#0", 1)]


@pytest.mark.parametrize("width", [2, 1 << 20])
def test_arrivals_are_dense_and_in_order(spark, width):
    from rollbook.sources import blocks

    rows = [(b * 3, t, o) for b in range(9) for t in range(1 + b % 4) for o in range(1, 2 + (b + t) % 3)]
    df = spark.createDataFrame(rows, "seq long, tx_pos long, tx_order int")
    got = blocks.arrivals(df, width).orderBy("seq", "tx_pos", "tx_order").collect()
    assert [r["arrival"] for r in got] == list(range(len(rows)))


def test_order_survives_a_join_that_turns_into_a_broadcast(spark):
    """A shuffle join planned on (name, chunk) that becomes a broadcast join at run time
    reads its shuffle locally; the fold must still see sorted, complete groups."""
    rows = random_ledger(600, 4, 3)
    want = walk(rows)
    ledger = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), SCHEMA).repartition(6)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    try:
        got = fold.annotate(ledger, width=16, detail=True).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        for k, v in saved.items():
            spark.conf.set(k, v)
    assert {r["seq"]: tuple(r[f"new_{f}"] for f in STATE) for r in got} == {
        seq: flat(state) for seq, (_, _, state) in want.items()
    }


def test_every_sorted_fold_has_its_own_shuffle(spark):
    ledger = spark.createDataFrame(random_ledger(50, 2, 1), SCHEMA).repartition(3)
    plan = fold.annotate(ledger, width=4)._jdf.queryExecution().executedPlan().toString()
    steps = plan.count("MapInArrow")
    assert steps == 3
    assert plan.count("hashpartitioning(xxhash64(") == plan.count("REPARTITION_BY_COL") == steps


def test_folds_read_the_ledger_once(spark, small):
    """Without hot assets: one scan, one exchange for each order of rows."""
    from rollbook.plans import QUERIES

    for name, scans, exchanges in (("st_owner_upsert", 1, 2), ("w_accept_gate", 1, 2)):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") <= scans and plan.count("Exchange hashpartitioning") <= exchanges, plan
