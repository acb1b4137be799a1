"""The stream of blocks: several transactions a block, blocks of any size, batches cut anywhere."""

import random

import pytest
from pyspark.sql import functions as F

from rollbook.operators import fold, position, rollback
from rollbook.session import scratch_dir
from rollbook.sources import blocks as B
from rollbook.sources import fixtures as X
from rollbook.streaming.registry_stream import RegistryStream

FIELDS = "amount updated created utxo holder lovelace datum".split()


def states(df):
    return {r["name"]: tuple(r[f] for f in FIELDS) for r in df.collect()}


def random_blocks(seed, blocks=9, txs=2, outputs=6):
    """Blocks of several transactions whose outputs share a few assets; some mint, some burn."""
    rnd, rows = random.Random(seed), []
    for seq in range(1, blocks + 1):
        for tx in range(txs):
            outs, mint = [], {}
            for i in range(outputs):
                asset = rnd.choice(["a1", "b2", "c3", "d4"]).encode().hex()
                outs.append((i, f"addr{rnd.randrange(3)}", 100 * seq + i, {X.POLICIES[0]: {asset: 1}}, None, None))
                if rnd.random() < 0.3:
                    mint[asset] = rnd.choice([1, -1])
            # later transactions come with smaller ids, so that only tx_pos tells their order
            rows.append((seq, 0, seq * 10, tx, f"t{seq}-{9 - tx}", 1, 0, outs, {X.POLICIES[0]: mint}, None))
    return rows


def envelopes(spark, rows, marks):
    forward = [("forward", r, None, None, r[0]) for r in rows]
    return spark.createDataFrame(forward + [("backward", None, (slot, ""), None, seq) for seq, slot in marks], B.ENVELOPE)


def whole(spark, rows, marks):
    """One fold over densely numbered rows."""
    nested = spark.createDataFrame(rows, B.BLOCK)
    ledger = B.ledger_rows(nested, X.POLICIES).cache()
    ends = ledger.join(spark.createDataFrame(marks, "mseq long, bslot long"), F.col("slot") <= F.col("mseq") * 10)
    controls = ends.groupBy("mseq", "bslot").agg(F.max("seq").alias("bseq")).select("bseq", "bslot")
    return fold.current_state(fold.annotate(rollback.canonical(ledger, controls), detail=True))


@pytest.mark.parametrize("n, width, seed", [(1, 1 << 20, 1), (2, 3, 2)])
def test_blocks_of_several_transactions_equal_one_fold(spark, n, width, seed):
    rows, marks = random_blocks(seed), [(4, 20), (6, 50)]
    sent = envelopes(spark, rows, marks).cache()
    stream = RegistryStream(spark, scratch_dir(spark, "registry"), width, seq="string")
    process = stream.process_envelopes(X.POLICIES)
    for i in range(n):  # transactions of a block fall into different batches, later ones first
        part = F.coalesce(F.col("block.tx_pos"), F.lit(0)) if n > 1 else F.lit(0)
        process(sent.where(part == n - 1 - i), i)
    got = states(stream.registry())
    assert got == states(whole(spark, rows, marks)) and len(got) > 1
    seqs = [r["seq"] for r in stream.ledger(n).select("seq").collect()]
    assert len(set(seqs)) == len(seqs) > 100


def test_a_backward_envelope_cancels_all_of_a_long_block(spark):
    row = lambda seq, outs: (seq, 0, seq * 10, 0, f"t{seq}", 1, 0, outs, {}, None)
    out = lambda i, asset: (i, "addr", 5, {X.POLICIES[0]: {asset.encode().hex(): 1}}, None, None)
    rows = [row(1, [out(0, "a1")]), row(2, [out(i, "b2") for i in (0, 1 << 20, (1 << 21) + 5, 2**31 - 1)]), row(3, [out(0, "c3")])]
    stream = RegistryStream(spark, scratch_dir(spark, "registry"), 3, seq="string")
    stream.process_envelopes(X.POLICIES)(envelopes(spark, rows, [(2, 15)]), 0)
    assert sorted(states(stream.registry())) == ["a1", "c3"]


def test_positions_sort_like_their_parts(spark):
    numbers = [0, 1, 5, 1 << 20, (1 << 20) + 1, 1 << 40, 2**63 - 1]
    rnd = random.Random(4)
    rows = [
        (rnd.choice([-7, *numbers]), rnd.choice(numbers), rnd.randrange(2), rnd.choice(numbers), rnd.choice(["61", "6161", "62"]), rnd.choice(["p", "q"]))
        for _ in range(400)
    ]
    df = spark.createDataFrame(rows, "b long, t long, p int, o long, a string, y string")
    df = df.withColumns({"at": position.of_row(*[F.col(c) for c in "btpoay"]), "end": position.end_of_block(F.col("b"))})
    found = sorted(df.collect(), key=lambda r: r["at"])
    assert [tuple(r)[:6] for r in found] == sorted(rows)
    assert all((r["at"] < s["end"]) == (r["b"] <= s["b"]) for r in found for s in found[::40])


@pytest.mark.parametrize("transactions", [1, 40])
def test_chunks_of_a_hot_asset_within_one_block(spark, transactions):
    """One block, one asset: chunks hold counted rows, in one long transaction as in many."""
    from rollbook.operators import skew

    at = position.of_row(F.lit(7), F.col("id") % transactions, F.lit(1), F.floor(F.col("id") / transactions), F.lit("61"), F.lit("p"))
    rows = spark.range(4000).select(F.lit("hot").alias("name"), at.alias("seq"))
    _, hot = skew.split_hot(rows, "name", "seq", 200)
    found = hot.groupBy("chunk").agg(F.count("seq").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("chunk").collect()
    assert sum(r["n"] for r in found) == 4000 and max(r["n"] for r in found) <= 200 and len(found) <= 41
    assert all(x["b"] < y["a"] for x, y in zip(found, found[1:], strict=False))


def test_rollbacks_are_found_without_making_the_rows(spark, monkeypatch):
    seen, sent = [], envelopes(spark, random_blocks(1), [(4, 20)])
    stream = RegistryStream(spark, scratch_dir(spark, "registry"), seq="string")
    monkeypatch.setattr(stream, "process", lambda *given: seen.extend(given))
    stream.process_envelopes(X.POLICIES)(sent, 0)
    rows, batch_id, marks = seen
    assert batch_id == 0 and rows.where("kind = 'rollback'").isEmpty() and [r["slot"] for r in marks.collect()] == [20]
    assert "Generate" not in marks._jdf.queryExecution().optimizedPlan().toString()
