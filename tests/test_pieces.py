"""Long transactions in pieces, balanced lookups, chunks of sparse positions."""

import oracle
import pytest
from ledgers import SCHEMA, random_ledger
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from rollbook.operators import fold, skew
from rollbook.sources import fixtures

BLOCK_QUERIES = (
    "etl_mint_explode etl_output_explode etl_scanned_event etl_metadata_pick f_policy f_unnamed k_label_parse "
    "k_is_mint k_datum_attrs k_missing_keys k_settings_struct st_event_order st_route st_block_fold src_block_stream"
).split()


@pytest.mark.parametrize("width", [1, 3])
def test_block_queries_do_not_depend_on_the_cut(spark, small, monkeypatch, width):
    monkeypatch.setattr(fixtures, "PIECE_LINES", width)
    con = oracle.connect(small)
    assert fixtures.blocks(spark, small).agg(F.max("pieces")).first()[0] > 1
    for name in BLOCK_QUERIES:
        got, want = oracle.compare(
            spark, con, small, entry_point.queries()[name], entry_point.oracle_sql()[name]
        )
        assert got == want, name


def _sizes(df):
    return [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]


@pytest.mark.parametrize("key", ["'absent'", "cast(null as string)", "'k1'"])
def test_lookup_of_a_hot_key_is_balanced(spark, key):
    rows = spark.range(200_000).select(
        "id", F.when(F.col("id") % 2 == 0, F.expr(key)).otherwise(F.concat(F.lit("k"), F.col("id") % 5000)).alias("key")
    )
    right = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("value"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = skew.spread_lookup(rows, right, "key", F.col("id"))
        sizes = _sizes(out)
        assert sum(sizes) == 200_000 and max(sizes) < 2 * 200_000 / 16
        plain = rows.join(right, "key", "left").select("id", "key", "value")
        assert out.exceptAll(plain).isEmpty() and plain.exceptAll(out).isEmpty()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("power", [1, 7])
def test_chunks_follow_counts(spark, power):
    rows = spark.range(5000).select((F.col("id") * 10**power).alias("seq"))
    sizes = [r["count"] for r in skew.with_chunks(rows, "seq", 500).groupBy("chunk").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 1000
    last = skew.with_chunks(rows, "seq", 500).groupBy("chunk").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("chunk").collect()
    assert all(x["b"] < y["a"] for x, y in zip(last, last[1:], strict=False))


@pytest.mark.parametrize("gap", [1, 1000, 1 << 20])
def test_chunks_of_a_hot_key_follow_counts(spark, gap):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    rows = spark.range(6000).select((F.col("id") * gap).alias("seq"), key.alias("key"))
    cold, hot = skew.split_hot(rows, "key", "seq", 100)
    found = hot.groupBy("key", "chunk").agg(F.count("seq").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b")).orderBy("chunk").collect()
    assert cold.count() == 4000 and {r["key"] for r in found} == {"hot"} and sum(r["n"] for r in found) == 2000
    assert max(r["n"] for r in found) <= 100 and len(found) <= 1 + 2 * 2000 / 100
    assert all(x["b"] < y["a"] for x, y in zip(found, found[1:], strict=False)) and found[0]["chunk"] > 0


def test_a_hot_asset_with_gaps_reaches_the_chain_as_a_few_rows(spark):
    rows = [((s + 1) << 20, *rest) for s, *rest in random_ledger(3000, 2, 5)]
    ledger = spark.createDataFrame(rows, SCHEMA)
    events = ledger.transform(fold.coded)
    _, hot = skew.split_hot(events, "name", "seq", 500)
    assert hot.count() > 2000
    assert fold.incoming_states(hot).count() <= 2 + 2 * 3000 / 500
    none = spark.createDataFrame([], "name string, last_saved_seq long")
    detail = lambda width: fold.with_saves_before(fold.annotate(ledger, width, detail=True), none).drop("chunk").collect()
    assert sorted(map(str, detail(500))) == sorted(map(str, detail(1 << 20)))
