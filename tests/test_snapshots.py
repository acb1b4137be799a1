import pytest
from pyspark.sql import functions as F

from rollbook.session import scratch_dir
from rollbook.sources import snapshots

V = snapshots.SCHEMA_VERSION


def manifest(spark, rows):
    return spark.createDataFrame([(f"p{i}", *r, "0:0,0:0", "registry,history", None) for i, r in enumerate(rows)], snapshots.MANIFEST_SCHEMA)


@pytest.mark.parametrize(
    "rows, want",
    [
        # slot, hash, version, is_remote
        ([(42, "l", V, False), (75, "r", V, True)], ["r", "l"]),
        ([(75, "l", V, False), (42, "r", V, True)], ["l", "r"]),
        ([(75, "l", V, False), (75, "r", V, True)], ["r", "l"]),
        ([(75, "l", V, False), (42, "r", V + 1, True)], ["l"]),
        ([(75, "l", V, False), (42, "r", None, True)], ["l"]),
        ([(1, "l", V, False)], ["l"]),
        ([(2, "r", V, True)], ["r"]),
        ([(1, "l", 1, False)], []),
    ],
)
def test_choice(spark, rows, want):
    found = manifest(spark, rows).withColumn("node", F.lit(1))
    ranked = snapshots.ranked(found, ["node"]).orderBy("attempt").collect()
    assert [r["hash"] for r in ranked] == want


def test_write_restore_and_fallback(spark):
    base = scratch_dir(spark, "t")
    one = spark.createDataFrame([("a",)], "name string")
    two = spark.createDataFrame([("a",), ("b",)], "name string")
    none = spark.createDataFrame([], "slot long")
    with pytest.raises(ValueError):
        snapshots.write(one, none, base, slot=0, block_hash="x")
    snapshots.write(one, none, base, slot=10, block_hash="x")
    snapshots.write(two, none, base, slot=20, block_hash="y")
    assert snapshots.restore(spark, base)[0].count() == 2
    lost = spark.createDataFrame([(f"{base}/none", 30, "z", V, True, "0:0,0:0", None, None)], snapshots.MANIFEST_SCHEMA)
    lost.write.mode("append").parquet(f"{base}/manifest")
    assert snapshots.restore(spark, base)[0].count() == 2
    lost.write.mode("append").parquet(f"{base}/manifest")
    assert snapshots.restore(spark, base) is None


def test_damaged_pages_lead_to_the_fallback(spark):
    import glob
    import os

    base = scratch_dir(spark, "t")
    none = spark.createDataFrame([], "slot long")
    rows = spark.range(20_000).selectExpr("cast(id as string) as name")
    snapshots.write(rows.limit(5), none, base, slot=10, block_hash="x")
    path = snapshots.write(rows, none, base, slot=20, block_hash="y")
    for file in glob.glob(f"{path}/registry/part-*"):
        size = os.path.getsize(file)
        with open(file, "r+b") as page:  # the footer stays whole
            page.seek(size // 3)
            page.write(b"\xff" * 200)
        os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    with pytest.warns(UserWarning):
        assert snapshots.restore(spark, base)[0].count() == 5


def test_resume_after_the_chosen_snapshot(spark):
    ledger = spark.createDataFrame([(s,) for s in range(10)], "slot long")
    rows = manifest(spark, [(6, "l", V, False), (9, "r", V - 1, True)])
    assert sorted(r[0] for r in snapshots.resume_from(ledger, rows).collect()) == [7, 8, 9]
    empty = spark.createDataFrame([], snapshots.MANIFEST_SCHEMA)
    assert snapshots.resume_from(ledger, empty, genesis=4).count() == 5
