"""Queries over snapshots: read, write, choice, restore, reconciliation, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators import fold, holders, reconcile, rollback, views
from rollbook.plans.base import query, reg_sql
from rollbook.plans.ledger_queries import FLAT_LOG, LOG_CTE, flat_log, fold_sql
from rollbook.session import read_table, scratch_dir
from rollbook.sources import fixtures as X
from rollbook.sources import snapshots

ROLLUP_COLUMNS = ("holder", "total_handles", "default_handle", "type")


@query(
    "snap_read",
    reg_sql(
        """select asset_id, name, holder, utxo, created_slot from reg
 where asset_id % 53 <> 0 and asset_id % 101 <> 0"""
    ),
)
def snap_read(spark, sf):
    """A compressed JSON export with some broken lines: the good rows survive."""
    a, _ = X.snapshot_pair(spark, sf)
    fields = ("asset_id", "name", "holder", "utxo", "created_slot")
    line = F.to_json(F.struct(*fields))
    broken = F.when(F.col("asset_id") % 101 == 0, F.concat(F.lit("{broken"), line)).otherwise(line)
    path = scratch_dir(spark, "export")
    a.select(broken.alias("value")).write.option("compression", "gzip").text(path)
    schema = "asset_id long, name string, holder string, utxo string, created_slot long, _corrupt string"
    rows = snapshots.read_rows(spark, path, schema)
    return rows.where(F.col("_corrupt").isNull()).select(*fields)


def _history(spark, sf) -> DataFrame:
    log = fold.change_log(fold.annotate(X.ledger(spark, sf), detail=True))
    return rollback.retained(log)


@query("snap_write_roundtrip", reg_sql("select asset_id, name, utxo, holder from reg where asset_id % 53 <> 0"))
def snap_write_roundtrip(spark, sf):
    a, _ = X.snapshot_pair(spark, sf)
    base = scratch_dir(spark, "snapshots")
    rows = a.select("asset_id", "name", "utxo", "holder")
    path = snapshots.write(rows, _history(spark, sf), base, slot=100, block_hash="a")
    return spark.read.parquet(f"{path}/registry")


def _node_manifest(spark, sf) -> DataFrame:
    """Per node a local and a remote snapshot, some missing or of another version."""
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    local = c.where(F.col("node") % 7 != 0).select(
        "node",
        (F.col("node") * 7919 % 10).alias("slot"),
        F.when(F.col("node") % 4 == 0, 47).otherwise(48).alias("schema_version"),
        F.lit(False).alias("is_remote"),
    )
    remote = c.where(F.col("node") % 11 != 0).select(
        "node",
        (F.col("node") * 104729 % 7).alias("slot"),
        F.when(F.col("node") % 5 == 0, 47).otherwise(48).alias("schema_version"),
        F.lit(True).alias("is_remote"),
    )
    return local.unionByName(remote)


@query(
    "snap_choose",
    """with m as (select c_custkey as node, c_custkey * 7919 % 10 as slot, false as is_remote from customer
  where c_custkey % 7 <> 0 and c_custkey % 4 <> 0
 union all select c_custkey, c_custkey * 104729 % 7, true from customer
  where c_custkey % 11 <> 0 and c_custkey % 5 <> 0)
select node, slot, is_remote, cast(1 + (select count(*) from m o where o.node = m.node and o.is_remote <> m.is_remote
   and (o.slot > m.slot or (o.slot = m.slot and o.is_remote))) as integer) as attempt from m""",
)
def snap_choose(spark, sf):
    ranked = snapshots.ranked(_node_manifest(spark, sf), group=["node"])
    return ranked.select("node", "slot", "is_remote", "attempt")


_RESTORED = """, ra as (select *, row_number() over (partition by holder order by
   case when og_number > 0 then 0 else 1 end, case when og_number > 0 then og_number else 0 end,
   length, created_slot, by_name) as pref_a from reg where asset_id % 53 <> 0)
select holder, count(*) as total_handles, max(case when pref_a = 1 then name end) as default_handle,
 min(holder_type) as type from ra group by holder"""


@query("snap_restore", reg_sql(_RESTORED))
def snap_restore(spark, sf):
    """The newest snapshot has another version and the next one has lost rows since it was
    written: the fallback is restored and the rollup derived from it."""
    a, b = X.snapshot_pair(spark, sf)
    base = scratch_dir(spark, "snapshots")
    keep = ("name", "holder", "og_number", "created_slot", "holder_type", "known_owner_name")
    empty = spark.createDataFrame([], "slot long, name string")
    snapshots.write(a.select(*keep), empty, base, slot=100, block_hash="a")
    damaged = snapshots.write(b.select(*keep), empty, base, slot=200, block_hash="b")
    b.where(F.col("asset_id") % 7 != 0).select(*keep).write.mode("overwrite").parquet(f"{damaged}/registry")
    snapshots.write(b.select(*keep), empty, base, slot=300, block_hash="c", version=47)
    registry, _ = snapshots.restore(spark, base)
    return holders.holder_rollup(registry).select(*ROLLUP_COLUMNS)


@query(
    "snap_history",
    fold_sql(f"{LOG_CTE} {FLAT_LOG} where slot >= (select max(slot) - {rollback.TWELVE_HOURS} from h)"),
)
def snap_history(spark, sf):
    """The retained change log, written with a snapshot and read back from it."""
    base = scratch_dir(spark, "snapshots")
    rows = X.snapshot_pair(spark, sf)[0].select("name", "utxo")
    snapshots.write(rows, _history(spark, sf), base, slot=100, block_hash="a")
    return flat_log(snapshots.restore(spark, base)[1])


@query("st_reset", fold_sql("select cast(0 as bigint) as assets, (select count(*) from s) as assets_before"))
def st_reset(spark, sf):
    """A registry stream that ran over the ledger, reset to genesis: nothing is left."""
    from rollbook.streaming.registry_stream import RegistryStream

    stream = RegistryStream(spark, scratch_dir(spark, "reset"))
    stream.process(X.ledger(spark, sf), 0)
    before = stream.registry().count()
    stream.reset()
    return stream.registry().agg(F.count(F.lit(1)).alias("assets")).withColumn("assets_before", F.lit(before).cast("long"))


@query("sink_name_list", reg_sql("select name from reg where utxo <> ''"))
def sink_name_list(spark, sf):
    path = scratch_dir(spark, "names")
    views.live_rows(X.registry(spark, sf)).select("name").write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "name")


# ------------------------------------------------------------------ reconciliation

_PAIR_CTE = f""",
sa as (select * from reg where asset_id % 53 <> 0),
sb as (select * replace ({', '.join(f'{v} as {k}' for k, v in X.SNAPSHOT_SQL.items())}) from reg where asset_id % 59 <> 0),
da as (select holder, name as d from (select holder, name, row_number() over (partition by holder order by
   case when og_number > 0 then 0 else 1 end, case when og_number > 0 then og_number else 0 end,
   length, created_slot, by_name) as x from sa) where x = 1),
db as (select holder, name as d from (select holder, name, row_number() over (partition by holder order by
   case when og_number > 0 then 0 else 1 end, case when og_number > 0 then og_number else 0 end,
   length, created_slot, by_name) as x from sb) where x = 1),
fa as (select sa.*, da.d as dflt from sa join da on sa.holder = da.holder),
fb as (select sb.*, db.d as dflt from sb join db on sb.holder = db.holder),
cmp as (select coalesce(fa.name, fb.name) as name,
 case when fb.name is null then 'only_a' when fa.name is null then 'only_b' else 'both' end as place,
 case when fa.name is null or fb.name is null then '' else concat_ws(',',
  case when fa.utxo <> fb.utxo then 'utxo' end, case when fa.address <> fb.address then 'address' end,
  case when fa.holder <> fb.holder then 'holder' end,
  case when fa.dflt <> fb.dflt then 'default_in_wallet' end) end as fields,
 fa.utxo as a_utxo, fb.utxo as b_utxo
 from fa full join fb on fa.name = fb.name)"""


def _pair(spark, sf):
    return tuple(
        holders.with_default(
            side.select("name", "utxo", "address", "holder"), holders.holder_rollup(side)
        )
        for side in X.snapshot_pair(spark, sf)
    )


@query("j_reconcile", reg_sql(f"{_PAIR_CTE} select * from cmp where place <> 'both' or fields <> ''"))
def j_reconcile(spark, sf):
    rows = reconcile.compare(*_pair(spark, sf))
    return rows.select(
        "name",
        "place",
        F.array_join("fields", ",").alias("fields"),
        F.col("a.utxo").alias("a_utxo"),
        F.col("b.utxo").alias("b_utxo"),
    )


@query(
    "a_reconcile_counts",
    reg_sql(
        f"""{_PAIR_CTE} select count(*) filter (where place = 'only_a') as missing_in_b,
 count(*) filter (where place = 'only_b') as missing_in_a,
 count(*) filter (where contains(fields, 'utxo')) as utxo_mismatches,
 count(*) filter (where contains(fields, 'address')) as address_mismatches,
 count(*) filter (where contains(fields, 'holder')) as holder_mismatches,
 count(*) filter (where contains(fields, 'default')) as default_in_wallet_mismatches from cmp"""
    ),
)
def a_reconcile_counts(spark, sf):
    return reconcile.counts(reconcile.compare(*_pair(spark, sf)))


@query(
    "set_except",
    reg_sql(
        """select name, case when asset_id % 59 = 0 and asset_id % 53 <> 0 then 'only_a'
 when asset_id % 53 = 0 and asset_id % 59 <> 0 then 'only_b' else 'both' end as place from reg
where asset_id % 53 <> 0 or asset_id % 59 <> 0"""
    ),
)
def set_except(spark, sf):
    return reconcile.keys(*X.snapshot_pair(spark, sf))


