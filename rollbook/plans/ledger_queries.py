"""Queries over the ledger: state folds, change log, rollback, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.operators import fold, holders, progress, rollback
from rollbook.operators.skew import running_pair, split_counted
from rollbook.plans.base import LEDGER_CTE, ledger_sql, query
from rollbook.session import stored
from rollbook.sources import fixtures as X
from rollbook.sources import snapshots

_OP_SQL = """case when kind = 'mint' then 0 when kind = 'transfer' then 1 when kind = 'burn' then 5
 when datum is null then 6 when kind = 'reference' then 2 when kind = 'virtual' then 3 else 4 end"""

VIRTUAL_SQL = "case when kind = 'reference' and seq % 2 = 0 then 'virtual' else kind end"


def fold_sql(body: str, kind: str = "kind", ledger: str = LEDGER_CTE) -> str:
    """The fold as a recursive query: one step per event of an asset."""
    return f"""with recursive {ledger},
k as (select * replace ({kind} as kind) from l),
ev as (select *, {_OP_SQL} as op, row_number() over (partition by name order by seq) as rn from k),
f as (
 select name, cast(0 as bigint) as rn, cast(null as bigint) as seq, cast(null as bigint) as slot,
  cast(null as varchar) as kind, cast(null as integer) as op, cast(null as boolean) as is_default,
  false as accepted, false as saved,
  cast(null as bigint) as o_amount, cast(null as bigint) as o_updated, cast(null as bigint) as o_created,
  cast(null as bigint) as o_life, cast(null as varchar) as o_utxo, cast(null as varchar) as o_holder,
  cast(null as bigint) as o_lovelace, cast(null as bigint) as o_refseq, cast(null as bigint) as o_setseq,
  cast(null as bigint) as n_amount, cast(null as bigint) as n_updated, cast(null as bigint) as n_created,
  cast(null as bigint) as n_life, cast(null as varchar) as n_utxo, cast(null as varchar) as n_holder,
  cast(null as bigint) as n_lovelace, cast(null as varchar) as n_datum,
  cast(null as bigint) as n_refseq, cast(null as varchar) as n_refdatum,
  cast(null as bigint) as n_setseq, cast(null as varchar) as n_setdatum
 from (select distinct name from ev)
 union all
 select name, rn, seq, slot, kind, op, is_default, accepted, saved,
  o_amount, o_updated, o_created, o_life, o_utxo, o_holder, o_lovelace, o_refseq, o_setseq,
  case when dead then null when creates then 1 when op = 5 then o_amount - 1
    when accepted and op = 0 and o_utxo <> '' and o_utxo <> utxo then o_amount + 1 else o_amount end,
  case when dead then null when accepted and op <> 5 then slot else o_updated end,
  case when dead then null when creates then slot when late and op = 0 then least(o_created, slot) else o_created end,
  case when dead then null when creates then seq else o_life end,
  case when dead then null when accepted and op in (0, 1, 3) then utxo when creates then '' else o_utxo end,
  case when dead then null when accepted and op in (0, 1, 3) then holder when creates then '' else o_holder end,
  case when dead then null when accepted and op in (0, 1) then lovelace when creates then 0 else o_lovelace end,
  case when dead then null when accepted and op in (0, 1) then datum when creates then null else o_datum end,
  case when dead then null when accepted and op in (2, 3) then seq when creates then null else o_refseq end,
  case when dead then null when accepted and op in (2, 3) then datum when creates then null else o_refdatum end,
  case when dead then null when accepted and op = 4 then seq when creates then null else o_setseq end,
  case when dead then null when accepted and op = 4 then datum when creates then null else o_setdatum end
 from (select *, (op = 5 and alive and o_amount <= 1) or (not alive and not accepted) as dead from (
  select *, not alive and op in (0, 1, 2, 3) as creates,
   case op when 6 then false when 5 then alive when 4 then alive and not late else not late end as accepted,
   case op when 6 then alive and slot < o_updated when 5 then alive when 4 then alive else true end as saved from (
   select *, alive and op not in (5, 6) and slot < o_updated as late from (
    select e.*, f.n_life is not null as alive, f.n_amount as o_amount, f.n_updated as o_updated,
     f.n_created as o_created, f.n_life as o_life, f.n_utxo as o_utxo, f.n_holder as o_holder,
     f.n_lovelace as o_lovelace, f.n_datum as o_datum, f.n_refseq as o_refseq, f.n_refdatum as o_refdatum,
     f.n_setseq as o_setseq, f.n_setdatum as o_setdatum
    from f join ev e on e.name = f.name and e.rn = f.rn + 1)))) ),
a as (select * from f where rn > 0),
s as (select a.*, (select max(x.seq) from a x where x.name = a.name and x.saved) as last_saved_seq from a
  where n_life is not null and rn = (select max(x.rn) from a x where x.name = a.name))
{body}"""


def _annotated(spark, sf, detail=True):
    return fold.annotate(X.ledger(spark, sf), detail=detail)


def _state(spark, sf):
    return fold.current_state(_annotated(spark, sf))


def folded_ledger(spark, sf):
    """The folded ledger as a table, for queries that read it more than once."""
    return stored(spark, sf, "folded", _annotated)


# ------------------------------------------------------------------ windows and progress


@query(
    "w_latest_per_asset",
    ledger_sql(
        """select name, seq, slot, kind, holder, utxo, created_slot from (select *,
 row_number() over (partition by name order by slot desc, seq desc) as rn,
 min(slot) over (partition by name) as created_slot from l) where rn = 1"""
    ),
)
def w_latest_per_asset(spark, sf):
    latest = X.ledger(spark, sf).groupBy("name").agg(
        F.max_by(F.struct("seq", "slot", "kind", "holder", "utxo"), F.struct("slot", "seq")).alias("e"),
        F.min("slot").alias("created_slot"),
    )
    return latest.select("name", "e.*", "created_slot")


@query(
    "w_accept_gate",
    ledger_sql(
        """select seq, name, slot, life, top is null or slot >= top as accepted from (select *,
 max(slot) over (partition by name, life order by seq rows between unbounded preceding and 1 preceding) as top from (
 select *, cast(coalesce(sum(case when kind = 'burn' then 1 else 0 end) over (partition by name order by seq
   rows between unbounded preceding and 1 preceding), 0) as bigint) as life from l) where kind <> 'burn')"""
    ),
)
def w_accept_gate(spark, sf):
    """Running maximum per life, with a life ending at each burn."""
    rows = X.ledger(spark, sf).select("seq", "name", "slot", "kind")
    burned = F.when(F.col("kind") == "burn", 1).otherwise(0)
    lives = running_pair(split_counted(rows, "name", "seq"), ["name"], ["seq"], {"life": ("sum", burned)})
    lives = tuple(side if side is None else side.where(F.col("kind") != "burn") for side in lives)
    cold, hot = running_pair(lives, ["name", "life"], ["seq"], {"top": ("max", F.col("slot"))})
    accepted = F.col("top").isNull() | (F.col("slot") >= F.col("top"))
    both = cold if hot is None else cold.unionByName(hot)
    return both.select("seq", "name", "slot", "life", accepted.alias("accepted"))


@query(
    "a_late_blocks",
    ledger_sql(
        """select count(*) as blocks, count(*) filter (where slot < prev) as late_blocks
from (select slot, lag(slot) over (order by seq) as prev from l)"""
    ),
)
def a_late_blocks(spark, sf):
    return progress.late_blocks(X.ledger(spark, sf))


_METRICS_CTE = """,
m as (select cast(floor(seq / 500.0) as bigint) as batch, count(*) as events, min(slot) as first_slot,
 max(slot) as last_slot, arg_max(slot, seq) as current_slot, arg_max(utxo, seq) as current_hash,
 arg_max(utxo, slot * 100000000 + seq) as tip_hash from l group by 1)"""


def _metrics(spark, sf):
    return progress.metrics(X.ledger(spark, sf), F.floor(F.col("seq") / 500).cast("long"))


@query("st_metrics", ledger_sql(f"{_METRICS_CTE} select * from m"))
def st_metrics(spark, sf):
    return _metrics(spark, sf)


@query(
    "a_progress",
    ledger_sql(
        """select min(slot) as first_slot, max(slot) as last_slot, arg_max(slot, seq) as current_slot,
 printf('%.2f', (arg_max(slot, seq) - min(slot)) / (max(slot) - min(slot)) * 100) as percent_complete from l"""
    ),
)
def a_progress(spark, sf):
    m = X.ledger(spark, sf).agg(
        F.min("slot").alias("first_slot"),
        F.max("slot").alias("last_slot"),
        F.max_by("slot", "seq").alias("current_slot"),
    )
    return m.withColumn(
        "percent_complete",
        progress.percent(F.col("first_slot"), F.col("last_slot"), F.col("current_slot")),
    )


@query(
    "a_status",
    ledger_sql(
        f"""{_METRICS_CTE} select batch, last_slot - current_slot < 120 and tip_hash = current_hash as caught_up,
 case when batch % 7 = 0 then 'waiting_on_cardano_node' when batch % 5 = 0 then 'ogmios_behind'
 when not (last_slot - current_slot < 120 and tip_hash = current_hash) then 'storage_behind'
 else 'current' end as status from m"""
    ),
)
def a_status(spark, sf):
    m = _metrics(spark, sf).withColumn(
        "caught_up",
        progress.caught_up(
            F.col("last_slot"), F.col("current_slot"), F.col("tip_hash"), F.col("current_hash")
        ),
    )
    sync = F.when(F.col("batch") % 5 == 0, 0.9).otherwise(1.0)
    connected = F.col("batch") % 7 != 0
    return m.select("batch", "caught_up", progress.status(F.col("caught_up"), sync, connected).alias("status"))


# ------------------------------------------------------------------ fold


@query(
    "st_owner_upsert",
    fold_sql(
        """select name, n_amount as amount, n_created as created_slot, n_updated as updated_slot, n_utxo as utxo,
 n_holder as holder, n_lovelace as lovelace, n_datum as datum from s"""
    ),
)
def st_owner_upsert(spark, sf):
    return _state(spark, sf).select(
        "name",
        "amount",
        F.col("created").alias("created_slot"),
        F.col("updated").alias("updated_slot"),
        "utxo",
        "holder",
        "lovelace",
        "datum",
    )


@query(
    "st_reference_upsert",
    fold_sql(
        """select name, n_refseq as reference_seq, n_refdatum as reference_datum, n_utxo <> '' as live,
 n_updated as updated_slot from s where n_refseq is not null"""
    ),
)
def st_reference_upsert(spark, sf):
    rows = _state(spark, sf).where(F.col("reference_seq").isNotNull())
    return rows.select(
        "name",
        "reference_seq",
        "reference_datum",
        (F.col("utxo") != "").alias("live"),
        F.col("updated").alias("updated_slot"),
    )


@query(
    "st_virtual_upsert",
    fold_sql(
        """select name, n_utxo as utxo, n_holder as holder, n_refseq as reference_seq, n_amount as amount,
 n_updated as updated_slot from s""",
        VIRTUAL_SQL,
    ),
)
def st_virtual_upsert(spark, sf):
    ledger = X.ledger(spark, sf).withColumn("kind", F.expr(VIRTUAL_SQL))
    state = fold.current_state(fold.annotate(ledger, detail=True))
    return state.select(
        "name", "utxo", "holder", "reference_seq", "amount", F.col("updated").alias("updated_slot")
    )


@query(
    "st_settings_upsert",
    fold_sql(
        "select name, n_setseq as settings_seq, n_setdatum as settings_datum from s where n_setseq is not null"
    ),
)
def st_settings_upsert(spark, sf):
    rows = _state(spark, sf).where(F.col("settings_seq").isNotNull())
    return rows.select("name", "settings_seq", "settings_datum")


@query(
    "st_burn",
    fold_sql(
        """select seq, name, o_amount as amount_before, n_amount as amount_after, accepted as applied,
 accepted and n_life is null as removed from a where kind = 'burn'"""
    ),
)
def st_burn(spark, sf):
    rows = _annotated(spark, sf, detail=False).where(F.col("kind") == "burn")
    return rows.select(
        "seq",
        "name",
        F.col("old_amount").alias("amount_before"),
        F.col("new_amount").alias("amount_after"),
        F.col("accepted").alias("applied"),
        (F.col("accepted") & F.col("new_life").isNull()).alias("removed"),
    )


@query(
    "st_double_mint",
    fold_sql(
        """select seq, name, o_utxo as old_utxo, n_utxo as new_utxo, n_amount as amount from a
where kind = 'mint' and n_amount = o_amount + 1"""
    ),
)
def st_double_mint(spark, sf):
    rows = _annotated(spark, sf, detail=False).where(
        (F.col("kind") == "mint") & (F.col("new_amount") == F.col("old_amount") + 1)
    )
    return rows.select(
        "seq",
        "name",
        F.col("old_utxo").alias("old_utxo"),
        F.col("new_utxo").alias("new_utxo"),
        F.col("new_amount").alias("amount"),
    )


@query(
    "st_late_data",
    fold_sql(
        """select seq, name, slot, kind, o_updated as updated_slot, n_created as created_slot from a
where o_updated is not null and slot < o_updated and kind <> 'burn'"""
    ),
)
def st_late_data(spark, sf):
    rows = _annotated(spark, sf, detail=False).where(
        (F.col("slot") < F.col("old_updated")) & (F.col("kind") != "burn")
    )
    return rows.select(
        "seq",
        "name",
        "slot",
        "kind",
        F.col("old_updated").alias("updated_slot"),
        F.col("new_created").alias("created_slot"),
    )


@query(
    "st_quarantine",
    fold_sql(
        """select seq, name, kind, case when op = 6 and not saved then 'no_datum'
 when not saved then 'no_asset' end as reason, op <> 6 and saved or op = 6 and saved as valid from a"""
    ),
)
def st_quarantine(spark, sf):
    rows = _annotated(spark, sf, detail=False)
    reason = F.when(~F.col("saved"), F.when(F.col("op") == fold.REJECT, "no_datum").otherwise("no_asset"))
    return rows.select("seq", "name", "kind", reason.alias("reason"), F.col("saved").alias("valid"))


@query(
    "j_root_guard",
    fold_sql(
        "select seq, name, o_life is not null as kept from a where kind = 'settings' and datum_ok"
    ).replace("a as (select * from f where rn > 0)", "a as (select *, op <> 6 as datum_ok from f where rn > 0)"),
)
def j_root_guard(spark, sf):
    rows = _annotated(spark, sf, detail=False).where(F.col("op") == fold.SETTINGS)
    return rows.select("seq", "name", F.col("old_life").isNotNull().alias("kept"))


# ------------------------------------------------------------------ holders over time

_L_ROLLUP = """select holder, count(*) as total_handles, arg_min(name, key) as default_handle from (
 select n_holder as holder, name, lpad(cast(length(name) as varchar), 4, '0') ||
  lpad(cast(n_created + 100000 as varchar), 12, '0') || translate(name, '_-.@', '!"#$') as key
 from s where n_holder <> '') group by holder"""


@query("st_holder_move", fold_sql(_L_ROLLUP))
def st_holder_move(spark, sf):
    """Rollup after the second half of the ledger, recomputed for touched holders only."""
    rows = folded_ledger(spark, sf)
    half = rows.where(F.col("seq") <= X.ledger(spark, sf).agg(F.max("seq") / 2).scalar())
    before, after = holders.held(fold.current_state(half)), holders.held(fold.current_state(rows))
    changed = holders.touched_holders(before, after)
    rollup = holders.refreshed_rollup(holders.holder_rollup(before), after, changed)
    return rollup.select("holder", "total_handles", "default_handle")


MANUAL_DEFAULT = (
        f""", roll as ({_L_ROLLUP}),
d as (select n_holder as holder, max(seq) as dseq, arg_max(name, seq) as dname from a
  where kind = 'reference' and accepted and is_default and n_holder <> '' group by 1)
select roll.holder, total_handles, s.name is not null as manually_set,
 coalesce(s.name, default_handle) as default_handle
from roll left join d on d.holder = roll.holder
 left join s on s.name = d.dname and s.last_saved_seq = d.dseq and s.n_holder = d.holder"""
)


DEFAULT_COLUMNS = ("holder", "total_handles", "manually_set", "default_handle")


def default_events(rows: DataFrame) -> DataFrame:
    """Accepted events that ask for their asset to be the holder's default."""
    return rows.where(
        (F.col("kind") == "reference") & F.col("accepted") & F.col("is_default") & (F.col("new_holder") != "")
    ).select(F.col("new_holder").alias("holder"), "name", "seq")


@query("a_manual_default", fold_sql(MANUAL_DEFAULT))
def a_manual_default(spark, sf):
    rows = folded_ledger(spark, sf)
    return holders.manual_defaults(holders.held(fold.current_state(rows)), default_events(rows)).select(*DEFAULT_COLUMNS)


# ------------------------------------------------------------------ change log and rollback

_LOG_COLS = (
    ("amount", "amount"),
    ("updated", "updated"),
    ("created", "created"),
    ("utxo", "utxo"),
    ("holder", "holder"),
    ("lovelace", "lovelace"),
    ("reference_seq", "refseq"),
    ("settings_seq", "setseq"),
)
_CHANGED = "concat_ws(',', " + ", ".join(
    f"case when o_{c} is distinct from n_{c} then '{f}' end" for f, c in _LOG_COLS
) + ")"
LOG_CTE = f""", h as (select case when accepted then slot else n_updated end as slot, seq, name,
 {_CHANGED} as changed, o_life, o_amount, o_updated, o_utxo, o_holder, n_life, n_amount, n_updated, n_utxo, n_holder
 from a where {_CHANGED} <> '')"""


def _log(spark, sf):
    return fold.change_log(_annotated(spark, sf))


def flat_log(log):
    side = lambda s: [F.col(f"{s}.{f}").alias(f"{s}_{f}") for f in ("amount", "updated", "utxo", "holder")]
    return log.select(
        "slot",
        "seq",
        "name",
        F.array_join("changed", ",").alias("changed"),
        F.col("old").isNull().alias("is_create"),
        F.col("new").isNull().alias("is_remove"),
        *side("old"),
        *side("new"),
    )


FLAT_LOG = """select slot, seq, name, changed, o_life is null as is_create, n_life is null as is_remove,
 o_amount as old_amount, o_updated as old_updated, o_utxo as old_utxo, o_holder as old_holder,
 n_amount as new_amount, n_updated as new_updated, n_utxo as new_utxo, n_holder as new_holder from h"""


@query("st_change_log", fold_sql(f"{LOG_CTE} {FLAT_LOG}"))
def st_change_log(spark, sf):
    return flat_log(_log(spark, sf))


@query("k_diff", fold_sql(f"{LOG_CTE} select seq, name, changed from h where o_life is not null and n_life is not null"))
def k_diff(spark, sf):
    both = _log(spark, sf).where(F.col("old").isNotNull() & F.col("new").isNotNull())
    return both.select("seq", "name", F.array_join("changed", ",").alias("changed"))


@query(
    "st_history_retention",
    fold_sql(f"{LOG_CTE} {FLAT_LOG} where slot >= (select max(slot) - {rollback.TWELVE_HOURS} from h)"),
)
def st_history_retention(spark, sf):
    return flat_log(rollback.retained(fold.change_log(folded_ledger(spark, sf))))


@query(
    "st_rewind",
    fold_sql(
        f"""{LOG_CTE}, t as (select max(slot) - {rollback.TWELVE_HOURS} as target from h),
u as (select name, o_life, o_amount, o_updated, o_utxo, o_holder, row_number() over (partition by name order by slot, seq) as rn
 from h where slot > (select target from t)),
x as (select coalesce(s.name, u.name) as name, u.name is null as untouched, s.name is not null as has_now,
  u.o_life is not null as has_old, s.n_amount, s.n_updated, s.n_utxo, s.n_holder, u.o_amount, u.o_updated, u.o_utxo, u.o_holder
 from s full join (select * from u where rn = 1) u on u.name = s.name)
select name, case when untouched then 'keep' when has_now and has_old then 'update' when has_now then 'delete'
  else 'create' end as action,
 case when untouched then n_amount else o_amount end as amount, case when untouched then n_updated else o_updated end as updated,
 case when untouched then n_utxo else o_utxo end as utxo, case when untouched then n_holder else o_holder end as holder
from x where untouched or has_now or has_old"""
    ),
)
def st_rewind(spark, sf):
    rows = folded_ledger(spark, sf)
    log = fold.change_log(rows)
    target = log.agg(F.max("slot") - rollback.TWELVE_HOURS).scalar()
    back = rollback.rewind(fold.current_state(rows), log, target)
    return back.select("name", "action", *[F.col(f"state.{f}") for f in ("amount", "updated", "utxo", "holder")])


@query(
    "st_canonical_chain",
    ledger_sql(
        """select seq, name, slot, kind, utxo from l where not exists
 (select 1 from ctl where bseq >= seq and bslot < slot)"""
    ),
)
def st_canonical_chain(spark, sf):
    rows = rollback.canonical(X.ledger(spark, sf), X.controls(spark, sf))
    return rows.select("seq", "name", "slot", "kind", "utxo")


# ------------------------------------------------------------------ resume

_MANIFEST_SQL = """,
man as (select seq // 1000 as part, max(slot) as slot, case when (seq // 1000) % 3 = 0 then 47 else 48 end as version
 from l group by 1, 3)"""


def _manifest(ledger):
    part = F.floor(F.col("seq") / 1000).cast("long")
    return ledger.groupBy(part.alias("part")).agg(F.max("slot").alias("slot")).select(
        "slot",
        F.when(F.col("part") % 3 == 0, 47).otherwise(snapshots.SCHEMA_VERSION).alias("schema_version"),
        (F.col("part") % 2 == 0).alias("is_remote"),
    )


@query(
    "src_resume_filter",
    ledger_sql(
        f"{_MANIFEST_SQL} select seq, name, slot, kind from l where slot > (select coalesce(max(slot), 0) from man where version = 48)"
    ),
)
def src_resume_filter(spark, sf):
    ledger = X.ledger(spark, sf)
    return snapshots.resume_from(ledger, _manifest(ledger)).select("seq", "name", "slot", "kind")
