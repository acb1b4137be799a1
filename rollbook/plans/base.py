"""Query registration and the SQL the results are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rollbook.sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def columns_sql(expressions: dict[str, str]) -> str:
    return ",\n ".join(f"{sql} as {name}" for name, sql in expressions.items())


CATALOG_CTE = f"""b as (select *, cast(epoch(o_orderdate) as bigint) as o_epoch,
   md5(cast(o_orderkey as string)) h, substr(md5(cast(o_custkey as string)),1,6) rootname from orders),
n as (select *, {X.NAME_SQL} as name from b),
r as (select *, row_number() over (partition by name order by o_orderkey) rn from n),
c as (select {columns_sql(X.CATALOG_SQL)} from r where rn = 1)"""


def rarity_sql(col: str) -> str:
    return (
        f"case when length({col}) = 1 then 'legendary' when length({col}) = 2 then 'ultra_rare' "
        f"when length({col}) = 3 then 'rare' when length({col}) between 4 and 7 then 'common' else 'basic' end"
    )


def characters_sql(col: str) -> str:
    return (
        f"concat_ws(',', case when regexp_matches({col}, '[a-z]') then 'letters' end, "
        f"case when regexp_matches({col}, '[0-9]') then 'numbers' end, "
        f"case when {col} like '%-%' or {col} like '%.%' or contains({col}, '_') then 'special' end)"
    )


def numeric_sql(col: str) -> str:
    return (
        f"case when regexp_full_match({col}, '-[0-9]+') then 'negative' "
        f"when regexp_full_match({col}, '-[0-9]+\\.[0-9]+') then 'negative,decimal' "
        f"when regexp_full_match({col}, '[0-9]+\\.[0-9]+') then 'decimal' else '' end"
    )


REGISTRY_CTE = (
    CATALOG_CTE
    + f""",
c2 as (select *, case when contains(name,'@') then split_part(name,'@',1) end as sub_name,
   case when contains(name,'@') then split_part(name,'@',2) end as root from c),
reg as (select *, cast(length(name) as integer) as length, {rarity_sql('name')} as rarity,
   {characters_sql('name')} as characters, {numeric_sql('name')} as numeric_modifiers,
   cast(length(sub_name) as integer) as sub_length,
   case when sub_name is not null then {rarity_sql('sub_name')} end as sub_rarity,
   case when sub_name is not null then {characters_sql('sub_name')} end as sub_characters,
   case when sub_name is not null then {numeric_sql('sub_name')} end as sub_numeric_modifiers,
   case when contains(name,'@') then sub_kind else 'handle' end as asset_type,
   datum is not null as has_datum,
   translate(name, '_-.@', '!"#$') as by_name from c2)"""
)

HOLDERS_CTE = """,
ranked as (select *, row_number() over (partition by holder order by
   case when og_number > 0 then 0 else 1 end, case when og_number > 0 then og_number else 0 end,
   length, created_slot, by_name) as pref from reg),
hold as (select holder, count(*) as total_handles, max(case when pref = 1 then name end) as default_handle,
   min(holder_type) as type, min(known_owner_name) as known_owner_name from ranked group by holder)"""

LEDGER_CTE = """l as (select event_id as seq,
  concat('h', json_extract_string(props,'$.k'), '_', cast(user_id % 10 as string)) as name,
  cast(floor(epoch_us(ts)/1000000) as bigint) - 1704067200
    - case when event_id % 11 = 0 then 7200 else 0 end as slot,
  case event_type when 'signup' then 'mint' when 'click' then 'transfer' when 'purchase' then 'reference'
                  when 'view' then 'settings' else 'burn' end as kind,
  concat('stake', cast(user_id as string)) as holder,
  concat(md5(cast(event_id as string)), '#', cast(event_id % 4 as string)) as utxo,
  cast(round(value * 100) as bigint) as lovelace,
  event_id % 3 = 0 as is_default,
  case when event_id % 13 = 0 then null else props end as datum
from events),
ctl as (select seq as bseq, slot - 20000 as bslot from l where seq % 500 = 499)"""

BLOCK_CTE = f"""ln0 as (select *, {columns_sql(X.LINE_SQL)} from lineitem),
ln1 as (select *, {X.ASSET_SQL} as asset from ln0),
ln2 as (select *, {X.META_KEY_SQL} as meta_key, {X.DATUM_SQL} as datum, {X.LANGUAGE_SQL} as language from ln1),
ln as (select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1
      as integer) as out_pos,
    md5(cast(l_orderkey as string)) as tx_id,
    cast(floor(epoch(o_orderdate) / 86400) * 86400 as bigint) as slot,
    case when label = '000de140' then '222' when label = '000643b0' then '100'
         when label = '00000000' then '000' when label = '00001070' then '001' end as code
    from ln2 join orders on l_orderkey = o_orderkey),
mints as (select l_orderkey, tx_id, slot, policy, asset, max(qty) as qty from ln where qty <> 0
    group by l_orderkey, tx_id, slot, policy, asset)"""


def reg_sql(body: str) -> str:
    return f"with {REGISTRY_CTE} {body}"


def hold_sql(body: str) -> str:
    return f"with {REGISTRY_CTE}{HOLDERS_CTE} {body}"


def ledger_sql(body: str) -> str:
    return f"with {LEDGER_CTE} {body}"


def block_sql(body: str) -> str:
    return f"with {BLOCK_CTE} {body}"
