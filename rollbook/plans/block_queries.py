"""Queries over nested blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.functions import datum as D
from rollbook.functions import scalars as S
from rollbook.operators import fold, holders, registry, search, views
from rollbook.plans.base import BLOCK_CTE, block_sql, characters_sql, query, rarity_sql
from rollbook.plans.ledger_queries import fold_sql
from rollbook.session import materialized, stored
from rollbook.sources import blocks as B
from rollbook.sources import fixtures as X

ALLOWED = "policy in ('pol0', 'pol1')"
UTXO = "concat(tx_id, '#', cast(out_pos as string))"
REG_HEX = (
    "case when code is null or code = '000' then asset else concat('000de140', substr(asset, 9)) end"
)


@query("etl_mint_explode", block_sql("select tx_id, slot, policy, asset, cast(qty as bigint) as qty from mints"))
def etl_mint_explode(spark, sf):
    return B.mints(X.blocks(spark, sf)).select("tx_id", "slot", "policy", "asset", "qty")


@query(
    "etl_output_explode",
    block_sql(f"select tx_id, slot, out_pos, {UTXO} as utxo, policy, asset, address, lovelace from ln"),
)
def etl_output_explode(spark, sf):
    return B.outputs(X.blocks(spark, sf)).select(
        "tx_id", "slot", "out_pos", "utxo", "policy", "asset", "address", "lovelace"
    )


_IS_MINT = """exists (select 1 from mints m where m.l_orderkey = ln.l_orderkey and m.policy = ln.policy
   and m.asset = ln.asset and m.qty > 0) and (code is null or code = '222')"""


@query(
    "etl_scanned_event",
    block_sql(
        f"""select asset, slot, address, {UTXO} as utxo, lovelace, datum, policy, {_IS_MINT} as is_mint,
 replace(language, ':', '_') as script_type, case when language is not null then md5(asset) end as script_cbor
from ln where {ALLOWED} and asset <> ''"""
    ),
)
def etl_scanned_event(spark, sf):
    rows = B.scanned_events(X.blocks(spark, sf), X.POLICIES)
    return rows.select(
        "asset",
        "slot",
        "address",
        "utxo",
        "lovelace",
        "datum",
        "policy",
        "is_mint",
        F.col("script.type").alias("script_type"),
        F.col("script.cbor").alias("script_cbor"),
    )


@query(
    "etl_metadata_pick",
    block_sql(
        f"""select {UTXO} as utxo, asset, meta.k as meta_key,
 case when meta.k is not null then concat('ipfs://', md5(meta.k)) end as image, length(meta.k) as og
from (select ln.*, case when code is null then text else {REG_HEX} end as want from ln) x
left join (select distinct l_orderkey as ok, policy as pol, meta_key as k from ln where qty > 0) meta
  on meta.ok = l_orderkey and meta.pol = policy and meta.k = want
where {ALLOWED} and asset <> ''"""
    ),
)
def etl_metadata_pick(spark, sf):
    rows = B.scanned_events(X.blocks(spark, sf), X.POLICIES)
    return rows.select(
        "utxo",
        "asset",
        F.when(F.col("picked").isNotNull(), B.metadata_key(F.col("asset"))).alias("meta_key"),
        F.col("picked.image").alias("image"),
        F.col("picked.core.og").alias("og"),
    )


@query("f_policy", block_sql(f"select {UTXO} as utxo, policy, asset from ln where {ALLOWED}"))
def f_policy(spark, sf):
    return B.allowed(B.outputs(X.blocks(spark, sf)), X.POLICIES).select("utxo", "policy", "asset")


@query("f_unnamed", block_sql(f"select {UTXO} as utxo, asset from ln where asset <> ''"))
def f_unnamed(spark, sf):
    return B.named(B.outputs(X.blocks(spark, sf))).select("utxo", "asset")


@query(
    "k_label_parse",
    block_sql(
        f"""select {UTXO} as utxo, asset, code as label, code is not null as is_labelled,
 case when asset <> '' then text else '' end as name, {REG_HEX} as registry_hex from ln"""
    ),
)
def k_label_parse(spark, sf):
    asset = F.col("asset")
    prefixed = F.concat(F.col("policy"), F.lit("."), asset)
    bare = S.without_policy(F.when(F.col("out_pos") % 2 == 0, prefixed).otherwise(asset))
    rows = B.outputs(X.blocks(spark, sf)).select("utxo", bare.alias("asset"))
    return rows.select(
        "utxo",
        "asset",
        S.label_of(asset).alias("label"),
        S.label_of(asset).isNotNull().alias("is_labelled"),
        S.asset_text(asset).alias("name"),
        S.registry_hex(asset).alias("registry_hex"),
    )


@query(
    "k_is_mint",
    block_sql(f"select {UTXO} as utxo, asset, {_IS_MINT} as is_mint from ln"),
)
def k_is_mint(spark, sf):
    rows = B.outputs(X.blocks(spark, sf), keep=("mint",))
    return rows.select("utxo", "asset", B.is_mint(F.col("mint"), F.col("policy"), F.col("asset")).alias("is_mint"))


_REF_CTE = f""",
refs as (select {UTXO} as utxo, asset, datum, case when json_valid(datum) and
   json_array_length(datum, '$.constructor_0') = 3 then datum end as d from ln where code in ('100', '000')),
ref as (select utxo, asset, d is not null as valid, d, d -> '$.constructor_0[0]' as a, d -> '$.constructor_0[2]' as p from refs)"""


def _references(spark, sf):
    label = S.label_of(F.col("asset"))
    return B.outputs(X.blocks(spark, sf)).where(label.isin("100", "000"))


@query(
    "k_datum_attrs",
    block_sql(
        _REF_CTE
        + """
select utxo, asset, valid,
 case when valid then coalesce(cast(a ->> '$.og_number' as bigint), 0) end as og_number,
 case when valid then coalesce(a ->> '$.image', '') end as image,
 case when valid then coalesce(p ->> '$.image_hash', '') end as image_hash,
 case when valid then coalesce(p ->> '$.standard_image_hash', '') end as standard_image_hash,
 case when valid then coalesce(p ->> '$.standard_image', '') end as standard_image,
 case when valid then coalesce(p ->> '$.svg_version', '') end as svg_version,
 p ->> '$.bg_asset' as bg_asset, p ->> '$.last_update_address' as last_update_address,
 case when valid then coalesce((p ->> '$.default'), '') in ('1', 'true') end as is_default,
 case when valid then coalesce((p ->> '$.pz_enabled'), '') in ('1', 'true') end as pz_enabled,
 cast((p ->> '$.virtual.expires_time') as bigint) as virtual_expires_time,
 case when (p -> '$.virtual') is not null then (p ->> '$.virtual.public_mint') = '1' end as virtual_public_mint,
 substr((p ->> '$.resolved_addresses.ada'), 3) as virtual_address from ref"""
    ),
)
def k_datum_attrs(spark, sf):
    rows = D.with_attributes(_references(spark, sf).select("utxo", "asset", "datum"))
    return rows.select(
        "utxo",
        "asset",
        "valid",
        *[
            f"attributes.{c}"
            for c in (
                "og_number image image_hash standard_image_hash standard_image svg_version bg_asset "
                "last_update_address is_default pz_enabled virtual_expires_time virtual_public_mint virtual_address"
            ).split()
        ],
    )


def _missing_sql(keys, side: str) -> str:
    items = ", ".join(f"'{k}'" for k in keys)
    return f"array_to_string(list_filter([{items}], lambda x: not list_contains(json_keys({side}), x)), ',')"


@query(
    "k_missing_keys",
    block_sql(
        _REF_CTE
        + f""" select utxo, asset, {_missing_sql(D.REQUIRED_METADATA, 'a')} as missing_metadata,
 {_missing_sql(D.REQUIRED_PROJECT, 'p')} as missing_project from ref where valid"""
    ),
)
def k_missing_keys(spark, sf):
    rows = _references(spark, sf).select("utxo", "asset", D.parts(F.col("datum")).alias("parts"))
    rows = rows.where(D.is_asset_datum(F.col("parts")))
    side = lambda i: F.get("parts", F.lit(i))
    return rows.select(
        "utxo",
        "asset",
        F.array_join(D.missing_keys(side(0), D.REQUIRED_METADATA), ",").alias("missing_metadata"),
        F.array_join(D.missing_keys(side(2), D.REQUIRED_PROJECT), ",").alias("missing_project"),
    )


def _settings_sql() -> str:
    blocks = [
        f"s ->> '$[{i}][{j}]' as {name}_{field}"
        for i, name in enumerate(D.SETTINGS_FIELDS[:2])
        for j, field in enumerate(D.TYPE_FIELDS)
    ]
    rest = [f"s ->> '$[{i}]' as {name}" for i, name in enumerate(D.SETTINGS_FIELDS) if i > 1]
    return f"""select utxo, asset, {', '.join(blocks + rest)} from
 (select {UTXO} as utxo, asset, case when json_valid(datum) then datum end as s from ln where code = '001')"""


@query("k_settings_struct", block_sql(_settings_sql()))
def k_settings_struct(spark, sf):
    rows = B.outputs(X.blocks(spark, sf)).where(S.label_of(F.col("asset")) == "001")
    rows = rows.select("utxo", "asset", D.settings(F.col("datum")).alias("s"))
    blocks = [
        F.col(f"s.{name}.{field}").alias(f"{name}_{field}")
        for name in D.SETTINGS_FIELDS[:2]
        for field in D.TYPE_FIELDS
    ]
    return rows.select("utxo", "asset", *blocks, *[f"s.{name}" for name in D.SETTINGS_FIELDS[2:]])


@query(
    "st_event_order",
    block_sql(
        f""",
ev as (select tx_id, slot, 0 as phase, 0 as out_pos, asset from
   (select m.*, substr(asset, 1, 8) as head from mints m) where qty = -1 and {ALLOWED}
     and head not in ('000643b0', '00001070')
 union all select tx_id, slot, 1 as phase, out_pos, asset from ln where {ALLOWED} and asset <> '')
select tx_id, slot, phase, out_pos, asset,
 cast(row_number() over (partition by tx_id order by phase, out_pos, asset) as integer) as tx_order from ev"""
    ),
)
def st_event_order(spark, sf):
    rows = B.ordered_events(X.blocks(spark, sf), X.POLICIES)
    return rows.select("tx_id", "slot", "phase", "out_pos", "asset", "tx_order")


@query(
    "st_route",
    block_sql(
        f"""select {UTXO} as utxo, asset, case when code is null or code = '222' then 'owner'
 when code = '100' then 'reference' when code = '000' then 'virtual' else 'settings' end as kind
from ln where {ALLOWED} and asset <> ''"""
    ),
)
def st_route(spark, sf):
    rows = B.named(B.allowed(B.outputs(X.blocks(spark, sf)), X.POLICIES))
    return rows.select("utxo", "asset", B.kind_of(F.col("asset")).alias("kind"))


BLOCK_LEDGER = f"""{BLOCK_CTE},
meta as (select distinct l_orderkey as ok, policy as pol, meta_key as mk from ln where qty > 0),
ord as (select l_orderkey, slot, 0 as phase, 0 as out_pos, asset, cast(null as varchar) as utxo,
   cast(null as varchar) as address, cast(null as bigint) as lovelace, cast(null as varchar) as datum,
   false as is_mint, cast(null as varchar) as code, cast(null as varchar) as hex, policy, cast(null as varchar) as mk,
   cast(null as varchar) as language from mints where qty = -1 and {ALLOWED}
   and substr(asset, 1, 8) not in ('000643b0', '00001070')
 union all select l_orderkey, slot, 1, out_pos, asset, {UTXO}, address, lovelace, datum, {_IS_MINT}, code, {REG_HEX}, policy,
   mk, language from ln left join meta on ok = l_orderkey and pol = policy
     and mk = case when code is null then text else {REG_HEX} end
   where {ALLOWED} and asset <> ''),
kinds as (select *, row_number() over (order by l_orderkey, phase, out_pos, asset) - 1 as seq,
  case when phase = 0 then 'burn' when code = '100' then 'reference' when code = '000' then 'virtual'
   when code = '001' then 'settings' when is_mint then 'mint' else 'transfer' end as kind,
  json_valid(datum) as is_json, case when json_valid(datum) then datum end as j from ord),
l as (select seq, decode(unhex(case when substr(asset, 1, 8) in ('000de140', '000643b0', '00000000', '00001070')
   then substr(asset, 9) else asset end)) as name, slot, kind,
  case when kind = 'virtual' then substr((j ->> '$.constructor_0[2].resolved_addresses.ada'), 3) else address end as holder,
  utxo, lovelace, false as is_default,
  case when kind = 'reference' and not is_json then null
   when kind = 'virtual' and not coalesce(json_array_length(j, '$.constructor_0') = 3, false) then null
   else datum end as datum, hex, policy, mk, case when language is not null then md5(asset) end as cbor from kinds)"""


@query(
    "st_block_fold",
    fold_sql(
        """select name, n_amount as amount, n_created as created_slot, n_updated as updated_slot, n_utxo as utxo,
 n_holder as holder, n_lovelace as lovelace, n_refseq as reference_seq, n_setseq as settings_seq from s""",
        ledger=BLOCK_LEDGER,
    ),
)
def st_block_fold(spark, sf):
    """The whole way: nested blocks to events, in arrival order, to the current registry."""
    fields = "amount", "created", "updated", "utxo", "holder", "lovelace", "reference_seq", "settings_seq"
    rows = B.ledger_rows(X.blocks(spark, sf), X.POLICIES, gaps=True, keep=B.PLACE)
    # counted, folded and numbered below: made once, as what these need
    events = materialized(fold.lean(fold.coded(rows), fields, keep=("place",)), "block-events", "zstd")
    state = fold.folded(events, fields).select("name", *fields)
    state = materialized(state, "block-state")  # read twice below
    return B.with_numbers(state, ("reference_seq", "settings_seq"), B.numbers_of(events.select("place.*"))).select(
        "name",
        "amount",
        F.col("created").alias("created_slot"),
        F.col("updated").alias("updated_slot"),
        "utxo",
        "holder",
        "lovelace",
        "reference_seq",
        "settings_seq",
    )


def _ledger_registry(spark, sf):
    """The registry of the block ledger: blocks, events, fold, rows; stored once."""

    def build(spark, sf):
        ledger = B.ledger_rows(X.blocks(spark, sf), X.POLICIES, gaps=True)
        events = fold.lean(fold.coded(ledger, whole=True), fold.State._fields)
        events = materialized(events, "block-events", "zstd")  # counted and folded: made once
        rows = registry.from_state(fold.folded(events, fold.State._fields))
        return rows.repartitionByRange("name").sortWithinPartitions("name")

    return stored(spark, sf, "ledger-registry", build)


# Written from the rule, not from the fold's fields: what the accepted events of an asset's life brought.
_REGISTRY_CTE = f""",
ac as (select s.name, a.seq, a.op, l.utxo, l.lovelace, l.holder, l.datum, l.hex, l.policy, l.mk, l.cbor,
  case when a.op in (2, 3) then l.datum end as rd
  from s join a on a.name = s.name and a.seq >= s.n_life and a.accepted join l on l.seq = a.seq),
fa as (select name, arg_min(struct_pack(hex, policy, mk), seq) as built,
  arg_max(rd, seq) filter (where json_array_length(rd, '$.constructor_0') = 3) as d,
  arg_max(rd, seq) filter (where op = 3) as vd,
  arg_max(struct_pack(utxo, lovelace, holder, datum), seq) filter (where op in (2, 3)) as rt,
  arg_max(struct_pack(utxo, lovelace, holder, datum), seq) filter (where op = 4) as se,
  arg_max(struct_pack(cbor), seq) filter (where op in (0, 1)) as sc from ac group by name),
w as (select s.*, fa.* exclude (name), d -> '$.constructor_0[0]' as a, d -> '$.constructor_0[2]' as p, vd -> '$.constructor_0[2]' as q,
  case when json_valid(n_setdatum) then n_setdatum end as st,
  coalesce('ipfs://' || md5(built.mk), '') as own_image from s join fa using (name)),
rg as (select name, built.hex as hex, built.policy as policy, cast(case when built.mk is null then 0 else 1 end as bigint) as version,
 n_amount as amount, n_created as created_slot,
 n_updated as updated_slot, n_utxo as utxo, n_holder as holder, n_datum is not null as has_datum,
 case when sc.cbor is not null then 'plutus_v2' end as script_type, sc.cbor as script_cbor,
 cast(length(name) as integer) as length, {rarity_sql('name')} as rarity, {characters_sql('name')} as characters,
 case when vd is not null then 'virtual_subhandle' when not contains(name, '@') then 'handle'
   else 'nft_subhandle' end as asset_type,
 case when d is not null then coalesce(cast(a ->> '$.og_number' as bigint), 0) else 0 end as og_number,
 case when d is not null then coalesce(a ->> '$.image', '') else own_image end as image,
 case when d is not null then coalesce(p ->> '$.image_hash', '') else '' end as image_hash,
 case when d is not null then coalesce(p ->> '$.standard_image', '') else own_image end as standard_image,
 case when d is not null then coalesce(p ->> '$.standard_image_hash', '') else '' end as standard_image_hash,
 case when d is not null then coalesce(p ->> '$.svg_version', '') else '0' end as svg_version,
 p ->> '$.bg_asset' as bg_asset, p ->> '$.last_update_address' as last_update_address,
 case when d is not null then coalesce((p ->> '$.pz_enabled'), '') in ('1', 'true') end as pz_enabled,
 case when d is not null then coalesce((p ->> '$.default'), '') in ('1', 'true') end as is_default,
 case when (q -> '$.virtual') is not null then cast((q ->> '$.virtual.expires_time') as bigint) end as virtual_expires_time,
 split_part(rt.utxo, '#', 1) as reference_tx, cast(split_part(rt.utxo, '#', 2) as bigint) as reference_index,
 rt.lovelace as reference_lovelace, rt.holder as reference_address, rt.datum as reference_datum,
 se.utxo as settings_utxo, se.lovelace as settings_lovelace, se.holder as settings_address,
 st ->> '$[0][0]' as nft_open, st ->> '$[2]' as buy_down_price, n_life, translate(name, '_-.@', '!"#$') as by_name from w)"""
_REGISTRY_COLUMNS = (
    "name, hex, policy, version, amount, created_slot, updated_slot, utxo, holder, has_datum, length, rarity, characters, "
    "asset_type, og_number, image, image_hash, standard_image, standard_image_hash, svg_version, bg_asset, "
    "last_update_address, pz_enabled, is_default"
)
_TOKEN_COLUMNS = (
    "script_type, script_cbor, virtual_expires_time, reference_tx, reference_index, reference_lovelace, reference_address, "
    "reference_datum, settings_utxo, settings_lovelace, settings_address, nft_open, buy_down_price"
)


@query("st_registry", fold_sql(f"{_REGISTRY_CTE} select {_REGISTRY_COLUMNS}, {_TOKEN_COLUMNS} from rg", ledger=BLOCK_LEDGER))
def st_registry(spark, sf):
    """Blocks to registry rows, with all that owner, reference, virtual and settings events brought."""
    return _ledger_registry(spark, sf).select(
        *_REGISTRY_COLUMNS.split(", "),
        F.col("script.type").alias("script_type"),
        F.col("script.cbor").alias("script_cbor"),
        F.col("virtual.expires_time").alias("virtual_expires_time"),
        *[F.col(f"reference_token.{f}").alias(f"reference_{n}") for f, n in (("tx_id", "tx"), ("index", "index"))],
        *[F.col(f"reference_token.{f}").alias(f"reference_{f}") for f in ("lovelace", "address", "datum")],
        F.concat(F.col("settings.utxo.tx_id"), F.lit("#"), F.col("settings.utxo.index")).alias("settings_utxo"),
        F.col("settings.utxo.lovelace").alias("settings_lovelace"),
        F.col("settings.utxo.address").alias("settings_address"),
        F.col("settings.nft.public_minting_enabled").alias("nft_open"),
        F.col("settings.buy_down_price").alias("buy_down_price"),
    )


@query(
    "search_ledger_page",
    fold_sql(
        f"""{_REGISTRY_CTE},
m as (select * from rg where utxo <> '' and rarity = 'common' and asset_type = 'handle'),
pick as (select holder, name as default_in_wallet from (select *, row_number() over (partition by holder order by
   case when og_number > 0 then 0 else 1 end, case when og_number > 0 then og_number else 0 end,
   length, created_slot, by_name) as place from rg where utxo <> '') where place = 1)
select name, holder, default_in_wallet, utxo, og_number, (select count(*) from m) as search_total
from (select * from m order by by_name limit 40) left join pick using (holder)""",
        ledger=BLOCK_LEDGER,
    ),
)
def search_ledger_page(spark, sf):
    """The main search over the registry that the blocks gave."""
    rows = views.live_rows(_ledger_registry(spark, sf))
    found = search.matches(rows, search.SearchSpec(rarity="common", asset_type="handle"))
    page = search.paged(found, search.PageSpec(size=40))
    best = rows.groupBy("holder").agg(holders.best_asset(rows).alias("default_in_wallet"))
    shown = page.join(best, "holder", "left")
    return shown.select("name", "holder", "default_in_wallet", "utxo", "og_number").withColumn(
        "search_total", search.search_total(found)
    )
