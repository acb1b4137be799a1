"""Queries over the catalog: filters, views, lookups, rollups, pages, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions import scalars as S
from rollbook.operators import enrich, holders, lookups, views
from rollbook.operators import search as Q
from rollbook.plans.base import hold_sql, query, reg_sql
from rollbook.session import read_table
from rollbook.sources import fixtures as X

LIVE = "utxo <> ''"


def _search(name: str, where: str, **spec):
    sql = reg_sql(f"select asset_id, name, utxo from reg where {LIVE} and {where}")

    @query(name, sql)
    def run(spark, sf):
        rows = Q.matches(X.registry(spark, sf), Q.SearchSpec(**spec))
        return rows.select("asset_id", "name", "utxo")


_search("f_live", "true")
_search("f_characters", "characters = 'letters,numbers'", characters="letters,numbers")
_search("f_length", "length = 6", length=6)
_search("f_length_range", "length between 3 and 6", length="3-6")
_search("f_rarity", "rarity = 'rare'", rarity="rare")
_search("f_numeric_mod", "numeric_modifiers = 'negative'", numeric_modifiers="negative")
_search("f_og", "og_number <> 0", og=True)


@query("f_holder", reg_sql(f"select asset_id, name, utxo from reg where {LIVE} and holder = 'stake7'"))
def f_holder(spark, sf):
    """The holder filter, from the copy clustered by holder."""
    rows = lookups.at_key(X.registry_by(spark, sf, "holder"), "stake7")
    return Q.matches(rows, Q.SearchSpec(holder="stake7")).select("asset_id", "name", "utxo")


def _search_postings(name: str, text: str):
    @query(name, reg_sql(f"select asset_id, name, utxo from reg where {LIVE} and (contains(name, '{text}') or contains(hex, '{text}'))"))
    def run(spark, sf):
        return views.live_rows(Q.search_postings(X.search_index(spark, sf), text)).select("asset_id", "name", "utxo")


_search_postings("f_search_postings", "616")
_search_postings("f_search_postings_long", "2d36")


_search(
    "f_search_indexed",
    "rarity = 'basic' and contains(name, 'a61')",
    rarity="basic",
    search="a61",
)
_search("f_search_any", "(contains(name, '616') or contains(hex, '616'))", search="616")
_search("f_type", "asset_type = 'nft_subhandle'", asset_type="nft_subhandle")
_search("f_personalized", "image_hash <> standard_image_hash", personalized=True)
_search(
    "f_conjunction",
    "rarity = 'basic' and characters = 'letters,numbers' and length between 8 and 12 "
    "and image_hash <> standard_image_hash and asset_type = 'handle'",
    rarity="basic",
    characters="letters,numbers",
    length="8-12",
    personalized=True,
    asset_type="handle",
)
_search("f_no_match", "rarity = 'legendary' and length between 8 and 12", rarity="legendary", length="8-12")


@query(
    "f_name_list",
    reg_sql(
        f"select asset_id, name from reg where {LIVE} and name in "
        "(select substr(md5(cast(c_custkey as string)),1,6) from customer)"
    ),
)
def f_name_list(spark, sf):
    wanted = read_table(spark, sf, "customer").select(
        F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 6).alias("name")
    )
    return Q.matches(X.registry(spark, sf), Q.SearchSpec(names=wanted)).select("asset_id", "name")


@query(
    "f_public_mint",
    reg_sql(
        f"select name from reg where {LIVE} and name in (select root from reg) "
        "and (mint_open_virtual or mint_open_nft)"
    ),
)
def f_public_mint(spark, sf):
    rows = views.live_rows(lookups.roots(X.registry(spark, sf))).withColumn("settings", views.settings())
    open_for_all = F.col("settings.virtual.public_minting_enabled") | F.col(
        "settings.nft.public_minting_enabled"
    )
    return rows.where(open_for_all).select("name")


@query(
    "f_subtype",
    reg_sql(
        "select s.name, s.root from reg s join reg r on s.root = r.name "
        "where s.asset_type = 'virtual_subhandle'"
    ),
)
def f_subtype(spark, sf):
    subs = lookups.sub_assets(X.registry(spark, sf))
    return subs.where(F.col("asset_type") == S.TYPE_VIRTUAL_SUB).select("name", "root")


def _param_error_sql() -> str:
    m = {k: v.replace("'", "''") for k, v in Q.MESSAGES.items()}

    def subset(allowed):
        items = ", ".join(f"'{a}'" for a in allowed)
        return f"len(list_filter(string_split(value, ','), lambda x: x not in ({items}))) = 0"

    def one_of(allowed):
        return "value in (" + ", ".join(f"'{a}'" for a in allowed) + ")"

    length = (
        "(regexp_full_match(value, '[0-9]+(-[0-9]+)?') "
        "and list_max(list_transform(string_split(value, '-'), lambda x: try_cast(x as integer))) <= 28)"
    )
    return f"""with q as (select c_custkey as request_id, {X.PARAM_SQL['param']} as param,
  {X.PARAM_SQL['value']} as value from customer)
select request_id, param, value, case
 when param = 'records_per_page' and not regexp_full_match(value, '[0-9]+') then '{m['records_per_page']}'
 when param = 'sort' and not {one_of(S.SORTS)} then '{m['sort']}'
 when param = 'characters' and not {subset(S.CHARACTER_CLASSES)} then '{m['characters']}'
 when param = 'length' and not {length} then '{m['length']}'
 when param = 'rarity' and not {one_of(S.RARITIES)} then '{m['rarity']}'
 when param = 'numeric_modifiers' and not {subset(S.NUMERIC_MODIFIERS)} then '{m['numeric_modifiers']}'
 when param = 'handle_type' and not {one_of(S.ASSET_TYPES)} then '{m['handle_type']}'
 when param = 'search' and length(value) < 3 then '{m['search']}' end as error from q"""


@query("f_param_check", _param_error_sql())
def f_param_check(spark, sf):
    asked = X.param_requests(spark, sf)
    return asked.withColumn("error", Q.param_error(F.col("param"), F.col("value")))


# ------------------------------------------------------------------ views


@query(
    "p_asset_view",
    hold_sql(
        """select hex, name, image, coalesce(standard_image, image) as standard_image, g.holder, holder_type,
 length, og_number, rarity, utxo, characters, numeric_modifiers, h.default_handle as default_in_wallet,
 pfp_image, bg_image, last_update_address, original_address, last_edited_time,
 replace(pfp_asset, '0x', '') as pfp_asset, substr(bg_asset, 3) as bg_asset, address as resolved_ada,
 created_slot as created_slot_number, updated_slot as updated_slot_number, has_datum,
 coalesce(svg_version, '0') as svg_version, substr(image_hash, 3) as image_hash,
 substr(standard_image_hash, 3) as standard_image_hash, coalesce(version, 0) as version,
 asset_type as handle_type, payment_key_hash,
 case when pz_enabled is not null then pz_enabled when asset_type = 'handle' then true end as pz_enabled,
 sub_rarity, sub_length, sub_characters, sub_numeric_modifiers,
 case when asset_type = 'virtual_subhandle' then created_slot + 31536000 end as virtual_expires_time,
 case when asset_type = 'virtual_subhandle' then mint_open_virtual end as virtual_public_mint, policy
from reg g left join hold h on g.holder = h.holder where utxo <> ''"""
    ),
)
def p_asset_view(spark, sf):
    reg = X.registry(spark, sf)
    rows = holders.with_default(reg, holders.holder_rollup(reg))
    return views.asset_view(rows).withColumns(
        {
            "resolved_ada": F.col("resolved_addresses")["ada"],
            "virtual_expires_time": F.col("virtual.expires_time"),
            "virtual_public_mint": F.col("virtual.public_mint"),
        }
    ).drop("resolved_addresses", "virtual")


@query(
    "p_pz_enabled",
    reg_sql(
        f"select name, coalesce(pz_enabled, case when asset_type = 'handle' then true end) as pz_enabled "
        f"from reg where {LIVE}"
    ),
)
def p_pz_enabled(spark, sf):
    rows = views.live_rows(X.registry(spark, sf))
    return rows.select("name", S.pz_flag(F.col("pz_enabled"), F.col("asset_type")).alias("pz_enabled"))


@query(
    "p_utxo",
    reg_sql(
        f"""select name, split_part(utxo,'#',1) as tx_id, cast(split_part(utxo,'#',2) as integer) as "index",
 lovelace, address, datum, script_cbor as reference_script from reg where {LIVE}"""
    ),
)
def p_utxo(spark, sf):
    return views.utxo_view(X.registry(spark, sf))


@query(
    "p_reference",
    reg_sql(
        f"""select name, case when datum is not null then md5(concat('r', cast(asset_id as string))) end as tx_id,
 case when datum is not null then asset_id % 3 end as "index", case when datum is not null then lovelace end as lovelace,
 datum, case when datum is not null then address end as address from reg where {LIVE}"""
    ),
)
def p_reference(spark, sf):
    rows = views.live_rows(X.registry(spark, sf)).withColumn("token", views.reference_token())
    return rows.select("name", "token.*")


_CONTENT_CTE = """,
doc as (select md5(cast(doc_id as string)) as cid, text as body from documents
  where doc_id % 3 <> 0 or doc_id % 5 <> 0)"""


def _facts():
    return {"md5": F.md5("body"), "chars": F.length("body")}


@query(
    "enrich_content",
    reg_sql(
        f"""{_CONTENT_CTE}
select name, md5(p.body) as portal_md5, cast(length(p.body) as integer) as portal_chars, md5(d.body) as designer_md5,
 cast(length(d.body) as integer) as designer_chars, md5(s.body) as socials_md5, cast(length(s.body) as integer) as socials_chars
from reg left join doc p on portal_link = concat('ipfs://', p.cid)
 left join doc d on designer_link = concat('ipfs://', d.cid)
 left join doc s on socials_link = concat('ipfs://', s.cid)"""
    ),
)
def enrich_content(spark, sf):
    content = enrich.content_facts(*X.content(spark, sf), _facts())
    rows = X.registry(spark, sf).select("name", "portal_link", "designer_link", "socials_link")
    parts = ("portal", "designer", "socials")
    rows = enrich.resolve(rows, "name", {part: F.col(f"{part}_link") for part in parts}, content)
    return rows.select("name", *[F.col(f"{p}.{fact}").alias(f"{p}_{fact}") for p in parts for fact in ("md5", "chars")])


@query(
    "p_personalization",
    reg_sql(
        f"""{_CONTENT_CTE},
t as (select name, json_array_length(datum, '$.constructor_0') = 3 as ok, datum from reg
  where {LIVE} and datum is not null),
a as (select name, case when ok then json_extract_string(datum, '$.constructor_0[2].validated_by') else '' end as validated_by,
  case when ok then json_extract_string(datum, '$.constructor_0[2].trial') else 'true' end as trial,
  case when ok then json_extract_string(datum, '$.constructor_0[2].nsfw') else 'true' end as nsfw,
  case when ok then json_extract_string(datum, '$.constructor_0[2].portal') end as portal,
  case when ok then json_extract_string(datum, '$.constructor_0[2].designer') end as designer from t)
select name, validated_by, trial, nsfw, md5(p.body) as portal_md5, md5(d.body) as designer_md5
from a left join doc p on portal = concat('ipfs://', p.cid) left join doc d on designer = concat('ipfs://', d.cid)"""
    ),
)
def p_personalization(spark, sf):
    content = enrich.content_facts(*X.content(spark, sf), _facts())
    rows = enrich.personalization(X.registry(spark, sf), content)
    return rows.select(
        "name",
        "validated_by",
        "trial",
        "nsfw",
        F.col("portal_facts.md5").alias("portal_md5"),
        F.col("designer_facts.md5").alias("designer_md5"),
    )


@query(
    "p_script",
    reg_sql("select name, 'plutus_v2' as type, script_cbor as cbor from reg where script_cbor is not null"),
)
def p_script(spark, sf):
    rows = X.registry(spark, sf).withColumn("script", views.script())
    return rows.where(F.col("script").isNotNull()).select("name", "script.*")


@query(
    "p_settings",
    reg_sql(
        f"""select name, mint_open_nft as nft_open, mint_open_virtual as virtual_open,
 concat('[[', cast(asset_id as string), ']]') as raw_datum, md5(concat('t', cast(asset_id as string))) as utxo_tx_id,
 asset_id % 2 as utxo_index, lovelace as utxo_lovelace, address as utxo_address
from reg where {LIVE} and name in (select root from reg)"""
    ),
)
def p_settings(spark, sf):
    rows = views.live_rows(lookups.roots(X.registry(spark, sf))).withColumn("s", views.settings())
    return rows.select(
        "name",
        F.col("s.nft.public_minting_enabled").alias("nft_open"),
        F.col("s.virtual.public_minting_enabled").alias("virtual_open"),
        F.col("s.utxo.datum").alias("raw_datum"),
        F.col("s.utxo.tx_id").alias("utxo_tx_id"),
        F.col("s.utxo.index").alias("utxo_index"),
        F.col("s.utxo.lovelace").alias("utxo_lovelace"),
        F.col("s.utxo.address").alias("utxo_address"),
    )


@query("p_datum", reg_sql(f"select name, datum from reg where {LIVE} and datum is not null"))
def p_datum(spark, sf):
    return views.live_rows(X.registry(spark, sf)).where(F.col("has_datum")).select("name", "datum")


@query(
    "p_default_in_wallet",
    hold_sql(
        "select g.name, g.holder, h.default_handle as default_in_wallet "
        "from reg g left join hold h on g.holder = h.holder"
    ),
)
def p_default_in_wallet(spark, sf):
    reg = X.registry(spark, sf)
    rows = reg.select("name", "holder").withColumn("stored_default", F.lit(""))
    return holders.with_default(rows, holders.holder_rollup(reg)).drop("stored_default")


_HOLDER_VIEW = f"""select total_handles, coalesce(picked, default_handle) as default_handle,
 picked is not null as manually_set, hold.holder as address, known_owner_name, type from hold
 left join (select holder, arg_max(name, asset_id) as picked from reg where {X.PICK_SQL} group by holder) p
 on p.holder = hold.holder"""


def _holder_view(spark, sf):
    reg = X.registry(spark, sf)
    held = reg.withColumn("last_saved_seq", F.col("asset_id"))
    return holders.manual_defaults(held, X.default_picks(reg)).select(
        "total_handles", "default_handle", "manually_set", F.col("holder").alias("address"), "known_owner_name", "type"
    )


@query("p_holder_view", hold_sql(_HOLDER_VIEW))
def p_holder_view(spark, sf):
    return _holder_view(spark, sf)


@query(
    "p_root_view",
    hold_sql(
        f"""select name, hex, g.holder, rarity, utxo, default_handle as default_in_wallet,
 mint_open_nft as nft_open, mint_open_virtual as virtual_open
from reg g left join hold h on g.holder = h.holder where {LIVE} and name in (select root from reg)"""
    ),
)
def p_root_view(spark, sf):
    reg = X.registry(spark, sf)
    rows = lookups.roots(reg).withColumn("settings", views.settings())
    rows = views.live_rows(holders.with_default(rows, holders.holder_rollup(reg)))
    return rows.select(
        "name",
        "hex",
        "holder",
        "rarity",
        "utxo",
        "default_in_wallet",
        F.col("settings.nft.public_minting_enabled").alias("nft_open"),
        F.col("settings.virtual.public_minting_enabled").alias("virtual_open"),
    )


# ------------------------------------------------------------------ lookups

_REQUEST_CTE = f""",
req as (select asset_id as request_id, name from c union all
 select c_custkey + 1000000000000 as request_id, {X.REQUEST_SQL} as name from customer)"""


@query(
    "j_by_name",
    reg_sql(
        f"{_REQUEST_CTE} select request_id, req.name, utxo, rarity from req left join reg on req.name = reg.name"
    ),
)
def j_by_name(spark, sf):
    return lookups.by_name(X.requests(spark, sf), X.registry(spark, sf), ["utxo", "rarity"])


_ASKED_HEX = "case when asset_id % 5 = 0 then concat('000643b0', lower(hex(name))) else hex end"


@query(
    "j_by_hex",
    reg_sql(
        f"""select asset_id as request_id, {_ASKED_HEX} as asked_hex,
 case when asset_id % 5 <> 0 then name end as name from reg"""
    ),
)
def j_by_hex(spark, sf):
    reg = X.registry(spark, sf)
    asked = reg.select(F.col("asset_id").alias("request_id"), F.expr(_ASKED_HEX).alias("asked_hex"))
    return lookups.by_hex(asked, reg)


def _asked_holders(spark, sf):
    key = F.col("c_custkey").cast("string")
    return (
        read_table(spark, sf, "customer")
        .where(F.col("c_custkey") % 3 == 0)
        .select(
            F.concat(F.lit("stake"), key).alias("address"),
            F.md5(F.concat(F.lit("sk"), key)).alias("stake_hash"),
        )
    )


_ASKED_CTE = """,
asked as (select concat('stake', cast(c_custkey as string)) as address,
  md5(concat('sk', cast(c_custkey as string))) as stake_hash from customer where c_custkey % 3 = 0),
staked as (select name, case when id_hash is not null then substr(id_hash, 37)
  else md5(unhex(stake_key_hash)) end as stake_key from reg)"""


@query(
    "j_by_holder",
    reg_sql(
        f"""{_ASKED_CTE} select name from reg where holder in (select address from asked)
 union select name from staked where stake_key in (select md5(unhex(stake_hash)) from asked)"""
    ),
)
def j_by_holder(spark, sf):
    copies = (X.registry_by(spark, sf, key) for key in ("holder", "stake_key"))
    return lookups.by_holder(*copies, _asked_holders(spark, sf))


@query(
    "j_by_stake_hash",
    reg_sql(
        f"{_ASKED_CTE} select name from staked where stake_key in (select md5(unhex(stake_hash)) from asked)"
    ),
)
def j_by_stake_hash(spark, sf):
    return lookups.by_stake_hash(X.registry_by(spark, sf, "stake_key"), _asked_holders(spark, sf).select("stake_hash"))


@query(
    "j_by_payment_key",
    reg_sql(
        "select name from reg where payment_key_hash in "
        "(select md5(concat('pk', cast(c_custkey as string), '_1')) from customer)"
    ),
)
def j_by_payment_key(spark, sf):
    keys = read_table(spark, sf, "customer").select(
        F.md5(F.concat(F.lit("pk"), F.col("c_custkey").cast("string"), F.lit("_1")))
    )
    return lookups.at_keys(X.registry_by(spark, sf, "payment_key_hash"), keys).select("name")


@query(
    "j_by_address",
    reg_sql(
        "select name from reg where address in "
        "(select concat('addr', cast(c_custkey as string), '_', cast(c_custkey % 5 as string)) from customer)"
    ),
)
def j_by_address(spark, sf):
    key = F.col("c_custkey")
    keys = read_table(spark, sf, "customer").select(
        F.concat(F.lit("addr"), key.cast("string"), F.lit("_"), (key % 5).cast("string"))
    )
    return lookups.at_keys(X.registry_by(spark, sf, "address"), keys).select("name")


_ASKED_ASSET = "concat(case cast(asset_id % 3 as int) when 0 then '000643b0' when 1 then 'pol1.000de140' else '' end, lower(hex(name)))"


@query(
    "j_by_asset_hex",
    reg_sql("select name, hex from reg where asset_id % 2 = 0"),
)
def j_by_asset_hex(spark, sf):
    reg = X.registry(spark, sf)
    asked = reg.where(F.col("asset_id") % 2 == 0).select(F.expr(_ASKED_ASSET).alias("asset"))
    return reg.join(lookups.names_of_assets(asked), "name", "left_semi").select("name", "hex")


def _numbered(page: DataFrame, *order) -> DataFrame:
    """Position on a page (at most 1000 rows, so one task is enough)."""
    return page.withColumn("position", F.row_number().over(Window.orderBy(*order)))


@query(
    "j_list_search",
    reg_sql(
        f"""{_ASKED_CTE}, found as (select name from reg where holder in (select address from asked)
 union select name from staked where stake_key in (select md5(unhex(stake_hash)) from asked))
select name, cast(row_number() over (order by by_name desc) as integer) as position, (select count(*) from reg
   where {LIVE} and rarity = 'basic' and name in (select name from found)) as search_total
from reg where {LIVE} and rarity = 'basic' and name in (select name from found) order by by_name desc limit 200"""
    ),
)
def j_list_search(spark, sf):
    reg = X.registry(spark, sf)
    copies = (X.registry_by(spark, sf, key) for key in ("holder", "stake_key"))
    names = lookups.by_holder(*copies, _asked_holders(spark, sf))
    rows = Q.matches(reg, Q.SearchSpec(rarity="basic", names=names)).select("name")
    page = Q.PageSpec(sort="desc", size=200)
    numbered = _numbered(Q.paged(rows, page), *Q.order_columns(page))
    return numbered.withColumn("search_total", Q.search_total(rows))


@query(
    "j_subassets",
    reg_sql("select r.asset_id as root_id, s.root, s.name from reg s join reg r on s.root = r.name"),
)
def j_subassets(spark, sf):
    return lookups.sub_assets(X.registry(spark, sf)).select("root_id", "root", "name")


@query("j_roots", reg_sql("select asset_id, name from reg where name in (select root from reg)"))
def j_roots(spark, sf):
    return lookups.roots(X.registry(spark, sf)).select("asset_id", "name")


_WORDS_SQL = " union all ".join(f"select '{w}' as word, {c} as code" for w, c in X.DENIED_WORDS.items())


@query(
    "j_availability",
    reg_sql(
        f"""{_REQUEST_CTE},
words as ({_WORDS_SQL} union all select {X.RESERVED_SQL}, {X.RESERVED_CODE} from customer where c_custkey % 7 = 2),
asked_names as (select distinct req.name from req left join reg on req.name = reg.name where reg.name is null
  and (regexp_full_match(req.name, '[a-z0-9_.-]{{2,15}}') or
   (regexp_full_match(req.name, '[a-z0-9_.-]+@[a-z0-9_.-]{{2,15}}') and length(req.name) <= 28))),
coded as (select name, min(code) as code from asked_names join words on contains(name, word) group by name)
select request_id, req.name, case when utxo <> '' then 200 when utxo is not null then 404
 when asked_names.name is null then 406 else coalesce(coded.code, 404) end as code
from req left join reg on req.name = reg.name left join asked_names on asked_names.name = req.name
 left join coded on coded.name = req.name"""
    ),
)
def j_availability(spark, sf):
    return lookups.availability(X.requests(spark, sf), X.registry(spark, sf), X.denied_words(spark, sf))


# ------------------------------------------------------------------ rollups


@query("a_holder_rollup", hold_sql("select holder, total_handles, default_handle, type, known_owner_name from hold"))
def a_holder_rollup(spark, sf):
    return holders.holder_rollup(X.registry(spark, sf))


@query("a_default_asset", hold_sql("select holder, default_handle from hold"))
def a_default_asset(spark, sf):
    reg = X.registry(spark, sf)
    return reg.groupBy("holder").agg(holders.best_asset(reg).alias("default_handle"))


@query("a_totals", reg_sql("select count(*) as assets, count(distinct holder) as holders from reg"))
def a_totals(spark, sf):
    reg = X.registry(spark, sf)
    return reg.agg(F.count(F.lit(1)).alias("assets"), F.countDistinct("holder").alias("holders"))


POSTINGS = {
    "rarity": ("rarity", lambda: F.col("rarity")),
    "characters": ("characters", lambda: F.col("characters")),
    "numeric_modifier": ("numeric_modifiers", lambda: F.col("numeric_modifiers")),
    "length": ("length", lambda: F.col("length")),
    "og": ("case when og_number = 0 then 0 else 1 end", lambda: F.when(F.col("og_number") == 0, 0).otherwise(1)),
    "root": ("root", lambda: F.col("root")),
    "address": ("address", lambda: F.col("address")),
    "payment_key_hash": ("payment_key_hash", lambda: F.col("payment_key_hash")),
    "stake_key_hash": (
        "coalesce(substr(id_hash, 37), md5(unhex(stake_key_hash)))",
        lambda: lookups.stake_key(),
    ),
}


def _posting(index: str, sql: str, key):
    @query(
        f"a_postings_{index}",
        reg_sql(
            f"select key, count(*) as names from (select cast({sql} as string) as key from reg) "
            "where key is not null group by key"
        ),
    )
    def run(spark, sf):
        keyed = X.registry(spark, sf).select(key().cast("string").alias("key"))
        return keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("names"))


for _index, (_sql, _key) in POSTINGS.items():
    _posting(_index, _sql, _key)


@query(
    "a_search_total",
    reg_sql(
        f"""select name, (select count(*) from reg where {LIVE} and characters = 'letters') as search_total
 from reg where {LIVE} and characters = 'letters' order by by_name limit 100"""
    ),
)
def a_search_total(spark, sf):
    rows = Q.matches(X.registry(spark, sf), Q.SearchSpec(characters="letters")).select("name")
    return Q.paged(rows, Q.PageSpec()).withColumn("search_total", Q.search_total(rows))


# ------------------------------------------------------------------ order and pages


def _page(name: str, page: Q.PageSpec, order_sql: str, tail: str, where: str = "true"):
    sql = reg_sql(
        f"select name, updated_slot, cast(row_number() over (order by {order_sql}) as integer) as position from "
        f"(select * from reg where {LIVE} and {where} order by {order_sql} {tail})"
    )

    @query(name, sql)
    def run(spark, sf):
        rows = views.live_rows(X.registry(spark, sf)).select("name", "updated_slot")
        return _numbered(Q.paged(rows, page), *Q.order_columns(page))


_page("s_name_asc", Q.PageSpec(size=Q.MAX_PAGE), "by_name", "limit 1000")
_page("s_name_desc", Q.PageSpec(size=Q.MAX_PAGE, sort="desc"), "by_name desc", "limit 1000")
_page("s_page", Q.PageSpec(page=3), "by_name", "limit 100 offset 200")
_page(
    "s_slot_cursor",
    Q.PageSpec(slot=120009600, size=250),
    "updated_slot, by_name",
    "limit 250",
    "updated_slot >= 120009600",
)
_page(
    "s_slot_cursor_desc",
    Q.PageSpec(slot=120009600, size=250, sort="desc"),
    "updated_slot desc, by_name",
    "limit 250",
    "updated_slot <= 120009600",
)
_page("s_keyset", Q.PageSpec(after="h_x"), "by_name", "limit 100", "by_name > 'h!x'")
_page("s_keyset_desc", Q.PageSpec(after="h_x", sort="desc"), "by_name desc", "limit 100", "by_name < 'h!x'")


@query("s_random", reg_sql(f"select name from reg where {LIVE}"))
def s_random(spark, sf):
    """All names in the random order of a seed."""
    rows = views.live_rows(X.registry(spark, sf)).select("name")
    return Q.paged(rows, Q.PageSpec(sort="random", show_all=True))


_SHUFFLED = "md5(concat('42:', name)), name"
_page("s_random_page", Q.PageSpec(sort="random", page=2), _SHUFFLED, "limit 100 offset 100")
_page("s_random_after", Q.PageSpec(sort="random", after="h_x"), _SHUFFLED, "limit 100", "md5(concat('42:', name)) > md5('42:h_x')")


@query(
    "s_show_all",
    reg_sql(f"select name from reg where {LIVE} order by by_name limit 1000000000 offset 100"),
)
def s_show_all(spark, sf):
    rows = views.live_rows(X.registry(spark, sf)).select("name")
    return Q.paged(rows, Q.PageSpec(page=2, show_all=True))


@query(
    "s_holders_page",
    hold_sql(
        f"""select *, cast(row_number() over (order by total_handles desc, address) as integer) as position from (
 {_HOLDER_VIEW} order by total_handles desc, address limit 100 offset 100)"""
    ),
)
def s_holders_page(spark, sf):
    order = [F.col("total_handles").desc(), F.col("address")]
    view = _holder_view(spark, sf)
    return _numbered(view.orderBy(*order).offset(100).limit(100), *order)


# ------------------------------------------------------------------ sets


@query(
    "set_intersect",
    reg_sql("select name from reg where rarity = 'basic' intersect select name from reg where characters = 'letters'"),
)
def set_intersect(spark, sf):
    reg = X.registry(spark, sf)
    return (
        reg.where(F.col("rarity") == "basic")
        .select("name")
        .intersect(reg.where(F.col("characters") == "letters").select("name"))
    )


@query("set_union", reg_sql("select name from reg where length between 2 and 4 union all select name from reg where og_number > 0"))
def set_union(spark, sf):
    reg = X.registry(spark, sf)
    short = reg.where(Q.length_between(F.col("length"), "2-4")).select("name")
    return short.unionByName(reg.where(F.col("og_number") != 0).select("name"))


@query(
    "set_distinct",
    reg_sql("select name from reg where length between 2 and 4 union select name from reg where og_number > 0"),
)
def set_distinct(spark, sf):
    return set_union(spark, sf).distinct()


# ------------------------------------------------------------------ scalars


def _scalar(name: str, sql: str, make):
    @query(name, reg_sql(f"select {sql} from reg"))
    def run(spark, sf):
        return X.registry(spark, sf).select(*make())


_scalar("k_rarity", "name, rarity", lambda: ["name", S.rarity(F.col("name")).alias("rarity")])
_scalar("k_characters", "name, characters", lambda: ["name", S.characters(F.col("name")).alias("characters")])
_scalar(
    "k_numeric_mod",
    "name, numeric_modifiers",
    lambda: ["name", S.numeric_modifiers(F.col("name")).alias("numeric_modifiers")],
)
_scalar("k_lengths", "name, length, sub_length", lambda: ["name", "length", "sub_length"])
_scalar(
    "k_root_split",
    "name, root, sub_name, sub_rarity, sub_characters, sub_numeric_modifiers",
    lambda: ["name", "root", "sub_name", "sub_rarity", "sub_characters", "sub_numeric_modifiers"],
)
_scalar(
    "k_hex_text",
    "hex, name as decoded, lower(hex(name)) as encoded",
    lambda: [
        "hex",
        S.asset_text(F.col("hex")).alias("decoded"),
        S.text_to_hex(F.col("name")).alias("encoded"),
    ],
)
_scalar(
    "k_md5_hex",
    "name, md5(unhex(stake_key_hash)) as stake_hash",
    lambda: ["name", S.md5_of_hex(F.col("stake_key_hash")).alias("stake_hash")],
)
_scalar(
    "k_type",
    """name, asset_type, case when asset_id % 4 = 0 and contains(name, '@') then 'virtual_subhandle'
 when contains(name, '@') then 'nft_subhandle' else 'handle' end as type_from_hex""",
    lambda: [
        "name",
        "asset_type",
        S.type_from_hex(
            F.expr("case when asset_id % 4 = 0 and name like '%@%' then concat('00000000', hex) else hex end"),
            F.col("name"),
        ).alias("type_from_hex"),
    ],
)

_BROKEN_HEX = "case when asset_id % 17 = 0 then concat(hex, '00') else hex end"
_scalar(
    "k_hex_check",
    f"name, {_BROKEN_HEX} as hex, asset_id % 17 <> 0 as valid",
    lambda: [
        "name",
        F.expr(_BROKEN_HEX).alias("hex"),
        S.hex_matches_name(F.expr(_BROKEN_HEX), F.col("name")).alias("valid"),
    ],
)


@query(
    "k_defaults",
    reg_sql(
        """select name, coalesce(amount, 1) as amount, og_number, coalesce(standard_image, image) as standard_image,
 coalesce(svg_version, '0') as svg_version, coalesce(version, 0) as version, utxo, lovelace from reg"""
    ),
)
def k_defaults(spark, sf):
    return views.filled(X.registry(spark, sf)).select(
        "name", "amount", "og_number", "standard_image", "svg_version", "version", "utxo", "lovelace"
    )


# ------------------------------------------------------------------ sinks over the catalog


@query(
    "snap_prune",
    reg_sql(
        """select asset_id, name, hex from reg where not (hex like '000de140%' or hex like '00000000%'
 or created_slot >= 97958246 or updated_slot >= 97958246)"""
    ),
)
def snap_prune(spark, sf):
    from rollbook.sources.snapshots import prune

    return prune(X.registry(spark, sf), cutoff=97958246).select("asset_id", "name", "hex")
