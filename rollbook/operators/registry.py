"""Registry rows from the folded ledger: what the fold keeps, and all that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import datum as D
from rollbook.functions import scalars as S
from rollbook.operators.fold import PLACE_MARK

# What a reference event overwrites (functions/datum.py) and a row shows.
ATTRIBUTES = (
    "og_number image image_hash standard_image_hash standard_image svg_version bg_image bg_asset pfp_image pfp_asset "
    "last_update_address original_address id_hash pz_enabled last_edited_time"
).split()


def name_columns(name: Column) -> dict[str, Column]:
    """The columns that follow from a name when a row is built."""
    sub = S.sub_part(name)
    has_root = sub.isNotNull()
    return {
        "length": F.length(name),
        "rarity": S.rarity(name),
        "characters": S.characters(name),
        "numeric_modifiers": S.numeric_modifiers(name),
        "root": S.root_part(name),
        "sub_name": sub,
        "sub_length": F.length(sub),
        "sub_rarity": F.when(has_root, S.rarity(sub)),
        "sub_characters": F.when(has_root, S.characters(sub)),
        "sub_numeric_modifiers": F.when(has_root, S.numeric_modifiers(sub)),
    }


#: What a row is built from (``blocks.ledger_rows``), and a script.
BUILT_SQL = "hex string, policy string, image string, version long"
SCRIPT_SQL = "type string, cbor string"


def _token(place: Column, datum: Column) -> Column:
    """The output a reference or settings event came with."""
    parts = F.split(place, PLACE_MARK)
    utxo = parts[0]
    token = F.struct(
        S.utxo_tx(utxo).alias("tx_id"),
        S.utxo_index(utxo).cast("long").alias("index"),
        parts[1].cast("long").alias("lovelace"),
        F.coalesce(datum, F.lit("")).alias("datum"),
        parts[2].alias("address"),
    )
    return F.when(place.isNotNull(), token)


def from_state(state: DataFrame) -> DataFrame:
    """Registry rows from the whole states of the assets that exist.

    A row is built once, from the event that created the asset (hex by label, policy, image
    and version of its metadata). The last reference datum that was an asset datum overwrites
    its attributes; an invalid one later leaves them and only takes over token and addresses. A
    virtual event makes the asset a virtual one for good. The last accepted settings event gives the settings.
    """
    name = F.col("name")
    rows = D.with_attributes(state, "reference_datum").withColumn("addresses", F.col("attributes.other_addresses"))
    rows = D.with_attributes(rows, "virtual_datum").withColumn("as_virtual", F.col("attributes"))
    rows = D.with_attributes(rows, "valid_datum").withColumns(
        {"row": F.from_json("built", BUILT_SQL), "as_script": F.from_json("script", SCRIPT_SQL), **name_columns(name)}
    )
    attributes, virtual = F.col("attributes"), F.col("as_virtual")
    image = F.coalesce("row.image", F.lit(""))
    unfilled = {
        "og_number": F.lit(0).cast("long"),
        "image": image,
        "standard_image": image,
        "image_hash": F.lit(""),
        "standard_image_hash": F.lit(""),
        "svg_version": F.lit("0"),
    }
    expires = F.struct(virtual["virtual_expires_time"].alias("expires_time"), virtual["virtual_public_mint"].alias("public_mint"))
    kind = F.when(F.col("virtual_datum").isNotNull(), S.TYPE_VIRTUAL_SUB)
    ada = F.create_map(F.lit("ada"), F.col("holder"))
    other = F.coalesce("addresses", F.from_json(F.lit("{}"), "map<string, string>"))
    settings = F.struct(*D.settings_fields(F.col("settings_datum")), _token(F.col("settings_place"), F.col("settings_datum")).alias("utxo"))
    return rows.select(
        "name",
        F.coalesce("row.hex", F.concat(F.lit(S.LABEL_OWNER), S.text_to_hex(name))).alias("hex"),
        F.coalesce("row.policy", F.lit("")).alias("policy"),
        F.coalesce("row.version", F.lit(0)).alias("version"),
        "amount",
        F.col("created").alias("created_slot"),
        F.col("updated").alias("updated_slot"),
        "utxo",
        "holder",
        F.map_concat(other, ada).alias("resolved_addresses"),
        "lovelace",
        "datum",
        F.col("datum").isNotNull().alias("has_datum"),
        F.when(F.col("as_script").isNotNull(), F.col("as_script")).alias("script"),
        *name_columns(name),
        F.coalesce(kind, S.asset_type(name, F.lit(None).cast("string"))).alias("asset_type"),
        *[
            F.when(attributes.isNotNull(), attributes[a]).otherwise(unfilled.get(a, F.lit(None))).alias(a)
            for a in (*ATTRIBUTES, "is_default")
        ],
        F.when(virtual["virtual_public_mint"].isNotNull(), expires).alias("virtual"),
        _token(F.col("reference_place"), F.col("reference_datum")).alias("reference_token"),
        F.when(F.col("settings_datum").isNotNull(), settings).alias("settings"),
        "last_saved_seq",
    )
