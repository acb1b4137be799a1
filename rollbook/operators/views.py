"""Projections of registry rows as they are handed out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import scalars as S


def live_rows(registry: DataFrame) -> DataFrame:
    return registry.where(S.live(F.col("utxo")))


def filled(registry: DataFrame) -> DataFrame:
    """Defaults a row gets when it is built."""
    image = F.coalesce("image", F.lit(""))
    return registry.withColumns(
        {
            "amount": F.coalesce("amount", F.lit(1)),
            "og_number": F.coalesce("og_number", F.lit(0)),
            "image": image,
            "standard_image": F.coalesce("standard_image", image),
            "standard_image_hash": F.coalesce("standard_image_hash", "image_hash", F.lit("")),
            "image_hash": F.coalesce("image_hash", F.lit("")),
            "holder": F.coalesce("holder", F.lit("")),
            "holder_type": F.coalesce("holder_type", F.lit("")),
            "utxo": F.coalesce("utxo", F.lit("")),
            "lovelace": F.coalesce("lovelace", F.lit(0)),
            "svg_version": F.coalesce("svg_version", F.lit("0")),
            "version": F.coalesce("version", F.lit(0)),
        }
    )


def virtual_of(kind: Column) -> Column:
    return F.when(
        kind == S.TYPE_VIRTUAL_SUB,
        F.struct(
            F.col("virtual_expires").alias("expires_time"),
            F.col("mint_open_virtual").alias("public_mint"),
        ),
    )


def reference_token() -> Column:
    return F.when(
        F.col("datum").isNotNull(),
        F.struct(
            S.utxo_tx(F.col("reference_utxo")).alias("tx_id"),
            S.utxo_index(F.col("reference_utxo")).cast("long").alias("index"),
            "lovelace",
            "datum",
            "address",
        ),
    )


def script() -> Column:
    return F.when(
        F.col("script_cbor").isNotNull(),
        F.struct(F.col("script_type").alias("type"), F.col("script_cbor").alias("cbor")),
    )


def settings() -> Column:
    """Sub-registry settings of a root row."""
    return F.struct(
        F.struct(F.col("mint_open_nft").alias("public_minting_enabled")).alias("nft"),
        F.struct(F.col("mint_open_virtual").alias("public_minting_enabled")).alias("virtual"),
        F.struct(
            S.utxo_tx(F.col("settings_utxo")).alias("tx_id"),
            S.utxo_index(F.col("settings_utxo")).cast("long").alias("index"),
            "lovelace",
            F.col("settings_datum").alias("datum"),
            "address",
        ).alias("utxo"),
    )


def asset_view(rows: DataFrame) -> DataFrame:
    """Public view of live rows; expects ``default_in_wallet`` to be attached."""
    full = filled(live_rows(rows)).withColumn("virtual", virtual_of(F.col("asset_type")))
    return full.select(
        "hex",
        "name",
        "image",
        "standard_image",
        "holder",
        "holder_type",
        "length",
        "og_number",
        "rarity",
        "utxo",
        "characters",
        "numeric_modifiers",
        "default_in_wallet",
        "pfp_image",
        S.strip_0x(F.col("pfp_asset")).alias("pfp_asset"),
        "bg_image",
        S.strip_0x(F.col("bg_asset")).alias("bg_asset"),
        F.create_map(F.lit("ada"), F.col("address")).alias("resolved_addresses"),
        F.col("created_slot").alias("created_slot_number"),
        F.col("updated_slot").alias("updated_slot_number"),
        "has_datum",
        "svg_version",
        S.strip_0x(F.col("image_hash")).alias("image_hash"),
        S.strip_0x(F.col("standard_image_hash")).alias("standard_image_hash"),
        "last_update_address",
        "version",
        F.col("asset_type").alias("handle_type"),
        "payment_key_hash",
        S.pz_flag(F.col("pz_enabled"), F.col("asset_type")).alias("pz_enabled"),
        "sub_rarity",
        "sub_length",
        "sub_characters",
        "sub_numeric_modifiers",
        "virtual",
        "original_address",
        "last_edited_time",
        F.coalesce("policy", F.lit("")).alias("policy"),
    )


def utxo_view(rows: DataFrame) -> DataFrame:
    return live_rows(rows).select(
        "name",
        S.utxo_tx(F.col("utxo")).alias("tx_id"),
        S.utxo_index(F.col("utxo")).alias("index"),
        "lovelace",
        "address",
        F.when(F.col("has_datum"), F.col("datum")).alias("datum"),
        F.col("script_cbor").alias("reference_script"),
    )
