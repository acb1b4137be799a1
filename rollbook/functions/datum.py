"""Datum JSON to columns. Invalid datums give nulls and ``valid = false``; no row fails a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys a complete asset datum has.
REQUIRED_METADATA = (
    "name",
    "image",
    "mediaType",
    "og",
    "og_number",
    "rarity",
    "length",
    "characters",
    "numeric_modifiers",
    "version",
    "handle_type",
)
REQUIRED_PROJECT = (
    "standard_image",
    "default",
    "last_update_address",
    "validated_by",
    "image_hash",
    "standard_image_hash",
    "svg_version",
    "agreed_terms",
    "migrate_sig_required",
    "trial",
    "nsfw",
)

# Positions in the settings array and in each of its two type blocks.
SETTINGS_FIELDS = (
    "nft",
    "virtual",
    "buy_down_price",
    "buy_down_paid",
    "buy_down_percent",
    "agreed_terms",
    "migrate_sig_required",
    "payment_address",
)
TYPE_FIELDS = (
    "public_minting_enabled",
    "pz_enabled",
    "tier_pricing",
    "default_styles",
    "save_original_address",
)

ASSET_TYPE = T.StructType(
    [T.StructField("og_number", T.LongType()), T.StructField("image", T.StringType())]
)
PROJECT_TYPE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "image_hash",
            "standard_image_hash",
            "standard_image",
            "bg_image",
            "bg_asset",
            "pfp_image",
            "pfp_asset",
            "svg_version",
            "default",
            "last_update_address",
            "original_address",
            "id_hash",
            "pz_enabled",
            "last_edited_time",
        )
    ]
    + [
        T.StructField("virtual", T.StructType([T.StructField("expires_time", T.LongType()), T.StructField("public_mint", T.StringType())])),
        T.StructField("resolved_addresses", T.MapType(T.StringType(), T.StringType())),
    ]
)


def truthy(value: Column) -> Column:
    """``1`` and ``true`` both count as set."""
    return F.coalesce(value.isin("1", "true"), F.lit(False))


def parts(datum: Column) -> Column:
    """The elements of ``constructor_0`` as JSON text, parsed once; null if there is no such array.

    A text that does not hold the key, plain or with escapes, is not parsed at all."""
    may_hold = datum.contains("constructor_0") | datum.contains("\\")
    return F.from_json(F.when(may_hold, datum), "constructor_0 array<string>")["constructor_0"]


def is_asset_datum(items: Column) -> Column:
    return F.coalesce(F.size(items) == 3, F.lit(False))


def with_attributes(rows: DataFrame, datum: str = "datum", only: Sequence[str] = ()) -> DataFrame:
    """Add ``valid`` and ``attributes``: the columns a reference event overwrites, as one
    struct, null if the datum is not an asset datum; ``only`` names those that are asked for.

    Step by step, so that each JSON text is parsed once and not once per field.
    """
    split = rows.withColumn("parts", parts(F.col(datum)))
    parsed = split.withColumns(
        {
            "valid": is_asset_datum(F.col("parts")),
            "own_part": F.from_json(F.get("parts", F.lit(0)), ASSET_TYPE),
            "project_part": F.from_json(F.get("parts", F.lit(2)), PROJECT_TYPE),
        }
    )
    fields = [f for name, f in _overwritten(F.col("own_part"), F.col("project_part")).items() if not only or name in only]
    return parsed.withColumn("attributes", F.when(F.col("valid"), F.struct(*fields))).drop(
        "parts", "own_part", "project_part"
    )


def _overwritten(a: Column, p: Column) -> dict[str, Column]:
    blank = F.lit("")
    fields = {
        "og_number": F.coalesce(a["og_number"], F.lit(0)),
        "image": F.coalesce(a["image"], blank),
        "image_hash": F.coalesce(p["image_hash"], blank),
        "standard_image_hash": F.coalesce(p["standard_image_hash"], blank),
        "standard_image": F.coalesce(p["standard_image"], blank),
        "svg_version": F.coalesce(p["svg_version"], blank),
        "bg_image": p["bg_image"],
        "bg_asset": p["bg_asset"],
        "pfp_image": p["pfp_image"],
        "pfp_asset": p["pfp_asset"],
        "is_default": truthy(p["default"]),
        "last_update_address": p["last_update_address"],
        "original_address": p["original_address"],
        "id_hash": p["id_hash"],
        "pz_enabled": truthy(p["pz_enabled"]),
        "last_edited_time": p["last_edited_time"],
        "virtual_expires_time": p["virtual"]["expires_time"],
        "virtual_public_mint": F.when(p["virtual"].isNotNull(), truthy(p["virtual"]["public_mint"])),
        "virtual_address": F.regexp_replace(p["resolved_addresses"]["ada"], "^(.*?)0x", "$1"),
        "other_addresses": F.map_filter(p["resolved_addresses"], lambda chain, _: chain != "ada"),
    }
    return {name: field.alias(name) for name, field in fields.items()}


def missing_keys(json: Column, required: tuple[str, ...]) -> Column:
    wanted = F.array(*[F.lit(k) for k in required])
    return F.array_except(wanted, F.json_object_keys(json))


def settings(datum: Column) -> Column:
    """Positional settings array to a struct; a bad datum gives a struct of nulls."""
    return F.struct(*settings_fields(datum))


def settings_fields(datum: Column) -> list[Column]:
    items = F.from_json(datum, T.ArrayType(T.StringType()))
    block = lambda i: F.from_json(F.get(items, F.lit(i)), T.ArrayType(T.StringType()))
    return [
        *[
            F.struct(*[F.get(block(i), F.lit(j)).alias(f) for j, f in enumerate(TYPE_FIELDS)]).alias(name)
            for i, name in enumerate(SETTINGS_FIELDS[:2])
        ],
        *[F.get(items, F.lit(i)).alias(name) for i, name in enumerate(SETTINGS_FIELDS) if i > 1],
    ]
