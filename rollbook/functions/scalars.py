"""Name, key and flag expressions. Everything here is a built-in Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Asset-name labels (8 hex digits) and what they mean.
LABEL_OWNER = "000de140"  # 222
LABEL_REFERENCE = "000643b0"  # 100
LABEL_VIRTUAL = "00000000"  # 000
LABEL_SETTINGS = "00001070"  # 001
LABEL_CODES = {
    LABEL_OWNER: "222",
    LABEL_REFERENCE: "100",
    LABEL_VIRTUAL: "000",
    LABEL_SETTINGS: "001",
}

# Asset types.
TYPE_PLAIN = "handle"
TYPE_NFT_SUB = "nft_subhandle"
TYPE_VIRTUAL_SUB = "virtual_subhandle"

# The enums a search may ask for.
RARITIES = ("basic", "common", "rare", "ultra_rare", "legendary")
CHARACTER_CLASSES = ("letters", "numbers", "special")
NUMERIC_MODIFIERS = ("negative", "decimal")
ASSET_TYPES = (TYPE_VIRTUAL_SUB, TYPE_NFT_SUB, TYPE_PLAIN)
SORTS = ("asc", "desc", "random")
MAX_NAME_LENGTH = 28


def rarity(name: Column) -> Column:
    n = F.length(name)
    return (
        F.when(n == 1, "legendary")
        .when(n == 2, "ultra_rare")
        .when(n == 3, "rare")
        .when(n <= 7, "common")
        .otherwise("basic")
    )


def characters(name: Column) -> Column:
    return F.concat_ws(
        ",",
        F.when(name.rlike("[a-z]"), "letters"),
        F.when(name.rlike("[0-9]"), "numbers"),
        F.when(name.rlike("[-._]"), "special"),
    )


def numeric_modifiers(name: Column) -> Column:
    return F.concat_ws(
        ",",
        F.when(name.rlike(r"^-\d+(\.\d+)?$"), "negative"),
        F.when(name.rlike(r"^-?\d+\.\d+$"), "decimal"),
    )


def is_sub(name: Column) -> Column:
    return F.instr(name, "@") > 0


def sub_part(name: Column) -> Column:
    return F.when(is_sub(name), F.split_part(name, F.lit("@"), F.lit(1)))


def root_part(name: Column) -> Column:
    return F.when(is_sub(name), F.split_part(name, F.lit("@"), F.lit(2)))


def asset_type(name: Column, given: Column) -> Column:
    """The stored type of a sub-asset, or the plain type for names without a root."""
    return F.when(is_sub(name), F.coalesce(given, F.lit(TYPE_NFT_SUB))).otherwise(TYPE_PLAIN)


def type_from_hex(hex_name: Column, name: Column) -> Column:
    return (
        F.when(hex_name.startswith(LABEL_VIRTUAL), TYPE_VIRTUAL_SUB)
        .when(is_sub(name), TYPE_NFT_SUB)
        .otherwise(TYPE_PLAIN)
    )


def live(utxo: Column) -> Column:
    """An empty or missing output means the row is not live. Plain comparisons, so they reach the files."""
    return utxo.isNotNull() & (utxo != "")


def label_of(asset: Column) -> Column:
    """``222``/``100``/``000``/``001`` or null for an unlabelled asset."""
    head = F.substring(asset, 1, 8)
    code = F.lit(None).cast("string")
    for prefix, value in LABEL_CODES.items():
        code = F.when(head == prefix, value).otherwise(code)
    return code


def without_policy(asset: Column) -> Column:
    return F.when(F.instr(asset, ".") > 0, F.split_part(asset, F.lit("."), F.lit(2))).otherwise(asset)


def body_hex(asset: Column) -> Column:
    return F.when(label_of(asset).isNotNull(), F.substr(asset, F.lit(9))).otherwise(asset)


def asset_text(asset: Column) -> Column:
    return hex_to_text(body_hex(asset))


def registry_hex(asset: Column) -> Column:
    """Hex of the asset an event belongs to: labelled assets point at their 222 twin, 000 stays."""
    label = label_of(asset)
    return (
        F.when(label.isNull(), asset)
        .when(label == "000", asset)
        .otherwise(F.concat(F.lit(LABEL_OWNER), F.substr(asset, F.lit(9))))
    )


def hex_to_text(hex_name: Column) -> Column:
    return F.decode(F.unhex(hex_name), "utf-8")


def text_to_hex(name: Column) -> Column:
    return F.lower(F.hex(F.encode(name, "utf-8")))


def md5_of_hex(hex_bytes: Column) -> Column:
    return F.md5(F.unhex(hex_bytes))


def strip_0x(value: Column) -> Column:
    """Drop the first ``0x`` only."""
    return F.regexp_replace(value, "^(.*?)0x", "$1")


def sort_name(name: Column) -> Column:
    """Locale order (``_ - . @`` before digits before letters)."""
    return F.collate(name, "UNICODE")


def personalized(image_hash: Column, standard_hash: Column) -> Column:
    return ~image_hash.eqNullSafe(standard_hash)


def pz_flag(stored: Column, kind: Column) -> Column:
    return F.coalesce(stored, F.when(kind == TYPE_PLAIN, F.lit(True)))


def utxo_tx(utxo: Column) -> Column:
    return F.split_part(utxo, F.lit("#"), F.lit(1))


def utxo_index(utxo: Column) -> Column:
    return F.split_part(utxo, F.lit("#"), F.lit(2)).try_cast("int")


def hex_matches_name(hex_name: Column, name: Column) -> Column:
    return hex_name.endswith(text_to_hex(name))
