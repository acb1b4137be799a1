"""Nested blocks to flat rows: mints, outputs and scanned events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions import datum as D
from rollbook.functions import scalars as S
from rollbook.operators import position
from rollbook.operators.skew import CHUNK_ROWS, running, with_chunks
from rollbook.session import materialized

ASSETS = T.MapType(T.StringType(), T.LongType())
OUTPUT = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("address", T.StringType()),
        T.StructField("lovelace", T.LongType()),
        T.StructField("value", T.MapType(T.StringType(), ASSETS)),
        T.StructField("datum", T.StringType()),
        T.StructField(
            "script",
            T.StructType([T.StructField("language", T.StringType()), T.StructField("cbor", T.StringType())]),
        ),
    ]
)
BLOCK = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("day", T.LongType()),
        T.StructField("slot", T.LongType()),
        T.StructField("tx_pos", T.LongType()),
        T.StructField("tx_id", T.StringType()),
        T.StructField("pieces", T.IntegerType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("outputs", T.ArrayType(OUTPUT)),
        T.StructField("mint", T.MapType(T.StringType(), ASSETS)),
        T.StructField("metadata", T.StringType()),
    ]
)
ENVELOPE = T.StructType(
    [
        T.StructField("direction", T.StringType()),
        T.StructField("block", BLOCK),
        T.StructField("point", T.StructType([T.StructField("slot", T.LongType()), T.StructField("id", T.StringType())])),
        T.StructField(
            "tip",
            T.StructType(
                [
                    T.StructField("slot", T.LongType()),
                    T.StructField("id", T.StringType()),
                    T.StructField("height", T.LongType()),
                ]
            ),
        ),
        T.StructField("seq", T.LongType()),
    ]
)

# label 721 -> policy -> asset key -> attributes
METADATA = "map<string, map<string, map<string, struct<image string, core struct<og long, version long>>>>>"
METADATA_LABEL = "721"


# What tells transactions apart and orders them, and in how many nested rows one comes.
TRANSACTION = ("seq", "tx_pos", "slot", "tx_id", "pieces")


def mints(blocks: DataFrame) -> DataFrame:
    """One row per minted asset of a transaction; an asset is in one piece only."""
    # outer: a plain explode has the map made once more for a filter on its size
    per_policy = blocks.select(*TRANSACTION, F.explode_outer("mint").alias("policy", "assets"))
    return per_policy.where(F.col("policy").isNotNull()).select(*TRANSACTION, "policy", F.explode("assets").alias("asset", "qty"))


def outputs(blocks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per output asset; ``keep`` names block columns to carry along.

    An output's index is its place in the whole transaction, whatever piece it comes in.
    """
    # outer: a plain explode has the array made once more for a filter on its size
    per_output = blocks.select(*TRANSACTION, *keep, F.explode_outer("outputs").alias("output")).withColumn(
        "out_pos", F.col("output.index")
    )
    per_policy = per_output.where(F.col("output").isNotNull()).select("*", F.explode("output.value").alias("policy", "assets"))
    per_asset = per_policy.select("*", F.explode("assets").alias("asset", "qty"))
    return per_asset.select(
        *TRANSACTION,
        "out_pos",
        F.concat_ws("#", "tx_id", "out_pos").alias("utxo"),
        "policy",
        "asset",
        "qty",
        "output.address",
        "output.lovelace",
        "output.datum",
        "output.script",
        *keep,
    )


def allowed(rows: DataFrame, policies: Sequence[str]) -> DataFrame:
    """Rows of the network's policies (a short configured list)."""
    return rows.where(F.col("policy").isin(*policies))


def named(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("asset") != "")


def is_mint(mint: Column, policy: Column, asset: Column) -> Column:
    """Minted in its own transaction, and a plain or owner-labelled asset."""
    label = S.label_of(asset)
    minted = F.coalesce(F.try_element_at(F.try_element_at(mint, policy), asset) > 0, F.lit(False))
    return minted & (label.isNull() | (label == "222"))


def metadata_key(asset: Column) -> Column:
    return F.when(S.label_of(asset).isNull(), S.asset_text(asset)).otherwise(S.registry_hex(asset))


def labelled(metadata: Column) -> Column:
    """What the metadata of a transaction says about assets, by policy and asset key."""
    return F.try_element_at(F.from_json(metadata, METADATA), F.lit(METADATA_LABEL))


def pick_metadata(per_policy: Column, policy: Column, key: Column) -> Column:
    return F.try_element_at(F.try_element_at(per_policy, policy), key)


def scanned_events(blocks: DataFrame, policies: Sequence[str]) -> DataFrame:
    # parsed once a transaction, not once for each of its outputs
    parsed = blocks.withColumn("per_policy", labelled(F.col("metadata")))
    rows = named(allowed(outputs(parsed, keep=("mint", "per_policy")), policies))
    picked = pick_metadata(F.col("per_policy"), F.col("policy"), metadata_key(F.col("asset")))
    script = F.when(
        F.col("script").isNotNull(),
        F.struct(
            F.regexp_replace("script.language", "^([^:]*):", "$1_").alias("type"),
            F.coalesce("script.cbor", F.lit("")).alias("cbor"),
        ),
    )
    return rows.withColumns(
        {
            "script": script,
            "picked": picked,
            "is_mint": is_mint(F.col("mint"), F.col("policy"), F.col("asset")),
        }
    ).drop("mint", "per_policy", "qty")


def kind_of(asset: Column) -> Column:
    label = S.label_of(asset)
    return (
        F.when(label.isNull() | (label == "222"), "owner")
        .when(label == "100", "reference")
        .when(label == "000", "virtual")
        .otherwise("settings")
    )


def burns(blocks: DataFrame, policies: Sequence[str]) -> DataFrame:
    label = S.label_of(F.col("asset"))
    rows = allowed(mints(blocks), policies)
    return rows.where((F.col("qty") == -1) & (label.isNull() | label.isin("222", "000")))


def numbered_in_transaction(rows: DataFrame, width: int = CHUNK_ROWS) -> DataFrame:
    """Number the rows of each transaction from 1 as ``tx_order``: burns by asset, then outputs by index.

    A transaction in one piece is small, so a window numbers it; the rows of one in
    several pieces are numbered in chunks of output indexes.
    """
    order = ["phase", "out_pos", "asset"]
    keys = ["seq", "tx_pos", "tx_id"]
    whole = rows.where(F.col("pieces") == 1).withColumn(
        "tx_order", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    chunk = F.when(F.col("phase") == 0, 0).otherwise(1 + F.floor(F.col("out_pos") / width)).cast("long")
    cut = running(
        rows.where(F.col("pieces") > 1).withColumn("chunk", chunk),
        keys,
        order,
        {"earlier": ("sum", F.lit(1))},
        exclusive=True,
    )
    cut = cut.withColumn("tx_order", (F.col("earlier") + 1).cast("int")).drop("chunk", "earlier")
    return whole.unionByName(cut)


def ordered_events(blocks: DataFrame, policies: Sequence[str]) -> DataFrame:
    """Burns first, then outputs in index order, numbered within the transaction.

    Blocks and transactions order by ``(seq, tx_pos)``.
    """
    burned = burns(blocks, policies).select(
        *TRANSACTION, F.lit(0).alias("phase"), F.lit(0).alias("out_pos"), "asset"
    )
    sent = named(allowed(outputs(blocks), policies)).select(
        *TRANSACTION, F.lit(1).alias("phase"), "out_pos", "asset"
    )
    return numbered_in_transaction(materialized(burned.unionByName(sent), "events"))  # read more than once


def arrivals(rows: DataFrame, width: int = CHUNK_ROWS) -> DataFrame:
    """Number rows ordered by ``(seq, tx_pos, tx_order)`` without gaps, as column ``arrival``.

    Rows are counted per transaction; a chunked running sum over those counts gives
    each transaction its first number. Nothing is sorted as a whole.
    """
    sizes = rows.groupBy("seq", "tx_pos").agg(F.count(F.lit(1)).alias("size"))
    placed = running(
        with_chunks(sizes, "seq", width),
        [],
        ["seq", "tx_pos"],
        {"earlier": ("sum", F.col("size"))},
        exclusive=True,
    )
    numbered = rows.join(placed.select("seq", "tx_pos", "earlier"), ["seq", "tx_pos"])
    return numbered.withColumn("arrival", F.col("earlier") + F.col("tx_order") - 1).drop("earlier")


def block_order(rows: DataFrame) -> DataFrame:
    """Order rows by block, transaction and place in it, as column ``arrival``, from each row alone.

    Needs no other row, so neither the size of a block nor what a batch holds of it matters: the
    order of a stream, as texts.
    """
    at = [F.col(c) for c in ("seq", "tx_pos", "phase", "out_pos", "asset", "policy")]
    return rows.withColumn("arrival", position.of_row(*at))


#: What tells events apart and orders them.
PLACE = (*TRANSACTION, "phase", "out_pos", "policy", "asset")


def numbers(blocks: DataFrame, policies: Sequence[str], width: int = CHUNK_ROWS) -> DataFrame:
    """``position, number``: what a ledger row at a position is numbered without gaps. Nothing but
    what tells rows apart is shuffled for it."""
    burned = burns(blocks, policies).withColumns({"phase": F.lit(0), "out_pos": F.lit(0)}).select(*PLACE)
    sent = named(allowed(outputs(blocks), policies)).withColumn("phase", F.lit(1)).select(*PLACE)
    return numbers_of(materialized(sent.unionByName(burned), "places"), width)


def numbers_of(places: DataFrame, width: int = CHUNK_ROWS) -> DataFrame:
    """``numbers`` from the places of all ledger rows, a table: it is read more than once."""
    rows = numbered_in_transaction(places).drop("tx_id", "slot", "pieces")
    rows = arrivals(rows, width).withColumnRenamed("arrival", "number")
    return block_order(rows).select(F.col("arrival").alias("position"), "number")


def with_numbers(state: DataFrame, columns: Sequence[str], numbered: DataFrame) -> DataFrame:
    """Rows, unique by name, with the numbers of the positions in ``columns`` instead of these."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("position")) for c in columns]))
    asked = state.select(F.col("name").alias("of"), each.alias("asked")).select("of", "asked.*").where("position is not null")
    found = asked.join(numbered, "position").groupBy("of").agg(
        *[F.max(F.when(F.col("which") == c, F.col("number"))).alias(f"n_{c}") for c in columns]
    )
    joined = state.join(found, F.col("name").eqNullSafe(F.col("of")), "left")
    return joined.select(*[F.col(f"n_{c}").alias(c) if c in columns else F.col(c) for c in state.columns])


def ledger_rows(
    blocks: DataFrame, policies: Sequence[str], width: int = CHUNK_ROWS, gaps: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Blocks to ledger rows, ready to be folded, numbered without gaps, or with ``gaps`` at their positions.

    A reference row keeps its datum if that is JSON at all, a virtual row only if it
    is an asset datum (its address comes from there); else the fold rejects the row. ``built``
    is what a registry row is built from if the event creates the asset, as JSON: hex, policy, and
    image and version of the transaction's metadata. ``keep`` names columns of an event's place (``PLACE``)
    to carry along, in a struct ``place``.
    """
    burned = burns(blocks, policies).select(
        *TRANSACTION, F.lit(0).alias("phase"), F.lit(0).alias("out_pos"), "policy", "asset"
    )
    sent = scanned_events(blocks, policies).withColumn("phase", F.lit(1))
    both = sent.unionByName(burned, allowMissingColumns=True)
    both = block_order(both) if gaps else arrivals(numbered_in_transaction(both), width)
    route = kind_of(F.col("asset"))
    kind = (
        F.when(F.col("phase") == 0, "burn")
        .when(route != "owner", route)
        .otherwise(F.when(F.col("is_mint"), "mint").otherwise("transfer"))
    )
    built = F.to_json(
        F.struct(
            S.registry_hex(F.col("asset")).alias("hex"),
            "policy",
            F.col("picked.image").alias("image"),
            F.col("picked.core.version").alias("version"),
        )
    )
    both = both.withColumn("built", F.when(F.col("phase") == 1, built))
    rows = D.with_attributes(both.withColumn("kind", kind), only=("is_default", "virtual_address"))
    usable = (
        F.when(F.col("kind") == "reference", F.try_parse_json("datum").isNotNull())
        .when(F.col("kind") == "virtual", F.col("valid"))
        .otherwise(True)
    )
    return rows.select(
        F.col("arrival").alias("seq"),
        S.asset_text(F.col("asset")).alias("name"),
        "slot",
        "kind",
        F.when(F.col("kind") == "virtual", F.col("attributes.virtual_address"))
        .otherwise(F.col("address"))
        .alias("holder"),
        "utxo",
        "lovelace",
        F.coalesce("attributes.is_default", F.lit(False)).alias("is_default"),
        F.when(usable, F.col("datum")).alias("datum"),
        "built",
        F.when(F.col("script").isNotNull(), F.to_json("script")).alias("script"),
        *[F.struct(*keep).alias("place")] * bool(keep),
    )
