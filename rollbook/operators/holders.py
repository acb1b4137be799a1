"""Per-holder rollup and each holder's default asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import datum as D
from rollbook.functions import scalars as S
from rollbook.operators.skew import spread_filter, spread_lookup


def preference(og_number: Column, name: Column, created: Column) -> Column:
    """Smaller is better: lowest OG number, else shortest, then oldest, then first by name."""
    plain = F.coalesce(og_number, F.lit(0)) == 0
    return F.struct(
        plain.alias("plain"),
        F.when(plain, 0).otherwise(og_number).cast("long").alias("og"),
        F.length(name).alias("length"),
        created.alias("created"),
        S.sort_name(name).alias("by_name"),
    )


def best_asset(registry: DataFrame) -> Column:
    return F.min_by(
        "name", preference(F.col("og_number"), F.col("name"), F.col("created_slot"))
    )


def holder_rollup(registry: DataFrame) -> DataFrame:
    """One row per holder. Only mergeable aggregates: a holder with a third of all
    assets reaches the shuffle as one partial row per map task."""
    return registry.groupBy("holder").agg(
        F.count(F.lit(1)).alias("total_handles"),
        best_asset(registry).alias("default_handle"),
        F.min("holder_type").alias("type"),
        F.min("known_owner_name").alias("known_owner_name"),
    )


def with_default(rows: DataFrame, rollup: DataFrame) -> DataFrame:
    """Attach the holder's default asset; the stored value stays where there is no holder."""
    defaults = rollup.select("holder", "total_handles", F.col("default_handle").alias("default_in_wallet"))
    stored = "stored_default" in rows.columns
    out = spread_lookup(rows, defaults, "holder", F.col("name"), weight="total_handles")
    if stored:
        out = out.withColumn("default_in_wallet", F.coalesce("default_in_wallet", "stored_default"))
    return out


def page_with_default(page: DataFrame, registry: DataFrame) -> DataFrame:
    """Defaults for a page only: roll up just the holders on it (a page is at most 1000 rows)."""
    asked = F.broadcast(page.select("holder").distinct())
    rollup = registry.join(asked, "holder", "left_semi").groupBy("holder").agg(
        best_asset(registry).alias("default_in_wallet")
    )
    return page.join(rollup, "holder", "left")


def held(state: DataFrame) -> DataFrame:
    """What the rollup asks about folded states that have a holder; the number comes from the reference datum."""
    owned = D.with_attributes(state.where(F.col("holder") != ""), "reference_datum")
    return owned.select(
        "name",
        "holder",
        F.col("created").alias("created_slot"),
        F.coalesce(F.col("attributes.og_number"), F.lit(0)).alias("og_number"),
        F.lit("").alias("holder_type"),
        F.lit("").alias("known_owner_name"),
        "last_saved_seq",
    )


def touched_holders(before: DataFrame, after: DataFrame) -> DataFrame:
    """Holders with an asset that came, went or changed between two registry states."""
    compared = ("holder", "created_slot", "og_number")
    was = before.select("name", F.struct(*compared).alias("was"))
    now = after.select("name", F.struct(*compared).alias("now"))
    changed = was.join(now, "name", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return (
        changed.select(F.explode(F.array("was.holder", "now.holder")).alias("holder"))
        .where(F.col("holder").isNotNull())
        .distinct()
    )


def refreshed_rollup(old_rollup: DataFrame, after: DataFrame, touched: DataFrame) -> DataFrame:
    """Incremental rollup: keep untouched holders, recompute the touched ones."""
    kept = old_rollup.join(touched, "holder", "left_anti")
    redone = spread_filter(after, touched, "holder", F.col("name"))
    return kept.unionByName(holder_rollup(redone))


def manual_defaults(held: DataFrame, events: DataFrame) -> DataFrame:
    """Default asset per holder, where holders may have picked one.

    ``events`` are the accepted events that asked for it (``holder, name, seq``), ``held``
    the assets with the arrival of their last save. Any later save, move or burn of the
    picked asset clears the choice and an older choice does not come back: so the choice
    is the holder's latest such event, valid iff it is still that asset's last save.
    """
    latest = events.groupBy("holder").agg(F.max_by(F.struct("name", "seq"), "seq").alias("pick"))
    last_save = held.select("name", "holder", F.col("last_saved_seq").alias("seq"))
    valid = latest.select("holder", "pick.*").join(last_save, ["name", "holder", "seq"], "left_semi")
    picked = valid.select("holder", F.col("name").alias("picked"))
    return (
        holder_rollup(held)
        .join(picked, "holder", "left")
        .select(
            "holder",
            "total_handles",
            F.col("picked").isNotNull().alias("manually_set"),
            F.coalesce("picked", "default_handle").alias("default_handle"),
            "type",
            "known_owner_name",
        )
    )
