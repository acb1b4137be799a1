"""Off-chain content and personalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions import scalars as S
from rollbook.operators.skew import spread_lookup
from rollbook.operators.views import live_rows, reference_token

PROJECT_TYPE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("validated_by", "trial", "nsfw", "portal", "designer", "socials")
    ]
)


def unwrap(body: Column) -> Column:
    """The object that a body wraps in ``constructor_0[0]``, as JSON; the body itself if it wraps none."""
    return F.coalesce(F.get_json_object(body, "$.constructor_0[0]"), body)


def content_facts(primary: DataFrame, backup: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """``facts`` about the body of each content id, the primary copy first.

    The expressions read ``body`` and are taken where a copy is read, so no body moves.
    """
    known = F.struct(*[value.alias(name) for name, value in facts.items()])
    a = primary.where(F.col("body").isNotNull()).select("cid", known.alias("first_facts"))
    b = backup.where(F.col("body").isNotNull()).select("cid", known.alias("second_facts"))
    return a.join(b, "cid", "full_outer").select(
        "cid", F.coalesce("first_facts", "second_facts").alias("facts")
    )


def content_id(link: Column) -> Column:
    return F.when(link.startswith("ipfs://"), F.substr(link, F.lit(8)))


def resolve(rows: DataFrame, key: str, links: dict[str, Column], content: DataFrame) -> DataFrame:
    """Attach the facts about the body behind each link as a column; null where there is no such content.

    Links are melted to one row each, so all of them share one join, which moves
    only keys on the registry side, and one regrouping by ``key``.
    """
    parts = F.array(
        *[F.struct(F.lit(out).alias("part"), content_id(link).alias("cid")) for out, link in links.items()]
    )
    asked = rows.select(key, F.inline(parts)).where(F.col("cid").isNotNull())
    found = spread_lookup(asked, content.select("cid", "facts"), "cid", F.col(key))
    wide = (
        found.where(F.col("facts").isNotNull())
        .groupBy(key)
        .agg(*[F.any_value(F.when(F.col("part") == out, F.col("facts")), True).alias(out) for out in links])
    )
    return rows.join(wide, key, "left")


def personalization(registry: DataFrame, content: DataFrame) -> DataFrame:
    """Personalisation of live rows with a reference token.

    An invalid datum leaves the stored values (empty, on trial, not for all ages).
    """
    token = live_rows(registry).withColumn("reference_token", reference_token())
    token = token.where(F.col("reference_token").isNotNull())
    parts = F.col("reference_token.datum")
    valid = F.json_array_length(F.get_json_object(parts, "$.constructor_0")) == 3
    attributes = F.from_json(F.get_json_object(parts, "$.constructor_0[2]"), PROJECT_TYPE)
    rows = token.select("name", F.when(valid, attributes).alias("attributes")).select(
        "name", F.col("attributes").isNotNull().alias("valid"), "attributes.*"
    )
    rows = rows.withColumns(
        {
            "validated_by": F.when(F.col("valid"), F.col("validated_by")).otherwise(""),
            "trial": F.when(F.col("valid"), F.col("trial")).otherwise("true"),
            "nsfw": F.when(F.col("valid"), F.col("nsfw")).otherwise("true"),
        }
    )
    links = {f"{part}_facts": F.col(part) for part in ("portal", "designer", "socials")}
    return resolve(rows, "name", links, content).drop("valid", "portal", "designer", "socials")
