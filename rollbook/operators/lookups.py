"""Lookups from lists of keys to registry names, and name availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import scalars as S
from rollbook.operators.skew import spread_lookup


def by_name(requests: DataFrame, registry: DataFrame, columns: list[str]) -> DataFrame:
    """Point lookup in bulk: every request row, with nulls where the name is absent."""
    return spread_lookup(requests, registry.select("name", *columns), "name", F.col("request_id"))


def by_hex(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Decode the asked hex to a name; it counts only if the stored hex is the asked one."""
    asked = requests.withColumn("name", S.asset_text(F.col("asked_hex")))
    found = spread_lookup(asked, registry.select("name", "hex"), "name", F.col("request_id"))
    return found.select(
        "request_id", "asked_hex", F.when(F.col("hex") == F.col("asked_hex"), F.col("name")).alias("name")
    )


def stake_key() -> Column:
    """Key of the stake-hash index: tail of the stored id hash, else md5 of the stake hash."""
    return F.coalesce(
        F.substr(F.regexp_replace("id_hash", "^(.*?)0x", "$1"), F.lit(35)),
        S.md5_of_hex(F.col("stake_key_hash")),
    )


def by_holder(by_address: DataFrame, by_stake: DataFrame, holders: DataFrame) -> DataFrame:
    """``holders`` has ``address, stake_hash``: names held by the address or its stake hash, from the copies
    clustered by holder and by stake key."""
    direct = at_keys(by_address, holders.select("address")).select("name")
    return direct.unionByName(by_stake_hash(by_stake, holders.select("stake_hash"))).distinct()


def by_stake_hash(by_stake: DataFrame, hashes: DataFrame) -> DataFrame:
    keys = hashes.select(S.md5_of_hex(F.col(hashes.columns[0])))
    return at_keys(by_stake, keys).select("name")


def names_of_assets(assets: DataFrame) -> DataFrame:
    """Asset names or plain hex to names: the label goes, the rest is utf-8."""
    return assets.select(S.asset_text(S.without_policy(F.col(assets.columns[0]))).alias("name"))


def root_names(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("root").isNotNull()).select(F.col("root").alias("name")).distinct()


def roots(registry: DataFrame) -> DataFrame:
    """Assets that are the root of at least one sub-asset."""
    return registry.join(root_names(registry), "name", "left_semi")


def sub_assets(registry: DataFrame) -> DataFrame:
    """Each sub-asset whose root exists, with the root's id."""
    owners = registry.select(F.col("name").alias("root"), F.col("asset_id").alias("root_id"))
    subs = registry.where(F.col("root").isNotNull())
    return spread_lookup(subs, owners, "root", F.col("name")).where(F.col("root_id").isNotNull())


PART = "[a-z0-9_.-]"


def pattern_ok(name: Column) -> Column:
    """A plain name of 2 to 15 characters, or ``part@root`` of at most 28."""
    plain = name.rlike(f"^{PART}{{2,15}}$")
    sub = name.rlike(f"^{PART}+@{PART}{{2,15}}$") & (F.length(name) <= S.MAX_NAME_LENGTH)
    return plain | sub


def word_codes(names: DataFrame, words: DataFrame) -> DataFrame:
    """``name, code``: the smallest code among the words that a name holds; names without any are left out.

    Every stretch of a name that is as long as some word is looked up in the table of ``word, code``
    by an equal join: no pairing of names with words, and the table may be of any size.
    """
    lengths = [r[0] for r in words.select(F.length("word").alias("n")).where("n between 1 and 28").distinct().collect()]
    if not lengths:
        return names.limit(0).select("name", F.lit(0).alias("code"))
    name = F.col("name")

    def stretches(n: int) -> Column:
        last = F.length(name) - (n - 1)
        places = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)
        return F.transform(places, lambda i: F.substr(name, i, F.lit(n)))

    every = F.array_distinct(F.flatten(F.array(*map(stretches, sorted(lengths)))))
    held = names.select("name").distinct().select("name", F.explode(every).alias("word"))
    return held.join(words, "word").groupBy("name").agg(F.min("code").alias("code"))


def availability(requests: DataFrame, registry: DataFrame, words: DataFrame) -> DataFrame:
    """Answer code per requested name: 200 taken, 406 bad name, the smallest code of the words in it
    (``words`` has ``word, code``), 404 free."""
    found = by_name(requests, registry, ["utxo"])
    # words are asked about acceptable names only, which have at most 28 characters
    open_names = found.where(F.col("utxo").isNull() & pattern_ok(F.col("name")))
    coded = spread_lookup(found, word_codes(open_names, words), "name", F.col("request_id"))
    answer = (
        F.when(S.live(F.col("utxo")), 200)
        .when(F.col("utxo").isNotNull(), 404)
        .when(~pattern_ok(F.col("name")), 406)
        .otherwise(F.coalesce("code", F.lit(404)))
    )
    return coded.select("request_id", "name", answer.alias("code"))


# ------------------------------------------------------------------ copies clustered by a key

FOLDERS = 64  # of a clustered copy
FEW_KEYS = 1 << 16  # a list up to this length is broadcast


def folder_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")


def clustered(registry: DataFrame, key: Column) -> DataFrame:
    """The registry with ``lookup_key`` and the ``folder`` it belongs to, to be written by folder. A key
    of very many rows fills several files of its folder: rows are dealt by ranges of (folder, key, name)."""
    rows = registry.withColumn("lookup_key", key).withColumn("folder", folder_of(F.col("lookup_key")))
    return rows.repartitionByRange("folder", "lookup_key", "name").sortWithinPartitions("folder", "lookup_key", "name")


def at_key(copy: DataFrame, key: str) -> DataFrame:
    """Rows of one key: one folder, and in it the row groups that can hold the key."""
    folder = copy.sparkSession.range(1).select(folder_of(F.lit(key))).first()[0]
    return copy.where((F.col("folder") == folder) & (F.col("lookup_key") == key))


def at_keys(copy: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is on the list: only the folders of listed keys are read, and the copy is not
    shuffled for a list of up to ``FEW_KEYS``."""
    asked = keys.toDF("lookup_key").where(F.col("lookup_key").isNotNull()).distinct()
    per_folder = asked.groupBy(folder_of(F.col("lookup_key")).alias("folder")).count().collect()  # at most FOLDERS rows
    rows = copy.where(F.col("folder").isin([r["folder"] for r in per_folder]))
    short = sum(r["count"] for r in per_folder) <= FEW_KEYS
    return rows.join(F.broadcast(asked) if short else asked, "lookup_key", "left_semi")
