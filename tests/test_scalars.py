import pytest
from pyspark.sql import functions as F

from rollbook.functions import datum as D
from rollbook.functions import scalars as S


def column(spark, values, make, name="x"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(make(F.col(name))).collect()]


def test_rarity(spark):
    names = ["will_be_common", "common", "abc", "_._", "__", "."]
    assert column(spark, names, S.rarity) == ["basic", "common", "rare", "rare", "ultra_rare", "legendary"]


def test_numeric_modifiers(spark):
    names = ["-1", "0.1", "-0.1", "1a", "1", "-.-", "--1", "1.2."]
    assert column(spark, names, S.numeric_modifiers) == [
        "negative", "decimal", "negative,decimal", "", "", "", "", "",
    ]


def test_characters(spark):
    names = ["abc", "a1", "1", "a-1", "v@taco", "-1", "_"]
    assert column(spark, names, S.characters) == [
        "letters", "letters,numbers", "numbers", "letters,numbers,special", "letters", "numbers,special", "special",
    ]


@pytest.mark.parametrize(
    "asset, label, name, registry_hex",
    [
        ("6275727269746f", None, "burrito", "6275727269746f"),
        ("f0ff.6275727269746f", None, "burrito", "6275727269746f"),
        ("000de1406275727269746f", "222", "burrito", "000de1406275727269746f"),
        ("f0ff.000643b06275727269746f", "100", "burrito", "000de1406275727269746f"),
        ("000010706275727269746f", "001", "burrito", "000de1406275727269746f"),
        ("000000006275727269746f", "000", "burrito", "000000006275727269746f"),
    ],
)
def test_label_parse(spark, asset, label, name, registry_hex):
    bare = column(spark, [asset], S.without_policy)
    assert column(spark, bare, S.label_of) == [label]
    assert column(spark, bare, S.asset_text) == [name]
    assert column(spark, bare, S.registry_hex) == [registry_hex]


def test_strip_0x_takes_the_first_only(spark):
    assert column(spark, ["0xab", "0x0xab", "ab", "a0xb", None], S.strip_0x) == ["ab", "0xab", "ab", "ab", None]


def test_locale_order(spark):
    names = ["aab", "a1b", "a@b", "a.b", "a-b", "a_b"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    got = [r[0] for r in df.orderBy(S.sort_name(F.col("x"))).collect()]
    assert got == ["a_b", "a-b", "a.b", "a@b", "a1b", "aab"]


def test_settings_array(spark):
    good = '[[1,1,[[1,50]],[],0],[0,0,[],[],1],10,20,30,"terms",1,"0xab"]'
    rows = column(spark, [good, "{broken", None], D.settings)
    assert rows[0]["nft"]["public_minting_enabled"] == "1"
    assert rows[0]["nft"]["tier_pricing"] == "[[1,50]]"
    assert rows[0]["virtual"]["save_original_address"] == "1"
    assert rows[0]["payment_address"] == "0xab"
    assert rows[1]["nft"]["public_minting_enabled"] is None and rows[2]["buy_down_price"] is None


def test_attributes(spark):
    texts = [
        '{"constructor_0":[{"og_number":3},1,{"default":true,"pz_enabled":0}]}',
        '{"constructor_0":[{"og_number":3},1]}',
        '{"constructor_1":[]}',
        "{broken",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, datum string")
    rows = D.with_attributes(df).orderBy("i").collect()
    assert [r["valid"] for r in rows] == [True, False, False, False, False]
    a = rows[0]["attributes"]
    assert (a["og_number"], a["is_default"], a["pz_enabled"], a["image_hash"]) == (3, True, False, "")
    assert rows[1]["attributes"] is None
