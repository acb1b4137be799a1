import pytest
from pyspark.sql import functions as F

from rollbook.operators import lookups
from rollbook.operators import search as Q
from rollbook.operators import views

ROWS = [
    # name, hex, utxo, holder, og, updated, image_hash, type
    ("barbacoa", "6261", "u#0", "s1", 0, 100, "a", "handle"),
    ("burrito", "6275", "u#1", "s1", 2, 200, "b", "handle"),
    ("taco", "7461", "u#2", "s2", 0, 300, "a", "handle"),
    ("v@taco", "7640", "u#3", "s2", 0, 300, "a", "virtual_subhandle"),
    ("gone", "676f", "", "s2", 0, 400, "a", "handle"),
]


@pytest.fixture(scope="module")
def registry(spark):
    from rollbook.functions import scalars as S

    df = spark.createDataFrame(
        ROWS,
        "name string, hex string, utxo string, holder string, og_number int, updated_slot long, "
        "image_hash string, asset_type string",
    )
    name = F.col("name")
    return df.withColumns(
        {
            "standard_image_hash": F.lit("a"),
            "length": F.length(name),
            "rarity": S.rarity(name),
            "characters": S.characters(name),
            "numeric_modifiers": S.numeric_modifiers(name),
            "root": S.root_part(name),
            "asset_id": F.length(name).cast("long"),
        }
    ).cache()


def names(df):
    return [r["name"] for r in df.select("name").collect()]


@pytest.mark.parametrize(
    "spec, want",
    [
        ({}, {"barbacoa", "burrito", "taco", "v@taco"}),
        ({"length": "4-7"}, {"burrito", "taco", "v@taco"}),
        ({"length": 7}, {"burrito"}),
        ({"length": "20-28"}, set()),
        ({"og": True}, {"burrito"}),
        ({"personalized": True}, {"burrito"}),
        ({"search": "746"}, {"taco"}),
        ({"search": "746", "rarity": "common"}, set()),
        ({"search": "tac", "rarity": "common"}, {"taco", "v@taco"}),
        ({"holder": "s1"}, {"barbacoa", "burrito"}),
        ({"holder": "nobody"}, set()),
        ({"rarity": "common", "holder": "s1"}, {"burrito"}),
        ({"asset_type": "virtual_subhandle"}, {"v@taco"}),
        ({"names": ["taco", "gone", "new"]}, {"taco"}),
        ({"names": []}, set()),
    ],
)
def test_filters(registry, spec, want):
    assert set(names(Q.matches(registry, Q.SearchSpec(**spec)))) == want


def test_pages(registry):
    rows = Q.matches(registry, Q.SearchSpec())
    assert names(Q.paged(rows, Q.PageSpec())) == ["barbacoa", "burrito", "taco", "v@taco"]
    assert names(Q.paged(rows, Q.PageSpec(sort="desc", size=3))) == ["v@taco", "taco", "burrito"]
    assert names(Q.paged(rows, Q.PageSpec(page=2, size=3))) == ["v@taco"]
    assert names(Q.paged(rows, Q.PageSpec(page=2, size=1, show_all=True))) == ["burrito", "taco", "v@taco"]
    desc = Q.PageSpec(page=2, size=1, sort="desc", show_all=True)
    assert names(Q.paged(rows, desc)) == ["taco", "burrito", "barbacoa"]
    assert names(Q.paged(rows, Q.PageSpec(page=9, size=1, show_all=True))) == []
    assert sorted(names(Q.paged(rows, Q.PageSpec(sort="random")))) == ["barbacoa", "burrito", "taco", "v@taco"]


def test_slot_cursor(registry):
    rows = Q.matches(registry, Q.SearchSpec())
    assert names(Q.paged(rows, Q.PageSpec(slot=200, size=2))) == ["burrito", "taco"]
    assert names(Q.paged(rows, Q.PageSpec(slot=200, sort="desc"))) == ["burrito", "barbacoa"]
    assert names(Q.paged(rows, Q.PageSpec(slot=250))) == ["taco", "v@taco"]


@pytest.mark.parametrize(
    "make",
    [
        lambda: Q.SearchSpec(characters="nope"),
        lambda: Q.SearchSpec(length="nope"),
        lambda: Q.SearchSpec(length="1-29"),
        lambda: Q.SearchSpec(rarity="nope"),
        lambda: Q.SearchSpec(numeric_modifiers="nope"),
        lambda: Q.SearchSpec(asset_type="taco"),
        lambda: Q.SearchSpec(search="ab"),
        lambda: Q.SearchSpec(names={"handles": ["burritos"]}),
        lambda: Q.PageSpec(sort="hmm"),
        lambda: Q.PageSpec(size="two"),
        lambda: Q.PageSpec(page=1, slot=123),
    ],
)
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_availability(spark, registry):
    asked = ["taco", "gone", "***", "l", "free-name", "myjapan", "nope@taco", "x" * 30]
    requests = spark.createDataFrame(list(enumerate(asked)), "request_id long, name string")
    got = lookups.availability(requests, registry, spark.createDataFrame([("japan", 451)], "word string, code int")).orderBy("request_id").collect()
    assert [r["code"] for r in got] == [200, 404, 406, 406, 404, 451, 404, 406]


def test_sub_assets_and_roots(registry):
    assert names(lookups.sub_assets(registry)) == ["v@taco"]
    assert names(lookups.roots(registry)) == ["taco"]


def test_utxo_view_skips_rows_without_utxo(registry):
    assert "gone" not in names(views.live_rows(registry))


def test_pages_in_random_order_fit_together(spark):
    names = [f"n{i}" for i in range(100)]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    seen, last = [], None
    for page in (1, 2, 3, 4):
        part = rows.repartition(page + 2)
        spec = Q.PageSpec(sort="random", page=page, size=25)
        found = [r["name"] for r in Q.paged(part, spec).collect()]
        if last is not None:
            after = Q.paged(part, Q.PageSpec(sort="random", after=last, size=25))
            assert [r["name"] for r in after.collect()] == found
        seen, last = seen + found, found[-1]
    assert sorted(seen) == sorted(names) and seen != sorted(names, key=names.index)
    rest = [r["name"] for r in Q.paged(rows, Q.PageSpec(sort="random", page=2, size=25, show_all=True)).collect()]
    assert rest == seen[25:]
    other = [r["name"] for r in Q.paged(rows, Q.PageSpec(sort="random", size=100, seed=7)).collect()]
    assert other != seen


def test_words_of_a_table(spark):
    words = spark.createDataFrame([("ab", 423), ("abc", 403), ("x", 451), ("c" * 40, 423)], "word string, code int")
    names = spark.createDataFrame([("zabcz",), ("zabz",), ("x",), ("q",), ("zabz",)], "name string")
    got = sorted(tuple(r) for r in lookups.word_codes(names, words).collect())
    assert got == [("x", 451), ("zabcz", 403), ("zabz", 423)]
    assert lookups.word_codes(names, words.limit(0)).count() == 0


def test_postings_find_what_a_scan_finds(spark):
    names = ["abcabc", "xabcx", "ab", "a", "", "bcabca", "zz@root", "abcd" * 30]
    registry = spark.createDataFrame([(n, n.encode().hex()) for n in names], "name string, hex string")
    index = Q.postings(registry, ()).cache()
    for text in ("abc", "bca", "abca", "6162", "zz@", "nope", "6263616263"):
        want = sorted(n for n in names if text in n or text in n.encode().hex())
        assert sorted(r["name"] for r in Q.search_postings(index, text).collect()) == want
    with pytest.raises(ValueError):
        Q.search_postings(index, "ab")


def test_lookups_read_the_folders_they_need(spark):
    from rollbook.session import scratch_dir

    rows = spark.createDataFrame([(f"n{i}", f"h{i % 97}" if i % 3 else "hot") for i in range(600)], "name string, holder string")
    path = scratch_dir(spark, "copy")
    lookups.clustered(rows, F.col("holder")).write.partitionBy("folder").parquet(path)
    copy = spark.read.parquet(path)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    one = lookups.at_key(copy, "h5")
    assert sorted(r["name"] for r in one.collect()) == sorted(f"n{i}" for i in range(600) if i % 3 and i % 97 == 5)
    assert len({r[0] for r in one.select(F.input_file_name()).collect()}) == 1 and "PushedFilters: [IsNotNull(lookup_key), EqualTo(lookup_key,h5)]" in plan(one)
    keys = spark.createDataFrame([("h5",), ("h6",), (None,), ("h5",), ("nobody",)], "key string")
    some = lookups.at_keys(copy, keys)
    assert {r["holder"] for r in some.collect()} == {"h5", "h6"}
    folders = {r[0].split("folder=")[1].split("/")[0] for r in copy.select(F.input_file_name()).distinct().collect()}
    assert 1 <= len({r[0] for r in some.select(F.input_file_name()).collect()}) <= 3 < len(folders)
    assert "hashpartitioning(lookup_key" not in plan(some).split("BroadcastExchange")[0]
