"""Tables written on the way hold what cannot be made where they are read, and nothing twice."""

import glob
import os

import pytest
from ledgers import SCHEMA, random_ledger
from pyspark.sql import functions as F

from rollbook import session
from rollbook.functions import datum as D
from rollbook.operators import fold
from rollbook.operators import search as Q
from rollbook.plans import QUERIES, stream_queries
from rollbook.sources import blocks as B
from rollbook.sources import fixtures as X
from rollbook.streaming.registry_stream import RegistryStream


def _bytes(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def _written(spark, monkeypatch, build):
    """Bytes of the tables that a call stores."""
    paths = {}
    monkeypatch.setattr(session, "_STORED", paths)
    build()
    return sum(map(_bytes, paths.values()))


def test_the_block_archive_holds_lines_only(spark, small, monkeypatch):
    lines = session.read_table(spark, small, "lineitem").count()
    assert _written(spark, monkeypatch, lambda: X.blocks(spark, small)) < 40 * lines


def test_the_registry_is_stored_as_what_it_follows_from(spark, small, monkeypatch):
    rows = X.registry(spark, small).count()
    assert _written(spark, monkeypatch, lambda: X.registry(spark, small)) < 150 * rows
    X.registry_by(spark, small, "stake_key")
    copy = next(path for (_, _, label), path in session._STORED.items() if label == "registry-by-stake_key")
    assert set(spark.read.parquet(copy).columns) == {*X.BASE, "lookup_key", "folder"}


def test_pieces_do_not_depend_on_which_orders_are_hot(spark, small, monkeypatch):
    monkeypatch.setattr(X, "PIECE_LINES", 3)
    with_hot = X.transactions(spark, small)
    monkeypatch.setattr(X, "counted_hot", lambda *_: None)
    without = X.transactions(spark, small)
    assert without.agg(F.max("pieces")).first()[0] > 1
    assert with_hot.exceptAll(without).isEmpty() and without.exceptAll(with_hot).isEmpty()


def test_names_are_posted_in_lists_and_held_once(spark):
    names = [f"n{i:05d}" for i in range(3000)]
    registry = spark.createDataFrame([(n, n.encode().hex()) for n in names] + [(None, "6e30"), ("n01", None)], "name string, hex string")
    index = Q.postings(registry.coalesce(1), ()).cache()
    assert index.where("gram is null").agg(F.sum(F.size("held"))).first()[0] == 3002
    posted = index.where("gram is not null").agg(F.count(F.lit(1)), F.sum(F.size("rows"))).first()
    assert posted[0] * 4 < posted[1]  # a row for a list, not for each name in it
    assert Q.search_postings(index, "n01").count() == 1000


@pytest.mark.parametrize("width", [5, 1 << 20])
@pytest.mark.parametrize("form", [{}, {"detail": True}, {"whole": True}])
def test_states_without_a_row_per_event_are_those_of_the_annotated_ledger(spark, width, form):
    ledger = spark.createDataFrame(random_ledger(300, 7, 11), SCHEMA)
    brief = fold.current(ledger, width, **form)
    whole = fold.current_state(fold.annotate(ledger, width, **form))
    assert sorted(map(str, brief.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))


def test_late_numbers_are_the_numbers_of_the_ledger(spark, small):
    nested = X.blocks(spark, small)
    dense = B.ledger_rows(nested, X.POLICIES).select("name", "slot", "utxo", "kind", F.col("seq").alias("number"))
    placed = B.ledger_rows(nested, X.POLICIES, gaps=True).join(B.numbers(nested, X.POLICIES), F.col("seq") == F.col("position"))
    placed = placed.select(*dense.columns)
    assert placed.count() > 1000 and dense.exceptAll(placed).isEmpty() and placed.exceptAll(dense).isEmpty()


def test_stream_input_is_packed(spark, small):
    base = session.scratch_dir(spark, "packed")
    rows = X.ledger(spark, small)
    for _ in stream_queries._arrivals(rows, base):
        pass
    assert glob.glob(f"{base}/step*/*.json.gz") and not glob.glob(f"{base}/step*/*.json")
    assert spark.read.json(f"{base}/step*").count() == rows.count()


@pytest.mark.parametrize("width", [5, 1 << 20])
def test_marked_ends_give_the_same_states(spark, width):
    ledger = spark.createDataFrame(random_ledger(300, 7, 5), SCHEMA)
    ends = fold.annotate(ledger, width, whole=True, ends=True)
    assert ends.where("is_end").count() == ends.select("name", "chunk").distinct().count() < ends.count()
    want = fold.final_state(fold.annotate(ledger, width, whole=True))
    assert sorted(map(str, fold.final_state(ends).collect())) == sorted(map(str, want.collect()))


def test_the_work_of_a_batch_goes_with_it(spark, small):
    stream = RegistryStream(spark, session.scratch_dir(spark, "registry"))
    stream.process(X.ledger(spark, small), 0)
    assert stream.registry().count() > 0
    assert not [path for table in stream.WORK for path in glob.glob(f"{stream.base}/{table}/*")]


@pytest.mark.parametrize("name", ["st_block_fold", "st_registry"])
def test_events_are_made_once_for_counting_and_folding(spark, small, monkeypatch, name):
    seen, folded = [], fold.folded
    monkeypatch.setattr(session, "_STORED", {})
    monkeypatch.setattr(fold, "folded", lambda events, fields: seen.append(events) or folded(events, fields))
    QUERIES[name](spark, small)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1 and "Relation" in plan and "Generate" not in plan and "transform(" not in plan


@pytest.mark.parametrize("width", [5, 1 << 20])
def test_events_carry_what_the_fields_asked_for_come_from(spark, width):
    ledger = spark.createDataFrame(random_ledger(300, 7, 3), SCHEMA)
    fields = "amount", "updated", "holder", "reference_seq"
    events = fold.lean(fold.coded(ledger), fields)
    assert events.where("datum is not null or lovelace is not null").isEmpty() and not events.where("holder is not null").isEmpty()
    want = fold.current(ledger, width, detail=True).select("name", *fields)
    assert sorted(map(str, fold.folded(events, fields, width).select("name", *fields).collect())) == sorted(map(str, want.collect()))


def test_numbers_follow_from_the_places_of_the_ledger(spark, small):
    nested = X.blocks(spark, small)
    rows = session.materialized(B.ledger_rows(nested, X.POLICIES, gaps=True, keep=B.PLACE), "rows")
    got, want = B.numbers_of(rows.select("place.*")), B.numbers(nested, X.POLICIES)
    assert got.count() == rows.select("seq").distinct().count() > 1000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_texts_without_the_key_are_not_parsed(spark):
    texts = [
        '{"constructor_0":[1,"a",{"b":2}]}', '{"constructor\\u005f0":[1,2,3]}', '{"owner":7}', '{"constructor_1":[1]}', "{broken", "[[1,2],3]",
        '{"constructor_0":{"a":1}}', '{"constructor_0":[1,2', '"constructor_0"', "", None,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "datum string")
    plain = F.from_json("datum", "constructor_0 array<string>")["constructor_0"]
    found = rows.select(D.parts(F.col("datum")).alias("got"), plain.alias("want")).collect()
    assert [r["got"] for r in found] == [r["want"] for r in found] and found[1]["got"] == ["1", "2", "3"]
    assert "constructor_0" in str(D.parts(F.col("datum"))._jc).partition("from_json(")[2].partition("THEN")[0]
