"""Shards by sampled splitters, against their SQL and a plain version."""

import collections
import hashlib
import zlib

import duckdb
import oracle
import pytest

from rollbook.llm import sharding
from rollbook.llm.common import stored_once
from rollbook.llm.queries import ORACLES, QUERIES
from rollbook.session import read_table, scratch_dir


def plain(rows, shards):
    """(doc_id, size, checksum, shard, slot) of each row, from one global order."""
    texts = [(hashlib.md5((t or "").encode()).hexdigest(), d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows]
    texts.sort()
    total, parts = sum(r[3] for r in texts), sharding.part_count(len(texts), shards)
    held, count, first, at = collections.Counter(), collections.Counter(), {}, 0
    for r in texts:
        first.setdefault(r[0], at)
        held[r[0]] += r[3]
        count[r[0]] += 1
        at += r[3]
    out, slots, at = [], collections.Counter(), 0
    for digest, has_id, doc_id, size, crc in texts:
        cut = held[digest] * parts > total or count[digest] * parts > len(texts)
        middle = 2 * at + size if cut else 2 * first[digest] + held[digest]
        shard = min(shards - 1, middle * shards // (2 * total))
        out.append((doc_id if has_id else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        at += size
    return sorted(out, key=repr)


def result(frame):
    assert {(r["law"], r["grown_shard"]) for r in frame.collect()} <= {("bytes", None)}
    return sorted((tuple(r[c] for c in ("doc_id", "size", "text_crc32", "shard", "slot")) for r in frame.collect()), key=repr)


def test_shards_equal_their_sql(spark, small):
    name = "op11_sampled_splitters"
    got, want = oracle.compare(spark, oracle.connect(small), small, QUERIES[name], ORACLES[name])
    assert got == want


def test_shards_stay_in_the_jvm(spark, small):
    frame = sharding.shard_records(read_table(spark, small, "documents"))
    assert "Python" not in frame._jdf.queryExecution().toString()


HOT = [(k % 7, "the hot text") for k in range(400)] + [(9, "")] * 300 + [(None, None)] * 50
ODD = [(1, None), (1, ""), (2, "é\U0001d518"), (None, "no id"), (3, "long " * 30_000), (4, "a"), (4, "a"), (4, "a")]


@pytest.mark.parametrize("parts,shards", [(128, 8), (2, 8), (1, 3), (16, 1)])
def test_hot_groups_ties_and_odd_rows(spark, monkeypatch, parts, shards):
    monkeypatch.setattr(sharding, "PARTS", parts)
    rows = HOT + ODD + [(100 + k, f"text {k} " + "word " * (k % 90)) for k in range(700)]
    docs = spark.createDataFrame([(*r, "x", 1.5, 7) for r in rows], "doc_id long, text string, digest string, row double, shard int")
    assert result(sharding.shard_records(docs.repartition(5), shards)) == plain(rows, shards)


def test_sizes_are_near_equal_and_groups_whole(spark):
    rows = HOT + [(100 + k, f"text {k // 3} " + "word " * (k // 3 % 90)) for k in range(3000)]
    out = plain(rows, 8)
    got = result(sharding.shard_records(spark.createDataFrame(rows, "doc_id long, text string"), 8))
    assert got == out
    sizes, shards_of = collections.Counter(), collections.defaultdict(set)
    for _, size, crc, shard, _ in got:
        sizes[shard] += size
        shards_of[crc].add(shard)
    ideal, longest = sum(sizes.values()) / 8, max(r[1] for r in got)
    assert all(abs(sizes[k] - ideal) <= 2 * (ideal / 128 + longest) for k in range(8))
    hot = {zlib.crc32(b"the hot text"), 0}
    assert all(len(s) == 1 for crc, s in shards_of.items() if crc not in hot)
    for shard in range(8):
        slots = sorted(r[4] for r in got if r[3] == shard)
        assert slots == list(range(len(slots)))


def test_no_range_is_overfull(spark):
    rows = HOT + [(100 + k, f"text {k}") for k in range(3000)]
    records = spark.createDataFrame(rows, "doc_id long, text string").select(*sharding.key_columns())
    records = stored_once(spark, records, "keys")
    ranges = sharding.sampled_ranges(records, 8)
    parts = sharding.part_count(len(rows), 8)
    counts = records.groupBy(sharding.range_of(ranges.splitters).alias("r")).count().collect()
    assert max(r["count"] for r in counts) <= 2 * len(rows) / parts + 1
    assert ranges.splitters == sorted(set(ranges.splitters))


def test_written_shards_hold_every_row(spark, small):
    docs = read_table(spark, small, "documents")
    docs = docs.unionByName(docs.limit(20)).withColumnRenamed("lang", "Shard")
    path = scratch_dir(spark, "shards")
    written = sharding.write_shards(docs, path, 4)
    assert written.columns == [*docs.columns, "shard_"]
    assert sorted(map(repr, written.drop("shard_").collect())) == sorted(map(repr, docs.collect()))
    want = collections.Counter((r[0], r[3]) for r in result(sharding.shard_records(docs, 4)))
    assert collections.Counter((r["doc_id"], r["shard_"]) for r in written.collect()) == want


def test_empty_and_checksums(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_records(docs).count() == 0
    assert sharding.write_shards(docs, scratch_dir(spark, "shards")).count() == 0
    con = duckdb.connect()
    con.execute("create table documents as select 1 as doc_id, 'é, text' as text")
    assert con.execute(sharding.shards_sql()).fetchone()[2] == zlib.crc32("é, text".encode())
