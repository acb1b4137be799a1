"""The pipeline: planted cases, odd rows, brute force for each stage."""

import hashlib

import brute
import pytest

import corpus_pipeline
from rollbook.llm.queries import byte_bpe
from rollbook.session import read_table

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, DIR, "documents")


def test_stages_return_the_columns_of_documents(spark, docs, tmp_path_factory):
    now = docs.selectExpr("*", "doc_id as component_id", "'x' as score")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, DIR, "labels").collect()}
    before = set(texts)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / "out")
        out = stage(spark, now, DIR)
        out.write.parquet(path)
        out = spark.read.parquet(path)
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        if k < 3:
            assert out.dtypes == now.dtypes, name
        if k == 0:
            good = [d for d in before if labels.get(d) == 1]
            assert sum(d in kept for d in good) >= 0.98 * len(good)
            bad = [d for d in before if labels.get(d) == 0]
            assert sum(d in kept for d in bad) <= 0.05 * len(bad)
        elif k == 1:
            want = brute.near_duplicates([(d, texts[d]) for d in before], 5)
            assert kept == {d for d in before if want[d][1] == d}
        elif k == 2:
            items = [(r["item_id"], r["text"]) for r in read_table(spark, DIR, "benchmark").collect()]
            want = brute.contaminated([(d, texts[d]) for d in before], items)
            assert want and kept == before - {d for d, _ in want}
        else:
            assert kept == before
            for r in out.collect():
                assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        before, now = kept, out


def test_odd_rows(spark, docs):
    rows = [(-1, None), (-2, ""), (-3, ""), (None, "One plain sentence without anything odd in it."), (-4, "x " * 100_000)]
    odd = spark.createDataFrame([(*r, "en", None, 0) for r in rows], docs.schema)
    for table in (odd, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, DIR)
            assert now.count() <= table.count()
    assert corpus_pipeline.ORACLE_SQL is None and byte_bpe()
