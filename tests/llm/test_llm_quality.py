"""Quality discriminant: held-out accuracy, the formula, odd rows."""

import zlib

import numpy as np
import pyarrow as pa

from rollbook.llm import quality_qda as Q
from rollbook.llm.queries import QUERIES
from rollbook.session import read_table

DIR = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    got = {r["doc_id"]: r for r in QUERIES["op7_quality_discriminant"](spark, DIR).collect()}
    labels = read_table(spark, DIR, "labels").collect()
    assert len(got) == read_table(spark, DIR, "documents").count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    out = [(got[r["doc_id"]]["score"], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    assert np.mean([(s >= 0.5) == q for s, q in out]) >= 0.95
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


def test_scores_are_the_normal_densities():
    rng = np.random.default_rng(1)
    rows = [rng.normal(c, 1 + c, (400, 3)) for c in (0, 1)]
    model = Q.fit(
        np.array([400.0, 400.0]),
        np.array([r.sum(axis=0) for r in rows]),
        np.array([r.T @ r for r in rows]),
        shrinkage=0.0,
    )
    point = rng.normal(0, 1, (50, 3))
    logs = []
    for r in rows:
        cov, off = np.cov(r.T, bias=True), point - r.mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.scores(point), 1 / (1 + np.exp(logs[0] - logs[1])), atol=1e-3)


def test_statistics_depend_on_the_text_alone():
    texts = ["A b, c!", "", "x" * 100_000, "A b, c!", "é ü\nline | line", "  "]
    every = Q.document_statistics(pa.array(texts))
    alone = np.concatenate([Q.document_statistics(pa.array([t])) for t in texts])
    assert np.array_equal(every, alone) and np.isfinite(every).all()


def test_odd_rows(spark):
    rows = [(1, None, 3.0), (2, "", 3.0), (2, "", 3.0), (None, "word", 3.0), (5, "w " * 100_000, 3.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (77, 0), (5, None)], "doc_id long, quality int")
    statistics = Q.with_statistics(docs)
    model = Q.train(statistics, labels)
    assert model is None  # one class only
    got = Q.score(statistics, model).collect()
    assert len(got) == 5 and {(r["score"], r["predicted"]) for r in got} == {(0.5, 1)}
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert Q.keep_good(docs, model).collect() == docs.collect()
    assert Q.score(Q.with_statistics(docs.limit(0)), model).count() == 0
    trained = Q.train(Q.with_statistics(read_table(spark, DIR, "documents")), read_table(spark, DIR, "labels"))
    again = Q.score(statistics, trained).collect()
    assert len(again) == 5 and all(0 <= r["score"] <= 1 for r in again)
