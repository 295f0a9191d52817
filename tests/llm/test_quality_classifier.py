"""The field against all labellings of short chains; held-out labels; odd rows."""

import itertools
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilake.llm import quality_classifier as qc

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def every_labelling(node, switch):
    """(log partition sum, marginals of good, expected switches) of one chain by going through all labellings."""
    weights = []
    labellings = list(itertools.product((0, 1), repeat=len(node)))
    for y in labellings:
        weights.append(sum(v for v, k in zip(node, y, strict=True) if k) + sum(switch[a, b] for a, b in zip(y, y[1:], strict=False)))
    p = np.exp(weights) / np.exp(weights).sum()
    switches = np.zeros((2, 2))
    for w, y in zip(p, labellings, strict=True):
        for a, b in zip(y, y[1:], strict=False):
            switches[a, b] += w
    return np.log(np.exp(weights).sum()), [sum(w for w, y in zip(p, labellings, strict=True) if y[t]) for t in range(len(node))], switches


def test_forward_backward_equals_all_labellings():
    rng = np.random.default_rng(1)
    sizes = [3, 0, 1, 7, 5, 1, 0, 2]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    node, switch = rng.normal(size=starts[-1]) * 2, rng.normal(size=(2, 2))
    log_z, marginal, pair = qc.chain(node, switch, starts)
    for k, size in enumerate(sizes):
        if size:
            a, b = starts[k], starts[k + 1]
            z, good, switches = every_labelling(node[a:b], switch)
            assert np.isclose(log_z[k], z) and np.allclose(marginal[a:b, 1], good) and np.allclose(pair[a:b].sum(axis=0), switches)
    assert np.allclose(marginal.sum(axis=1), 1)


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    starts = np.array([0, 4, 4, 9, 10])
    x, y = rng.normal(size=(10, 3)), rng.integers(0, 2, 10)
    w, s = rng.normal(size=3), rng.normal(size=(2, 2))
    _, g, h = qc.gradient(w, s, x, y, starts)
    e = 1e-6
    for k in range(3):
        up = w.copy()
        up[k] += e
        assert abs((qc.gradient(up, s, x, y, starts)[0] - qc.gradient(w, s, x, y, starts)[0]) / e - g[k]) < 1e-3
    for i, j in itertools.product((0, 1), repeat=2):
        up = s.copy()
        up[i, j] += e
        assert abs((qc.gradient(w, up, x, y, starts)[0] - qc.gradient(w, s, x, y, starts)[0]) / e - h[i, j]) < 1e-3


def test_features_of_lines_equal_plain_counts():
    texts = ["One two two.\n\n  \nTHREE!! 4$$ é é é\nOne two two.", None, "", "x", "\n".join(["same"] * 3)]
    own, weight, starts = qc.text_features(texts)
    assert starts.tolist() == [0, 3, 3, 3, 4, 7]
    assert np.allclose(own[:, -1], [0, 0, 1, 0, 0, 1, 1])
    assert np.allclose(own[:, 0] * 5, np.log1p([3, 5, 3, 1, 1, 1, 1]))
    assert np.allclose(own[:2, 8], [0, 2 / 5]) and np.allclose(own[:2, 9], [0, 2 / 5])
    assert np.allclose(own[1, 2] ** 2, 2 / weight[1]) and np.allclose(own[1, 11], 1 / 5)
    long = "word " * 40000
    assert b"".join(qc.lines_of(long)) == long.encode() and len(qc.lines_of(long)) == 4
    assert len(qc.lines_of("y" * 200000)) == 4


def test_chunks_do_not_change_features(monkeypatch):
    texts = ["\n".join(f"line {i % 7} of {k} and more" for i in range(30)) for k in range(5)]
    whole = qc.text_features(texts)
    monkeypatch.setattr(qc, "CHUNK_BYTES", 50)
    assert all(np.allclose(a, b) for a, b in zip(whole, qc.text_features(texts), strict=True))


def area(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    pos = labels.sum()
    return (rank[labels == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(labels) - pos))


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = qc.op12_quality_classifier(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    scores, labels = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert area(scores, labels) >= 0.97
    wrong = [(r.predicted, r.quality) for r in rows if r.predicted != r.quality]
    assert len(wrong) <= 0.05 * len(rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_query_learns_nothing_from_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = qc.labelled_lines(docs, labels), qc.labelled_lines(docs, turned)
    assert len(a) == len(b) > 20 and all((x[0] == y[0]).all() and x[2] == y[2] for x, y in zip(a, b, strict=True))
    out = qc.op12_quality_classifier(spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(8)] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")
    model = qc.fit_from(odd_docs, labels)
    out = qc.score_documents(odd_docs, model)
    rows = out.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.score for r in rows if r.n_lines == 0} == {model.base}
    assert qc.score_documents(no_docs, model).count() == 0
    none = qc.fit_from(odd_docs, labels.limit(0))
    assert {r.predicted for r in qc.score_documents(odd_docs, none).collect()} == {1}
    bad = qc.fit_from(odd_docs, labels.withColumn("quality", F.lit(0)))
    assert {r.predicted for r in qc.score_documents(odd_docs, bad).collect()} == {0}


if __name__ == "__main__":
    pytest.main([__file__])
