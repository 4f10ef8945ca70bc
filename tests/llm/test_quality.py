"""The statistics of op4."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from cellmatrix.llm import quality


def test_top_word_is_the_most_frequent():
    at = quality.STATS.index("top_word")
    assert quality.stats("a of in " + "stuffing " * 17)[at] == 17 / 20
    assert quality.stats("bb aa cc dd dd")[at] == 2 / 5
    assert quality.stats(None)[at] == quality.stats(" \n")[at] == 0


def test_normal_equations_and_calibration(spark):
    """Ridge weights against numpy on all rows at once; scores never fall as the raw fit rises."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, len(quality.STATS)))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(float)
    train = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    m = quality.fit(train)
    z = m.map(x)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * 300 * np.diag([1.0] * quality.RFF + [0.0]) + 1e-9 * np.eye(quality.RFF + 1), z.T @ y)
    assert np.allclose(m.beta, want, atol=1e-6)
    assert (np.diff(m.to) >= 0).all() and ((m.score(x) >= 0.5) == (y == 1)).mean() > 0.9
    assert quality.isotonic(np.array([1.0, 1, 2]), np.array([1.0, 0, 0.25])).tolist() == [0.375, 0.375, 0.375]


def test_kernel():
    """Products of the features come to the Gaussian kernel."""
    rng = np.random.default_rng(1)
    m = quality.Model(np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    x = rng.normal(size=(40, len(quality.STATS))) * 0.5
    z = m.map(x)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-quality.GAMMA * far)).mean() < 0.06


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r["doc_id"]: r for r in quality.classify(docs.withColumn("score", F.lit("x")), labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [i for i in truth if i in got and got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.9


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a " * 200_000), (4, "same text"), (4, "same text"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, None), (None, 1), (77, 1), (3, 1)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 6
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
