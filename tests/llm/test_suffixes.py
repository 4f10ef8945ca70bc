"""op5 against brute force, and the suffix arrays themselves."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from cellmatrix.llm import queries, suffixes


def brute(rows):
    first, out = {}, {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            k = b[i : i + 50]
            first[k] = min(first.get(k, d), d)
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        gone = gone[:-1]
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 50, 301])
@pytest.mark.parametrize("k", [1, 2, 9])
def test_dc3(n, k):
    s = np.random.default_rng(n * k).integers(0, k, n)
    assert suffixes.dc3(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_edges(spark):
    p = "".join(chr(97 + i * 7 % 26) + chr(65 + i * 11 % 25) for i in range(60))
    rows = [(1, "x" + p), (2, p + "tail"), (3, None), (4, ""), (5, "a" * 300), (6, "b" + "a" * 90), (7, p[:49]), (8, "é" * 60), (9, "z" + "é" * 40), (10, p[:70] + "-" + p[50:]), (11, p + p)]
    assert result(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    extra = spark.createDataFrame([(None, p, 1), (5, p, 2), (5, p, 2)], "doc_id long, text string, d int")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.dedup(extra).collect())
    assert got == [(0, len(p)), (5, 0), (5, 0)]
    assert suffixes.dedup(extra.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    assert result(queries.queries()["op5_suffix_dedup"](spark, sf)) == brute(rows)
