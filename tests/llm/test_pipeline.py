"""Each stage of the pipeline is judged on what its predecessor kept."""

import re
import string

import corpus_pipeline
import pyarrow.parquet as pq

from cellmatrix.llm.common import Workspace

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    ws, docs, seen = Workspace(spark), spark.read.parquet(f"{SF}/documents.parquet"), {}
    names, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = ws.keep(stage(spark, docs, SF), f"test_{k}")
        rows = docs.collect()
        seen[name] = {r["doc_id"] for r in rows}
        assert len(seen[name]) == len(rows) and seen[name] <= before
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == names
        if name == "near_dedup":
            assert len({" ".join((r["text"] or "").lower().split()) for r in rows if (r["text"] or "").split()}) == len([r for r in rows if (r["text"] or "").split()])
        if name == "decontamination":
            items = [" ".join(t.lower().split()) for t in pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist() if t and t.split()]
            assert not [1 for r in rows for t in items if f" {t} " in f" {' '.join((r['text'] or '').lower().split())} "]
        before = seen[name]
    # The written stages give what run() gives.
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == before


def shingles(text, n=5):
    w = re.findall(r"[^ \t-\r]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def test_near_dedup_five_words(spark):
    """What the stage keeps is the smallest id of each component of pairs that reach 0.8 on five words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    by_size, root = sorted((len(s), i) for i, s in sets.items() if s), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (n, a) in enumerate(by_size):
        for m, b in by_size[k + 1 :]:
            if 10 * n < 8 * m:
                break
            both = len(sets[a] & sets[b])
            if 10 * both >= 8 * (n + m - both):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i in root if root[i] == i}
