"""op1 and op2 against their SQL, and archives with magic in their payloads."""

import duckdb
import pytest

from cellmatrix.llm import neardup, oracles, queries, warc
from cellmatrix.llm.common import Workspace

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = con.execute(oracles.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(map(repr, got.fetchall())) == sorted(repr(tuple(r)) for r in queries.queries()[name](spark, SF).select(*names).collect())


def test_magic_in_payload(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "u", "a" + fake * 3 + "é"), (2, "u\n", fake), (3, None, None), (4, "v", "x" * 1500), (5, "v", "x" * 1500), (None, "v", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = Workspace(spark).root + "/warc"
    warc.write(warc.plan(df), path)
    out = {r["page_id"]: r for r in warc.read(spark, path).collect()}
    assert len(out) == 6
    assert bytes(out[1]["payload"]).decode() == rows[0][2]
    assert bytes(out[2]["payload"]).decode() == fake
    assert out[3]["payload_bytes"] == 0
    assert (out[4]["record_type"], out[4]["refers_to"], out[5]["record_type"]) == ("revisit", 5, "response")


def test_near_duplicates_edges(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base + " end"), (3, base + " end more"), (4, None), (5, ""), (6, "A b"), (7, "a B"), (8, base.replace("w30", "q") + "".join(f" z{i}" for i in range(9)))]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["component_id"] for i in range(1, 9)] == [1, 1, 1, 4, 5, 6, 6, 8]
    assert got[4]["n_shingles"] == 0 and got[6]["n_shingles"] == 1


def test_groups_by_brute_force(spark):
    """A large group of near copies, texts that share a passage, ids of several texts, repeats: components against all pairs."""
    import random

    rng = random.Random(5)
    base, passage, rows = [f"b{i}" for i in range(90)], [f"p{i}" for i in range(40)], []
    for k in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        rows.append((1000 - k, " ".join(w)))
    for k in range(80):
        own = [f"o{k}_{i}" for i in range(rng.choice([0, 2, 4, 8, 20, 60]))]
        rows.append((2000 + k, " ".join(own + passage)))
    rows += [(3000, "x y z"), (3000, "q r s t"), (3001, "Q r s T"), (3002, "X y z"), (3003, None), (None, "x y z"), (3004, " "), rows[0], rows[200]]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, keys string").repartition(4)
    for pct, size in ((85, 3), (80, 5)):
        sets = []
        for i, t in rows:
            w = (t or "").lower().split()
            sets.append((i, frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()))
        root = {i: i for i, _ in sets if i is not None}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        known = [x for x in sets if x[0] is not None and x[1]]
        for n, (i, s) in enumerate(known):
            for j, t in known[:n]:
                both = len(s & t)
                if 100 * both >= pct * (len(s) + len(t) - both):
                    lo, hi = sorted((find(i), find(j)))
                    root[hi] = lo
        want = sorted(repr((i, len(s), find(i) if i is not None and s else i)) for i, s in sets)
        got = neardup.near_duplicates(df, pct, size).collect()
        assert sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_far_members_of_a_group_make_few_candidates(spark, monkeypatch):
    """Texts with four or five edits each of one text that is not there: nearly all pairs share buckets, few are similar."""
    import random

    rng = random.Random(3)
    rows = []
    for k in range(240):
        w = [f"b{i}" for i in range(150)]
        for i in rng.sample(range(150), 4 + k % 2):
            w[i] = f"e{k}_{i}"
        rows.append((k, " ".join(w)))
    rows += [(1000, rows[7][1] + " x y"), (1001, rows[7][1] + " x z"), (1002, "q " + rows[100][1])]
    made, keep = {}, Workspace.keep

    def counted(self, df, name, codec="zstd"):
        out = keep(self, df, name, codec)
        if name.startswith("cand"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(Workspace, "keep", counted)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows}
    want = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                lo, hi = sorted((want[i], want[j]))
                want = {k: lo if v == hi else v for k, v in want.items()}
    assert got == want
    assert made["cand2"] < 2 * len(rows) and sum(made.values()) < 20 * len(rows)
