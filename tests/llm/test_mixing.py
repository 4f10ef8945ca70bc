"""The topic by which documents are mixed."""

import collections
import math
import random

import pyarrow.parquet as pq

from cellmatrix.llm import mixing


def test_topic_follows_subject(spark):
    """Long documents that share their common words have the topic of their own keyword, whatever else they hold."""
    rng, subjects = random.Random(1), [f"subject{i}" for i in range(24)]
    common, others = [f"the{i}" for i in range(40)], [f"word{i}" for i in range(600)]
    rows = []
    for k in range(240):
        w = common * 6 + rng.choices(others, k=150) + [subjects[k % 24]] * 12
        rng.shuffle(w)
        rows.append((k, " ".join(w), "en", f"s{k % 3}"))
    rows += [(900, None, "en", "s0"), (901, "the1 the2", "en", "s0"), (902, "the1", None, None)]
    got = {r["doc_id"]: r["topic"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    by_subject = [{got[k] for k in range(s, 240, 24)} for s in range(24)]
    assert all(len(t) == 1 for t in by_subject)
    assert len(set.union(*by_subject)) >= 5 and min(set.union(*by_subject)) >= 0
    assert got[900] == got[901] == -1


def test_no_topic_holds_most_long_texts(spark):
    """On long English documents no topic holds half; the most over-represented keyword by brute force is the one taken."""
    sf = "/root/testdata/sf0.01"
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = {r["doc_id"]: (r["topic"], r["n_tokens"]) for r in mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    held = collections.Counter(got[d["doc_id"]][0] for d in docs if d["lang"] == "en" and got[d["doc_id"]][1] >= 300)
    assert max(held.values()) < 0.5 * sum(held.values())
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = {d["doc_id"]: [w for w in (d["text"] or "").translate(lower).translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" ") if w] for d in docs}
    count, of = collections.defaultdict(collections.Counter), {d["doc_id"]: d["lang"] for d in docs}
    for i, w in split.items():
        count[of[i]].update(w)
    total, best = {k: sum(c.values()) for k, c in count.items()}, {}
    for i, w in split.items():
        z = {}
        for x, k in collections.Counter(w).items():
            if mixing.RARE <= (p := count[of[i]][x] / total[of[i]]) <= mixing.COMMON:
                z[x] = (k - len(w) * p) / math.sqrt(len(w) * p)
        best[i] = {x for x, v in z.items() if v > max(z.values()) - 1e-9}
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([(x,) for x in set.union(*best.values())], "w string").selectExpr("w", f"cast(pmod(xxhash64(w), {mixing.TOPICS}) as int) b").collect()}
    assert all(got[i][0] in ({bucket[x] for x in b} or {-1}) for i, b in best.items())


def table(spark, n=400):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.randint(1, 80))), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), 0.5, "x") for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight double, _topic string")


def test_weights_meet_the_marginals(spark):
    """Raked weights against plain iterative fitting; probabilities give the budget; columns of clashing names."""
    out = mixing.mix(table(spark), fraction=0.3, tolerance=1e-9)
    assert out.columns == ["doc_id", "text", "lang", "source", "_topic", "topic", "n_tokens", "weight", "prob", "selected"]
    rows = out.collect()
    assert len(rows) == 400 and all(0 <= r["prob"] <= 1 and r["selected"] in (True, False) for r in rows)
    cells = collections.Counter()
    for r in rows:
        cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    total = sum(cells.values())
    goals = []
    for i in range(3):
        t = collections.Counter()
        for k, v in cells.items():
            t[k[i]] += v
        part = sum(v**mixing.ALPHA for v in t.values())
        goals.append({k: v**mixing.ALPHA / part for k, v in t.items()})
    w = {k: v / total for k, v in cells.items()}
    for _ in range(500):
        for i, goal in enumerate(goals):
            have = collections.Counter()
            for k, v in w.items():
                have[k[i]] += v
            w = {k: v * goal[k[i]] / have[k[i]] for k, v in w.items()}
    for r in rows:
        assert math.isclose(r["weight"], w[r["source"], r["lang"], r["topic"]], rel_tol=1e-5)
    assert math.isclose(sum(r["prob"] * r["n_tokens"] for r in rows), 0.3 * total, rel_tol=1e-6)
    kept = sum(r["n_tokens"] for r in rows if r["selected"])
    assert 0.2 * total < kept < 0.4 * total


def test_edges(spark):
    import pytest

    assert mixing.mix(table(spark).limit(0)).count() == 0
    goals = {d: spark.createDataFrame([(v, t) for v, t in g], f"{d} {k}, target double") for d, k, g in (("source", "string", [("a", 0.5), ("zz", 0.5)]), ("lang", "string", [("en", 1.0)]))}
    with pytest.raises(ValueError):
        mixing.mix(table(spark), goals=goals)
    same = spark.createDataFrame([(1, "a b c", "en", "s")] * 5 + [(2, "", None, None), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    rows = mixing.mix(same).collect()
    assert len({(r["selected"], r["prob"]) for r in rows if r["doc_id"] == 1}) == 1 and not any(r["selected"] for r in rows if r["doc_id"] > 1)
