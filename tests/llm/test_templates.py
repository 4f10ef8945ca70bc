"""Line dedup: passages that few texts hold, and what stays."""

import pytest

from cellmatrix.llm import templates


def prose(tag, n):
    return " ".join(f"{tag}{i}" for i in range(n))


def cleaned(spark, rows):
    out = templates.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: (r["text"], r["n_dropped"]) for r in out}


@pytest.mark.parametrize("texts", [2, 3, 5])
@pytest.mark.parametrize("passage", [prose("p", 60), "\n".join(prose(f"{c}", 12) for c in "pqrst"), prose("p", 30) + "\n\n" + prose("q", 30)])
def test_passages_of_few_texts(spark, texts, passage):
    rows = [(k, f"{prose(f'a{k}x', 30)}\n{passage}\n{prose(f'b{k}x', 30)}") for k in range(texts)]
    got = cleaned(spark, [*rows, (9, prose("z", 80))])
    n = sum(bool(x) for x in passage.split("\n"))
    assert got[0] == (rows[0][1], 0) and got[9][1] == 0
    for k in range(1, texts):
        assert got[k][1] == n
        assert got[k][0].split() == (prose(f"a{k}x", 30) + " " + prose(f"b{k}x", 30)).split()


def test_what_stays(spark):
    """Short lines of few texts, exact copies, copies of the first text and lines with a field of their own stay."""
    shared = prose("p", 60)
    rows = [
        (1, f"{prose('a', 30)}\n{shared}"), (2, f"{prose('a', 30)}\n{shared}"), (3, f"{prose('b', 30)}\n{shared}"), (4, prose("c", 50)), (5, prose("c", 50)),
        (6, f"{prose('s', 10)}\n{prose('d', 40)}"), (7, f"{prose('s', 10)}\n{prose('e', 40)}"), (8, prose("v", 30) + " x"), (9, prose("v", 30) + " y"), (10, None), (None, shared),
    ]
    got = cleaned(spark, rows)
    assert {k for k, v in got.items() if v[1]} == {3, None}
    assert got[3] == (prose("b", 30), 1) and got[None] == ("", 1)
    assert all(got[k][0] == t for k, t in rows if k not in (3, None))


def test_templates_by_brute_force(spark):
    """Recurring lines with variable fields against the definition in plain Python; clashing columns."""
    import random
    import re

    rng, rows = random.Random(4), []
    for k in range(60):
        lines = [f"Posted by user{rng.randint(0, 9)} on day {rng.randint(1, 28)} of the month", "read more about our terms", " ".join(rng.choices("abcdefg", k=6)), "", prose(f"own{k}", 8)]
        rng.shuffle(lines)
        rows.append((k if k % 11 else None, "\n".join(lines[: rng.randint(1, 5)]), k, "h", 1))
    rows += [(500, None, 0, "h", 1), (501, "", 0, "h", 1), (rows[3][0], rows[3][1], 7, "h", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, text_hash string, marks int")
    out = templates.clean_lines(df)
    assert out.columns == ["doc_id", "text", "text_hash", "marks", "n_lines", "n_dropped"]
    # Token count and leading tokens (those with digits masked) name a leaf.
    texts, leaves = sorted({r[1] for r in rows if r[1]}), {}
    for t in texts:
        for i, line in enumerate(t.split("\n")):
            w = line.split()
            if len(w) >= templates.MIN_TOKENS:
                leaves.setdefault((len(w), *["<*>" if re.search("[0-9]", x) else x for x in w[: templates.DEPTH]]), []).append((t, i, w))
    first = {t: min([r[0] for r in rows if r[1] == t and r[0] is not None], default=None) for t in texts}
    found = {}
    for leaf, lines in leaves.items():
        if len({t for t, _, _ in lines}) < templates.MIN_DOCS:
            continue
        for t, i, w in lines:
            shown = [x if len({u for u, _, v in lines if v[p] == x}) >= templates.MIN_DOCS else "<*>" for p, x in enumerate(w)]
            if sum(x != "<*>" for x in shown) >= templates.MIN_CONST * len(w):
                found.setdefault((leaf, *shown), []).append((t, i))
    drop = {}
    for lines in found.values():
        if len({t for t, _ in lines}) >= templates.MIN_DOCS:
            keeper = min((first[t] for t, _ in lines if first[t] is not None), default=None)
            for t, i in lines:
                drop.setdefault(t, []).append((i, keeper))
    want = []
    for d, t, *_ in rows:
        gone = {i for i, keeper in drop.get(t, []) if keeper != d}
        left = [x for i, x in enumerate((t or "").split("\n")) if i not in gone]
        want.append((d, t if not gone else "\n".join(left), sum(bool(x.split()) for x in (t or "").split("\n")), len(gone)))
    assert any(w[3] for w in want)
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"])) for r in out.collect())


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "\n".join(f"line number {i} of this long text" for i in range(20_000)))], "doc_id long, text string")
    assert templates.clean_lines(df).first()["n_dropped"] == 0 and templates.clean_lines(df.limit(0)).count() == 0
