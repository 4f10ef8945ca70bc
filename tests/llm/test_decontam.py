"""op6 against the word edit distance of every window, on passages edited by up to a tenth."""

import random

from cellmatrix.llm import decontam

ITEMS, DOCS = "item_id long, text string", "doc_id long, text string"


def edits(y, x):
    """Least word edits of y against any window of x."""
    row = [0] * (len(x) + 1)
    for i, w in enumerate(y, 1):
        new = [i]
        for j, v in enumerate(x, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edited_passages(spark):
    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    items = {n: [rnd.choice(vocab) for _ in range(rnd.randint(15, 40))] for n in range(12)}
    docs, planted = {}, set()
    for d in range(120):
        text = [rnd.choice(vocab) for _ in range(rnd.randint(0, 120))]
        if d % 2:
            n = rnd.randrange(12)
            y = list(items[n])
            for _ in range(len(y) // 10):
                k = rnd.randrange(len(y))
                y[k : k + 1] = [[], [rnd.choice(vocab)], [y[k], rnd.choice(vocab)]][rnd.randrange(3)]
            at = rnd.randint(0, len(text))
            text[at:at] = y
            planted.add((d, n))
        docs[d] = text
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.leaks(spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], DOCS), spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], ITEMS)).collect()}
    true = {(d, n): e for d, t in docs.items() for n, y in items.items() if (e := edits(y, t)) <= int(decontam.RATE * len(y))}
    assert planted <= set(true)
    assert set(got) <= set(true)
    assert all(got[k] == true[k] for k in got)
    assert len(set(got) & planted) >= 0.95 * len(planted)


def test_edges(spark):
    item = "the quick brown fox jumps over the lazy dog today"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (None, item)], ITEMS)
    docs = spark.createDataFrame([(1, "So: The QUICK brown, fox jumps over the lazy dog today!"), (2, None), (3, ""), (4, "here are two words."), (5, "two other words"), (1, item)], DOCS).selectExpr("*", "'x' as item_id", "0 as h")
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontam.leaks(docs, items).collect())
    assert got == [(1, 1, 0), (1, 1, 0), (4, 4, 0)]
    assert sorted(r["doc_id"] for r in decontam.clean_documents(docs, items).collect()) == [2, 3, 5]
    assert decontam.leaks(docs.limit(0), items).count() == 0 and decontam.clean_documents(docs, items.limit(0)).count() == 6


def test_short_items_of_equal_words(spark):
    docs = spark.createDataFrame([(1, "x alpha beta gamma y"), (2, "alpha gamma beta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "alpha, beta gamma."), (3, "alpha gamma")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["edits"], r["first_word"]) for r in decontam.leaks(docs, items).collect())
    assert got == [(1, 1, 0, 1), (1, 2, 0, 1), (2, 3, 0, 0)]


def test_recall_at_the_limit():
    """Passages edited by a fifth of their words, in long texts: at least 0.95 are found, and texts of other words are not."""
    import numpy as np

    from cellmatrix.llm import decontam

    rng = np.random.default_rng(11)
    vocabulary = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    pick = lambda n: vocabulary[rng.integers(0, len(vocabulary), n)]
    items = [pick(n) for n in rng.integers(8, 100, 400)]
    held = decontam.Items([(i, x.view(np.int64)) for i, x in enumerate(items)])
    texts = []
    for x in items:
        y = list(x)
        for _ in range(int(decontam.RATE * len(x))):
            at, kind = int(rng.integers(0, len(y))), rng.integers(0, 3)
            if kind == 0:
                y[at] = pick(1)[0]
            elif kind == 1:
                del y[at]
            else:
                y.insert(at, pick(1)[0])
        texts.append(np.concatenate([pick(150), np.array(y, np.uint64), pick(150)]))
    texts += [pick(300) for _ in range(100)]
    found = held.matches(np.concatenate(texts), np.cumsum([len(t) for t in texts]))
    assert sum((i, i) in found for i in range(400)) >= 0.95 * 400
    assert not [d for d, _ in found if d >= 400]
