"""op10 against a brute-force version of the counts and of the host verdicts."""

import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from cellmatrix.llm import queries, rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    t = text or ""
    w = WORDS.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    repeats = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in rules.SYMBOLS for c in t), len(lines), len(lines) - len(set(lines)), len(repeats)


def brute(rows):
    out, hosts = {}, defaultdict(lambda: [0] * 5)
    for d, text, host in rows:
        n, chars, symbols, lines, dup, repeat = c = counted(text)
        fails = (n < 50, 100 * repeat > 50 * n, 100 * symbols > rules.MAX_SYMBOL_PCT * chars, 100 * dup > rules.MAX_DUP_LINES_PCT * lines)
        out[d] = [n, chars, symbols, dup, repeat, fails[0] or fails[1], host]
        if host is not None:
            hosts[host] = [a + b for a, b in zip(hosts[host], (1, *fails), strict=True)]
    failed = set()
    for k in range(1, 5):
        rates = [h[k] / h[0] for h in hosts.values()]
        mean = sum(rates) / len(rates)
        var = sum((x - mean) ** 2 for x in rates) / len(rates)
        strength = min(rules.MAX_STRENGTH, max(rules.MIN_STRENGTH, mean * (1 - mean) / var - 1 if var > 0 else rules.MAX_STRENGTH))
        failed |= {name for name, h in hosts.items() if (h[k] + mean * strength) / (h[0] + strength) > rules.MAX_RATE}
    return {d: (*v[:6], not v[5] and v[6] not in failed) for d, v in out.items()}


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def result(df):
    return {r["doc_id"]: tuple(r[c] for c in NAMES) for r in df.collect()}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    assert result(queries.queries()["op10_quality_rules"](spark, sf)) == brute(rows)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\x0b\n", "a"), (4, long, "a"), (5, long, None), (6, "x y z " * 40, "b"), (7, "a\na\r\na\n\n \n" * 30, "b"), (8, long + "\n" + long, "c"), (9, "é# " * 60, "c"), (10, long, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n_words", "2 as host")
    assert result(rules.quality_rules(df)) == brute(rows)
    assert rules.quality_rules(df.limit(0)).count() == 0
