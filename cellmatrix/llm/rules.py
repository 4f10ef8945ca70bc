"""Quality rules with host-level verdicts.

Each document is counted (words, characters, symbols, repeated lines, repeated
three-word windows) inside its own row, in native expressions. Rule failures are
then summed by host, each host's failure rate is shrunk by a beta prior fitted to
all hosts (method of moments), and a host whose shrunk rate of some rule passes
``max_rate`` takes its remaining documents with it.

Defined results: null or empty text has no words and fails; a null host gives no
host verdict; repeated rows each get their own row and count each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Workspace, join_small, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PCT, MAX_SYMBOL_PCT, MAX_DUP_LINES_PCT = 50, 50, 10, 30
RULES = ("short", "repeats", "symbols", "dup_lines")
MAX_RATE, MIN_STRENGTH, MAX_STRENGTH = 0.5, 2.0, 1000.0


def counts(docs: DataFrame, text: str = "text", *carry: str) -> DataFrame:
    """``carry`` columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    # Lines of spaces alone hold no word; a line is compared whole, outer spaces included.
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    a = docs.select(
        *carry,
        words(t).alias("_w"),
        lines.alias("_l"),
        F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
    )
    b = a.select(
        *carry,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "_w",
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    kept = b.columns[:-2]
    n = F.size("_h")
    hashed = F.transform("_h", lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2)))
    c = b.select(*kept, "_w", F.when(n > 3, F.slice(hashed, 1, n - 2)).alias("_g"))
    # A text whose windows all hash apart has none twice; in the others the windows themselves are compared.
    gram = lambda i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    c = c.select(
        *kept,
        F.when(
            F.size("_g") > F.size(F.array_distinct("_g")),
            F.array_sort(F.transform("_g", lambda _, i: F.struct(gram(i).alias("g"), i.alias("i")))),
        ).alias("_s"),
    )
    twin = lambda x, j: (x["g"] == F.get("_s", j - 1)["g"]) | (x["g"] == F.get("_s", j + 1)["g"])
    d = c.select(*kept, F.array_sort(F.transform(F.filter("_s", twin), lambda x: x["i"])).alias("_p"))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(3), p - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )
    return d.select(*kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def failures() -> dict[str, Column]:
    """Whether a counted document breaks each rule."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINES_PCT * F.col("n_lines"),
    }


def host_rates(counted: DataFrame, host: str = "host") -> DataFrame:
    """A row per host: n, k_<rule> for each rule."""
    fails = failures()
    return (
        counted.where(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(fails[r].cast("long")).alias(f"k_{r}") for r in RULES])
    )


def host_verdicts(hosts: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """hosts with rate_<rule> (posterior mean) and host_failed.

    Only the moments of the host rates, one row, reach the driver.
    """
    rate = {r: F.col(f"k_{r}") / F.col("n") for r in RULES}
    m = hosts.agg(*[f(rate[r]).alias(f"{a}_{r}") for r in RULES for a, f in (("m", F.avg), ("v", F.var_pop))]).first()
    out = hosts
    for r in RULES:
        mean, var = m[f"m_{r}"] or 0.0, m[f"v_{r}"] or 0.0
        strength = mean * (1 - mean) / var - 1 if var > 0 else MAX_STRENGTH
        strength = min(MAX_STRENGTH, max(MIN_STRENGTH, strength))
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    return out.withColumn("host_failed", worst > max_rate)


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_RATE) -> DataFrame:
    """One row per document: doc_id, host, its counts, base_failed, host_failed, kept."""
    ws = Workspace(docs.sparkSession)
    src = docs.select("doc_id", F.col(host).cast("string").alias("host"), "text")
    counted = ws.keep(counts(src, "text", "doc_id", "host"), "counts")
    hosts = ws.keep(host_rates(counted), "hosts")
    verdicts = host_verdicts(hosts, max_rate).select("host", "host_failed")
    base = F.col("n_words").isNull() | failures()["short"] | failures()["repeats"]
    out = join_small(counted.withColumn("base_failed", base), verdicts, "host", hosts.count())
    return out.withColumn("host_failed", F.coalesce("host_failed", F.lit(False))).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_failed")
    )
