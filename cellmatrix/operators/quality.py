"""How well estimates meet the truth: correlation, error, ranks, strata, means over seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmatrix.operators.structure import running_totals

KEYS = ("gene_id", "cell_type")
MIN_ROWS = 10


def _corr(a: str, b: str) -> Column:
    """Pearson's r; null where it is not defined."""
    r = F.corr(a, b)
    return F.when(~F.isnan(r), r)


def errors(pairs: DataFrame, a: str = "estimate", b: str = "truth") -> DataFrame:
    """One row over all pairs: n, pearson, mse, bias (mean of a - b) and max_abs_err."""
    d = F.col(a) - F.col(b)
    return pairs.agg(F.count(F.lit(1)).alias("n"), _corr(a, b).alias("pearson"), F.avg(d * d).alias("mse"), F.avg(d).alias("bias"), F.max(F.abs(d)).alias("max_abs_err"))


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the 1-based rank of ``column`` as ``name``, ties by their mean; in two levels, over distinct values."""
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_totals(n, column, "_n").select(F.col(column), (F.col("sum__n") - (F.col("_n") - 1) / 2.0).alias(name))
    return df.join(ranks, column)


def spearman(pairs: DataFrame, a: str = "estimate", b: str = "truth") -> DataFrame:
    """One row: n and Spearman's rank correlation; pairs with a null count nowhere."""
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_ranks(average_ranks(known, a, "_ra"), b, "_rb")
    return ranked.agg(F.count(F.lit(1)).alias("n"), _corr("_ra", "_rb").alias("spearman"))


def strata(pairs: DataFrame, level: str, a: str = "estimate", b: str = "truth", least: int = MIN_ROWS) -> DataFrame:
    """(stratum, n, pearson) of the pairs with 0 < level < 1 (low) and level >= 1 (high); null with ``least`` rows or fewer."""
    at = F.when(F.col(level) >= 1, "high").when(F.col(level) > 0, "low")
    per = pairs.withColumn("stratum", at).where("stratum is not null").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), _corr(a, b).alias("_r"))
    return per.select("stratum", "n", F.when(F.col("n") > least, F.col("_r")).alias("pearson"))


def aligned(truth: DataFrame, estimate: DataFrame, t: str, e: str) -> DataFrame:
    """Every (gene, type) of ``truth`` with truth and estimate; one without an estimate gets 0."""
    est = estimate.select(*KEYS, F.col(e).alias("estimate"))
    return truth.select(*KEYS, F.col(t).alias("truth")).join(est, list(KEYS), "left").fillna(0.0, ["estimate"])


def mean_over(scores: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean) over the rows whose value is a number; null where there is none."""
    number = F.when(~F.isnan(value), F.col(value))
    return scores.groupBy(by).agg(F.count(number).alias("n"), F.avg(number).alias("mean"))


def fidelity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row over the coordinates where either layer is positive: n, pearson, max_abs_err."""
    keys = ["cell_id", "gene_id"]
    both = a.select(*keys, F.col("value").cast("double").alias("a")).join(b.select(*keys, F.col("value").cast("double").alias("b")), keys, "full_outer").fillna(0.0, ["a", "b"])
    both = both.where("a > 0 or b > 0")
    return both.agg(F.count(F.lit(1)).alias("n"), _corr("a", "b").alias("pearson"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_err"))


def accuracy(stored: DataFrame, fresh: DataFrame, columns: tuple[str, ...] = ("obs_zero_frac", "mean_expr", "mean_expr_nz", "frac_expressing")) -> DataFrame:
    """(statistic, mse, max_abs_err, pearson) of stored statistics against a recomputation."""
    ours = fresh.select(*KEYS, *[F.col(c).alias(f"_{c}") for c in columns])
    # Both sides have a row for each gene and type; stored ones compress so well that their files look small enough to broadcast.
    both = stored.select(*KEYS, *columns).join(ours.hint("merge"), list(KEYS))
    wide = F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("double").alias("a"), F.col(f"_{c}").cast("double").alias("b")) for c in columns]))
    rows = both.select(wide.alias("x")).select("x.*")
    d = F.col("a") - F.col("b")
    return rows.groupBy("statistic").agg(F.avg(d * d).alias("mse"), F.max(F.abs(d)).alias("max_abs_err"), _corr("a", "b").alias("pearson"))
