"""Simulated counts with a known truth: zero-inflated negative binomial over cell types.

Gene parameters are drawn on the driver (a row for each gene and type); cells are drawn on
the executors, each from its own seed, so the result does not depend on the partitions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmatrix.operators import matrix as M
from cellmatrix.operators import quality as Q

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Lognormal parameters of gene means, dispersions, fold changes and library sizes, and bounds.
MEAN, BCV, BCV_RANGE, FOLD, DE_SHARE, LIBRARY = (0.52, 1.47), (-0.46, 0.39), (0.05, 2.0), (0.0, 0.4), 0.10, (7.64, 0.78)
DROPOUT_SLOPE, DROPOUT_RANGE = 1.0, (1e-6, 1 - 1e-6)


@dataclass
class Truth:
    """Per gene: bcv; per gene and type: mu and the dropout probability pi."""

    bcv: np.ndarray
    mu: np.ndarray
    pi: np.ndarray


def draw_genes(n_genes: int, n_types: int, seed: int = 0, legacy: bool = False) -> Truth:
    """Dropout falls with the mean; with ``legacy`` it rises."""
    rng = np.random.default_rng([seed, 1])
    base = rng.lognormal(*MEAN, n_genes)
    bcv = np.clip(rng.lognormal(*BCV, n_genes), *BCV_RANGE)
    on = rng.random((n_genes, n_types)) < DE_SHARE
    fold = np.exp(np.where(on, rng.choice([-1.0, 1.0], (n_genes, n_types)) * rng.lognormal(*FOLD, (n_genes, n_types)), 0.0))
    mu = base[:, None] * fold
    x = DROPOUT_SLOPE * (np.log(mu) - np.median(np.log(mu)))
    return Truth(bcv, mu, np.clip(1 / (1 + np.exp(-x if legacy else x)), *DROPOUT_RANGE))


def cells(spark: SparkSession, n_cells: int, n_types: int) -> DataFrame:
    """(cell_id, barcode, cell_type): types in even runs, the rest in the last."""
    kind = F.least(F.floor(F.col("id") / max(1, n_cells // n_types)), F.lit(n_types - 1)).cast("int")
    return spark.range(n_cells).select(F.col("id").alias("cell_id"), F.format_string("CELL_%05d", "id").alias("barcode"), F.format_string("type_%02d", kind).alias("cell_type"))


def counts(obs: DataFrame, truth: Truth, seed: int = 0) -> DataFrame:
    """(cell_id, gene_id, value): gamma rates, scaled to the cell's library size, Poisson counts, dropout; zeros are not stored."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = []
            for cell, kind in zip(p["cell_id"], p["cell_type"], strict=True):
                rng, t = np.random.default_rng([seed, 2, int(cell)]), int(kind[5:])
                shape = 1 / truth.bcv**2
                rate = rng.gamma(shape, truth.mu[:, t] / shape)
                value = rng.poisson(rate / max(rate.sum(), 1e-12) * round(rng.lognormal(*LIBRARY)))
                value[rng.random(len(value)) < truth.pi[:, t]] = 0
                at = np.flatnonzero(value)
                got.append(pd.DataFrame({"cell_id": cell, "gene_id": at, "value": value[at]}))
            if got:
                yield pd.concat(got, ignore_index=True)

    return obs.select("cell_id", "cell_type").mapInPandas(run, "cell_id long, gene_id long, value long")


def truth_table(spark: SparkSession, truth: Truth) -> DataFrame:
    """(gene_id, cell_type, mu, pi)."""
    g, t = np.indices(truth.mu.shape)
    frame = pd.DataFrame({"gene_id": g.ravel(), "cell_type": [f"type_{i:02d}" for i in t.ravel()], "mu": truth.mu.ravel(), "pi": truth.pi.ravel()})
    return spark.createDataFrame(frame, "gene_id long, cell_type string, mu double, pi double")


def validation(spark: SparkSession, n_cells: list[int], n_genes: int, n_types: int, seeds: list[int]) -> DataFrame:
    """(n_cells, seed, method, pearson, mse, bias) of the estimated dropout by moments and by plain zero shares."""
    rows = []
    for n in n_cells:
        for seed in seeds:
            truth = draw_genes(n_genes, n_types, seed)
            obs = cells(spark, n, n_types)
            layer = counts(obs, truth, seed)
            var = spark.range(n_genes).select(F.col("id").alias("gene_id"))
            table = truth_table(spark, truth)
            for method, df, column in (("moments", M.zinb_params(layer, obs, var), "pi"), ("naive", M.celltype_stats(layer, obs, var), "obs_zero_frac")):
                r = Q.errors(Q.aligned(table, df, "pi", column)).first()
                rows.append((n, seed, method, r["pearson"], r["mse"], r["bias"]))
    return spark.createDataFrame(rows, "n_cells int, seed int, method string, pearson double, mse double, bias double")
