"""Ways in and out: coordinate tables, scipy-like matrices, AnnData, Matrix Market files, downloads."""

from __future__ import annotations

import os
import urllib.error
import urllib.request
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmatrix.operators.container import MAIN, CellMatrix
from cellmatrix.operators.matrix import from_coo

RAW, NORM, CHUNK = "X_raw", "X_norm", 8 << 20


def axis(spark: SparkSession, n: int, key: str, label: str, kind: str, names: Iterable | None = None) -> DataFrame:
    """(key, label) of ``n`` rows, named ``names`` or by zero-padded position."""
    if names is None:
        return spark.range(n).select(F.col("id").alias(key), F.format_string(f"{kind}_%06d", "id").alias(label))
    names = [str(x) for x in names]
    if len(names) != n:
        raise ValueError(f"{len(names)} names for {n} rows of {label}")
    return spark.createDataFrame(pd.DataFrame({key: np.arange(n), label: names}), f"{key} long, {label} string")


def layer_key(kind: str) -> str:
    """The default key of a matrix: counts are raw."""
    return RAW if kind in ("tinyint", "smallint", "int", "bigint") else NORM


def from_table(coo: DataFrame, cell: str, gene: str, value: str, obs: DataFrame | None = None, var: DataFrame | None = None, key: str | None = None) -> CellMatrix:
    """A dataset of a coordinate table; repeated coordinates are summed. Without axis tables the ids present are the axes."""
    layer = from_coo(coo, cell, gene, F.col(value))
    if "int" in dict(coo.dtypes)[value]:
        layer = layer.withColumn("value", F.col("value").cast("bigint"))
    obs = obs if obs is not None else coo.select(F.col(cell).alias("cell_id")).distinct()
    var = var if var is not None else coo.select(F.col(gene).alias("gene_id")).distinct()
    out = CellMatrix(obs, var)
    out.add_layer(key or layer_key(dict(coo.dtypes)[value]), layer)
    return out


def from_sparse(spark: SparkSession, matrix, obs_names: Iterable | None = None, var_names: Iterable | None = None, key: str | None = None) -> CellMatrix:
    """A dataset of an in-memory matrix that has ``tocoo`` (row, col, data, shape), as scipy's do."""
    m = matrix.tocoo()
    whole = np.issubdtype(np.asarray(m.data).dtype, np.integer)
    frame = pd.DataFrame({"cell_id": np.asarray(m.row, np.int64), "gene_id": np.asarray(m.col, np.int64), "value": np.asarray(m.data, np.int64 if whole else np.float64)})
    coo = spark.createDataFrame(frame, f"cell_id long, gene_id long, value {'long' if whole else 'double'}")
    n, k = m.shape
    return from_table(coo, "cell_id", "gene_id", "value", axis(spark, n, "cell_id", "barcode", "cell", obs_names), axis(spark, k, "gene_id", "name", "gene", var_names), key or RAW)


def from_array(spark: SparkSession, x: np.ndarray, obs_names: Iterable | None = None, var_names: Iterable | None = None, key: str = RAW, sparsify: bool = True) -> CellMatrix:
    """A dataset of an in-memory dense array; ``sparsify`` drops the zeros."""
    x = np.asarray(x)
    if x.ndim != 2:
        raise ValueError("a matrix has two dimensions")
    at = np.nonzero(x) if sparsify else tuple(i.ravel() for i in np.indices(x.shape))
    whole = np.issubdtype(x.dtype, np.integer)
    frame = pd.DataFrame({"cell_id": at[0].astype(np.int64), "gene_id": at[1].astype(np.int64), "value": x[at].astype(np.int64 if whole else np.float64)})
    out = CellMatrix(axis(spark, x.shape[0], "cell_id", "barcode", "cell", obs_names), axis(spark, x.shape[1], "gene_id", "name", "gene", var_names))
    out.add_layer(key, spark.createDataFrame(frame, f"cell_id long, gene_id long, value {'long' if whole else 'double'}"))
    return out


def to_pandas(m: CellMatrix, layer: str | None = None, modality: str = MAIN) -> pd.DataFrame:
    """A layer's entries on the driver; for layers that fit there."""
    return m.layer(layer, modality).toPandas()


def from_anndata(spark: SparkSession, ad) -> CellMatrix:
    """A dataset of an AnnData-like object: X, layers, obs, var, obsm, uns; obsm['spatial'] becomes the positions."""

    def annotated(frame: pd.DataFrame, key: str, label: str) -> DataFrame:
        own = pd.DataFrame({key: np.arange(len(frame)), label: [str(x) for x in frame.index]})
        for c in frame.columns:
            v = frame[c]
            own[str(c)] = v.to_numpy() if v.dtype.kind in "biuf" else [None if pd.isna(x) else str(x) for x in v]
        return spark.createDataFrame(own)

    def entries(x) -> DataFrame:
        m = x.tocoo() if hasattr(x, "tocoo") else None
        row, col, data = (m.row, m.col, m.data) if m is not None else (*np.nonzero(x), np.asarray(x)[np.nonzero(x)])
        whole = np.issubdtype(np.asarray(data).dtype, np.integer)
        frame = pd.DataFrame({"cell_id": np.asarray(row, np.int64), "gene_id": np.asarray(col, np.int64), "value": np.asarray(data, np.int64 if whole else np.float64)})
        return spark.createDataFrame(frame, f"cell_id long, gene_id long, value {'long' if whole else 'double'}")

    out = CellMatrix(annotated(ad.obs, "cell_id", "barcode"), annotated(ad.var, "gene_id", "name"))
    x = entries(ad.X)
    out.add_layer(layer_key(dict(x.dtypes)["value"]), x)
    for key, value in ad.layers.items():
        out.add_layer(str(key), entries(value))
    for key, value in ad.obsm.items():
        rows = [(i, [float(v) for v in row]) for i, row in enumerate(np.asarray(value, np.float64))]
        df = spark.createDataFrame(rows, "cell_id long, vec array<double>")
        out.obsm[str(key)] = df
        if key == "spatial":
            out.set_spatial(df.withColumnRenamed("vec", "coords"))
    out.uns = dict(ad.uns)
    return out


def anndata_parts(m: CellMatrix) -> dict[str, object]:
    """What AnnData(**parts) takes, of a dataset that fits on the driver: X (raw counts first), layers, obs, var, obsm, uns."""
    obs, var = m.obs.orderBy("cell_id").toPandas(), m.modalities[MAIN].var.orderBy("gene_id").toPandas()
    row, col = (pd.Series(np.arange(len(a)), index=a[k]) for a, k in ((obs, "cell_id"), (var, "gene_id")))

    def dense(key: str) -> np.ndarray:
        f = to_pandas(m, key)
        x = np.zeros((len(obs), len(var)), f["value"].to_numpy().dtype)
        x[row[f["cell_id"]].to_numpy(), col[f["gene_id"]].to_numpy()] = f["value"].to_numpy()
        return x

    keys = m.layer_keys()
    first = next((k for k in (NORM, RAW) if k in keys), keys[0] if keys else None)
    obsm = {k: np.array(df.orderBy("cell_id").toPandas()["vec"].tolist()) for k, df in m.obsm.items()}
    if m.spatial is not None:
        obsm["spatial"] = np.array(m.spatial.orderBy("cell_id").toPandas()["coords"].tolist())
    index = lambda a, label, key: a.set_index(a[label if label in a.columns else key].astype(str))
    return {
        "X": dense(first) if first else None, "layers": {k: dense(k) for k in keys if k != first}, "obs": index(obs, "barcode", "cell_id"), "var": index(var, "name", "gene_id"), "obsm": obsm,
        "uns": {**m.uns, "ontology": m.ontology, "provenance": [vars(e) for e in m.provenance]},
    }


def to_anndata(m: CellMatrix):
    import anndata  # an optional package

    return anndata.AnnData(**anndata_parts(m))


def read_market(spark: SparkSession, path: str) -> CellMatrix:
    """A dataset of a Matrix Market coordinate file (1-based), read line by line on the executors."""
    nums = F.split(F.trim("value"), r"\s+")
    # The size line is the first that is no comment; it alone may repeat as an entry, so it is found by its place.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("k")).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = lines.orderBy("part", "k").first()
    if first is None or len(first["value"].split()) != 3:
        raise ValueError(f"{path} is no coordinate file")
    whole = " integer " in f" {spark.read.text(path).first()[0]} ".replace("\t", " ")
    n, k, _ = map(int, first["value"].split())
    rest = lines.where(~((F.col("part") == first["part"]) & (F.col("k") == first["k"])))
    coo = rest.select((nums[0].cast("long") - 1).alias("cell_id"), (nums[1].cast("long") - 1).alias("gene_id"), F.coalesce(F.get(nums, 2), F.lit("1")).cast("long" if whole else "double").alias("value"))
    return from_table(coo, "cell_id", "gene_id", "value", axis(spark, n, "cell_id", "barcode", "cell"), axis(spark, k, "gene_id", "name", "gene"))


def ingest(spark: SparkSession, path: str, out: str, cell: str = "cell_id", gene: str = "gene_id", value: str = "value", label: str = "cell_type", obs: str | None = None) -> CellMatrix:
    """Store a Parquet, CSV or Matrix Market coordinate file as a bundle: one distributed write.

    Counts get a derived log1p layer; with the cells' ``label`` (a Parquet table ``obs`` of cell_id) statistics are stored.
    """
    if path.endswith((".mtx", ".mtx.gz")):
        m = read_market(spark, path)
    else:
        table = spark.read.parquet(path) if not path.endswith((".csv", ".csv.gz")) else spark.read.csv(path, header=True, inferSchema=True)
        m = from_table(table, cell, gene, value, spark.read.parquet(obs) if obs else None)
    if RAW in m.layer_keys():
        m.add_derived_layer("X_log1p", "log1p", RAW)
    m.write(out, label=label)
    return m


def fetch(url: str, out: str, chunk: int = CHUNK) -> str:
    """Download to ``out`` by way of ``out.part``; what is there of it is kept on failure and resumed."""
    part = f"{out}.part"
    have = os.path.getsize(part) if os.path.exists(part) else 0
    request = urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {})
    try:
        with urllib.request.urlopen(request) as r, open(part, "ab" if r.status == 206 else "wb") as f:
            while data := r.read(chunk):
                f.write(data)
    except urllib.error.HTTPError as e:
        if e.code != 416:  # the file was whole already
            raise
    os.replace(part, out)
    return out
