"""Sparse matrix layers as coordinate tables (cell_id, gene_id, value).

A missing coordinate is zero. Every operator is one declarative plan over the stored
entries; dense results come from left joins to the cell or gene table. Entries whose cell
or gene is not in the cell or gene table count nowhere; ``orphans`` finds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRANSFORMS = {"log1p": F.log1p, "sqrt": F.sqrt}
R_LIMIT = 1e9
#: The largest finite half-precision number, to which the dispersion is clipped for storage.
HALF_LIMIT = 65504.0
#: Genes of a chunk of a dense matrix.
CHUNK = 64


def from_coo(df: DataFrame, cell: str, gene: str, value: Column, by_cell: bool = False) -> DataFrame:
    """A layer; repeated coordinates are summed.

    ``by_cell`` deals rows by cell alone, so that later steps by cell need no further exchange.
    """
    if by_cell:
        df = df.repartition(cell)
    return df.groupBy(F.col(cell).alias("cell_id"), F.col(gene).alias("gene_id")).agg(F.sum(value).alias("value"))


def from_dense(df: DataFrame, cell: str, vector: str, sparsify: bool = True, first: str | None = None) -> DataFrame:
    """A layer of the vectors' elements, gene ids by position, counted from the column ``first`` on where given; ``sparsify`` drops the zeros."""
    # The outer form: for the other a filter on the vector's size is put first, which would make the vector twice.
    start = F.col(first) if first else F.lit(0)
    out = df.select(F.col(cell).alias("cell_id"), start.alias("_first"), F.posexplode_outer(vector).alias("_at", "value")).where("_at is not null")
    out = out.where("value <> 0") if sparsify else out
    return out.select("cell_id", (F.col("_first") + F.col("_at")).alias("gene_id"), "value")


def to_dense(layer: DataFrame, size: int) -> DataFrame:
    """(cell_id, first, vec): the dense matrix of gene ids 0 to ``size - 1`` in chunks of CHUNK of a cell's genes.

    A chunk without an entry is all zeros and is not stored. Coordinates are unique; only entries are exchanged.
    """
    kind = dict(layer.dtypes)["value"]
    at, width = F.col("gene_id") % CHUNK, F.least(F.lit(CHUNK), F.lit(size) - F.col("first")).cast("int")
    own = layer.where(F.col("gene_id").between(0, size - 1)).groupBy("cell_id", (F.col("gene_id") - at).alias("first"))
    e = own.agg(F.array_sort(F.collect_list(F.struct(at.cast("int").alias("at"), "value"))).alias("e")).withColumn("n", width)
    zeros = lambda n: F.array_repeat(F.lit(0).cast(kind), n)
    before = lambda i: F.coalesce(F.get("e", i - 1)["at"], F.lit(-1))
    runs = F.transform("e", lambda x, i: F.concat(zeros(x["at"] - before(i) - 1), F.array(x["value"])))
    return e.select("cell_id", "first", F.flatten(F.concat(runs, F.array(zeros(F.col("n") - 1 - before(F.size("e")))))).alias("vec"))


def default_names(df: DataFrame, key: str, kind: str) -> DataFrame:
    """``key`` and the zero-padded name of each row of an axis without names."""
    return df.select(key, F.format_string(f"{kind}_%06d", key).alias("name"))


def size_factors(layer: DataFrame) -> DataFrame:
    """(cell_id, sf): the sum of each cell's stored entries."""
    return layer.groupBy("cell_id").agg(F.sum("value").cast("double").alias("sf"))


def log1p_norm(value: Column, factor: Column, scale: float = 1e4) -> Column:
    """log1p of the value's share of its cell; a zero or missing factor gives null."""
    return F.log1p(F.try_divide(value.cast("double"), factor) * F.lit(float(scale)))


def derived(layer: DataFrame, transform: str, size_factors: DataFrame | None = None, scale: float = 1e4) -> DataFrame:
    """A lazy layer over stored entries; log1p_norm without size factors is plain log1p, a zero or missing factor gives null."""
    if transform == "log1p_norm":
        if size_factors is None:
            return derived(layer, "log1p")
        return layer.join(size_factors, "cell_id", "left").select("cell_id", "gene_id", log1p_norm(F.col("value"), F.col("sf"), scale).alias("value"))
    if transform not in TRANSFORMS:
        raise ValueError(f"{transform} is not one of log1p, sqrt, log1p_norm")
    return layer.withColumn("value", TRANSFORMS[transform](F.col("value").cast("double")))


def normalized(layer: DataFrame, scale: float = 1e4) -> DataFrame:
    """log1p_norm by the cells' own totals, in one exchange by cell."""
    total = F.sum("value").over(Window.partitionBy("cell_id")).cast("double")
    return layer.select("cell_id", "gene_id", log1p_norm(F.col("value"), total, scale).alias("value"))


def filled(axis: DataFrame, key: str, part: DataFrame) -> DataFrame:
    """``part`` (key, value) over the whole axis; absent entries are 0, stored nulls and NaN stay."""
    part = part.select(key, "value", F.lit(True).alias("_stored"))
    zero = F.lit(0).cast(dict(part.dtypes)["value"])
    return axis.select(key).join(part, key, "left").select(key, F.when(F.col("_stored"), F.col("value")).otherwise(zero).alias("value"))


def gene(layer: DataFrame, obs: DataFrame, gene_id: int, var: DataFrame | None = None) -> DataFrame:
    """One gene over all cells, zeros filled; the filter reaches the scan. KeyError if ``var`` is given without it."""
    _known(var, "gene_id", gene_id)
    return filled(obs, "cell_id", layer.where(F.col("gene_id") == gene_id))


def cell(layer: DataFrame, var: DataFrame, cell_id: int, obs: DataFrame | None = None) -> DataFrame:
    """One cell over all genes, zeros filled. KeyError if ``obs`` is given without it."""
    _known(obs, "cell_id", cell_id)
    return filled(var, "gene_id", layer.where(F.col("cell_id") == cell_id))


def _known(axis: DataFrame | None, key: str, value: object) -> None:
    if axis is not None and axis.where(F.col(key) == F.lit(value)).isEmpty():
        raise KeyError(f"{key} {value!r} is not there")


def gene_index(var: DataFrame, name: str = "name", position: str = "col_ix") -> DataFrame:
    """(name, col_ix): of genes of one name the last."""
    return var.groupBy(name).agg(F.max(position).alias("col_ix"))


def cell_index(obs: DataFrame, name: str = "barcode", position: str = "row_ix") -> DataFrame:
    """(barcode, row_ix): of cells of one barcode the first."""
    return obs.groupBy(name).agg(F.min(position).alias("row_ix"))


def orphans(layer: DataFrame, axis: DataFrame, key: str) -> DataFrame:
    """Entries whose key the axis lacks."""
    return layer.join(axis.select(key), key, "left_anti")


def cell_totals(layer: DataFrame, obs: DataFrame) -> DataFrame:
    """(cell_id, total_counts) of every cell, those without entries included."""
    total = layer.groupBy("cell_id").agg(F.sum("value").alias("t"))
    return obs.select("cell_id").join(total, "cell_id", "left").select("cell_id", F.coalesce("t", F.lit(0)).alias("total_counts"))


def gene_means(layer: DataFrame, var: DataFrame, n_obs: int) -> DataFrame:
    """(gene_id, mean_expr) over all cells, of every gene."""
    total = layer.groupBy("gene_id").agg(F.sum("value").cast("double").alias("t"))
    return var.select("gene_id").join(total, "gene_id", "left").select("gene_id", (F.coalesce("t", F.lit(0.0)) / n_obs).alias("mean_expr"))


def expressing(layer: DataFrame, var: DataFrame) -> DataFrame:
    """(gene_id, n_cells): the cells in which each gene is not zero."""
    n = layer.groupBy("gene_id").agg(F.count_if(F.col("value") != 0).alias("n"))
    return var.select("gene_id").join(n, "gene_id", "left").select("gene_id", F.coalesce("n", F.lit(0)).alias("n_cells"))


def shape(layer: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """One row: n_obs, n_vars, nnz and sparsity."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = count(obs, "n_obs").join(count(var, "n_vars")).join(count(layer, "nnz"))
    return one.withColumn("sparsity", 1 - F.col("nnz").cast("double") / (F.col("n_obs") * F.col("n_vars")))


def cells_per_type(obs: DataFrame) -> DataFrame:
    return obs.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_cells"))


def partial_sums(layer: DataFrame, obs: DataFrame) -> DataFrame:
    """s1, s2, stored (ne) and positive (e) entries of every gene and cell type that has any; sums of parts add up."""
    v = F.col("value").cast("double")
    # By key: sorted files are so small beside their rows that a size read from them would broadcast all cells.
    per = layer.join(obs.select("cell_id", "cell_type").hint("merge"), "cell_id").groupBy("gene_id", "cell_type")
    return per.agg(F.sum(v).alias("s1"), F.sum(v * v).alias("s2"), F.count(F.lit(1)).alias("ne"), F.count_if((v > 0) & ~F.isnan(v)).alias("e"))


def on_grid(per: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """The sums of ``per`` and n, the cells of the type, for every gene and cell type, absent pairs included."""
    types = obs.where("cell_type is not null").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))
    grid = var.select("gene_id").crossJoin(F.broadcast(types))  # the grid itself is the result; a row for each type goes to all
    return grid.join(per.hint("merge"), ["gene_id", "cell_type"], "left").fillna(0, ["s1", "s2", "ne", "e"])


def celltype_stats(layer: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """Observed statistics; a cell expresses a gene where the value is positive."""
    return stats_of(on_grid(partial_sums(layer, obs), obs, var))


def stats_of(s: DataFrame) -> DataFrame:
    """The statistics of sums on the grid."""
    frac = F.col("e") / F.col("n")
    return s.select(
        "gene_id", "cell_type", F.col("n").alias("n_cells"), (1 - frac).alias("obs_zero_frac"), (F.col("s1") / F.col("n")).alias("mean_expr"),
        F.when(F.col("e") > 0, F.col("s1") / F.when(F.col("e") > 0, F.col("e"))).otherwise(0.0).alias("mean_expr_nz"), frac.alias("frac_expressing"),
    )


def zinb_params(layer: DataFrame, obs: DataFrame, var: DataFrame, clip: float | None = None) -> DataFrame:
    """Zero-inflated negative binomial moments; stored entries, explicit zeros included, count as expressed.

    ``clip`` bounds r (HALF_LIMIT for storage in half precision).
    """
    return zinb_of(on_grid(partial_sums(layer, obs), obs, var), clip)


def zinb_of(s: DataFrame, clip: float | None = None) -> DataFrame:
    """The moments of sums on the grid."""
    n, mu = F.col("n").cast("double"), F.col("s1") / F.col("n")
    var_ = F.when(F.col("n") > 1, (F.col("s2") - F.col("s1") * F.col("s1") / n) / F.greatest(n - 1, F.lit(1.0))).otherwise(0.0)
    s = s.select("gene_id", "cell_type", "n", "ne", mu.alias("mu"), var_.alias("v"))
    over = (F.col("v") > F.col("mu")) & (F.col("mu") > 0)
    s = s.withColumn("r", F.when(over, F.col("mu") * F.col("mu") / F.when(over, F.col("v") - F.col("mu"))).otherwise(R_LIMIT))
    zero = (F.col("n") - F.col("ne")) / F.col("n")
    p0 = F.pow(F.col("r") / (F.col("r") + F.col("mu")), F.col("r"))
    pi = F.when(F.col("mu") > 0, F.greatest(F.lit(0.0), zero - p0)).otherwise(zero)
    r = F.col("r") if clip is None else F.least(F.greatest("r", F.lit(0.0)), F.lit(float(clip)))
    return s.select("gene_id", "cell_type", "mu", r.alias("r"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), pi)).alias("pi"))
