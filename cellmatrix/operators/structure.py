"""Row structure of a layer: deltas, row pointers, label codes, overflow splits.

Running totals over a whole table are made in two levels, so that no task sees all rows:
rows are cut into ranges of the key at approximate quantiles, the ranges' totals (a row
each) are summed up, and each range adds its own start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES, LIMIT = 64, 255


def ranged(df: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``_range``: the number of approximate quantiles of the numeric ``key`` below it."""
    cuts = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    at = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    return df.withColumn("_range", F.size(F.filter(at, lambda c: c < F.col(key))))


def running_totals(df: DataFrame, key: str, *columns: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with sum_<column> over all rows up to and with this one, by ``key`` (unique)."""
    r = ranged(df, key, ranges)
    own = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)  # a row for each range
    totals = r.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    starts = totals.select("_range", *[(F.sum(f"_{c}").over(every) - F.col(f"_{c}")).alias(f"_{c}") for c in columns])
    out = r.select("*", *[F.sum(c).over(own).alias(f"_own_{c}") for c in columns]).join(F.broadcast(starts), "_range")
    return out.select(*df.columns, *[(F.col(f"_own_{c}") + F.col(f"_{c}")).alias(f"sum_{c}") for c in columns])


def previous(df: DataFrame, key: str, column: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with prev_<column>: that of the row before by ``key`` (unique); null for the first row."""
    r = ranged(df, key, ranges)
    own = Window.partitionBy("_range").orderBy(key)
    lasts = r.groupBy("_range").agg(F.max_by(column, key).alias("_last"))
    carried = lasts.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carry"))  # a row for each range
    out = r.withColumn("_prev", F.lag(column).over(own)).withColumn("_first", F.row_number().over(own) == 1).join(F.broadcast(carried), "_range")
    return out.select(*df.columns, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")).alias(f"prev_{column}"))


def row_deltas(layer: DataFrame) -> DataFrame:
    """(cell_id, gene_id, delta): each cell's gene ids as differences, the first as it is."""
    w = Window.partitionBy("cell_id").orderBy("gene_id")
    return layer.select("cell_id", "gene_id", (F.col("gene_id") - F.lag("gene_id", 1, 0).over(w)).alias("delta"))


def restore_rows(deltas: DataFrame, position: str = "pos") -> DataFrame:
    """(cell_id, gene_id) of stored deltas (cell_id, position, delta)."""
    w = Window.partitionBy("cell_id").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("cell_id", F.sum("delta").over(w).alias("gene_id"))


def row_pointers(layer: DataFrame, obs: DataFrame) -> DataFrame:
    """(row_ix, indptr): n_obs + 1 rows from 0 on, cells in order of their id, cells without entries included."""
    n = layer.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    deg = obs.select("cell_id").join(n, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).alias("n"), F.lit(1).cast("long").alias("one"))
    out = running_totals(deg, "cell_id", "n", "one").select(F.col("sum_one").alias("row_ix"), F.col("sum_n").alias("indptr"))
    return layer.sparkSession.range(1).select(F.lit(0).cast("long").alias("row_ix"), F.lit(0).cast("long").alias("indptr")).union(out)


def positions(layer: DataFrame, obs: DataFrame) -> DataFrame:
    """``layer`` with pos: the place of each entry by cell and gene, from 0 on."""
    n = layer.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))
    start = running_totals(n, "cell_id", "n").select("cell_id", (F.col("sum_n") - F.col("n")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("cell_id").orderBy("gene_id")) - 1
    return layer.withColumn("_own", own).join(start, "cell_id").select(*layer.columns, (F.col("_start") + F.col("_own")).alias("pos"))


def dictionary(df: DataFrame, label: str) -> DataFrame:
    """(label, code): the distinct labels in code-point order, numbered from 0; null is no label."""
    return df.where(F.col(label).isNotNull()).select(F.col(label).alias("label")).distinct().select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("code"))


def encode(df: DataFrame, label: str, codes: DataFrame) -> DataFrame:
    """``df`` with ``code`` in place of the label."""
    return df.join(codes.withColumnRenamed("label", label), label, "left").select(*[c for c in df.columns if c != label], "code")


def decode(df: DataFrame, codes: DataFrame) -> DataFrame:
    """``df`` with ``label`` in place of the code."""
    return df.join(codes, "code", "left").select(*[c for c in df.columns if c != "code"], "label")


def code_bits(n_labels: int) -> int:
    """Bits of the codes: 8, 16 or 32."""
    return 8 if n_labels <= 1 << 8 else 16 if n_labels <= 1 << 16 else 32


def split_overflow(value: Column, limit: int = LIMIT) -> list[Column]:
    """main_value (0 to ``limit``) and overflow (the value above it, else null)."""
    return [F.least(F.greatest(value, F.lit(0)), F.lit(limit)).alias("main_value"), F.when(value > limit, value).alias("overflow")]


def merge_overflow(main: str = "main_value", overflow: str = "overflow") -> Column:
    return F.coalesce(overflow, main)


def same_topology(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: entries that both layers store, and mismatches that one stores; layers share keys only without any."""
    keys = ["cell_id", "gene_id"]
    both = a.select(*keys, F.lit(1).alias("_a")).join(b.select(*keys, F.lit(1).alias("_b")), keys, "full_outer")
    here = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.agg(F.count_if(here).alias("shared"), F.count_if(~here).alias("mismatches"))


def is_transform_of(floats: DataFrame, ints: DataFrame, transform: str) -> DataFrame:
    """One row: n, and whether ``floats`` has the keys of ``ints`` and exactly its transformed values (log1p or sqrt); an empty layer is none."""
    fn = {"log1p": F.log1p, "sqrt": F.sqrt}[transform]
    keys = ["cell_id", "gene_id"]
    both = floats.select(*keys, F.col("value").alias("_f")).join(ints.select(*keys, F.col("value").alias("_i")), keys, "full_outer")
    same = F.coalesce(F.col("_f") == fn(F.col("_i").cast("double")), F.lit(False))
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(same), F.lit(False)).alias("detected"))


def regroup(rows: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """(key, vec): the values of each key as an array by position."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v"))))
    return rows.groupBy(key).agg(pairs.alias("_p")).select(key, F.transform("_p", lambda x: x["v"]).alias("vec"))
