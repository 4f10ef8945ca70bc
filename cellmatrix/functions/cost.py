"""What the codecs would cost, in native expressions: no value leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmatrix.operators.structure import positions, previous

BLOCK, LEAD_CAP, HEAD = 128, 31, 13


def float_bits(c: Column) -> Column:
    """The IEEE 754 bits of a double, as a long."""
    return F.reflect(F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), c.cast("double")).cast("bigint")


def leading_zeros(c: Column) -> Column:
    """Of 64 bits; 64 for zero."""
    return F.when(c == 0, 64).otherwise(64 - F.length(F.bin(c)))


def trailing_zeros(c: Column) -> Column:
    """Of 64 bits; 63 for zero."""
    text = F.bin(c)
    return F.when(c == 0, 63).otherwise(F.length(text) - F.length(F.rtrim(text, F.lit("0"))))


def xor_bits(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, bits) of each value but the first by ``key``: 1 if it repeats the one before, else header and payload."""
    own = df.select(key, float_bits(F.col(value)).alias("b"))
    x = F.col("b").bitwiseXOR(F.col("prev_b"))
    cost = F.when(x == 0, 1).otherwise(HEAD + 64 - F.least(F.lit(LEAD_CAP), leading_zeros(x)) - trailing_zeros(x))
    return previous(own, key, "b").where("prev_b is not null").select(key, cost.alias("bits"))


def zigzag(c: Column) -> Column:
    return F.when(c >= 0, c * 2).otherwise(-c * 2 - 1)


def pack_blocks(layer: DataFrame, obs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, n, width, bytes) of the gene ids' packed differences, by cell and gene."""
    w = Window.partitionBy("cell_id").orderBy("gene_id")
    d = positions(layer, obs).withColumn("_d", F.col("gene_id") - F.lag("gene_id", 1, 0).over(w))
    per = d.groupBy(F.floor(F.col("pos") / block).alias("block")).agg(F.count(F.lit(1)).alias("n"), F.max(zigzag(F.col("_d"))).alias("_m"))
    width = F.length(F.bin("_m"))
    return per.select("block", "n", width.alias("width"), (2 + F.ceil(F.col("n") * width / 8)).alias("bytes"))
