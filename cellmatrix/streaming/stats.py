"""Statistics of a layer that grows: the sums behind them are additive, so each batch is added once.

A stream of new entries (cell_id, gene_id, value; each coordinate once over the whole
stream) updates a table of sums. Every batch writes a new version of the table and then
replaces the pointer that names it and the batch, so a batch that is run again after a
failure changes nothing. Cells that no batch has brought yet count as zero entries.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellmatrix.operators import matrix as M
from cellmatrix.sources.paths import Store

POINTER, KEYS, SUMS = "current.json", ("gene_id", "cell_type"), ("s1", "s2", "ne", "e")


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The sums so far; None before the first batch."""
    store = Store(spark, path)
    if not store.exists(POINTER):
        return None
    return spark.read.parquet(f"{store.path}/{json.loads(store.read(POINTER))['folder']}")


def add_batch(batch: DataFrame, number: int, obs: DataFrame, path: str) -> None:
    """Add a batch's entries to the sums, once."""
    spark = batch.sparkSession
    store = Store(spark, path)
    before = json.loads(store.read(POINTER)) if store.exists(POINTER) else {"batch": -1, "folder": None}
    if number <= before["batch"]:
        return
    new, old = M.partial_sums(batch, obs), current(spark, path)
    both = new if old is None else new.unionByName(old).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
    folder = f"sums-{number:012d}"
    both.write.mode("overwrite").parquet(f"{store.path}/{folder}")
    store.write(POINTER, json.dumps({"batch": number, "folder": folder}).encode())
    for name in store.names():
        if name.startswith("sums-") and name not in (folder, before["folder"]):
            store.delete(name)


def maintain(entries: DataFrame, obs: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start the query that keeps the sums at ``path`` up to date; with ``once`` it ends when what is there now is read."""
    out = entries.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, obs, path)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def celltype_stats(spark: SparkSession, obs: DataFrame, var: DataFrame, path: str) -> DataFrame:
    """The statistics of all entries that were added."""
    sums = current(spark, path)
    empty = spark.createDataFrame([], "gene_id long, cell_type string, s1 double, s2 double, ne long, e long")
    return M.stats_of(M.on_grid(empty if sums is None else sums, obs, var))


def zinb_params(spark: SparkSession, obs: DataFrame, var: DataFrame, path: str, clip: float | None = None) -> DataFrame:
    sums = current(spark, path)
    empty = spark.createDataFrame([], "gene_id long, cell_type string, s1 double, s2 double, ne long, e long")
    return M.zinb_of(M.on_grid(empty if sums is None else sums, obs, var), clip)
