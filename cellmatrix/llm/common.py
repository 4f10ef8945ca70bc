"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def ship(module: str) -> None:
    """Send what ``module`` defines to workers by value, so that they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
WORD, GAP = r"[^ \t\n\x0B\f\r]", r"[ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a join side that may be broadcast where its rows are of a fixed width (64 bytes at most, so 6 MB).
BROADCAST_ROWS = 100_000
#: How written tables are made: joins of tables that grow with the corpus are dealt by key at every size,
#: shuffle files go when the table is there, and Python workers get small batches.
MAKING = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

_created: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (tests, a laptop) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellmatrix-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def local_path(uri: str) -> str:
    """A path that ``open`` takes, of a file: URI or plain path; ValueError for any other store."""
    for head in ("file://", "file:"):
        if uri.startswith(head):
            return uri[len(head) :]
    if ":" in uri.split("/", 1)[0]:
        raise ValueError(f"{uri} cannot be opened as a file; spark.checkpoint.dir must be a folder that all machines mount")
    return uri


@contextmanager
def making(spark: SparkSession) -> Iterator[None]:
    """The settings of MAKING, for what runs inside."""
    before = {k: spark.conf.get(k, None) for k in MAKING}
    for k, v in MAKING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Workspace:
    """Tables written in the shared folder to cut lineage; a lost executor rereads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/cellmatrix/{uuid.uuid4().hex}"
        if not _created:
            atexit.register(_clean)
        _created.append((spark, self.root))

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` once and return the written table."""
        path = f"{self.root}/{name}"
        with making(self.spark):
            df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _created:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; the folder's owner sweeps it
            return


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def maybe(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows of a fixed width, for a join: broadcast if it is small, else dealt by key."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_small(big: DataFrame, small: DataFrame, key: str, rows: int, how: str = "left", salts: int = 16) -> DataFrame:
    """Join a table whose ``key`` may be very uneven to one with unique keys.

    ``rows`` is the counted size of ``small``: up to BROADCAST_ROWS it is broadcast;
    beyond that the hot keys of ``big`` are dealt over ``salts`` copies of each small row.
    """
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    salt = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return big.withColumn("_salt", salt).join(copies, [key, "_salt"], how).drop("_salt")


def word_hashes(text: Column) -> Column:
    """The 64-bit hashes of the lower-cased words, in order."""
    return F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w))
