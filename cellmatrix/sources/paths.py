"""Paths that the driver and all executors see."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a temporary one is made and set."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cellmatrix-"))
        path = sc.getCheckpointDir()
    return path.rstrip("/")


class Store:
    """Files by Hadoop's file systems, so that any store that Spark reads works."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")

    def _at(self, name: str):
        p = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.conf), p

    def exists(self, name: str = "") -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def read(self, name: str) -> bytes:
        fs, p = self._at(name)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """The file appears whole or not at all: it is written beside its place and renamed."""
        fs, p = self._at(name)
        _, own = self._at(f".{name}.writing")
        out = fs.create(own, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        fs.delete(p, False)
        if not fs.rename(own, p):
            raise OSError(f"cannot rename {own} to {p}")

    def delete(self, name: str = "") -> None:
        fs, p = self._at(name)
        fs.delete(p, True)

    def names(self, name: str = "") -> list[str]:
        fs, p = self._at(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
