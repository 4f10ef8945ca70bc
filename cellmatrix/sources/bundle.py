"""Stored datasets: Parquet tables with a manifest that is written last.

A bundle is a folder. Each write makes a new version folder of tables and then replaces
``manifest.json``, so a write that fails leaves the bundle as it was. The manifest has the
format's version, shape, layers, derived layers (a descriptor, no values), modalities and
the size and SHA-256 digest of every file, and a digest of itself. A layer is stored twice
where asked for: ranged by gene and by cell, so that either kind of query reads few files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmatrix.sources.paths import Store

VERSION, MANIFEST, KIND = 3, "manifest.json", "cellmatrix-bundle"
SPATIAL, MODALITIES, STATS = 1, 2, 4


class BundleError(ValueError):
    """A bundle that cannot be read: not one, another version, or damaged."""


def _digest(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def sane(x: object) -> object:
    """``x`` as JSON holds it: arrays become lists, numbers of numpy plain numbers, other objects text."""
    if isinstance(x, dict):
        return {str(k): sane(v) for k, v in x.items()}
    if isinstance(x, list | tuple | set):
        return [sane(v) for v in x]
    if hasattr(x, "tolist"):
        return sane(x.tolist())
    return x if x is None or isinstance(x, bool | int | float | str) else str(x)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of the data files under ``path``; each is hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


class Writer:
    """One version of a bundle in the making; ``commit`` makes it the bundle's."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)
        self.folder = f"v-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def table(self, name: str, df: DataFrame, by: str | None = None) -> None:
        """Write a table; ``by`` ranges its rows by that column."""
        if by:
            df = df.repartitionByRange(by).sortWithinPartitions(*[by, *[c for c in ("cell_id", "gene_id") if c in df.columns and c != by]])
        df.write.option("compression", "zstd").parquet(f"{self.store.path}/{self.folder}/{name}")
        self.tables[name] = df.schema.json()

    def layer(self, modality: str, key: str, df: DataFrame, two_ways: bool = True) -> None:
        df = df.select("cell_id", "gene_id", "value")
        self.table(f"layers/{modality}/{key}/by_gene", df, "gene_id")
        if two_ways:
            stored = self.spark.read.schema(df.schema).parquet(f"{self.store.path}/{self.folder}/layers/{modality}/{key}/by_gene")
            self.table(f"layers/{modality}/{key}/by_cell", stored, "cell_id")

    def commit(self, **body: object) -> None:
        """Digest all files, write the manifest, and take the version before away."""
        base = f"{self.store.path}/{self.folder}/"
        files = [r.asDict() for r in file_digests(self.spark, base).collect()]  # a row for each file
        body = sane({"kind": KIND, "version": VERSION, "folder": self.folder, "tables": self.tables, **body})
        body["files"] = sorted(({**f, "path": f["path"].split(f"{self.folder}/", 1)[1]} for f in files), key=lambda f: f["path"])
        self.store.write(MANIFEST, json.dumps({"body": body, "sha256": _digest(body)}).encode())
        for name in self.store.names():
            if name.startswith("v-") and name != self.folder:
                self.store.delete(name)

    def abandon(self) -> None:
        self.store.delete(self.folder)


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a bundle, checked."""
    store = Store(spark, path)
    if not store.exists(MANIFEST):
        raise FileNotFoundError(f"{path} has no {MANIFEST}")
    try:
        whole = json.loads(store.read(MANIFEST))
        body, digest = whole["body"], whole["sha256"]
        if body["kind"] != KIND:
            raise BundleError(f"{path} is not a bundle")
    except (ValueError, KeyError, TypeError) as e:
        raise BundleError(f"{path}: the manifest cannot be read: {e}") from e
    if body.get("version") != VERSION:
        raise BundleError(f"{path} is of version {body.get('version')}, not {VERSION}")
    if _digest(body) != digest:
        raise BundleError(f"{path}: the manifest is damaged")
    return body


def verify(spark: SparkSession, path: str, body: dict | None = None) -> None:
    """BundleError unless every file of the bundle is there with its size and digest."""
    body = body or manifest(spark, path)
    base = f"{path.rstrip('/')}/{body['folder']}"
    known = {f["path"]: (f["size"], f["sha256"]) for f in body["files"]}
    there = {r["path"].split(f"{body['folder']}/", 1)[1]: (r["size"], r["sha256"]) for r in file_digests(spark, base).collect()} if known else {}
    bad = sorted(k for k, v in known.items() if there.get(k) != v) + sorted(set(there) - set(known))
    if bad:
        raise BundleError(f"{path}: {len(bad)} files are damaged, missing or foreign: {bad[:3]}")


class Reader:
    """The tables of a stored bundle, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, path: str, check: bool = True) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.body = manifest(spark, path)
        if check:
            verify(spark, path, self.body)

    def has(self, name: str) -> bool:
        return name in self.body["tables"]

    def table(self, name: str) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(self.body["tables"][name]))
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.body['folder']}/{name}")

    def layer(self, modality: str, key: str, by: str = "gene") -> DataFrame:
        name = f"layers/{modality}/{key}/by_{by}"
        return self.table(name if self.has(name) else f"layers/{modality}/{key}/by_gene")

    def flags(self) -> int:
        """1: spatial, 2: several modalities, 4: statistics."""
        on = {SPATIAL: self.has("spatial"), MODALITIES: len(self.body["modalities"]) > 1, STATS: self.has("celltype_stats")}
        return reduce(int.__or__, (k for k, v in on.items() if v), 0)

    def blocks(self) -> DataFrame:
        """(path, size, sha256): the index of the bundle's files."""
        rows = [(f["path"], f["size"], f["sha256"]) for f in self.body["files"]]
        return self.spark.createDataFrame(rows, "path string, size long, sha256 string")
