"""Command line: ``python -m cellmatrix.cli ingest PATH -o BUNDLE``, ``fetch``, ``info``, ``query``, ``stats``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from cellmatrix.operators.container import read
from cellmatrix.sources.convert import fetch, ingest


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="cellmatrix", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="store a coordinate file (Parquet, CSV, Matrix Market) as a bundle")
    a.add_argument("path")
    a.add_argument("-o", "--out", required=True)
    a.add_argument("--obs", help="Parquet table of the cells")
    a.add_argument("--label", default="cell_type")
    a = sub.add_parser("fetch", help="download a file, resuming what is there, and store it")
    a.add_argument("url")
    a.add_argument("-o", "--out")
    a.add_argument("--keep", action="store_true", help="download only")
    for name, text in (("info", "print a bundle's manifest"), ("stats", "print cell-type statistics"), ("query", "print a gene's or a cell's stored entries")):
        a = sub.add_parser(name, help=text)
        a.add_argument("path")
        if name != "info":
            a.add_argument("--layer")
            a.add_argument("--limit", type=int, default=20, help="rows to print")
        if name == "query":
            a.add_argument("--gene")
            a.add_argument("--cell")
        if name == "stats":
            a.add_argument("--label", default="cell_type")
    o = p.parse_args(args)
    if o.command == "fetch":
        name = os.path.basename(o.url.split("?")[0]) or "download"
        file = fetch(o.url, name if not o.keep or not o.out else o.out)
        if o.keep:
            return 0
        o.path, o.out, o.obs, o.label = file, o.out or f"{file}.bundle", None, "cell_type"
    spark = spark or SparkSession.builder.appName("cellmatrix").getOrCreate()
    if o.command in ("ingest", "fetch"):
        ingest(spark, o.path, o.out, label=o.label, obs=o.obs)
        return 0
    m = read(spark, o.path, verify=o.command == "info")
    if o.command == "info":
        print(json.dumps({"shape": m.shape, "modalities": {k: m.layer_keys(k) for k in m.modalities}, "flags": m._reader.flags()}))
    elif o.command == "stats":
        m.celltype_stats(o.label, o.layer).show(o.limit, truncate=False)
    elif (o.gene is None) == (o.cell is None):
        p.error("query needs --gene or --cell")
    else:
        try:
            (m.gene(o.gene, o.layer, dense=False) if o.gene is not None else m.cell(o.cell, o.layer, dense=False)).show(o.limit, truncate=False)
        except KeyError as e:
            print(e.args[0], file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
