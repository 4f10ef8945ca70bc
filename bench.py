"""Times the headline queries; prints one JSON line.

``bundle_write`` stores the counts in both clusterings with statistics, ``bundle_load`` reads
and verifies them whole; the queries named ``stored_`` run on what was stored.
"""

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellmatrix.operators import container
from cellmatrix.plans import catalogue
from cellmatrix.sources.paths import Store, shared_dir

HEADLINE = ("coo_dedup", "celltype_stats", "zinb_params", "gene_query", "cell_query", "log1p_layer", "log1p_norm")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(f: Callable[[], object], n: int = 3) -> float:
    runs = []
    for _ in range(n):
        t = time.time()
        f()
        runs.append(time.time() - t)
    return round(min(runs), 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: best(lambda name=name: run(catalogue.queries()[name](spark, sf))) for name in HEADLINE}
    path = f"{shared_dir(spark)}/bench"
    counts = catalogue.raw(spark, sf)

    def write() -> None:
        m = container.CellMatrix(catalogue.obs(spark, sf), catalogue.named_var(spark, sf))
        m.add_layer("X_raw", counts)
        m.write(path)

    times["bundle_write"] = best(write, 2)
    times["bundle_load"] = best(lambda: run(container.read(spark, path, verify=True).layer("X_raw")))
    m = container.read(spark, path, verify=False)
    name = m.modalities["RNA"].var.first()["name"]
    times["stored_gene"] = best(lambda: run(m.gene(name)))
    times["stored_cell"] = best(lambda: run(m.cell(1)))
    times["stored_stats"] = best(lambda: run(m.tables["celltype_stats"]))
    Store(spark, path).delete()
    headline = sum(times[k] for k in HEADLINE)
    print(json.dumps({"metric": "headline queries, best of 3", "value": round(headline, 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
