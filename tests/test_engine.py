"""Storage, facade, converters, codecs and edge cases of the matrix engine."""

import math
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmatrix import cli
from cellmatrix.functions import codecs as Z
from cellmatrix.functions import cost as K
from cellmatrix.operators import container as C
from cellmatrix.operators import matrix as M
from cellmatrix.operators import quality as Q
from cellmatrix.operators import simulate
from cellmatrix.operators import structure as T
from cellmatrix.plans import catalogue
from cellmatrix.sources import bundle, convert


def matrix(spark, n=12, k=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 5, (n, k)) * (rng.random((n, k)) < 0.4)
    m = convert.from_array(spark, x, [f"c{i}" for i in range(n)], [f"g{i}" for i in range(k)])
    m.obs = m.obs.withColumn("cell_type", F.when(F.col("cell_id") % 3 == 0, "A").otherwise("B"))
    return m, x


def entries(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def stored(spark, tmp_path):
    m, x = matrix(spark)
    m.add_derived_layer("log", "log1p", "X_raw")
    m.add_modality("ATAC", spark.createDataFrame([(0, "p0"), (1, "p1")], "gene_id long, name string"))
    m.add_layer("counts", spark.createDataFrame([(0, 0, 3), (5, 1, 2)], "cell_id long, gene_id long, value long"), "ATAC")
    m.add_derived_layer("sqrt", "sqrt", "counts", modality="ATAC")
    m.set_spatial(m.obs.select("cell_id", F.array(F.lit(1.0), F.col("cell_id").cast("double")).alias("coords")))
    m.obsm["pca"] = m.obs.select("cell_id", F.array(F.lit(0.5), F.lit(-0.0)).alias("vec"))
    m.set_ontology("cell_type", {"A": "T:1"})
    m.uns = {"a": np.arange(3), "b": {"c": np.float64(1.5)}}
    path = str(tmp_path / "b")
    m.write(path)
    return m, x, path


def test_round_trip(spark, stored):
    m, x, path = stored
    r = C.read(spark, path)
    assert r.shape == m.shape == x.shape
    for by in ("gene", "cell"):
        assert entries(r.layer("X_raw", by=by)) == entries(m.layer("X_raw"))
    assert entries(r.layer("counts", "ATAC")) == [(0, 0, 3), (5, 1, 2)]
    assert entries(r.layer("log")) == [(i, j, math.log1p(v)) for i, j, v in entries(m.layer("X_raw"))]
    assert entries(r.layer("sqrt", "ATAC")) == [(0, 0, 3**0.5), (5, 1, 2**0.5)]
    assert entries(r.obs) == entries(m.obs) and entries(r.spatial) == entries(m.spatial) and entries(r.obsm["pca"]) == entries(m.obsm["pca"])
    assert r.uns == {"a": [0, 1, 2], "b": {"c": 1.5}} and r.ontology == m.ontology and r._reader.flags() == 7
    assert [e.operation for e in r.provenance] == [e.operation for e in m.provenance] and r.provenance[0].ts.endswith("Z")
    assert entries(r.tables["celltype_stats"]) == entries(m.celltype_stats())
    assert not any("log" in f["path"] for f in r._reader.body["files"])  # derived layers are not stored
    with pytest.raises(AttributeError):
        r.provenance[0].operation = "x"
    r.write(path)  # over what it was read from, statistics included
    assert entries(C.read(spark, path).layer("X_raw")) == entries(r.layer("X_raw")) == entries(m.layer("X_raw"))


def test_queries_by_name(spark, stored):
    _, x, path = stored
    r = C.read(spark, path)
    assert [v for _, v in entries(r.gene("g2"))] == x[:, 2].tolist()
    assert [v for _, v in entries(r.cell("c4"))] == x[4].tolist()
    assert [v for _, v in entries(r.gene("g2", "log"))] == np.log1p(x[:, 2]).tolist()
    assert [v for _, v in entries(r.gene("p1", modality="ATAC"))] == [0] * 5 + [2] + [0] * 6
    assert entries(r.gene("g2", dense=False)) == [(i, int(v)) for i, v in enumerate(x[:, 2]) if v]
    for bad in (lambda: r.gene("nope"), lambda: r.cell("nope"), lambda: r.gene("g1", "nope"), lambda: r.gene("g1", modality="nope"), lambda: r.gene("p1")):
        with pytest.raises(KeyError):
            bad()
    twice = C.CellMatrix(spark.createDataFrame([(0, "x"), (1, "x")], "cell_id long, barcode string"), spark.createDataFrame([(0, "g"), (1, "g")], "gene_id long, name string"))
    twice.add_layer("a", spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 1, 3)], "cell_id long, gene_id long, value long"))
    assert entries(twice.gene("g")) == [(0, 2), (1, 3)] and entries(twice.cell("x")) == [(0, 1), (1, 2)]


def test_damage(spark, stored, tmp_path):
    _, _, path = stored
    folder = tmp_path / "b"
    first = next(p for p in folder.rglob("part-*.parquet"))
    good, note = first.read_bytes(), (folder / "manifest.json").read_bytes()

    def hide_crc():
        for p in folder.rglob(".*.crc"):
            p.unlink()

    hide_crc()
    first.write_bytes(good[:20] + bytes([good[20] ^ 1]) + good[21:])
    with pytest.raises(bundle.BundleError):
        C.read(spark, path)
    first.write_bytes(good[:-5])
    with pytest.raises(bundle.BundleError):
        C.read(spark, path)
    first.write_bytes(good)
    C.read(spark, path)
    for bad in (b"{}", note[:-50], note.replace(b'"version": 3', b'"version": 99'), note.replace(b"cellmatrix-bundle", b"other"), note.replace(b'"shape": [12', b'"shape": [13')):
        (folder / "manifest.json").write_bytes(bad)
        with pytest.raises(bundle.BundleError):
            C.read(spark, path)
    (folder / "manifest.json").write_bytes(note)
    with pytest.raises(FileNotFoundError):
        C.read(spark, str(tmp_path / "none"))


def test_failed_write_leaves_the_bundle(spark, stored):
    m, x, path = stored
    other, _ = matrix(spark, seed=9)
    other.add_layer("bad", spark.range(3).select(F.col("id").alias("cell_id"), F.col("id").alias("gene_id"), F.raise_error(F.lit("no")).cast("int").alias("value")))
    with pytest.raises(Exception, match="no"):
        other.write(path)
    assert entries(C.read(spark, path).layer("X_raw")) == entries(m.layer("X_raw"))


def test_facade_errors(spark):
    m, _ = matrix(spark)
    with pytest.raises(ValueError):
        m.add_derived_layer("d", "exp", "X_raw")
    with pytest.raises(KeyError):
        m.add_derived_layer("d", "sqrt", "none")
    with pytest.raises(ValueError):
        m.add_modality("RNA", m.obs)
    with pytest.raises(ValueError):
        m.add_layer("x", m.obs)
    for coords in (m.obs.select("cell_id", F.array(F.lit(1.0)).alias("coords")), m.obs.where("cell_id > 0").select("cell_id", F.array(F.lit(1.0), F.lit(2.0)).alias("coords"))):
        with pytest.raises(ValueError):
            m.set_spatial(coords)
    with pytest.raises(ValueError):
        convert.from_array(spark, np.zeros(3))
    with pytest.raises(ValueError):
        convert.from_array(spark, np.zeros((2, 2)), ["a"])


@pytest.mark.parametrize("x", [np.ones((1, 5), int), np.zeros((4, 3)), np.array([[99_999, 0], [5, 1 << 40]]), np.array([[-3, 0], [0, 2]])])
def test_small_and_odd_matrices(spark, tmp_path, x):
    m = convert.from_array(spark, x)
    m.write(str(tmp_path / "m"), stats=False)
    r = C.read(spark, str(tmp_path / "m"))
    assert r.shape == x.shape and entries(r.layer()) == [(i, j, x[i, j].item()) for i, j in zip(*np.nonzero(x), strict=True)]
    assert [v for _, v in entries(r.cell("cell_000000"))] == x[0].tolist()
    kept = convert.from_array(spark, x, sparsify=False)
    assert kept.layer().count() == x.size


def test_stored_nan_null_and_unknown_keys(spark):
    layer = spark.createDataFrame([(0, 0, float("nan")), (1, 0, None), (2, 1, 2.0), (9, 0, 1.0), (0, 9, 1.0)], "cell_id long, gene_id long, value double")
    obs, var = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "cell_id long, cell_type string"), spark.createDataFrame([(0,), (1,)], "gene_id long")
    got = dict(entries(M.gene(layer, obs, 0).fillna(-1.0)))
    assert M.gene(layer, obs, 0).where("value is null").count() == 1 and math.isnan(M.gene(layer, obs, 0).where("cell_id = 0").first()["value"]) and got[2] == 0.0
    with pytest.raises(KeyError):
        M.gene(layer, obs, 7, var)
    assert M.orphans(layer, var, "gene_id").count() == 1 and M.orphans(layer, obs, "cell_id").count() == 1
    s = {(r["gene_id"], r["cell_type"]): r for r in M.celltype_stats(layer, obs, var).collect()}
    assert len(s) == 4 and s[1, "b"]["frac_expressing"] == 1.0 and s[0, "a"]["frac_expressing"] == 0.0
    assert {r["gene_id"]: r["n_cells"] for r in M.expressing(layer.limit(0), var).collect()} == {0: 0, 1: 0}
    assert M.zinb_params(layer.limit(0), obs, var, M.HALF_LIMIT).agg(F.max("r"), F.min("pi")).first() == (M.HALF_LIMIT, 1.0)


def test_normalisation(spark):
    layer = spark.createDataFrame([(0, 0, 1), (0, 1, 3), (1, 0, 5)], "cell_id long, gene_id long, value int")
    want = [(0, 0, math.log1p(0.25 * 1e4)), (0, 1, math.log1p(0.75 * 1e4)), (1, 0, math.log1p(1e4))]
    got = entries(M.normalized(layer))
    assert got == entries(M.derived(layer, "log1p_norm", M.size_factors(layer))) and np.allclose(got, want)
    zero = spark.createDataFrame([(0, 0.0)], "cell_id long, sf double")
    assert [r["value"] for r in M.derived(layer, "log1p_norm", zero).collect()] == [None] * 3
    assert entries(M.derived(layer, "log1p_norm")) == entries(M.derived(layer, "log1p"))
    with pytest.raises(ValueError):
        M.derived(layer, "exp")


def test_running_totals_and_previous(spark):
    df = spark.createDataFrame([(i * i, i % 7) for i in range(500)], "k long, n long").repartition(5)
    got = sorted((r["k"], r["sum_n"], r["prev_n"]) for r in T.previous(T.running_totals(df, "k", "n", ranges=9), "k", "n", ranges=6).collect())
    n = [i % 7 for i in range(500)]
    assert got == [(i * i, s, n[i - 1] if i else None) for i, s in enumerate(np.cumsum(n).tolist())]
    assert T.running_totals(df.limit(0), "k", "n").count() == 0
    assert [T.code_bits(n) for n in (1, 256, 257, 65536, 65537)] == [8, 8, 16, 16, 32]


FLOATS = [
    [], [1.5], [0.0, -0.0, 0.0], [math.inf, -math.inf, math.nan, 1.0], [7.25] * 500, np.random.default_rng(1).uniform(-1e6, 1e6, 300).tolist(),
    np.random.default_rng(2).uniform(-1e8, 1e8, 1000).tolist(), np.array([0, 2**64 - 1, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA], np.uint64).view(np.float64).tolist(),
]
INTS = [[], [0], [0, 1, -1, 100, -100, -32768, 32767], np.random.default_rng(3).integers(0, 10**5, 1000).tolist(), [2**56, -(2**56), 2**63 - 1, -(2**63)], [5] * 129]


def bits(x):
    return np.asarray(x, np.float64).tobytes()


def test_codecs(spark):
    for x in FLOATS:
        assert bits(Z.xor_decode(Z.xor_encode(np.array(x)))) == bits(Z.floats_decode(Z.floats_encode(np.array(x)))) == bits(x)
    for x in [*INTS, [1, 2, 300, 1, 500, 3, 1000, 2, -4], list(range(256, 400))]:
        assert Z.pack_decode(Z.pack_encode(np.array(x, np.int64))).tolist() == Z.counts_decode(Z.counts_encode(np.array(x, np.int64))).tolist() == x
        size = 8 + sum(2 + -(-max(1, int(max(Z.zigzag(np.array(x[i : i + 128]))))).bit_length() * len(x[i : i + 128]) // 8) for i in range(0, len(x), 128))
        assert len(Z.pack_encode(np.array(x, np.int64))) == size
    with pytest.raises(ValueError):
        Z.floats_decode(b"?")
    head, got = Z.table_decode(Z.table_encode({"a": np.array([0.1, 70000.0]), "b": np.zeros(0)}, n=2))
    assert head == {"n": 2} and got["a"].tolist() == [0.0999755859375, math.inf] and len(got["b"]) == 0
    df = spark.createDataFrame([(i, x) for i, x in enumerate(FLOATS)] + [(99, None)], "i int, x array<double>")
    back = {r["i"]: r["y"] for r in df.select("i", Z.xor_unpack(Z.xor_pack(F.col("x"))).alias("y")).collect()}
    assert all(bits(back[i]) == bits(x) for i, x in enumerate(FLOATS)) and back[99] is None
    assert [r[0] for r in spark.createDataFrame([(0.1,), (None,), (1e9,)], "x double").select(Z.half(F.col("x"))).collect()] == [0.0999755859375, None, math.inf]


def test_cost_is_the_codec(spark):
    x = [1.0, 1.0, 2.5, -3.0, 1e300, 0.0, -0.0]
    cost = K.xor_bits(spark.createDataFrame(list(enumerate(x)), "i long, x double"), "i", "x").agg(F.sum("bits")).first()[0]
    assert int.from_bytes(Z.xor_encode(np.array(x))[4:8], "little") == 64 + cost


def test_quality(spark):
    rows = [(i, "A", float(i % 5), float((i * 7) % 11)) for i in range(40)] + [(99, "A", None, 1.0)]
    df = spark.createDataFrame(rows, "gene_id long, cell_type string, estimate double, truth double")
    import pandas as pd

    a, b = pd.Series([r[2] for r in rows[:-1]]), pd.Series([r[3] for r in rows[:-1]])
    e = Q.errors(df.where("estimate is not null")).first()
    assert e["pearson"] == pytest.approx(a.corr(b)) and e["mse"] == pytest.approx(((a - b) ** 2).mean()) and e["bias"] == pytest.approx((a - b).mean())
    assert Q.spearman(df).first()["spearman"] == pytest.approx(a.rank().corr(b.rank()))
    assert Q.strata(df.limit(8), "truth").where("pearson is not null").count() == 0
    one = spark.createDataFrame([(1, float("nan")), (1, 2.0), (2, float("nan"))], "k int, v double")
    assert entries(Q.mean_over(one, "k", "v")) == [(1, 1, 2.0), (2, 0, None)]


def test_simulation(spark):
    v = simulate.validation(spark, [120], 40, 2, [1])
    assert {r["method"] for r in v.collect()} == {"moments", "naive"}
    t = simulate.draw_genes(300, 2, 0)
    low, high = t.pi[t.mu < np.median(t.mu)].mean(), t.pi[t.mu > np.median(t.mu)].mean()
    old = simulate.draw_genes(300, 2, 0, legacy=True)
    assert low > high and old.pi[old.mu < np.median(old.mu)].mean() < old.pi[old.mu > np.median(old.mu)].mean()


def test_converters(spark, tmp_path):
    sparse = types.SimpleNamespace(tocoo=lambda: types.SimpleNamespace(row=[0, 1, 1], col=[2, 0, 0], data=np.array([4, 1, 2]), shape=(2, 3)))
    m = convert.from_sparse(spark, sparse, var_names=np.array(["x", "y", "z"]))
    assert entries(m.layer("X_raw")) == [(0, 2, 4), (1, 0, 3)] and m.shape == (2, 3) and [r["barcode"] for r in m.obs.orderBy("cell_id").collect()] == ["cell_000000", "cell_000001"]
    parts = convert.anndata_parts(m)
    assert parts["X"].tolist() == [[0, 0, 4], [3, 0, 0]] and list(parts["var"].index) == ["x", "y", "z"]
    ad = types.SimpleNamespace(X=parts["X"], layers={"n": parts["X"] * 0.5}, obs=parts["obs"], var=parts["var"], obsm={"spatial": np.ones((2, 3))}, uns={})
    back = convert.from_anndata(spark, ad)
    assert back.layer_keys() == ["X_raw", "n"] and back.spatial.count() == 2 and convert.anndata_parts(back)["X"].tolist() == parts["X"].tolist()
    file = tmp_path / "a.mtx"
    file.write_text("%%MatrixMarket matrix coordinate integer general\n% a note\n2 3 2\n2 3 2\n1 1 7\n")
    assert entries(convert.read_market(spark, str(file)).layer()) == [(0, 0, 7), (1, 2, 2)]


def test_command_line(spark, tmp_path, capsys):
    src, out, obs = (str(tmp_path / x) for x in ("c.parquet", "b", "obs.parquet"))
    spark.createDataFrame([(0, 0, 1), (0, 0, 1), (1, 2, 5)], "cell_id long, gene_id long, value int").write.parquet(src)
    spark.createDataFrame([(0, "A"), (1, "B")], "cell_id long, cell_type string").write.parquet(obs)
    assert cli.main(["ingest", src, "-o", out, "--obs", obs], spark) == 0
    assert cli.main(["info", out], spark) == 0 and '"shape": [2, 2]' in capsys.readouterr().out
    assert cli.main(["query", out, "--gene", "2"], spark) == 0 and cli.main(["query", out, "--gene", "77"], spark) == 1
    assert cli.main(["stats", out], spark) == 0 and C.read(spark, out).tables["celltype_stats"].count() == 4
    page = tmp_path / "page.csv"
    page.write_text("cell_id,gene_id,value\n1,2,3\n")
    (tmp_path / "got.csv.part").write_bytes(b"old")
    assert convert.fetch(page.as_uri(), str(tmp_path / "got.csv")) and (tmp_path / "got.csv").read_text() == page.read_text()


def test_growing_layer(spark, tmp_path):
    from cellmatrix.streaming import stats

    m, _ = matrix(spark)
    src, path, check = (str(tmp_path / x) for x in ("in", "sums", "check"))
    layer, obs, var = m.layer("X_raw"), m.obs, m.modalities["RNA"].var
    assert stats.celltype_stats(spark, obs, var, path).agg(F.sum("mean_expr")).first()[0] == 0
    for part in ("cell_id < 5", "cell_id >= 5 and gene_id < 4", "cell_id >= 5 and gene_id >= 4"):
        layer.where(part).write.mode("append").parquet(src)
        stats.maintain(spark.readStream.schema(layer.schema).parquet(src), obs, path, check, once=True).awaitTermination()
    assert entries(stats.celltype_stats(spark, obs, var, path)) == entries(m.celltype_stats())
    assert entries(stats.zinb_params(spark, obs, var, path)) == entries(M.zinb_params(layer, obs, var))
    before = entries(stats.current(spark, path))
    stats.add_batch(layer, 2, obs, path)  # a batch that was added already
    assert entries(stats.current(spark, path)) == before


def test_dense_chunks(spark):
    """The dense matrix of a layer, chunk by chunk, and the layer again; a last chunk is shorter."""
    size, rng = 3 * M.CHUNK + 5, np.random.default_rng(3)
    rows = [(c, int(g), int(rng.integers(-3, 4))) for c in (1, 2) for g in {0, M.CHUNK - 1, M.CHUNK, size - 1, *rng.integers(0, size, 9).tolist()}]
    out = M.to_dense(spark.createDataFrame([*rows, (1, size, 9), (3, -1, 9)], "cell_id long, gene_id long, value int"), size)
    want = np.zeros((3, size), int)
    for c, g, v in rows:
        want[c, g] = v
    got = np.zeros_like(want)
    for r in out.collect():
        assert r["first"] % M.CHUNK == 0 and len(r["vec"]) == min(M.CHUNK, size - r["first"])
        got[r["cell_id"], r["first"] : r["first"] + len(r["vec"])] = r["vec"]
    assert (got == want).all()
    assert sorted(map(tuple, M.from_dense(out, "cell_id", "vec", first="first").collect())) == sorted(r for r in rows if r[2])


def test_no_dense_grid(spark):
    """Suppliers times parts is never joined: at 60 times sf0.1 that grid has 72 billion rows."""
    plan = catalogue.dense_sparsify(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Cross" not in plan


def test_accuracy_joins_by_key(spark, tmp_path):
    """Stored statistics compress to small files; their join is dealt by key all the same."""
    rows = [(g, t, 0.5 / (g + 1), float(g), g + 1.0, 0.5 * g) for g in range(20) for t in ("a", "b")]
    df = spark.createDataFrame(rows, "gene_id long, cell_type string, obs_zero_frac double, mean_expr double, mean_expr_nz double, frac_expressing double")
    df.write.parquet(f"{tmp_path}/s")
    out = Q.accuracy(spark.read.parquet(f"{tmp_path}/s"), df)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r["statistic"]: (r["mse"], r["max_abs_err"]) for r in out.collect()} == dict.fromkeys(("obs_zero_frac", "mean_expr", "mean_expr_nz", "frac_expressing"), (0.0, 0.0))


def test_stats_joins_by_key(spark):
    """However small the files look, only the types are broadcast: a join of all cells or genes on the driver takes its memory at 60 times sf0.1."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plan = catalogue.stats_accuracy(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in plan and plan.count("BroadcastExchange") == 1
