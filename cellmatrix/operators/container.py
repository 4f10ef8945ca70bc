"""A dataset: cells, genes of one or more modalities, layers, embeddings, positions, terms, history."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmatrix import __version__
from cellmatrix.operators import matrix as M
from cellmatrix.operators.structure import same_topology
from cellmatrix.sources.bundle import Reader, Writer, sane

MAIN, DERIVABLE = "RNA", ("log1p", "sqrt", "log1p_norm")


@dataclass(frozen=True)
class Derived:
    """A layer that is computed from another when read."""

    transform: str
    source: str
    scale: float = 1e4
    size_factors: DataFrame | None = None


@dataclass(frozen=True)
class Entry:
    """One step of the history."""

    seq: int
    ts: str
    operation: str
    parameters: str
    software_version: str = __version__


@dataclass
class Modality:
    var: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    derived: dict[str, Derived] = field(default_factory=dict)


class CellMatrix:
    """Tables over a fixed set of cells; ``obs`` has cell_id, each ``var`` gene_id and, for queries by name, name.

    Without a ``barcode`` or ``name`` column, ids are the names.
    """

    def __init__(self, obs: DataFrame, var: DataFrame) -> None:
        self.spark, self.obs = obs.sparkSession, obs
        self.modalities = {MAIN: Modality(var)}
        self.obsm: dict[str, DataFrame] = {}
        self.varm: dict[str, DataFrame] = {}
        self.tables: dict[str, DataFrame] = {}
        self.ontology: dict[str, dict[str, str]] = {}
        self.uns: dict[str, object] = {}
        self._history: list[Entry] = []
        self._reader: Reader | None = None
        self._sizes: dict[str, int] = {}

    # Shape

    def _count(self, key: str, df: DataFrame) -> int:
        if key not in self._sizes:
            self._sizes[key] = df.count()
        return self._sizes[key]

    @property
    def n_obs(self) -> int:
        return self._count("obs", self.obs)

    @property
    def n_vars(self) -> int:
        return self._count(f"var/{MAIN}", self.modalities[MAIN].var)

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_obs, self.n_vars

    # Content

    def _modality(self, name: str) -> Modality:
        if name not in self.modalities:
            raise KeyError(f"no modality {name!r}; there are {sorted(self.modalities)}")
        return self.modalities[name]

    def add_modality(self, name: str, var: DataFrame) -> None:
        if name in self.modalities:
            raise ValueError(f"modality {name!r} is there already")
        self.modalities[name] = Modality(var)
        self.log("add_modality", name=name)

    def add_layer(self, key: str, layer: DataFrame, modality: str = MAIN) -> None:
        """A stored layer (cell_id, gene_id, value)."""
        if missing := {"cell_id", "gene_id", "value"} - set(layer.columns):
            raise ValueError(f"a layer needs the columns {sorted(missing)}")
        m = self._modality(modality)
        m.derived.pop(key, None)
        m.layers[key] = layer.select("cell_id", "gene_id", "value")
        self.log("add_layer", key=key, modality=modality)

    def add_derived_layer(self, key: str, transform: str, source: str, size_factors: DataFrame | None = None, scale: float = 1e4, modality: str = MAIN) -> None:
        """A layer of which only the rule is kept: log1p, sqrt or log1p_norm of a stored layer."""
        if transform not in DERIVABLE:
            raise ValueError(f"{transform} is not one of {', '.join(DERIVABLE)}")
        m = self._modality(modality)
        if source not in m.layers:
            raise KeyError(f"no stored layer {source!r} in {modality}; there are {sorted(m.layers)}")
        m.derived[key] = Derived(transform, source, scale, size_factors)
        self.log("add_derived_layer", key=key, transform=transform, source=source, scale=scale, modality=modality)

    def layer_keys(self, modality: str = MAIN) -> list[str]:
        m = self._modality(modality)
        return [*m.layers, *[k for k in m.derived if k not in m.layers]]

    def layer(self, key: str | None = None, modality: str = MAIN, by: str = "gene") -> DataFrame:
        """A layer, stored or derived; without a key the first. ``by``: which clustering a stored bundle should read."""
        m = self._modality(modality)
        keys = self.layer_keys(modality)
        if key is None and keys:
            key = keys[0]
        if key in m.derived:
            d = m.derived[key]
            return M.derived(self.layer(d.source, modality, by), d.transform, d.size_factors, d.scale)
        if key not in m.layers:
            raise KeyError(f"no layer {key!r} in {modality}; there are {keys}")
        return self._reader.layer(modality, key, by) if self._reader and self._reader.has(f"layers/{modality}/{key}/by_{by}") else m.layers[key]

    def set_spatial(self, coords: DataFrame) -> None:
        """(cell_id, coords): one position of 2, 3 or 4 numbers for each cell."""
        sizes = [r[0] for r in coords.groupBy(F.size("coords").alias("n")).count().limit(10).select("n").collect()]
        if len(sizes) > 1 or any(n not in (2, 3, 4) for n in sizes):
            raise ValueError(f"positions need 2, 3 or 4 numbers, all alike; there are {sorted(sizes)}")
        if not coords.join(self.obs.select("cell_id"), "cell_id", "left_anti").isEmpty() or not self.obs.select("cell_id").join(coords, "cell_id", "left_anti").isEmpty():
            raise ValueError("positions must be of the dataset's cells, one for each")
        self.tables["spatial"] = coords.select("cell_id", F.col("coords").cast("array<double>").alias("coords"))
        self.log("set_spatial", dims=sizes[0] if sizes else 0)

    @property
    def spatial(self) -> DataFrame | None:
        return self.tables.get("spatial")

    def set_ontology(self, obs_col: str, mapping: dict[str, str]) -> None:
        """Terms of the labels of a column of ``obs``."""
        self.ontology[obs_col] = dict(mapping)
        self.log("set_ontology", obs_col=obs_col, terms=len(mapping))

    def with_terms(self, obs_col: str) -> DataFrame:
        """``obs`` with ``term``, null where the label has none."""
        rows = list(self.ontology.get(obs_col, {}).items())
        terms = self.spark.createDataFrame(rows, "_label string, term string")
        return self.obs.join(F.broadcast(terms), F.col(obs_col) == F.col("_label"), "left").drop("_label")  # the mapping came from the driver

    # History

    def log(self, operation: str, **parameters: object) -> None:
        now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        self._history.append(Entry(len(self._history), now, operation, json.dumps(sane(parameters), sort_keys=True)))

    @property
    def provenance(self) -> list[Entry]:
        """A copy; entries cannot be changed."""
        return list(self._history)

    # Queries

    def _id(self, axis: DataFrame, key: str, label: str, value: object, last: bool) -> int:
        """The id of a name; of several the last gene or the first cell."""
        name = label if label in axis.columns else key
        found = axis.where(F.col(name) == F.lit(value)).agg((F.max if last else F.min)(key)).first()[0]
        if found is None:
            raise KeyError(f"no {label} {value!r}")
        return found

    def gene(self, name: object, layer: str | None = None, modality: str = MAIN, dense: bool = True) -> DataFrame:
        """(cell_id, value) of one gene, over all cells or, with ``dense=False``, its stored entries."""
        values, at = self.layer(layer, modality), self._id(self._modality(modality).var, "gene_id", "name", name, True)
        return M.gene(values, self.obs, at) if dense else values.where(F.col("gene_id") == at).select("cell_id", "value")

    def cell(self, barcode: object, layer: str | None = None, modality: str = MAIN, dense: bool = True) -> DataFrame:
        """(gene_id, value) of one cell, over all genes or its stored entries."""
        values, at = self.layer(layer, modality, "cell"), self._id(self.obs, "cell_id", "barcode", barcode, False)
        return M.cell(values, self._modality(modality).var, at) if dense else values.where(F.col("cell_id") == at).select("gene_id", "value")

    def _labelled(self, label: str) -> DataFrame:
        return self.obs.select("cell_id", F.col(label).cast("string").alias("cell_type"))

    def celltype_stats(self, label: str = "cell_type", layer: str | None = None, modality: str = MAIN) -> DataFrame:
        return M.celltype_stats(self.layer(layer, modality), self._labelled(label), self._modality(modality).var)

    def zinb_params(self, label: str = "cell_type", layer: str | None = None, modality: str = MAIN, clip: float | None = M.HALF_LIMIT) -> DataFrame:
        return M.zinb_params(self.layer(layer, modality), self._labelled(label), self._modality(modality).var, clip)

    def shares_topology(self, a: str, b: str, modality: str = MAIN) -> bool:
        """Whether two layers store the same coordinates; equal counts do not tell."""
        return same_topology(self.layer(a, modality), self.layer(b, modality)).first()["mismatches"] == 0

    # Storage

    def write(self, path: str, stats: bool = True, label: str = "cell_type", two_ways: bool = True) -> None:
        """Store the dataset; a bundle at ``path`` is replaced once all is written."""
        w = Writer(self.spark, path)
        try:
            w.table("obs", self.obs, "cell_id")
            for name, m in self.modalities.items():
                w.table(f"var/{name}", m.var, "gene_id")
                for key in m.layers:
                    w.layer(name, key, self.layer(key, name), two_ways)
                for key, d in m.derived.items():
                    if d.size_factors is not None:
                        w.table(f"size_factors/{name}/{key}", d.size_factors.select("cell_id", "sf"), "cell_id")
            for kind, group in (("obsm", self.obsm), ("varm", self.varm)):
                for key, df in group.items():
                    w.table(f"{kind}/{key}", df)
            for key, df in self.tables.items():
                if key not in ("celltype_stats", "zinb") or not stats:
                    w.table(key, df)
            main = self.modalities[MAIN]
            if stats and label in self.obs.columns and main.layers:
                first = next(iter(main.layers))
                w.table("celltype_stats", self.celltype_stats(label, first), "gene_id")
                w.table("zinb", self.zinb_params(label, first), "gene_id")
            w.commit(
                shape=self.shape, uns=self.uns, ontology=self.ontology, provenance=[vars(e) for e in self._history], label=label,
                modalities={n: {"layers": {k: dict(v.dtypes)["value"] for k, v in m.layers.items()}, "derived": {k: {"transform": d.transform, "source": d.source, "scale": d.scale} for k, d in m.derived.items()}} for n, m in self.modalities.items()},
                obsm=list(self.obsm), varm=list(self.varm), extra=list(self.tables),
            )
        except BaseException:
            w.abandon()
            raise
        if self._reader and self._reader.path == path.rstrip("/"):  # the files this dataset was read from are gone
            self.__dict__.update(read(self.spark, path, verify=False).__dict__)


def read(spark: SparkSession, path: str, verify: bool = True) -> CellMatrix:
    """A stored dataset, lazily; with ``verify`` all digests are compared first."""
    r = Reader(spark, path, verify)
    out = CellMatrix(r.table("obs"), r.table(f"var/{MAIN}"))
    out._sizes = {"obs": r.body["shape"][0], f"var/{MAIN}": r.body["shape"][1]}
    for name, m in r.body["modalities"].items():
        own = out.modalities.setdefault(name, Modality(r.table(f"var/{name}")))
        own.layers = {k: r.layer(name, k) for k in m["layers"]}
        for key, d in m["derived"].items():
            sf = f"size_factors/{name}/{key}"
            own.derived[key] = Derived(d["transform"], d["source"], d["scale"], r.table(sf) if r.has(sf) else None)
    out.obsm = {k: r.table(f"obsm/{k}") for k in r.body["obsm"]}
    out.varm = {k: r.table(f"varm/{k}") for k in r.body["varm"]}
    out.tables = {k: r.table(k) for k in {*r.body["extra"], "celltype_stats", "zinb"} if r.has(k)}
    out.ontology, out.uns = r.body["ontology"], r.body["uns"]
    out._history = [Entry(**e) for e in r.body["provenance"]]
    out._reader = r
    return out
