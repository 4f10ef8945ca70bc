"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration.

Statistics of each whole text (a dozen numbers) are mapped to cosines whose products
approximate a Gaussian kernel. Each partition sums its part of the normal equations; the
parts are added by matrix row, and the driver solves one system of RFF + 1 unknowns.
Calibration pools adjacent violators over a grid of GRID score bins, also a fixed size.

Defined results: null counts as empty text, which is scored like any other; labels that
are null or of unknown documents teach nothing; without labels every score is 0.5;
repeated rows are each scored; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fold, ship

ship(__name__)

RFF, GAMMA, RIDGE, GRID, FOLDS, HELD, SEED = 192, 0.15, 1e-3, 1000, 3, 1, 5
_WORD = re.compile(r"[^ \t-\r]+")
STATS = (
    "log_words", "word_len", "word_len_sd", "distinct", "digits", "upper", "symbols", "stops", "commas",
    "dup_lines", "long_words", "line_words", "top_word", "non_ascii", "repeats",
)


def stats(t: str | None) -> list[float]:
    """The numbers of STATS."""
    t = t or ""
    w = _WORD.findall(t)
    n, c = max(len(w), 1), max(len(t), 1)
    size = np.fromiter(map(len, w), float, len(w)) if w else np.zeros(1)
    b = np.bincount(np.frombuffer(t.encode("utf-8", "replace"), np.uint8), minlength=256)
    lines = [x for x in t.split("\n") if x and not x.isspace()]
    m = max(len(lines), 1)
    distinct = set(w)
    grams = set(zip(w, w[1:], strict=False))
    first = max(Counter(w).values(), default=0)
    return [
        np.log1p(len(w)), min(size.mean(), 30.0), min(size.std(), 30.0), len(distinct) / n**0.8, b[48:58].sum() / c,
        b[65:91].sum() / c, b[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 123, 124, 125, 126]].sum() / c, (b[46] + b[63]) / n, b[44] / n,
        1 - len(set(lines)) / m, (size > 18).mean(), np.log1p(n / m), first / n, b[128:].sum() / c, 1 - len(grams) / max(len(w) - 1, 1),
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the array x of STATS."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"], "x": [stats(t) for t in p["text"].tolist()]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, x array<double>")


class Model:
    """Scaling, random directions, ridge weights and the calibration's steps."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.normal(0, np.sqrt(2 * GAMMA), (len(mean), RFF))
        self.b = rng.uniform(0, 2 * np.pi, RFF)
        self.beta = np.zeros(RFF + 1)
        self.at, self.to = np.array([0.0]), np.array([0.5])

    def map(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.hstack([np.sqrt(2 / RFF) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.map(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.to)


def isotonic(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Non-decreasing fit with weights n: adjacent violators are pooled."""
    out: list[list[float]] = []
    for weight, value in zip(n, mean, strict=True):
        out.append([weight, value, 1])
        while len(out) > 1 and out[-2][1] >= out[-1][1]:
            k, v, m = out.pop()
            a = out[-1]
            out[-1] = [a[0] + k, (a[0] * a[1] + k * v) / (a[0] + k), a[2] + m]
    return np.concatenate([np.full(int(m), v) for _, v, m in out])


def fit(train: DataFrame) -> Model | None:
    """Learn from rows (x, y)."""
    k = range(len(STATS))
    m = train.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i]).alias(f"{a}{i}") for i in k for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not m["n"]:
        return None
    model = Model(np.array([m[f"m{i}"] for i in k]), np.array([m[f"s{i}"] for i in k]))

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((RFF + 1, RFF + 2))
        for p in frames:
            if len(p):
                z = model.map(np.stack(p["x"].to_numpy()))
                total += z.T @ np.hstack([z, p["y"].to_numpy(float)[:, None]])
        yield pd.DataFrame({"i": np.arange(RFF + 1), "v": list(total)})

    def added(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [p["i"].iloc[0]], "v": [np.sum(np.stack(p["v"].to_numpy()), 0)]})

    rows = train.select("x", "y").mapInPandas(parts, "i int, v array<double>").groupBy("i").applyInPandas(added, "i int, v array<double>").collect()
    a = np.stack([r["v"] for r in sorted(rows, key=lambda r: r["i"])])
    model.beta = np.linalg.solve(a[:, :-1] + RIDGE * m["n"] * np.diag([1.0] * RFF + [0.0]) + 1e-9 * np.eye(RFF + 1), a[:, -1])

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            if len(p):
                v = np.clip(model.raw(np.stack(p["x"].to_numpy())), -0.5, 1.5)
                yield pd.DataFrame({"g": np.floor((v + 0.5) / 2 * GRID).astype("int32"), "y": p["y"]})

    bins = train.select("x", "y").mapInPandas(raw, "g int, y double").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).orderBy("g").collect()
    n = np.array([r["n"] for r in bins], float)
    model.at = (np.array([r["g"] for r in bins]) + 0.5) / GRID * 2 - 0.5
    model.to = isotonic(n, np.array([r["y"] for r in bins]))
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    ws = Workspace(docs.sparkSession)
    known = ws.keep(statistics(docs), "stats")
    held = fold(F.col("doc_id"), FOLDS) == HELD
    # A document of several label rows teaches their mean, so the join has one row a document.
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    train = ws.keep(known.where(~held).join(y, "doc_id").select("x", "y"), "train")
    m = fit(train)
    kind = dict(docs.dtypes)["doc_id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            s = m.score(np.stack(p["x"].to_numpy())) if m is not None and len(p) else np.full(len(p), 0.5)
            yield pd.DataFrame({"doc_id": p["doc_id"], "score": np.clip(s, 0, 1)})

    out = known.mapInPandas(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
