"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items become word hashes (lower case, letters and digits only). The CGK walk
reads a word, writes it, and steps on by a random bit that depends on the place in the
output and the word; small edit distances become small Hamming distances of the outputs.
Each of ``reps`` repetitions has its own walk and its own sample of output places as key.
Keys of every item offset are held against those of every document position whose words
could be part of an item (enough word pairs of the benchmark within a window). A hit
proposes the item-sized window there. Windows near which too few of the item's word
triples stand are set aside without loss, and a word edit distance of at most ``rate``
times the item's words confirms the others.

The benchmark is sent to workers in blocks of at most BLOCK_WORDS words; a larger one
takes one pass over the documents for each block.

Defined results: null or empty texts match nothing; items under ``min_words`` words are
matched by their exact words; null items are ignored; repeated rows each get their own
matches; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, words

ship(__name__)

RATE, MIN_WORDS, REPS, STEPS, SAMPLED, SPAN, NEED, BLOCK_WORDS = 0.2, 8, 12, 14, 4, 12, 4, 500_000


def plain_hashes(text: Column) -> Column:
    return F.transform(words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), lambda w: F.xxhash64(w))


def blend(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ np.uint64((k * 0x9E3779B97F4A7C15 + 0x1234567) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(x: np.ndarray, at: np.ndarray, rep: int) -> np.ndarray:
    """The sampled CGK output of the windows of x that begin at ``at``."""
    i, out = at.copy(), np.full(len(at), np.uint64(rep + 1))
    places = set(np.random.default_rng(100 + rep).choice(STEPS, SAMPLED, replace=False).tolist())
    for j in range(STEPS):
        w = x[np.minimum(i, len(x) - 1)]
        if j in places:
            out = blend(out * np.uint64(31) ^ w, j)
        i += (blend(w, rep * STEPS + j) & np.uint64(1)).astype(np.int64)
    return out


def triple(x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """A hash of the three words from each place on."""
    a, b, c = (x[:-2], x[1:-1], x[2:]) if at is None else (x[at], x[at + 1], x[at + 2])
    return blend(blend(a, 1) ^ b, 2) ^ c


class Items:
    """The benchmark's keys, sorted, and its word pairs."""

    def __init__(self, rows: list[tuple[object, np.ndarray]]) -> None:
        self.ids = [r[0] for r in rows]
        self.words = [np.asarray(r[1], np.int64).view(np.uint64) for r in rows]
        self.slack = np.array([int(RATE * len(x)) for x in self.words])
        got: list[list[np.ndarray]] = [[] for _ in range(REPS)]
        pairs, item, offset = [np.zeros(0, np.uint64)], [], []
        for n, x in enumerate(self.words):
            at = np.arange(max(1, len(x) - MIN_WORDS // 2))
            item.append(np.full(len(at), n))
            offset.append(at)
            for r in range(REPS):
                got[r].append(keys(x, at, r))
            pairs.append(blend(x[:-1], 1) ^ x[1:])
        self.item, self.offset = np.concatenate(item), np.concatenate(offset)
        self.sorted = []
        for r in range(REPS):
            k = np.concatenate(got[r])
            order = np.argsort(k, kind="stable")
            self.sorted.append((k[order], order))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[np.concatenate(pairs) >> np.uint64(42)] = True
        long = [n for n, x in enumerate(self.words) if len(x) >= MIN_WORDS]
        triples = [(triple(self.words[n]), np.full(len(self.words[n]) - 2, n), np.arange(len(self.words[n]) - 2)) for n in long]
        t, n, o = (np.concatenate([x[i] for x in triples] or [np.zeros(0, np.uint64 if i == 0 else np.int64)]) for i in range(3))
        order = np.argsort(t, kind="stable")
        self.triples, self.triple_item, self.triple_offset = t[order], n[order], o[order]
        self.short: dict[bytes, list[int]] = {}
        for n, x in enumerate(self.words):
            if len(x) < MIN_WORDS:
                self.short.setdefault(x.tobytes(), []).append(n)
        self.short_sizes = sorted({len(x) for x in self.words if len(x) < MIN_WORDS})

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Where a window of SPAN words begins that has NEED or more pairs of the benchmark."""
        hit = self.bits[(blend(x[:-1], 1) ^ x[1:]) >> np.uint64(42)]
        total = np.r_[0, np.cumsum(hit)]
        at = np.flatnonzero(hit)
        return at[total[np.minimum(at + SPAN, len(hit))] - total[at] >= NEED]

    def supported(self, x: np.ndarray, ends: np.ndarray, begins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(document, item, cell) of the key hits at the positions ``at`` near which enough word triples of the item stand.

        Each edit touches three of an item's triples at most, and the diagonals of a match
        lie within ``slack`` of each other, so a match has this support in its cell and the
        two beside it.
        """
        size = np.array([len(y) for y in self.words])
        width = int(np.diff(np.r_[begins, ends[-1:]]).max() + size.max()) + 3

        def cells(p: np.ndarray, n: np.ndarray, o: np.ndarray) -> np.ndarray:
            doc = np.searchsorted(ends, p, "right")
            return (doc * len(size) + n) * 2 * width + (p - begins[doc] - o) // (self.slack[n] + 1) + width

        def spread(p: np.ndarray, k: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            lo = np.searchsorted(k, q, "left")
            many = np.searchsorted(k, q, "right") - lo
            return np.repeat(p, many), np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))

        hit = self.bits[(blend(x[:-1], 1) ^ x[1:]) >> np.uint64(42)]
        p = np.flatnonzero(hit[:-1] & hit[1:])
        p, e = spread(p, self.triples, triple(x, p))
        known, count = np.unique(cells(p, self.triple_item[e], self.triple_offset[e]), return_counts=True)
        found = []
        for r, (k, order) in enumerate(self.sorted):
            p, e = spread(at, k, keys(x, at, r))
            e = order[e]
            found.append(cells(p, self.item[e], self.offset[e]))
        every = np.unique(np.concatenate(found))
        if not len(known) or not len(every):
            return np.zeros((0, 3), np.int64)
        total = np.zeros(len(every), np.int64)
        for step in (-1, 0, 1):
            i = np.minimum(np.searchsorted(known, every + step), len(known) - 1)
            total += np.where(known[i] == every + step, count[i], 0)
        n = every // (2 * width) % len(size)
        on = (size[n] >= MIN_WORDS) & (total >= size[n] - 2 - 3 * self.slack[n])
        return np.stack([every // (2 * width) // len(size), n, every % (2 * width) - width], 1)[on]

    def matches(self, x: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(document, item) -> (edits, first word, words) of the best window; x holds the documents up to each of ``ends``."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        begins = np.r_[0, ends[:-1]]
        for size in self.short_sizes:
            first = {y.tobytes()[:8] for y in self.words if len(y) == size}
            for s in np.flatnonzero(np.isin(x, np.frombuffer(b"".join(first), np.uint64))).tolist():
                doc = int(np.searchsorted(ends, s, "right"))
                if s + size <= ends[doc]:
                    for n in self.short.get(x[s : s + size].tobytes(), []):
                        out.setdefault((doc, n), (0, s - int(begins[doc]), size))
        if len(x) < 2 or not len(at := self.positions(x)):
            return out
        for doc, n, cell in self.supported(x, ends, begins, at).tolist():
            y, most = self.words[n], int(self.slack[n])
            lo = max(0, cell * (most + 1) - most)
            z = x[begins[doc] + lo : min(ends[doc], begins[doc] + lo + len(y) + 3 * most + 2)]
            # Each word of the item that is not in the region costs an edit.
            if np.isin(y, z).sum() < len(y) - most:
                continue
            best = within(y, z)
            if best[0] <= most and ((doc, n) not in out or best[0] < out[doc, n][0]):
                out[doc, n] = (best[0], lo + best[1], best[2])
        return out


def within(y: np.ndarray, x: np.ndarray) -> tuple[int, int, int]:
    """Least word edits of y against any window of x, and that window's start and length."""
    cols = np.arange(len(x) + 1)
    d, start = np.zeros(len(cols), np.int64), cols.copy()
    for i, w in enumerate(y, 1):
        sub, drop = d[:-1] + (x != w), d[1:] + 1
        new = np.r_[i, np.minimum(sub, drop)]
        begin = np.r_[0, np.where(sub <= drop, start[:-1], start[1:])]
        low = np.minimum.accumulate(new - cols)
        # The last column whose own value reaches the running minimum gives the path.
        src = np.maximum.accumulate(np.where(new - cols == low, cols, 0))
        d, start = low + cols, begin[src]
    j = int(d.argmin())
    return int(d[j]), int(start[j]), j - int(start[j])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, first_word, n_words) of every document and item that match."""
    kinds = dict(docs.dtypes)["doc_id"], dict(items.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, first_word int, n_words int"
    listed = items.where("item_id is not null").select("item_id", plain_hashes(F.col("text")).alias("h")).where("size(h) > 0")
    out, block, size = docs.sparkSession.createDataFrame([], schema), [], 0
    src = docs.select("doc_id", plain_hashes(F.col("text")).alias("h"))

    def search(rows: list[tuple[object, np.ndarray]]) -> DataFrame:
        held = Items(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                at = np.asarray(b.column(1).offsets, dtype=np.int64)
                flat = np.asarray(b.column(1).values, dtype=np.int64).view(np.uint64)
                for (i, n), m in held.matches(flat[at[0] : at[-1]], at[1:] - at[0]).items():
                    found.append((b.column(0)[i].as_py(), held.ids[n], *m))
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1]), *[pa.array(c, pa.int32()) for c in cols[2:]]], names=["doc_id", "item_id", "edits", "first_word", "n_words"])

        return src.mapInArrow(run, schema)

    for r in listed.toLocalIterator():  # one partition of the benchmark at a time
        block.append((r["item_id"], np.array(r["h"], np.int64)))
        size += len(r["h"])
        if size >= BLOCK_WORDS:
            out, block, size = out.union(search(block)), [], 0
    return out.union(search(block)) if block else out


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without those that hold an item."""
    found = leaks(docs, items).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
