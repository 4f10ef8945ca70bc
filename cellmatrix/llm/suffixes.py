"""Suffix-array dedup: bytes of 50-byte strings that a document with a smaller doc_id also holds.

A window is a 50-byte string inside one document. Sorting every suffix of the corpus would
move each byte many times over, so windows that cannot repeat are set aside first, without
loss. A text that equals one of a smaller doc_id goes whole. The least of a window's 24-byte
hashes depends on the window alone, so equal windows have equal anchors, and a window whose anchor no other document has repeats nowhere. The
others are cut into snippets (neighbouring windows with one anchor, at most RUN of them);
equal snippets become one with its smallest doc_id. Snippets are dealt by anchor, and each
group is sorted by the difference-cover algorithm: triples at two of three places are
sorted and named, the names are sorted by recursion, the remaining suffixes are merged in,
and neighbours that agree in 50 bytes form a class with its smallest doc_id. Which windows
go is joined back to every occurrence of a snippet.

Defined results: null and empty texts have no bytes; texts under 50 bytes lose nothing;
repeats inside one document, or between rows with one doc_id, remove nothing; a null
doc_id counts as larger than any other; repeated rows each get a row; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_small, making, ship

ship(__name__)

WINDOW, GRAM, RUN, BLOCK, DEALT, LAST = 50, 24, 27, 1 << 21, 64, (1 << 63) - 1
_M = [pow(0x5851F42D4C957F2D, 1 << i, 1 << 64) for i in range(5)]


def anchors(b: np.ndarray) -> np.ndarray:
    """The least hash of the GRAM-byte strings of each window of b."""
    if len(b) < WINDOW:
        return np.zeros(0, np.uint64)
    h = b.astype(np.uint64) + np.uint64(1)
    for i in range(4):  # of 2, 4, 8 and 16 bytes
        eight = h
        h = h[: -(1 << i)] * np.uint64(_M[i]) + h[1 << i :]
    h = h[:-8] * np.uint64(_M[3]) + eight[16:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    for i in range(4):
        h = np.minimum(h[: -(1 << i)], h[1 << i :])
    return np.minimum(h[: -(RUN - 16)], h[RUN - 16 :])


def blocks(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, their bytes, where each begins and the last ends) of about BLOCK bytes; column 1 is binary."""
    off = np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset :][: len(b) + 1].astype(np.int64)
    data = b.column(1).buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(b):
        j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
        yield i, j, flat[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def owned(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the text it begins in, and whether it ends there too."""
    n = np.diff(begin)
    doc = np.repeat(np.arange(len(n)), n)[: max(0, len(x) - WINDOW + 1)]
    return doc, np.arange(len(doc)) + WINDOW <= begin[1:][doc]


def dc3(s: np.ndarray) -> np.ndarray:
    """The suffix array of s (values of 0 to 2**20, or to len(s))."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64) + 1, np.zeros(4, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    at = np.concatenate([one, two])
    # Ranks of the pairs keep the key of a triple within 63 bits.
    high = int(t.max()) + 1
    key = t[at] * high + t[at + 1]
    if high < 1 << 20:
        key = key * high + t[at + 2]
        order = np.argsort(key, kind="stable")
        k = key[order]
        step = k[1:] != k[:-1]
    else:
        order = np.lexsort((t[at + 2], key))
        k, last = key[order], t[at + 2][order]
        step = (k[1:] != k[:-1]) | (last[1:] != last[:-1])
    name = np.empty(len(at), np.int64)
    name[order] = np.concatenate([[0], np.cumsum(step)])
    sample = at[dc3(name)] if not step.all() else at[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    sample = sample[sample < n]
    zero = np.arange(0, n, 3)
    base = n + 4
    zero = zero[np.argsort(t[zero] * base + rank[zero + 1], kind="stable")]
    of1, of2 = sample[sample % 3 == 1], sample[sample % 3 == 2]
    before = np.searchsorted(t[of1] * base + rank[of1 + 1], t[zero] * base + rank[zero + 1])
    # Two values and a rank: the pairs are ranked first.
    pair = np.unique(np.concatenate([t[of2] * high + t[of2 + 1], t[zero] * high + t[zero + 1]]), return_inverse=True)[1]
    before = before + np.searchsorted(pair[: len(of2)] * base + rank[of2 + 2], pair[len(of2) :] * base + rank[zero + 2])
    out = np.empty(n, np.int64)
    spot = before + np.arange(len(zero))
    out[spot] = zero
    free = np.ones(n, bool)
    free[spot] = False
    out[free] = sample
    return out


def classes(snips: list[bytes], doc: np.ndarray) -> list[np.ndarray]:
    """For each window of each snippet the smallest doc of any window equal to it."""
    size = np.array([len(x) for x in snips], np.int64)
    begin = np.r_[0, np.cumsum(size + 1)[:-1]]
    s = np.zeros(int((size + 1).sum()), np.uint16)
    raw = np.frombuffer(b"\0".join(snips) + b"\0", np.uint8)
    s[:] = raw
    s += 1
    s[begin + size] = 0
    count = size - WINDOW + 1
    owner = np.repeat(np.arange(len(size)), count)
    start = np.repeat(begin - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
    which = np.full(len(s), -1, np.int64)
    which[start] = np.arange(len(start))
    sa = dc3(s)
    order = which[sa]
    order = order[order >= 0]
    at = start[order]
    view = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)
    new = np.ones(len(at), bool)
    for i in range(1, len(at), 1 << 16):
        j = min(len(at), i + (1 << 16))
        new[i:j] = (view[at[i:j]] != view[at[i - 1 : j - 1]]).any(1)
    least = np.minimum.reduceat(doc[owner[order]], np.flatnonzero(new))
    out = np.empty(len(at), np.int64)
    out[order] = least[np.cumsum(new) - 1]
    return np.split(out, np.cumsum(count)[:-1])


def shared_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """(d, h): the anchors of each document that another document has too."""
    bits = np.uint64(64 - (buckets - 1).bit_length())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            hs, ds = [], []
            for i, _, x, begin in blocks(b):
                doc, whole = owned(x, begin)
                a = anchors(x)
                new = whole & np.r_[True, (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])] if len(a) else whole
                hs.append(a[new])
                ds.append(ids[i + doc[new]])
            h, d = np.concatenate(hs or [np.zeros(0, np.uint64)]), np.concatenate(ds or [np.zeros(0, np.int64)])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            if not len(h):
                continue
            once = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
            h, d = h[once], d[once]
            k = h >> bits
            cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            end = np.r_[cut[1:], len(k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[cut].astype(np.int64)), *[pa.array([v[p:q].tobytes() for p, q in zip(cut, end, strict=True)], pa.binary()) for v in (h, d)]],
                names=["k", "h", "d"],
            )

    def meet(table: pa.Table) -> pa.Table:
        h, d = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("h", np.uint64), ("d", np.int64)))
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.diff(np.r_[cut, len(h)])
        several = np.repeat(d[cut] != d[cut + n - 1], n)
        return pa.table({"d": d[several], "h": h[several].view(np.int64)})

    return texts.mapInArrow(emit, "k long, h binary, d binary").groupBy("k").applyInArrow(meet, "d long, h long")


def snippets(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(d, at, h, s): every snippet of windows with a shared anchor, and where it begins."""
    known = shared.groupBy("d").agg(F.collect_set("h").alias("hs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = np.asarray(b.column(2).offsets, np.int64)
            flat = np.asarray(b.column(2).values, np.int64).view(np.uint64)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j, x, begin in blocks(b):
                doc, whole = owned(x, begin)
                a = anchors(x)
                # Anchors shared by some text of the block; a text's own are found by the pair with its row.
                names, code = np.unique(np.concatenate([flat[off[i] : off[j]], a]), return_inverse=True)
                mine, code = code[: off[j] - off[i]], code[off[j] - off[i] :]
                pairs = np.unique(np.repeat(np.arange(j - i), np.diff(off[i : j + 1])) * len(names) + mine)
                want = doc * len(names) + code
                spot = np.minimum(np.searchsorted(pairs, want), max(0, len(pairs) - 1))
                on = whole & (pairs[spot] == want) if len(pairs) and len(a) else np.zeros(len(a), bool)
                p = np.flatnonzero(on)
                if not len(p):
                    continue
                fresh = np.r_[True, (p[1:] != p[:-1] + 1) | (a[p[1:]] != a[p[:-1]]) | (doc[p[1:]] != doc[p[:-1]])]
                head = np.flatnonzero(fresh)
                into = np.arange(len(p)) - np.repeat(head, np.diff(np.r_[head, len(p)]))
                first = np.flatnonzero(into % RUN == 0)
                size = np.diff(np.r_[first, len(p)])
                start, raw = p[first], x.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i + doc[start]]),
                        pa.array((start - begin[doc[start]]).astype(np.int32)),
                        pa.array(a[start].view(np.int64)),
                        pa.array([raw[u : u + v + WINDOW - 1] for u, v in zip(start.tolist(), size.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["d", "at", "h", "s"],
                )

    return texts.join(known, "d").select("d", "b", "hs").mapInArrow(cut, "d long, at int, h long, s binary")


def named() -> list[Column]:
    """Two hashes that stand for the snippet s; made where needed, as they don't compress."""
    return [F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(7), "s").alias("k2")]


def repeated_windows(found: DataFrame, groups: int) -> DataFrame:
    """(k1, k2, least): for each snippet with a window that may go, the smallest document of each window."""

    def sort(table: pa.Table) -> pa.Table:
        got = classes(table.column("s").to_pylist(), table.column("d").to_numpy())
        return pa.table({"k1": table.column("k1"), "k2": table.column("k2"), "least": pa.array([x.tolist() for x in got], pa.list_(pa.int64()))})

    one = found.groupBy("h", "s").agg(F.min("d").alias("d")).withColumn("g", F.pmod(F.xxhash64("h"), F.lit(groups)))
    return one.select("g", *named(), "d", "s").groupBy("g").applyInArrow(sort, "k1 long, k2 long, least array<long>")


def cover(at: np.ndarray, n: int) -> np.ndarray:
    """Which of n bytes the windows that begin at ``at`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def as_bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def dedup(docs: DataFrame, text: str = "text", per_partition: int = DEALT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (binary, what is left), kept_sha256."""
    spark = docs.sparkSession
    ws = Workspace(spark)
    groups = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)["doc_id"]
    same = F.struct(F.xxhash64("b").alias("x"), F.xxhash64(F.lit(7), "b").alias("y"), F.length("b").alias("n"))
    texts = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), as_bytes(text).alias("b"))
    # A text that a smaller document equals goes whole, and need not be searched.
    copies = texts.where(F.length("b") >= WINDOW).select("d", same.alias("same")).groupBy("same").agg(F.min("d").alias("least"), F.max("d").alias("most"))
    copies = ws.keep(copies.where("least < most").select("same", "least"), "copies")
    n = copies.count()
    texts = join_small(texts.withColumn("same", same), copies, "same", n).select("doc_id", "d", "b", F.coalesce(F.col("d") > F.col("least"), F.lit(False)).alias("whole"))
    with making(spark):
        long = texts.where((F.length("b") >= WINDOW) & ~F.col("whole")).select("d", "b")
        shared = ws.keep(shared_anchors(long, groups), "shared")
        found = ws.keep(snippets(long, shared), "snippets")
        ws.drop("shared")
        least = ws.keep(repeated_windows(found, groups), "least")
        hits = found.select("d", "at", *named()).join(least, ["k1", "k2"])
        gone = F.filter(F.transform("least", lambda m, i: F.when(m < F.col("d"), F.col("at") + i)), lambda p: p.isNotNull())
        gone = ws.keep(hits.select("d", gone.alias("p")).where("size(p) > 0").groupBy("d").agg(F.flatten(F.collect_set("p")).alias("p")), "gone")
        ws.drop("snippets", "least")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, p, whole in zip(b.column(1), b.column(2), b.column(3).to_pylist(), strict=True):
                raw = x.as_py()
                if whole:
                    rows.append((len(raw), 1, b"", hashlib.sha256().hexdigest(), len(raw)))
                    continue
                if not p.is_valid:
                    rows.append((0, 0, raw, hashlib.sha256(raw).hexdigest(), len(raw)))
                    continue
                out = cover(np.asarray(p.values, np.int64), len(raw))
                kept = np.frombuffer(raw, np.uint8)[~out].tobytes()
                rows.append((int(out.sum()), int(out[0]) + int((out[1:] & ~out[:-1]).sum()), kept, hashlib.sha256(kept).hexdigest(), len(raw)))
            n, spans, kept, sha, size = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(sha, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    both = texts.join(gone, "d", "left").select("doc_id", "b", "p", "whole")
    return both.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
