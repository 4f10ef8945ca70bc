"""MinHash near-dedup by tensored banding.

Two small collections of ``bands`` minhash bands are computed; table (i, j) is keyed by
band i of the first and band j of the second, so bands * bands tables cost 2 * bands band
hashes (bands of WIDTH minhashes). At similarity s a pair misses every table with chance
about 2 * (1 - s^WIDTH)^bands (3e-6 at 0.85, 9e-5 at 0.8). A band value that no other
component has is dropped before the combinations are made.

Texts with equal sets are one class. Candidates come in rounds. In the first two each member
of a bucket of the diagonal tables (i, i) is held against one leader of it, as long as the
bucket has several components: in a few tables the same leader wherever it stands, then in
all of them another in each bucket. These rounds only join what is easily joined. The last
takes the classes whose bands meet another component in both collections and holds every
pair across components that can reach the similarity by its shingles. Sets are ordered by
what no other component has, then by rarity, and a pair whose first common shingle stands
too late in both to leave enough in common is proven unlike (prefix filter with positions).
So is one whose sets differ too much: what only one component has differs, and of the rest
at least as many shingles as there are odd bins in one set and not in the other. Neither
loses a similar pair, and members of a group that are far from each other make no rows.
Candidates whose sizes cannot reach the
similarity, or whose sketches (BITS bits of each minhash) differ in more bits than a similar
pair does with chance LOST, are dropped; the others are confirmed on full shingle sets.

Defined results: null, empty or wordless texts have empty sets and are linked with
nothing; repeated rows each get a row, and the texts of one doc_id are linked with each
other; rows with a null doc_id are components of their own and kept; a very long text is
one row of shingles; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, lower_ascii, maybe, ship, words

ship(__name__)

SHINGLE, PCT, BANDS, WIDTH, SEED, LOST, BITS = 3, 85, 14, 3, 23, 1e-6, 4
#: Tables of the first round (of the diagonal).
QUICK = 3
#: Bins of the shingles that several components have, a multiple of 64 by a power of two.
BINS = 256


def shingle_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and s, the sorted distinct 64-bit hashes of word shingles; a shorter text is one shingle.

    Words and hashes are columns of their own, so neither is made again for each element.
    """
    w = docs.select("doc_id", F.transform(words(lower_ascii(F.col("text"))), lambda x: F.xxhash64(x)).alias("_w"))
    at = lambda x, i: F.xxhash64(x, *[F.get("_w", i + k) for k in range(1, size)])
    every = w.select("doc_id", F.size("_w").alias("_n"), F.transform("_w", at).alias("_g"))
    return every.select("doc_id", F.array_sort(F.array_distinct(F.slice("_g", 1, F.greatest(F.lit(1), F.col("_n") - (size - 1))))).alias("s"))


def sign(docs: DataFrame, bands: int, size: int = SHINGLE) -> DataFrame:
    """doc_id, n, h1, h2 (two hashes of the set), the band values of both collections and the sketch (longs of BITS bits a minhash)."""
    kind = dict(docs.dtypes)["doc_id"]
    rng = np.random.default_rng(SEED)
    mul = rng.integers(1, 1 << 63, 2 * bands * WIDTH, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, 2 * bands * WIDTH, dtype=np.uint64)
    each = 60 // BITS  # minhashes of a long

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.asarray(b.column(1).value_lengths().fill_null(0), dtype=np.int64)
            x = np.asarray(b.column(1).flatten(), dtype=np.int64).view(np.uint64)
            full = np.flatnonzero(n)
            begin = (np.cumsum(n) - n)[full]
            out, bits = np.zeros((len(n), 2 * bands), np.uint64), np.zeros((len(n), longs(bands)), np.uint64)
            # As many texts at a time as have some 200,000 shingles.
            for at in np.split(np.arange(len(full)), np.flatnonzero(np.diff((np.cumsum(n[full]) - n[full]) // 200_000)) + 1) if len(full) else []:
                rows, first = full[at], begin[at]
                y = x[first[0] : first[-1] + n[rows[-1]]]
                y, first = y ^ (y >> np.uint64(31)), first - first[0]
                for k in range(2 * bands * WIDTH):
                    z = y * mul[k] + add[k]
                    z ^= z >> np.uint64(32)
                    z *= np.uint64(0x9E3779B97F4A7C15)
                    least = np.minimum.reduceat(z, first)
                    out[rows, k // WIDTH] = out[rows, k // WIDTH] * np.uint64(0x100000001B3) + least
                    bits[rows, k // each] |= (least >> np.uint64(7) & np.uint64((1 << BITS) - 1)) << np.uint64(k % each * BITS)
            flat = pa.array(out.view(np.int64).ravel())
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (2 * bands)), flat)
            sketch = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in bits.T]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), b.column(2), b.column(3), keys, *sketch], names=["doc_id", "n", "h1", "h2", "keys", *names])

    names = [f"s{i}" for i in range(longs(bands))]
    sets = shingle_sets(docs, size)
    return sets.select("doc_id", "s", F.xxhash64("s", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "s").alias("h2")).mapInArrow(
        run, f"doc_id {kind}, n long, h1 long, h2 long, keys array<long>, " + ", ".join(f"{x} long" for x in names)
    )


def longs(bands: int) -> int:
    """How many longs a sketch has."""
    return -(-2 * bands * WIDTH // (60 // BITS))


def sketch_limit(hashes: int, pct: int) -> int:
    """In how many bits the sketches of a pair of ``pct`` percent differ at most, but with chance LOST.

    A minhash differs with one less the similarity, and then each of its BITS bits by chance.
    """
    p = 1 - pct / 100
    odds = [math.comb(hashes, j) * p**j * (1 - p) ** (hashes - j) for j in range(hashes + 1)]
    tail, t = 1.0, -1
    while tail > LOST:
        t += 1
        tail -= sum(o * math.comb(BITS * j, t) / 2 ** (BITS * j) for j, o in enumerate(odds) if t <= BITS * j)
    return t


def alike(a: str, b: str, bands: int, pct: int) -> Column:
    """Whether the sizes and sketches of a pair (columns n, s0, s1 and so on with the two endings) allow the similarity."""
    n, m = F.col(f"n{a}"), F.col(f"n{b}")
    far = sum(F.bit_count(F.col(f"s{i}{a}").bitwiseXOR(F.col(f"s{i}{b}"))) for i in range(longs(bands)))
    return (100 * F.least(n, m) >= pct * F.greatest(n, m)) & (far <= sketch_limit(2 * bands * WIDTH, pct))


def components(edges: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(node, comp) of the nodes of ``edges`` (a, b); comp is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers to their
    roots and contracts the edges to the roots, which at least halves the nodes.
    """
    known, left, k = None, ws.keep(edges.select("a", "b").where("a <> b"), f"{name}_e"), 0
    while (n := left.count()) > 0:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ws.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), f"{name}_p{k}_0")
        for j in range(1, 64):
            to = maybe(up.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), 2 * n)
            nxt = ws.keep(up.join(to, "comp").select("node", F.col("_to").alias("comp"), (F.col("_to") != F.col("comp")).alias("moved")), f"{name}_p{k}_{j}")
            ws.drop(f"{name}_p{k}_{j - 1}")
            up = nxt.select("node", "comp")
            if nxt.where("moved").isEmpty():
                break
        if known is None:
            known = up
        else:
            to = maybe(up.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), 2 * n)
            known = ws.keep(known.join(to, "comp", "left").select("node", F.coalesce("_to", "comp").alias("comp")), f"{name}_k{k}")
        pa_, pb = (maybe(up.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}")), 2 * n) for c in "ab")
        left = ws.keep(left.join(pa_, "a").join(pb, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct(), f"{name}_l{k}")
        k += 1
    return known if known is not None else edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).limit(0)


def full_sets(classes: DataFrame, docs: DataFrame, reps: DataFrame, ws: Workspace, name: str, size: int) -> DataFrame:
    """(c, s) of the distinct ``classes`` (c): their full sets."""
    need = ws.keep(classes, f"{name}_w")
    n = need.count()
    need = ws.keep(reps.join(maybe(need, n), "c").select("c", F.col("rep").alias("doc_id"), "h1"), f"{name}_n")
    # Texts are looked up by id, and by the hash of their set where an id has several.
    text = docs.join(maybe(need.select("doc_id"), n), "doc_id", "left_semi")
    made = shingle_sets(text, size).withColumn("h1", F.xxhash64("s", F.lit(1)))
    sets = ws.keep(made.dropDuplicates(["doc_id", "h1"]).join(maybe(need, n), ["doc_id", "h1"]).select("c", "s"), f"{name}_s")
    ws.drop(f"{name}_w", f"{name}_n")
    return sets


def crossing(sets: DataFrame, marks: DataFrame, ws: Workspace, bands: int, pct: int) -> DataFrame:
    """The distinct pairs (a, b) of classes of different components that their shingles and ``marks`` (c and sketches) allow to be similar.

    ``sets`` has c, comp and s. Of a shingle's classes, those of its most frequent component are not held against each other.
    """
    n = F.size("s").cast("long")
    token = sets.select("c", "comp", F.explode("s").alias("g"))
    met = token.groupBy("g").agg(F.count("*").alias("f"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    met = ws.keep(met.select("g", "f"), "met")
    odd = [F.expr(f"bit_xor(if(((g >> 6) & {BINS // 64 - 1}) = {k}, shiftleft(1L, cast(g & 63 as int)), 0L))").alias(f"o{k}") for k in range(BINS // 64)]
    order = token.select("c", "g").join(met, "g").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("f", "g"))).alias("m"), *odd)
    bins = [f"o{k}" for k in range(BINS // 64)]
    order = sets.select("c", "comp", n.alias("n")).join(order, "c").withColumn("own", F.col("n") - F.size("m"))
    # A first common shingle beyond this many leaves less in common than any partner needs.
    most = (F.floor((100 - pct) * F.col("n") / 100) + 1 - F.col("own")).cast("int")
    key = order.where(most > 0).select("c", "comp", "n", "own", *bins, F.posexplode(F.slice("m", 1, most)).alias("i", "x"))
    key = ws.keep(key.select("c", "comp", "n", "own", *bins, (F.col("n") - F.col("own") - F.col("i")).alias("left"), F.col("x.g").alias("g")), "key")
    big = key.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.mode("comp").alias("big")).where("lo < hi")
    row = ws.keep(key.join(big.select("g", "big"), "g").join(marks, "c"), "row")
    a, b = (row.select("g", *[F.col(x).alias(f"{x}_{k}") for x in row.columns if x != "g"]) for k in "ab")
    once = (F.col("comp_b") == F.col("big_b")) | (F.col("c_a") < F.col("c_b"))
    # What both have from this shingle on bounds what is common, where it is the first.
    total = F.col("n_a") + F.col("n_b")
    enough = F.least("left_a", "left_b") * (100 + pct) >= pct * total
    differ = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in bins), F.col("own_a") + F.col("own_b"))
    close = differ * (100 + pct) <= (100 - pct) * total
    on = (a["g"] == b["g"]) & (F.col("comp_a") != F.col("comp_b")) & once & enough & close & alike("_a", "_b", bands, pct)
    pairs = a.where("comp_a <> big_a").join(b, on).select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b"))
    return pairs.distinct()


def verified(pairs: DataFrame, sets: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """The distinct pairs (a, b) of classes with both, na, nb: the shingles of their full ``sets`` (c, s) that are common, a's and b's."""
    sa, sb = sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), sets.select(F.col("c").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    good = pairs.join(sb, "b").join(sa, "a").select("a", "b", both.alias("both"), F.size("sa").alias("na"), F.size("sb").alias("nb"))
    return ws.keep(good, f"{name}_v")


def near_duplicates(docs: DataFrame, pct: int = PCT, size: int = SHINGLE, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    ws = Workspace(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    marks = ["n", *[f"s{i}" for i in range(longs(bands))]]
    signed = ws.keep(sign(docs, bands, size), "signed")
    own = signed.where("n > 0 and doc_id is not null")
    first = own.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), *[F.first(x).alias(x) for x in marks[1:]], F.first("keys").alias("keys"))
    reps = ws.keep(first.withColumn("c", F.monotonically_increasing_id()), "reps")
    # Ids that stand for several texts link their classes.
    several = own.groupBy("doc_id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("doc_id")
    same = own.join(several, "doc_id").join(reps.select("h1", "h2", "n", "c"), ["h1", "h2", "n"]).select("doc_id", "c")
    links = same.join(same.groupBy("doc_id").agg(F.min("c").alias("a")), "doc_id").select("a", F.col("c").alias("b"))
    links = ws.keep(links.where("a <> b"), "links")
    n_reps = reps.count()
    side = lambda k: maybe(reps.select(F.col("c").alias(k), *[F.col(x).alias(f"{x}{k}") for x in marks]), n_reps)
    live = reps.select("c", F.posexplode("keys").alias("i", "v"))
    for r in range(3):
        comp = components(links, ws, f"comp{r}")
        n_comp = comp.count()
        at = live.select("c", "i", "v").join(maybe(comp.withColumnRenamed("node", "c"), n_comp), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
        at = ws.keep(at, f"at{r}")
        # Band values of several components; the two ends of a value's range tell without counting.
        shared = ws.keep(at.groupBy("i", "v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("i", "v"), f"shared{r}")
        live = ws.keep(at.join(shared, ["i", "v"]).select("c", "comp", "i", "v"), f"live{r}")
        ws.drop(f"at{r}", f"shared{r}", f"live{r - 1}")
        band = F.xxhash64("i", "v")
        half = live.groupBy("c", "comp").agg(F.collect_list(F.when(F.col("i") < bands, F.struct("i", band.alias("v")))).alias("x"), F.collect_list(F.when(F.col("i") >= bands, F.struct("i", band.alias("v")))).alias("y"))
        half = ws.keep(half.where("size(x) > 0 and size(y) > 0"), f"half{r}")
        if r < 2:
            table = half.select("c", "comp", F.explode("x").alias("x"), "y").where(F.col("x.i") < (QUICK if r == 0 else bands))
            table = table.select("c", "comp", "x", F.explode(F.filter("y", lambda y: y["i"] == F.col("x.i") + bands)).alias("y"))
            table = table.select("c", "comp", F.xxhash64("x.v", "y.v").alias("key"))
            # The order of the classes that makes the first the leader is one for all buckets, then each bucket's own.
            turn = F.lit(0).cast("long") if r == 0 else F.col("key")
            open_ = table.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.col("c").bitwiseXOR(turn)).alias("lead"))
            open_ = ws.keep(open_.where("lo < hi").select("key", F.col("lead").bitwiseXOR(turn).alias("b")), f"open{r}")
            pairs = table.join(open_, "key").where("c <> b").select(F.col("c").alias("a"), "b").distinct()
            to = [maybe(comp.select(F.col("node").alias(k), F.col("comp").alias(f"_{k}")), n_comp) for k in "ab"]
            pairs = ws.keep(pairs, f"pairs{r}").join(to[0], "a", "left").join(to[1], "b", "left").where(F.coalesce("_a", "a") != F.coalesce("_b", "b"))
            pairs = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(alike("a", "b", bands, pct)).select("a", "b")
            pairs = ws.keep(pairs, f"cand{r}")
            sets = full_sets(pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct(), docs, reps, ws, f"round{r}", size)
        else:
            sets = full_sets(half.select("c"), docs, reps, ws, "last", size)
            sets = ws.keep(sets.join(maybe(half.select("c", "comp"), half.count()), "c"), "sets")
            ws.drop("last_s")
            pairs = ws.keep(crossing(sets, reps.select("c", *marks[1:]), ws, bands, pct), f"cand{r}")
        found = verified(pairs, sets.select("c", "s"), ws, f"round{r}")
        both, either = F.col("both"), F.col("na") + F.col("nb") - F.col("both")
        links = ws.keep(links.union(found.where(100 * both >= pct * either).select("a", "b")), f"links{r}")
        ws.drop(f"half{r}", f"open{r}", f"pairs{r}", f"cand{r}", f"round{r}_s", "sets", "met", "key", "row")
    comp = components(links, ws, "comp_last")
    classes = reps.join(comp.withColumnRenamed("node", "c"), "c", "left").select("h1", "h2", "n", "rep", F.coalesce("comp", "c").alias("comp"))
    classes = ws.keep(classes, "classes")
    least = ws.keep(classes.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
    named = ws.keep(classes.join(least, "comp").select("h1", "h2", "n", "component_id"), "named")
    lone = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = own.select("doc_id", "h1", "h2", "n").join(named.hint("merge"), ["h1", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
