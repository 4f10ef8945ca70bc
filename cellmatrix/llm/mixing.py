"""Mixing sources to target weights, in native expressions.

Token counts are summed by cell (source, language, topic). Iterative proportional fitting
rakes the cells' weights to the marginal targets of the three dimensions, until no marginal
is further than ``tolerance`` (of all tokens) from its target; each document is then kept
with the probability that gives its cell the fitted weight, drawn by a hash of its id.

Unless a topic column is named, a document's topic is the class of its most over-represented
keyword. Keywords are the words with between RARE and COMMON of the tokens of their language,
counted over all documents; over-represented is a keyword by the standard score of its count
against that share of the document's words, so length has no part in it. Keywords are dealt
into TOPICS classes by hash; a document without keywords has topic -1. A document's words are
looked up in a table of SLOTS places, and those that may be keywords are sorted and counted.

The targets default to each value's token share to the power ``alpha``, so small sources
gain. Where a cell would need a probability above 1 its documents are all kept, and the
rest of the budget goes to the other cells.

Defined results: nulls in source or lang are a value of their own; a document without
words has no tokens, weight 0, and is not drawn; repeated rows share their draw; of
keywords with equal scores the one of the larger hash is taken; a very long text is one
row of words; targets that no weights of the cells can meet (their cells are missing, or
they contradict each other) raise ValueError; an empty table gives an empty result; extra
columns are kept, but columns named topic, n_tokens, weight, prob or selected are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, join_small, word_hashes

TOPICS, ROUNDS, TOLERANCE, ALPHA, FRACTION, SEED, SLOTS = 8, 200, 1e-6, 0.7, 0.5, 17, 4096
RARE, COMMON = 1 / 4000, 1 / 400
DIMS = ("source", "lang", "topic")


def language(lang: Column) -> Column:
    """The language as a key of joins; null is a value of its own."""
    return F.coalesce(lang.cast("string"), F.lit("\x00null"))


def slot(w: Column) -> Column:
    return F.pmod(w, F.lit(SLOTS)).cast("int")


def keywords(hashed: DataFrame, ws: Workspace) -> tuple[DataFrame, int]:
    """(_lang, _words, _shares, _first) and the most keywords of a slot.

    At most 1 / RARE keywords of each language and their shares of its tokens, by slot; ``_first``
    is where each slot's begin.
    """
    counted = ws.keep(hashed.select("_lang", F.explode("_h").alias("w")).groupBy("_lang", "w").count(), "words")
    total = counted.groupBy("_lang").agg(F.sum("count").alias("total"))
    share = counted.join(F.broadcast(total), "_lang").select("_lang", "w", (F.col("count") / F.col("total")).alias("p"))  # a row for each language
    rows = ws.keep(share.where(F.col("p").between(RARE, COMMON)).withColumn("s", slot(F.col("w"))), "rows")
    most = rows.groupBy("_lang", "s").count().agg(F.max("count")).first()[0] or 0
    found = rows.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("s", "w", "p"))).alias("k"))
    found = found.select("_lang", F.col("k.w").alias("_words"), F.col("k.p").alias("_shares"), F.col("k.s").alias("_slots"))
    first = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.nullif(F.array_position("_slots", s), F.lit(0)).cast("int") - 1)
    found = ws.keep(found.select("_lang", "_words", "_shares", first.alias("_first")), "keywords")
    ws.drop("words", "rows")
    return found, most


def with_topic(docs: DataFrame, most: int, n: int = TOPICS) -> DataFrame:
    """``docs`` (d, _h and the columns of ``keywords``) as d, _tokens and _topic.

    The topic is the class of the keyword that the document holds most above its share.
    """
    hits = F.sort_array(F.filter("_h", lambda w: F.get("_first", slot(w)).isNotNull()))
    a = docs.select("d", F.size("_h").cast("long").alias("_tokens"), hits.alias("_hits"), "_words", "_shares", "_first")
    begins = F.transform("_hits", lambda w, i: F.when((i == 0) | (F.get("_hits", i - 1) != w), F.struct(w.alias("w"), i.alias("i"))))
    a = a.select("d", "_tokens", F.size("_hits").alias("_all"), F.filter(begins, lambda x: x.isNotNull()).alias("_runs"), "_words", "_shares", "_first")

    def share(w: Column) -> Column:
        at = F.get("_first", slot(w))
        return F.coalesce(*[F.when(F.get("_words", at + k) == w, F.get("_shares", at + k)) for k in range(max(1, most))])

    a = a.select("d", "_tokens", F.transform("_runs", lambda x, j: F.struct(x["w"].alias("w"), (F.coalesce(F.get("_runs", j + 1)["i"], F.col("_all")) - x["i"]).alias("c"), (share(x["w"]) * F.col("_tokens")).alias("want"))).alias("_known"))
    score = F.transform(F.filter("_known", lambda x: x["want"].isNotNull()), lambda x: F.struct(((x["c"] - x["want"]) / F.sqrt(x["want"])).alias("z"), x["w"].alias("w")))
    return a.select("d", "_tokens", F.coalesce(F.pmod(F.array_max(score)["w"], F.lit(n)), F.lit(-1)).cast("int").alias("_topic"))


def targets(cells: DataFrame, dim: str, alpha: float = ALPHA) -> DataFrame:
    """(dim, target): token shares to the power alpha, which sum to 1."""
    t = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(alpha)).alias("target"))
    total = t.agg(F.sum("target")).first()[0] or 1.0
    return t.select(dim, (F.col("target") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, goals: dict[str, DataFrame], ws: Workspace, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """Cells with weight, whose marginals come to those of ``goals``, and the largest error left; written every few rounds."""
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("weight", F.lit(0.0)), 0.0
    out = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for dim, goal in goals.items():
        goal = goal.select(F.col(dim).alias("_v"), F.col("target").alias(f"_goal_{dim}"))
        missing = goal.where(F.col(f"_goal_{dim}") > tolerance).join(cells.select(F.col(dim).alias("_c")).distinct(), F.col("_v").eqNullSafe(F.col("_c")), "left_anti").first()
        if missing:
            raise ValueError(f"no document has the {dim} {missing[0]!r} of the targets")
        out = out.join(goal, F.col(dim).eqNullSafe(F.col("_v")), "left").drop("_v").fillna(0.0, [f"_goal_{dim}"])
    out, error, at_once = ws.keep(out, "round0"), float("inf"), 3
    for k in range(1, rounds // at_once + 1):
        for _ in range(at_once):
            for dim in goals:
                goal = F.col(f"_goal_{dim}")
                # The cells of a value, which are sums already, so few however many documents it has.
                out = out.withColumn("_have", F.sum("weight").over(Window.partitionBy(dim))).withColumn(f"_e_{dim}", F.abs(F.col("_have") - goal))
                out = out.withColumn("weight", F.when(F.col("_have") > 0, F.col("weight") * goal / F.col("_have")).otherwise(0.0))
        out = ws.keep(out, f"round{k}")
        ws.drop(f"round{k - 1}")
        last, error = error, out.agg(F.greatest(*[F.max(f"_e_{dim}") for dim in goals], F.lit(0.0))).first()[0]
        # Done, or it turns in a circle: the targets contradict each other.
        if error <= tolerance or error > 0.999 * last:
            break
    return out.select(*cells.columns, "weight"), error


def mix(docs: DataFrame, fraction: float = FRACTION, rounds: int = ROUNDS, topic_col: str | None = None, goals: dict[str, DataFrame] | None = None, seed: int = SEED, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with topic, n_tokens, weight (of its cell), prob and selected added."""
    ws = Workspace(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    if topic_col:
        sized = docs.select(row, F.size(word_hashes(F.col("text"))).cast("long").alias("_tokens"), F.col(f"`{topic_col}`").alias("_topic"))
    else:
        # Words are split once, and their hashes kept until the topics are found.
        hashed = ws.keep(docs.select(row, word_hashes(F.col("text")).alias("_h"), language(F.col("lang")).alias("_lang")), "hashed")
        known, most = keywords(hashed, ws)
        sized = with_topic(hashed.join(F.broadcast(known), "_lang", "left"), most)  # a row for each language, of 1 / RARE keywords at most
    dims = {"source": F.col("d.source").cast("string"), "lang": F.col("d.lang").cast("string"), "topic": F.col("_topic")}
    # Null dimensions are a value of their own, in the key and in the targets.
    key = F.xxhash64(*[F.coalesce(v.cast("string"), F.lit("\x00null")) for v in dims.values()])
    sized = ws.keep(sized.withColumn("_cell", key), "sized")
    ws.drop("hashed", "keywords")
    cells = sized.where("_tokens > 0").groupBy("_cell", dims["source"].alias("source"), dims["lang"].alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens"))
    cells = ws.keep(cells, "cells")
    fitted, error = rake(cells, goals or {d: ws.keep(targets(cells, d), f"goal_{d}") for d in DIMS}, ws, rounds, tolerance)
    if error > 1000 * tolerance:
        raise ValueError(f"the targets cannot be met: a marginal is off by {error:.2g} of all tokens")
    fitted = ws.keep(fitted, "fitted")
    # Scale so that the expected tokens are ``fraction`` of all; cells that reach probability 1 stay there.
    ratio = fitted.withColumn("_r", F.col("weight") / F.col("tokens"))
    budget = (cells.agg(F.sum("tokens")).first()[0] or 0) * fraction
    scale = None
    while True:  # the cells of probability 1 only grow in number
        hit = F.lit(False) if scale is None else F.col("_r") * scale >= 1
        s = ratio.agg(F.sum(F.when(hit, F.col("tokens"))).alias("full"), F.sum(F.when(~hit, F.col("weight"))).alias("rest")).first()
        new = (budget - (s["full"] or 0)) / s["rest"] if s["rest"] else scale or 0.0
        if scale is not None and new <= scale * (1 + 1e-12):
            break
        scale = new
    probs = ratio.select("_cell", "weight", F.least(F.lit(1.0), F.col("_r") * scale).alias("prob"))
    out = join_small(sized.select("d", "_tokens", "_topic", "_cell"), probs, "_cell", cells.count())
    draw = (F.pmod(F.xxhash64("d.doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40))
    own = [F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in ("topic", "n_tokens", "weight", "prob", "selected")]
    prob, weight = (F.coalesce(c, F.lit(0.0)).alias(c) for c in ("prob", "weight"))
    return out.select(*own, F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), weight, prob, (draw < F.coalesce("prob", F.lit(0.0))).alias("selected"))
