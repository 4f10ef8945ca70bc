"""Line dedup by log templates, in native expressions.

A fixed-depth tree parses lines: first by token count, then by the leading tokens, in
which tokens with digits count as variable. Leaves seen in fewer than ``min_docs``
distinct texts are done. In the others each token position is compared across the leaf's
lines: a token that ``min_docs`` texts share is constant, any other is a variable field,
and the line's template is what stays constant. A template of mostly constant tokens that
``min_docs`` distinct texts hold is dropped from all documents but the first (smallest
doc_id), which keeps it.

A passage needs no such support: the shortest run of whole lines from each line on that
has ``long`` words is a key, and the lines of a run that two distinct texts hold are
dropped from all but the first text and its exact copies, which are for exact or near
dedup to take out. At the end of a passage lines of under ``long`` words may stay.

Defined results: a null or empty text has no lines; blank lines are never dropped; lines
under ``min_tokens`` tokens are left alone; exact copies of a text support a template
once; repeated rows of the first document all keep the line; a null doc_id sorts after
all others; of texts with equal smallest doc_ids (repeated ids) any may keep a passage; a
very long text is one row of lines, so it is bounded by its own size; an empty table gives
an empty result; extra columns are kept, but columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Workspace, join_small, words

DEPTH, MIN_DOCS, MIN_TOKENS, MIN_CONST, LONG = 4, 10, 4, 0.7, 50


def masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit("<*>")).otherwise(token)


def line_rows(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: doc_id, text_hash, pos, tokens, leaf (0-based position)."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(F.col("line").rlike(WORD)).withColumn("tokens", words(F.col("line"))).select(
        "doc_id", "text_hash", "pos", "tokens",
        F.xxhash64(F.size("tokens"), F.concat_ws(" ", F.transform(F.slice("tokens", 1, DEPTH), masked))).alias("leaf"),
    )


def support(rows: DataFrame, *key: str) -> DataFrame:
    """Distinct texts of each key, in two steps so that a frequent key is summed before it is dealt."""
    return rows.groupBy(*key, "text_hash").agg(F.min("doc_id").alias("doc_id")).groupBy(*key).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def recurring(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, min_const: float = MIN_CONST) -> tuple[DataFrame, DataFrame]:
    """(text_hash, pos, template) of lines in recurring templates, and (template, n_docs, first_doc)."""
    ws = Workspace(docs.sparkSession)
    rows = line_rows(docs.select("doc_id", "text")).where(F.size("tokens") >= min_tokens)
    leaves = ws.keep(support(rows, "leaf").where(F.col("n_docs") >= min_docs).select("leaf"), "leaves")
    own = ws.keep(join_small(rows, leaves, "leaf", leaves.count(), "inner").groupBy("text_hash", "pos", "leaf", "tokens").agg(F.min("doc_id").alias("doc_id")), "lines")
    tokens = own.select("leaf", "text_hash", "pos", F.posexplode("tokens").alias("at", "token"))
    const = tokens.groupBy("leaf", "at", "token", "text_hash").count().groupBy("leaf", "at", "token").count().where(F.col("count") >= min_docs)
    # The constant tokens of each line, found by token, so that no row grows with a leaf's tokens.
    const = ws.keep(const.select("leaf", "at", "token", F.xxhash64("leaf", "at", "token").alias("key")), "const")
    each = tokens.select(F.xxhash64("leaf", "at", "token").alias("key"), "text_hash", "pos", "at")
    fixed = join_small(each, const.select("key"), "key", const.count(), "inner").groupBy("text_hash", "pos").agg(F.collect_list("at").alias("const"))
    shown = F.transform("tokens", lambda t, i: F.when(F.array_contains(F.coalesce("const", F.array().cast("array<int>")), i), t))
    known = own.join(fixed, ["text_hash", "pos"], "left").withColumn("shown", shown).where(F.size(F.filter("shown", lambda t: t.isNotNull())) >= min_const * F.size("tokens"))
    # Unshown places are written <*>; the leaf stands for the token count.
    line = F.concat_ws(" ", F.transform("shown", lambda t: F.coalesce(t, F.lit("<*>"))))
    known = ws.keep(known.select("text_hash", "pos", "doc_id", line.alias("line"), F.xxhash64("leaf", line).alias("template")), "known")
    templates = ws.keep(support(known, "template").where(F.col("n_docs") >= min_docs), "templates")
    hits = join_small(known.select("text_hash", "pos", "template"), templates.select("template"), "template", templates.count(), "inner")
    hits = ws.keep(hits, "hits")
    ws.drop("leaves", "lines", "const", "known")
    return hits, templates


def passages(docs: DataFrame, long: int = LONG, ws: Workspace | None = None) -> DataFrame:
    """(text_hash, begin, end, first_doc, first_text) of the runs of lines that two distinct texts hold; begin and end are positions."""
    ws = ws or Workspace(docs.sparkSession)
    split = F.transform(F.split("text", "\n", -1), words)
    lines = F.filter(F.transform(split, lambda w, i: F.struct(i.alias("pos"), F.size(w).alias("n"), F.xxhash64(w).alias("h"))), lambda x: x["n"] > 0)
    d = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("_l"))
    # Each line has a word, so a run is ``long`` lines at most.
    none = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"), F.lit(0).cast("long").alias("key"))
    longer = lambda a, x: F.when(a["n"] < long, F.struct((a["n"] + x["n"]).alias("n"), x["pos"].alias("end"), F.xxhash64(a["key"], x["h"]).alias("key"))).otherwise(a)
    runs = F.transform("_l", lambda x, i: F.struct(x["pos"].alias("begin"), F.aggregate(F.slice("_l", i + 1, F.lit(long)), none, longer).alias("run")))
    rows = d.select("doc_id", "text_hash", F.explode(runs).alias("r")).where(F.col("r.run.n") >= long)
    rows = ws.keep(rows.select("doc_id", "text_hash", "r.begin", "r.run.end", "r.run.key"), "runs")
    # The two ends of a run's range of texts tell whether it has two, without counting.
    shared = rows.groupBy("key").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"), F.min("doc_id").alias("first_doc"), F.min_by("text_hash", "doc_id").alias("first_text"))
    shared = ws.keep(shared.where("lo < hi").select("key", "first_doc", F.coalesce("first_text", "lo").alias("first_text")), "shared")
    hits = join_small(rows.select("text_hash", "begin", "end", "key"), shared, "key", shared.count(), "inner")
    return hits.select("text_hash", "begin", "end", "first_doc", "first_text")


def clean_lines(docs: DataFrame, min_docs: int = MIN_DOCS, long: int = LONG, **how: float) -> DataFrame:
    """``docs`` with text without dropped lines, and n_lines and n_dropped added; every row stays."""
    ws = Workspace(docs.sparkSession)
    src = docs.select("doc_id", "text")
    hits, templates = recurring(src, min_docs, **how)
    named = join_small(hits, templates.select("template", "first_doc"), "template", templates.count(), "inner")
    # A text is one row here however many lines of it recur; its size is bounded by the text's own.
    one = named.select("text_hash", F.col("pos").alias("begin"), F.col("pos").alias("end"), "first_doc", F.lit(None).cast("long").alias("first_text"))
    every = one.union(passages(src, long, ws)).distinct()
    marks = ws.keep(every.groupBy("text_hash").agg(F.collect_list(F.struct("begin", "end", "first_doc", "first_text")).alias("marks")), "marks")
    ws.drop("runs", "shared")
    # By sort and merge, in which a hot text's copies can be split; how many marks there are grows with the corpus.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(row.alias("d"), F.xxhash64("text").alias("text_hash")).join(marks.hint("merge"), "text_hash", "left")
    others = F.filter("marks", lambda m: ~m["first_doc"].eqNullSafe(F.col("d.doc_id")) & ~m["first_text"].eqNullSafe(F.col("text_hash")))
    places = F.array_distinct(F.flatten(F.transform(others, lambda m: F.sequence(m["begin"], m["end"]))))
    out = out.select("d", F.split("d.text", "\n", -1).alias("lines"), places.alias("places"))
    # Blank lines inside a run stay.
    out = out.select("d", "lines", F.coalesce(F.filter("places", lambda i: F.get("lines", i).rlike(WORD)), F.array().cast("array<int>")).alias("gone"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.get("lines", i))
    text = F.when(F.size("gone") > 0, F.array_join(left, "\n")).otherwise(F.col("d.text"))
    n_lines = F.coalesce(F.size(F.filter("lines", lambda x: x.rlike(WORD))), F.lit(0)).cast("long")
    own = [text.alias("text") if c == "text" else F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*own, n_lines.alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"))
