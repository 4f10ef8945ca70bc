"""The corpus pipeline: five stages, each written as Parquet and read again by the next.

Language ID drops documents it calls ``und`` or scores far under the labelled ones, and
fills a null lang; line dedup takes recurring template lines out and drops documents that
it leaves without a word; of each near-duplicate group the smallest doc_id stays;
documents that hold a benchmark item go; the last stage samples the rest to target weights.

Defined results: a null, empty or letterless text goes in the first stage; without labelled
rows all other documents pass it. Repeated rows share their fate in each stage: those of the
doc_id that stays all stay, and of a doc_id of several texts all rows go if the id is not the
smallest of its group. A row with a null doc_id is never a near duplicate. Very long texts
are whole rows. Extra columns pass all stages but the last, whatever their names. An empty
table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmatrix.llm import decontam, langid, mixing, neardup, templates
from cellmatrix.llm.common import BROADCAST_ROWS, WORD, Workspace

#: SQL cannot express the learned and randomised stages.
ORACLE_SQL = None
#: Near copies are alike in four fifths of their five-word shingles; op2's contract has its own values.
NEAR_PCT, NEAR_WORDS = 80, 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = templates.clean_lines(docs)
    return out.where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.near_duplicates(docs, pct=NEAR_PCT, size=NEAR_WORDS).where("not kept").select("doc_id").distinct()
    gone = Workspace(spark).keep(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mix(docs).where("selected")
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "prob")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents table."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.keep(stage(spark, docs, sf_dir), f"{k}_{name}")
    return docs
