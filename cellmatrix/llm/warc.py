"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Records of equal payloads of at least ``least`` bytes are written once as response and
else as revisits of it. Reading splits large files at the record magic, so that a task
reads a part of a file; each piece is a candidate record with an offset and, by its
Content-Length, a successor. Magic inside a payload makes false candidates, so only what
pointer jumping reaches from the start of each file is kept: the reached set doubles each
round, and so does the length of the jumps.

Defined results: null html is an empty payload; a null page_id or url leaves the header
out (null when read); line breaks in a url are written as %0A; rows repeated with page_id
and payload are each the response; an empty table gives an empty result; extra columns
are ignored; a very long payload is one row. A record that says nothing of its length, or
ends before its file does (a torn file), ends its file's chain: ``read`` raises ValueError
then, or with ``strict=False`` returns the records up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_small

MAGIC, LEAST, END = "WARC/1.0\r\n", 1000, "\r\n\r\n"


def plan(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, bytes and refers_to (null: response)."""
    ws = Workspace(pages.sparkSession)
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    # Payloads are equal where length and both hashes are.
    p = p.withColumn("same", F.when(F.col("bytes") >= least, F.substring(F.sha2(F.concat("digest", "payload"), 256), 1, 24)))
    groups = p.where("same is not null").groupBy("same").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "first")
    groups = ws.keep(groups, "groups")
    out = join_small(p, groups, "same", groups.count())
    return out.select("page_id", "url", "payload", "digest", "bytes", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def write(planned: DataFrame, path: str) -> None:
    """A WARC file for each task, by the commit protocol of Spark's writers."""
    line = lambda name, value: F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Date: 2000-01-01T00:00:00Z\r\n"),
        line("WARC-Record-ID", urn("page_id")), line("WARC-Refers-To", urn("refers_to")),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "%0A")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    planned.select(F.concat(head, block)).write.option("lineSep", END).text(path)


def candidates(spark: SparkSession, path: str, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(pieces, candidates): k and the text between magics; k, file, at (the offset of the magic) and next (null: not a record)."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("piece")
    )
    pieces = ws.keep(raw, "pieces")
    head = F.substring_index("piece", END, 1)
    length = F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length: *(\d{1,18})", 1)
    bytes_ = F.octet_length("piece")
    size = pieces.select(
        "file", "part", "k", (bytes_ + len(MAGIC)).cast("long").alias("size"),
        F.when((F.octet_length(head) < bytes_) & (length != ""), F.octet_length(head) + 2 * len(END) + length.cast("long")).alias("span"),
    )
    # Offsets: sums inside each split, then over the splits of a file.
    parts = size.groupBy("file", "part").agg(F.sum("size").alias("total"))
    starts = parts.select("file", "part", (F.sum("total").over(_upto("file", "part")) - F.col("total")).alias("base"))
    own = size.withColumn("own", F.sum("size").over(_upto(["file", "part"], "k")) - F.col("size"))
    at = own.join(starts, ["file", "part"]).withColumn("at", F.col("base") + F.col("own") - len(MAGIC))
    # What stands before a file's first magic is no candidate, but an empty file's or a foreign one's end.
    return pieces, ws.keep(at.select("k", "file", "at", (F.col("at") + len(MAGIC) + F.col("span")).alias("next"), (F.col("at") + F.col("size")).alias("end")), "candidates")


def _upto(keys, order):
    from pyspark.sql import Window

    return Window.partitionBy(keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def reachable(cand: DataFrame, ws: Workspace) -> DataFrame:
    """(file, at) of the candidates on each file's chain from offset 0."""
    edges = cand.where("next is not null and at >= 0").select("file", "at", "next")
    # Jumps that leave the candidates (the end of a file) lead nowhere.
    jump = ws.keep(edges.join(cand.select("file", F.col("at").alias("next")), ["file", "next"]).select("file", "at", "next"), "jump0")
    reached = new = ws.keep(cand.where("at = 0").select("file", "at"), "reach0")
    for k in range(1, 64):
        new = ws.keep(reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at")), f"reach{k}")
        if new.isEmpty():
            break
        reached = reached.union(new)
        to = jump.select("file", F.col("at").alias("next"), F.col("next").alias("to"))
        jump = ws.keep(jump.join(to, ["file", "next"]).select("file", "at", F.col("to").alias("next")), f"jump{k}")
        ws.drop(f"jump{k - 1}")
    return reached


def header(name: str) -> Column:
    v = F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)
    return F.when(v != "", v)


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A row per record: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload (binary; null: revisit)."""
    ws = Workspace(spark)
    pieces, cand = candidates(spark, path, ws)
    true = reachable(cand, ws).withColumn("real", F.lit(True))
    marked = ws.keep(cand.where("at >= 0").join(true, ["file", "at"], "left"), "marked")
    if strict:
        ends = marked.groupBy("file").agg(F.max("end").alias("size"), F.max(F.when(F.col("real"), F.coalesce("next", F.lit(-1)))).alias("to"))
        torn = ends.where("to is null or size <> to").select("file").limit(5).collect()
        if torn:
            raise ValueError(f"torn WARC files, or no WARC files: {sorted(r['file'] for r in torn)}")
    # False candidates are payload of the record before them. There are few, and only files that hold some are sorted.
    files = marked.where("real is null").select("file").distinct()
    last = F.max(F.when(F.col("real"), F.struct("at", "k"))).over(_upto("file", "at"))
    owners = marked.join(files, "file", "left_semi").select("k", "at", "real", last["k"].alias("owner")).where("real is null").select("k", "at", "owner")
    owners = ws.keep(owners, "owners")
    n = owners.count()
    # Pieces are dealt by key only where the false ones are too many to broadcast.
    tails = join_small(pieces, owners, "k", n, "inner").groupBy(F.col("owner").alias("k")).agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("rest"))
    tails = ws.keep(tails, "tails")
    # A piece is a record as it stands unless it is before the first magic, false, or has false ones after it.
    odd = owners.select("k", F.lit(False).alias("starts")).union(tails.select("k", F.lit(True))).union(cand.where("at < 0").select("k", F.lit(False)))
    odd = ws.keep(odd, "odd")
    told = join_small(pieces.select("k", "piece"), odd, "k", odd.count())
    plain = told.where("starts is null").select("k", "piece")
    # The records that were cut: their first piece and the others.
    cut = told.where("starts").select("k", "piece").join(tails, "k").select("k", F.concat("piece", F.array_join(F.transform("rest", lambda x: F.concat(F.lit(MAGIC), x["piece"])), "")).alias("piece"))
    ws.drop("candidates", "marked")
    recs = (plain.union(cut) if n else plain).withColumn("head", F.substring_index("piece", END, 1))
    piece = F.col("piece").cast("binary")
    size = header("Content-Length").cast("int")
    recs = recs.select("head", F.substring(piece, F.octet_length("head") + len(END) + 1, size).alias("block"))
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)
    recs = recs.withColumn("http", http).withColumn("payload", F.substring("block", F.col("http") + 1, F.octet_length("block")))
    page = lambda name: F.regexp_extract(F.coalesce(header(name), F.lit("")), r"<urn:page:(-?\d+)>", 1)
    number = lambda name: F.when(page(name) != "", page(name)).cast("long")
    told = F.regexp_extract(F.substring_index(F.col("block").cast("string"), END, 1), r"(?i)\r\nContent-Length: *(\d+)", 1)
    response = header("WARC-Type") == "response"
    return recs.select(
        number("WARC-Record-ID").alias("page_id"), F.when(response, F.octet_length("payload")).otherwise(F.when(told != "", told).cast("long")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.regexp_replace(header("WARC-Payload-Digest"), "^sha1:", "")).alias("payload_digest"),
        header("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), header("WARC-Target-URI").alias("url"), F.when(response, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    path = f"{Workspace(pages.sparkSession).root}/warc"
    write(plan(pages), path)
    return read(pages.sparkSession, path).drop("url", "payload")
