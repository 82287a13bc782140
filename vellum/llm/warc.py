"""WARC archives: writing pages with revisits, and reading records back by chain verification.

Writing: a record is one string and the text sink's line separator closes it, so part files
are WARC files, by default uncompressed, so that Spark can read a large one in several tasks.
Ones compressed as a whole are read too, each in one task.

Reading: the text source splits files at the records' magic, and each piece is only a candidate
for a record, because a payload may hold the magic, or a whole record. A candidate names its
successor: the offset where its declared length ends. The chain of true records starts at offset
0. Files are taken in spans of SPAN_BYTES. Each span first shortens its own chains to the offset
where they leave it; then pointers are doubled across spans, so rounds grow with the logarithm
of a file's spans, however they were read; last, each span marks what its entry reaches. Pieces
that aren't reached belong to the payload of the record before them and are put back.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, scratch_path, table

MAGIC = "WARC/1."
CLOSE = "\r\n\r\n"
MIN_REVISIT_BYTES = 1000
#: Bytes of a file whose chains one task group shortens and walks.
SPAN_BYTES = 1_000_000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, record_type, refers_to of every row.

    Among rows with equal payloads of at least ``min_bytes`` the largest page_id is the response
    and others revisit it; repeated rows with that same id are responses too, and so are rows of
    a group without any id. A null payload is empty. Groups are found on digests; a digest that
    many rows share is only counted per task before it is shuffled.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary"))})
    groups = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first_id")
    )
    groups = materialise(groups, "groups")  # its size is then known when the join is planned: few groups need no shuffle of payloads
    again = F.coalesce((F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    return rows.join(groups, "digest", "left").select(
        "page_id",
        "url",
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_bytes",
        "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def write_archives(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write the rows of :func:`with_revisits` as WARC files below ``path``, one for each task; ``compression`` may be "gzip"."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    block = F.concat(F.lit(_HTTP), F.coalesce("payload", F.lit("")))
    record = F.concat(
        F.lit(MAGIC + "1\r\nWARC-Type: "),
        text("record_type"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        text("page_id"),
        F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        F.regexp_replace(text("url"), r"\s+", "%20"),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), text("refers_to"), F.lit(">"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        text("digest"),
        F.lit("\r\nX-Payload-Length: "),
        text("payload_bytes"),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CLOSE),
        block,
    )
    records.select(record.alias("value")).write.option("lineSep", CLOSE).option("compression", compression).text(path)


#: A file is named by a 64-bit hash of its path, which keeps the rows small that are sorted and joined.
_EXITS = "file long, span long, offset long, next long, leaves long"
_REACHED = "file long, offset long"


def _shorten(part: pd.DataFrame) -> pd.DataFrame:
    """Where each candidate's chain leaves the span."""
    part = part.sort_values("offset")
    offsets, following = part["offset"].to_numpy(np.int64), part["next"].to_numpy(np.int64)
    at = np.searchsorted(offsets, following)
    inside = (at < len(offsets)) & (offsets[np.minimum(at, len(offsets) - 1)] == following)
    leaves = following.copy()
    for i in np.flatnonzero(inside)[::-1]:
        leaves[i] = leaves[at[i]]
    return part[["file", "span", "offset", "next"]].assign(leaves=leaves)


def _walk(part: pd.DataFrame) -> pd.DataFrame:
    """What the span's entries reach in it."""
    following = dict(zip(part["offset"], part["next"], strict=True))
    reached = set()
    for at in part.loc[part["entry"], "offset"]:
        while at in following and at not in reached:
            reached.add(at)
            at = following[at]
    return part.loc[part["offset"].isin(reached), ["file", "offset"]]


def pieces_at_magic(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The pieces of the files: (at, value), value being what follows the magic, and their places.

    Places: at, file, span, offset (of the magic), size, header_size, length, where the last two
    are null for a piece that can't be a record. Only the places, never the values, are shuffled.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = materialise(
        raw.select(F.monotonically_increasing_id().alias("at"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"),
        "pieces",
        compression="zstd",
    )
    header = F.substring_index("value", CLOSE, 1)
    possible = F.col("value").rlike(r"^[01]\r\n")
    length = F.regexp_extract(header, r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})", 1).try_cast("long")
    small = raw.select(
        "at", "file", "block",
        (F.octet_length("value") + len(MAGIC)).cast("long").alias("size"),
        F.when(possible, F.octet_length(header)).cast("long").alias("header_size"),
        F.when(possible, length).alias("length"),
    )
    earlier = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    local = materialise(small.withColumn("local", F.coalesce(F.sum("size").over(earlier), F.lit(0))), "local")
    blocks = local.groupBy("file", "block").agg(F.sum("size").alias("block_size"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("file", "block", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("base"))
    places = local.join(base, ["file", "block"]).select("at", "file", (F.col("base") + F.col("local") - len(MAGIC)).alias("offset"), "size", "header_size", "length")
    places = materialise(places.withColumn("span", F.floor(F.col("offset") / SPAN_BYTES)), "places")
    discard(local)
    return raw.select("at", "value"), places


def true_records(places: DataFrame) -> DataFrame:
    """file, offset of the pieces that the chain from the start of their file reaches."""
    follows = F.col("offset") + len(MAGIC) + F.col("header_size") + 2 * len(CLOSE) + F.col("length")
    candidates = places.where("offset >= 0 and length is not null").select("file", "span", "offset", follows.alias("next"))
    nodes = materialise(candidates.groupBy("file", "span").applyInPandas(_shorten, _EXITS), "candidates")
    # only the start of a file and the offsets at which a chain enters a span take part in the doubling
    targets = nodes.select("file", F.col("leaves").alias("offset")).distinct()
    starts = nodes.where("offset = 0").select("file", "offset", "leaves")
    jumps = materialise(nodes.join(targets, ["file", "offset"], "left_semi").select("file", "offset", "leaves").unionByName(starts).distinct(), "jumps")
    reached = materialise(starts.select("file", "offset"), "reached")
    for _ in range(doublings(nodes)):
        further = materialise(reached.unionByName(reached.join(jumps, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))).distinct(), "reached")
        onward = jumps.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("onward"))
        longer = materialise(jumps.join(onward, ["file", "leaves"]).select("file", "offset", F.col("onward").alias("leaves")), "jumps")
        discard(reached, jumps)
        reached, jumps = further, longer
    entries = reached.withColumn("entry", F.lit(True))
    marked = nodes.join(entries, ["file", "offset"], "left").select("file", "span", "offset", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    out = materialise(marked.groupBy("file", "span").applyInPandas(_walk, _REACHED), "true")
    discard(nodes, reached, jumps)
    return out


def doublings(nodes: DataFrame) -> int:
    """How often pointers are doubled, so that a chain through all spans of the longest file is followed."""
    most = nodes.groupBy("file").agg(F.count_distinct("span").alias("n")).agg(F.max("n")).first()[0] or 1
    return math.ceil(math.log2(most)) + 1 if most > 1 else 0


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """header, content (binary, of the declared length) of every true record below ``path``.

    Only magic in front of which the chain of lengths ends counts as a record. A file that
    doesn't begin with a record gives none; a record cut off by the end of its file gives the
    content that is there. A record of any length is one row. No files with records: an empty
    result.
    """
    values, places = pieces_at_magic(spark, path)
    reached = true_records(places)
    marked = places.join(reached.withColumn("true", F.lit(True)), ["file", "offset"], "left")
    # a piece belongs to the last record at or before it: in its span, or in the spans before
    last = marked.groupBy("file", "span").agg(F.max(F.when(F.col("true"), F.col("offset"))).alias("last"))
    earlier = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "span", F.max("last").over(earlier).alias("carried"))
    up_to = Window.partitionBy("file", "span").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.coalesce(F.last(F.when(F.col("true"), F.col("offset")), ignorenulls=True).over(up_to), F.col("carried"))
    whole = F.coalesce(F.col("true") & (F.col("header_size") + len(CLOSE) + F.col("length") + len(MAGIC) <= F.col("size")), F.lit(False))
    owned = marked.join(carried, ["file", "span"]).select("at", "file", "offset", owner.alias("owner"), whole.alias("whole"), F.coalesce("true", F.lit(False)).alias("true"))
    # most records are one piece; the pieces that aren't are few, and stored, so that their size is known when the join is planned
    owned = materialise(owned, "owned")
    others = materialise(owned.where("not whole").select("at"), "others")
    single = values.join(others, "at", "left_anti").select("value")
    # records with magic inside come in several pieces: those are gathered, by record
    split = owned.where("true and not whole").select("file", "owner")
    parts = materialise(owned.where("not whole").join(split, ["file", "owner"], "left_semi").select("at", "file", "owner", "offset"), "parts")
    discard(places, reached, owned)
    gathered = values.join(parts, "at").groupBy("file", "owner")
    joined = gathered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda p: p["value"]), MAGIC).alias("value"))
    header = F.substring_index("value", CLOSE, 1)
    length = F.regexp_extract(header, r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})", 1).try_cast("long")
    records = single.unionByName(joined.select("value"))
    return records.select(header.alias("header"), F.substring(F.col("value").cast("binary"), F.octet_length(header) + len(CLOSE) + 1, length.cast("int")).alias("content"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_archives` wrote: page_id, payload (null for revisits) and the header's fields."""
    records = read_archives(spark, path)
    field = lambda pattern: F.regexp_extract("header", pattern, 1)
    http = F.octet_length(F.substring_index(F.col("content").cast("string"), CLOSE, 1)) + len(CLOSE)
    kind = field(r"\r\nWARC-Type: (\w+)")
    payload = F.when(kind == "response", F.substring(F.col("content"), http + 1, F.octet_length("content")))
    number = lambda pattern: field(pattern).try_cast("long")
    return records.select(
        number(r"\r\nWARC-Record-ID: <urn:page:(-?\d*)>").alias("page_id"),
        kind.alias("record_type"),
        number(r"\r\nWARC-Refers-To: <urn:page:(-?\d*)>").alias("refers_to"),
        field(r"\r\nWARC-Payload-Digest: sha1:(\w+)").alias("digest"),
        number(r"\r\nX-Payload-Length: (\d+)").alias("payload_bytes"),
        payload.alias("payload"),
    )


def op4_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back. Digest and size of a response are those of the payload as read."""
    path = scratch_path(spark, "warc")
    write_archives(with_revisits(table(spark, sf_dir, "pages")), path)
    read = F.col("payload").isNotNull()
    return read_pages(spark, path).select(
        "page_id",
        F.when(read, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(read, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""
