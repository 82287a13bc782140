"""Site-relative line frequency: lines that too many of a site's pages share are dropped.

Native throughout: DataFrame functions only. Lines travel as 16-byte digests, never as text; what
comes back to a page are the places of the lines to drop, and its text is put together from the
runs between them, so the work on a page grows with its lines and not with their square.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_RATIO = 0.05
MIN_PAGES = 3
_BLANK = " \t\r\x0b\x0c"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without its port; null where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _digest(line: Column) -> Column:
    """Of the line without blanks at its ends, in hex; null for a blank line, which is never counted or dropped."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.when(bare != "", F.md5(bare.cast("binary")))


def _without(lines: Column, drop: Column) -> Column:
    """``lines`` without those at the places ``drop``, which are sorted and count from 0."""
    # an array of one struct holds both as values: expressions would be worked out again for each run
    held = F.array(F.struct(lines.alias("lines"), F.concat(F.array(F.lit(-1)), drop).alias("cuts")))
    run = lambda v, cut, i: F.slice(v["lines"], cut + 2, F.coalesce(F.get(v["cuts"], i + 1), F.size(v["lines"])) - cut - 1)
    return F.get(F.transform(held, lambda v: F.flatten(F.transform(v["cuts"], lambda cut, i: run(v, cut, i)))), F.lit(0))


def site_of(docs: DataFrame) -> Column:
    """What a page belongs to: the host of its ``url`` where it has one, else its ``source``."""
    found = [F.nullif(host_of(F.col("url")), F.lit(""))] if "url" in docs.columns else []
    found += [F.col("source").cast("string")] if "source" in docs.columns else []
    return F.coalesce(*found)


def boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """site, digest of every line in more than ``max_ratio`` of the site's pages and in ``min_pages`` of them.

    ``pages``: site, text, of which every row is a page. A line counts once a page. On a site of
    few pages a single page is more than the ratio, so a line must stand in ``min_pages`` to be
    called shared at all. A null site is a site of its own; a null text is a page without lines.
    """
    # as strings, of which array_distinct keeps a hash set; of binaries it compares every pair
    own = F.array_compact(F.array_distinct(F.transform(_lines(F.coalesce("text", F.lit(""))), _digest)))
    # a null stands for the page itself, so that one count gives the lines and the site's total
    marked = pages.select("site", F.explode(F.concat(F.array(F.lit(None).cast("string")), own)).alias("digest")).withColumn("digest", F.unhex("digest"))
    counted = marked.groupBy("site", "digest").agg(F.count("*").alias("n")).where(F.col("digest").isNull() | (F.col("n") >= min_pages))
    lines = counted.where("digest is not null")
    totals = counted.where("digest is null").select(F.col("site").alias("total_site"), F.col("n").alias("total"))
    return lines.join(totals, F.col("site").eqNullSafe(F.col("total_site"))).where(F.col("n") > max_ratio * F.col("total")).select("site", "digest")


def without_boilerplate(docs: DataFrame, site: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """``docs`` with the boilerplate lines of their site cut out of ``text``; all columns kept.

    Every row is a page. Rows come back once each, also repeated ones and those with a null
    ``doc_id``; a null text stays null, a text that loses all its lines becomes empty. The other
    lines keep their order and their blanks. With ``counts``, ``n_lines`` (lines that aren't
    blank) and ``n_dropped`` are added, in place of columns of these names. A text of any length
    is one row: a task holds it and 16 bytes for each of its lines. An empty table gives an empty
    result.
    """
    names = [c for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    pages = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), site.cast("string").alias("site"))
    found = boilerplate(pages.select("site", F.col("row.text").alias("text")), max_ratio, min_pages)
    # which of a page's lines to drop is found on digests; texts are shuffled once, by id. Of rows with
    # one id, or none, equal texts have equal answers and others are told apart by a hash
    key = {"hit_id": F.col("row.doc_id"), "hit_site": F.col("site"), "hit_text": F.xxhash64("row.text")}
    # keys first: beside a generator they would be worked out for every line
    named = pages.select(*[c.alias(n) for n, c in key.items()], F.transform(_lines(F.col("row.text")), _digest).alias("digests"))
    held = named.select(*key, F.posexplode("digests").alias("at", "digest")).where("digest is not null").withColumn("digest", F.unhex("digest"))
    hits = (
        held.join(found.withColumnRenamed("digest", "found"), F.col("hit_site").eqNullSafe(F.col("site")) & (F.col("digest") == F.col("found")))
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set("at")).alias("drop"))
    )
    joined = pages.join(hits, reduce(and_, [c.eqNullSafe(F.col(n)) for n, c in key.items()]), "left").drop(*key)
    text = F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(F.array_join(_without(_lines(F.col("row.text")), F.col("drop")), "\n"))
    out = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    if counts:
        full = F.filter(_lines(F.coalesce("row.text", F.lit(""))), lambda line: F.btrim(line, F.lit(_BLANK)) != "")
        out += [F.size(full).cast("long").alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_dropped")]
    return joined.select(*out)


def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate of their source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return without_boilerplate(docs, site_of(docs), counts=True)


ORACLE_SQL = """
WITH pages AS (SELECT row_number() OVER () AS page, source AS site, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT DISTINCT site, page, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT site, page, unnest(string_split(text, chr(10))) AS line FROM pages)
),
totals AS (SELECT site, count(*) AS total FROM pages GROUP BY site),
common AS (
  SELECT l.site, l.line FROM lines l JOIN totals t ON l.site IS NOT DISTINCT FROM t.site
  WHERE l.line <> '' GROUP BY l.site, l.line, t.total HAVING count(*) >= 3 AND count(*) > 0.05 * t.total
),
docs AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
parts AS (
  SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM docs WHERE text IS NOT NULL
),
marked AS (
  SELECT p.r, p.line, p.i, c.line IS NOT NULL AS dropped, trim(p.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '' AS full_line
  FROM parts p LEFT JOIN common c
    ON c.site IS NOT DISTINCT FROM p.source AND c.line = trim(p.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))
),
kept AS (
  SELECT r, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '') AS text,
         count(*) FILTER (WHERE full_line) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped
  FROM marked GROUP BY r
)
SELECT d.doc_id, d.source, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM docs d LEFT JOIN kept k ON k.r = d.r
"""
