"""How filters interact: every order of five filters is replayed over every document's flags.

Whether a filter would fail a document doesn't depend on the order, so a document is read once,
for its flags. Its flags then meet the 120 orders, of fixed number and broadcast; each meeting
knows its first failure and gives a row for each of the five steps, which tasks add up before
anything is shuffled: a shuffle holds a row for each part, order and step of a task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: Documents of one task of the replay, each of which makes 600 rows there.
DEALT = 20_000
_BLANK = r"[ \t\n\x0B\f\r]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text fails; a null text is an empty one.

    A: under 200 words. B: distinct words under 50 % of its words. C: A-Z over 2 % of its code
    points. D: holds one of ``#$%&*|``. Words are what blanks divide, in the case they have.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _BLANK), lambda w: w != "")
    capitals = F.size(F.regexp_extract_all(text, F.lit("[A-Z]"), F.lit(0)))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failures (a bit for each filter, A the lowest), good, toxic for every row of ``docs`` (doc_id, source, text).

    E fails a text that a smaller doc_id has too, anywhere in the table; texts are told apart by
    their SHA-256. A row without an id has no smaller one and is none; of repeated rows with one
    id none is smaller. ``labels``: doc_id, quality, toxic; a document is good or toxic if any of
    its labels says so. Other columns are ignored, whatever their names.
    """
    failures = text_failures(F.col("text"))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures.values())), F.lit(0))
    read = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
            bits.alias("bits"),
            F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"),
        ),
        "flags",
    )
    first = materialise(read.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "first")
    given = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    told = given.agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    repeats = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return (
        read.join(first, "digest", "left")
        .join(told, "doc_id", "left")
        .select("part", (F.col("bits") + F.when(repeats, 1 << FILTERS.index("E")).otherwise(0)).alias("failures"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    )


def replayed(flags: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of flags (part, failures, good, toxic).

    The 120 orders are the same at any size, so they are broadcast. A part has all 600 rows, as
    each of its documents makes one for each order and step; without documents there are none.
    """
    spark = flags.sparkSession
    orders = spark.createDataFrame([(i, [1 << FILTERS.index(f) for f in o]) for i, o in enumerate(ORDERS)], "at int, filters array<int>")
    fails = lambda k: F.col("failures").bitwiseAND(F.col(f"f{k}")) != 0
    first = F.lit(len(FILTERS) + 1)
    for k in reversed(range(len(FILTERS))):
        first = F.when(fails(k), k + 1).otherwise(first)
    broken = F.broadcast(orders.select("at", *[F.col("filters")[k].alias(f"f{k}") for k in range(len(FILTERS))]))
    met = flags.crossJoin(broken).select("part", "at", "failures", "good", "toxic", first.alias("first"), F.posexplode(F.array(*[f"f{k}" for k in range(len(FILTERS))])).alias("place", "filter"))
    step = F.col("place") + 1
    removed, failing = F.col("first") == step, F.col("failures").bitwiseAND(F.col("filter")) != 0
    n = lambda condition, name: F.sum(F.when(condition, 1).otherwise(0)).alias(name)
    counted = met.groupBy("part", "at", "place").agg(
        n(F.col("first") > step, "kept"),
        n(removed, "removed"),
        n(failing & (F.col("first") < step), "redundant"),
        n(F.col("failures") == F.col("filter"), "unique_fails"),
        n(removed & F.col("good"), "good_lost"),
        n(removed & F.col("toxic"), "toxic_lost"),
    )
    names = F.broadcast(spark.createDataFrame(list(enumerate(ORDERS)), "at int, filter_order string"))  # 120 rows
    counted = materialise(counted.join(names, "at").withColumn("step", (F.col("place") + 1).cast("int")).drop("at", "place"), "replay")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    shares = counted.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley")).withColumnRenamed("part", "their")
    return counted.join(shares, (F.col("part") == F.col("their")) & (letter == F.col("letter"))).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts of every part, order and step over all of ``docs``; see :func:`flagged` and :func:`replayed`.

    Nulls, empty texts and repeated rows are as said there, a null source is the part "". A text
    of any length is read whole, once, in one task. An empty table gives an empty result.
    """
    flags = materialise(flagged(docs, labels), "flags")
    tasks = -(-max(flags.count(), 1) // DEALT)
    return replayed(flags.repartition(tasks))


def op12_relational_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by source."""
    return filter_audit(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), table(spark, sf_dir, "labels"))


ORACLE_SQL = f"""
WITH docs AS (
  SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(d.text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM documents d LEFT JOIN (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
  ) l ON l.doc_id = d.doc_id
),
least AS (SELECT text, min(doc_id) AS least FROM docs GROUP BY text),
flags AS (
  SELECT row_number() OVER () AS r, part, good, toxic, {{
    'A': len(words) < 200,
    'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * len(regexp_extract_all(docs.text, '[A-Z]')) > 2 * length(docs.text),
    'D': regexp_matches(docs.text, '[#$%&*|]'),
    'E': coalesce(doc_id > least, false)
  }} AS f FROM docs JOIN least ON least.text = docs.text
),
fails AS (
  SELECT r, part, good, toxic, (CASE WHEN f.A THEN 'A' ELSE '' END) || (CASE WHEN f.B THEN 'B' ELSE '' END)
    || (CASE WHEN f.C THEN 'C' ELSE '' END) || (CASE WHEN f.D THEN 'D' ELSE '' END) || (CASE WHEN f.E THEN 'E' ELSE '' END) AS failing
  FROM flags
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step),
replay AS (
  SELECT part, failing, good, toxic, filter_order, step, substr(filter_order, step, 1) AS letter,
         len(regexp_replace(left(filter_order, step - 1), '[^' || failing || '-]', '', 'g')) > 0 AS before,
         contains(failing, substr(filter_order, step, 1)) AS here, n
  FROM (SELECT part, failing, good, toxic, count(*) AS n FROM fails GROUP BY ALL), orders, steps
),
counted AS (
  SELECT part, filter_order, step, letter,
         CAST(coalesce(sum(n) FILTER (WHERE NOT before AND NOT here), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE NOT before AND here), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE before AND here), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE failing = letter), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n) FILTER (WHERE NOT before AND here AND good = 1), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n) FILTER (WHERE NOT before AND here AND toxic = 1), 0) AS BIGINT) AS toxic_lost
  FROM replay GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
