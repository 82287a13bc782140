"""Queries over files made from the tables, over what is kept of them, and over logs of their use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluate, maintain, privacy, state
from ..sources import files
from .queries import _FEEDBACK, _PII, NORMALIZED, _feedback, query, read

_SUFFIXES = (".txt", ".md", ".log", ".csv", ".tsv", ".exe", ".txt", "")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content of a file for each document, in every plain format, with and without marks of its encoding; some empty or of no known format."""
    docs = read(spark, sf_dir, "documents")
    kind = (F.col("doc_id") % 8).cast("int")
    text = F.coalesce(F.col("text"), F.lit(""))
    quoted = lambda sep: F.concat_ws("\n", F.concat_ws(sep, F.lit("id"), F.lit(" lang "), F.lit("")), F.lit(""), F.concat_ws(sep, F.col("doc_id").cast("string"), F.concat(F.lit('"'), "lang", F.lit(f'{sep}"')), F.col("source")))
    mark = F.unhex(F.lit("EFBBBF"))
    content = (
        F.when(kind == 1, F.concat(mark, F.encode(text, "UTF-8")))
        .when(kind == 2, F.encode(text, "UTF-16"))
        .when(kind == 3, F.encode(quoted(","), "UTF-8"))
        .when(kind == 4, F.encode(quoted("\t"), "UTF-8"))
        .when(kind == 6, F.lit("").cast("binary"))
        .otherwise(F.encode(text, "UTF-8"))
    )
    path = F.concat(F.lit("/in/"), F.when(kind == 1, "文件 ").otherwise("doc "), "doc_id", F.element_at(F.array(*map(F.lit, _SUFFIXES)), kind + 1))
    return docs.select(path.alias("path"), content.alias("content"))


_FILE_SQL = f"""
raw AS (
  SELECT doc_id, '/in/' || CASE WHEN doc_id % 8 = 1 THEN '文件 ' ELSE 'doc ' END || doc_id || {list(_SUFFIXES)}[1 + doc_id % 8] AS path, {list(_SUFFIXES)}[1 + doc_id % 8] AS extension,
         CASE WHEN doc_id % 8 = 3 THEN 'id: ' || doc_id || '; lang: ' || lang || ',; ' || source WHEN doc_id % 8 = 4 THEN 'id: ' || doc_id || '; lang: ' || lang || '; ' || source ELSE coalesce(text, '') END AS text
  FROM documents
),
{NORMALIZED.replace("FROM documents", "FROM raw")},
read_ AS (
  SELECT r.path, r.extension, t AS text,
         CASE WHEN r.doc_id % 8 IN (5, 7) THEN 'unsupported format: ' || r.extension WHEN r.doc_id % 8 = 6 OR (r.text = '' AND r.doc_id % 8 = 0) THEN 'empty file' WHEN t = '' THEN 'no text' END AS error,
         CASE r.doc_id % 8 WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16' ELSE 'utf-8' END AS encoding
  FROM raw r JOIN f ON f.doc_id = r.doc_id
)
"""


@query(f"WITH {_FILE_SQL} SELECT path, extension, CASE WHEN error IS NULL THEN encoding END AS encoding, CASE WHEN error IS NULL THEN text END AS text, CASE WHEN error IS NULL THEN length(text) END AS chars, error FROM read_")
def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.extract(_files(spark, sf_dir)).select("path", "extension", "encoding", "text", F.col("chars").cast("long").alias("chars"), "error")


@query(f"""
WITH {_FILE_SQL}, s AS (SELECT *, trim(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1')) AS stem FROM read_)
SELECT CASE WHEN regexp_matches(stem, '^[A-Za-z0-9_.\\-]+$') THEN stem ELSE 'doc_' || substr(sha1(stem), 1, 10) END AS doc_id, stem AS title, sha1(text) AS sha1 FROM s WHERE error IS NULL
""")
def uploaded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as the documents that they are stored as, with the fingerprint that the next upload is compared with."""
    found = files.uploads(files.extract(_files(spark, sf_dir))).where("error is null")
    return found.join(maintain.manifest(found), "doc_id").select("doc_id", "title", "sha1")


@query("""
WITH c AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: list_transform(string_split(l, ','), lambda c: trim(c))) AS r FROM documents),
t AS (SELECT doc_id, list_filter(r, lambda x: len(list_filter(x, lambda c: c <> '')) > 0) AS t FROM c)
SELECT doc_id, CASE WHEN len(t) = 0 THEN '' WHEN len(t) = 1 THEN array_to_string(t[1], ' | ') ELSE array_to_string(list_transform(t[2:], lambda x: array_to_string(
  list_filter(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN x[i] = '' THEN NULL WHEN coalesce(t[1][i], '') <> '' THEN t[1][i] || ': ' || x[i] ELSE x[i] END), lambda y: y IS NOT NULL), '; ')), chr(10)) END AS text FROM t
""")
def rendered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read as tables: lines as rows, commas between the cells."""
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, ","))
    return read(spark, sf_dir, "documents").select("doc_id", rows.alias("cells")).select("doc_id", tx.render_rows(F.col("cells")).alias("text"))


@query("SELECT count(*) AS docs, coalesce(sum(chunks), 0) AS chunks FROM (SELECT greatest(CAST(ceil((length(text) - 40) / 160.0) AS BIGINT), 1) AS chunks FROM documents WHERE text <> '')")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text <> ''")
    chunks = F.greatest(F.ceil((F.char_length("text") - 40) / 160), F.lit(1))
    return maintain.total_chunks(docs.select("doc_id", chunks.alias("chunks"))).select("docs", F.col("chunks").cast("long").alias("chunks"))


@query("SELECT source AS tenant, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS kb_version FROM documents")
def tenant_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a write: the version that its tenant's documents have then."""
    writes = read(spark, sf_dir, "documents").select(F.col("source").alias("tenant"), "doc_id", F.col("doc_id").alias("seq"))
    return maintain.versions(writes).select("tenant", "doc_id", "kb_version")


@query(f"""
WITH {_FEEDBACK}
SELECT 'documents' AS name, source AS owner, count(*) AS n FROM documents GROUP BY source
UNION ALL SELECT 'sessions', NULL, count(DISTINCT conv_id) FROM conversations
UNION ALL SELECT 'limiter keys', NULL, count(DISTINCT user_id) FROM events
UNION ALL SELECT 'feedback', coalesce(nullif(tenant, ''), 'default'), count(*) FROM f GROUP BY 2
""")
def size_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    feedback = _feedback(spark, sf_dir).withColumn("tenant", F.coalesce(F.nullif("tenant", F.lit("")), F.lit("default")))
    return evaluate.sizes({
        "documents": (read(spark, sf_dir, "documents"), "source", None),
        "sessions": (read(spark, sf_dir, "conversations"), None, "conv_id"),
        "limiter keys": (read(spark, sf_dir, "events"), None, "user_id"),
        "feedback": (feedback, "tenant", None),
    })


@query("""
WITH h AS (SELECT event_type, le, count(*) FILTER (WHERE le IS NULL OR value <= le) AS n FROM events, (SELECT unnest([1, 10, 100, NULL]) AS le) WHERE value IS NOT NULL GROUP BY ALL)
SELECT 'calls' AS metric, 'event_type=' || event_type AS labels, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY event_type
UNION ALL SELECT 'value_bucket', 'event_type=' || event_type || ',le=' || CASE WHEN le IS NULL THEN '+Inf' ELSE CAST(CAST(le AS DOUBLE) AS VARCHAR) END, n FROM h
UNION ALL SELECT 'last_value', 'event_type=' || event_type, arg_max(value, (ts, event_id)) FROM events GROUP BY event_type
""")
def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters, histograms and gauges as one table of metric, labels and value."""
    events, by = read(spark, sf_dir, "events"), ["event_type"]
    return evaluate.metrics({
        "calls": (evaluate.counters(events, by), by, "n"),
        "value_bucket": (evaluate.histogram(events, "value", [1, 10, 100], by).withColumn("le", F.coalesce(F.col("le").cast("string"), F.lit("+Inf"))), [*by, "le"], "n"),
        "last_value": (evaluate.last_value(events, "value", F.struct("ts", "event_id"), by), by, "last"),
    })


@query(r"""
WITH p AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '[^/]*[0-9][^/]*', '{id}', 'g') AS p FROM pages)
SELECT CASE WHEN p = '' THEN '/' ELSE p END AS route, count(*) AS n FROM p GROUP BY 1
""")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.counters(read(spark, sf_dir, "pages").select(tx.route_label(F.col("url")).alias("route")), ["route"])


@query(f"""
WITH {_PII},
files AS (SELECT 'page/' || CASE WHEN page_id % 9 = 4 THEN 'Resume-' WHEN page_id % 9 = 5 THEN '证件' ELSE '' END || page_id AS path, 'page/' || page_id AS plain, page_id % 4 = 1 AS is_binary FROM pages)
SELECT f.path, h.line, h.rule, h.length FROM files f JOIN hits h ON h.path = f.plain WHERE NOT is_binary AND h.rule NOT IN ('card', 'token')
UNION ALL SELECT path, 0, '{tx.PRIVATE_NAME_RULE}', CASE WHEN path LIKE '%Resume%' THEN 6 ELSE 2 END FROM files WHERE path LIKE '%Resume%' OR path LIKE '%证件%'
""")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, some with telling names, some binary: those are judged by their names alone."""
    name = F.when(F.col("page_id") % 9 == 4, "Resume-").when(F.col("page_id") % 9 == 5, "证件").otherwise("")
    content = F.when(F.col("page_id") % 4 == 1, F.concat(F.unhex(F.lit("4D5A00")), F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    raw = read(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), name, "page_id").alias("path"), content.alias("content"))
    return privacy.scan_files(raw)


@query(f"""
WITH {_PII.replace("content, '[", "probe, '[").replace("content, '(", "probe, '(").replace("content, 's", "probe, 's").replace("content, '/", "probe, '/").replace("content, 't", "probe, 't").replace("FROM lines", "FROM probes").replace("found AS (", "probes AS (SELECT path, line, content AS probe FROM lines WHERE NOT starts_with(ltrim(content), '#') AND path LIKE 'doc/%'), found AS (")}
SELECT path, line, rule, length FROM hits
""")
def scanned_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as commit messages, whose lines of comment don't count."""
    messages = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
    return privacy.scan_messages(messages, {**tx.PRIVACY_RULES, **tx.MORE_RULES})


@query("""
WITH i AS (SELECT DISTINCT 'User ' || user_id || ' <U' || (user_id % 30) || '@corp.example>' || CASE WHEN user_id % 11 = 3 THEN ' 138' || '00138000' ELSE '' END AS identity, user_id FROM events)
SELECT identity, '身份含手机号' AS rule FROM i WHERE user_id % 11 = 3
UNION ALL SELECT identity, '不在允许清单内 (原文已隐去)' FROM i WHERE NOT (user_id % 2 = 0 AND user_id % 11 <> 3)
""")
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    plain = F.concat(F.lit("User "), user, F.lit(" <U"), user % 30, F.lit("@corp.example>"))
    people = users.select(F.concat(plain, F.when(user % 11 == 3, F.lit(" 138" + "00138000")).otherwise("")).alias("identity"))
    allowed = users.where(user % 2 == 0).select(F.concat(F.lit("  "), F.upper(plain)).alias("identity"))
    return privacy.identity_hits(people, allowed)


@query("""
WITH t AS (SELECT user_id, max(ts) AS touched FROM events GROUP BY user_id), now_ AS (SELECT max(ts) AS now FROM events)
SELECT user_id, epoch_us(touched) AS touched_us FROM t, now_ WHERE touched >= now - INTERVAL 30 MINUTE ORDER BY touched DESC, user_id LIMIT 2000
""")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that a sweep leaves: touched in the last half hour of the log, and the two thousand last touched of those."""
    events = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    left = state.swept(events, "user_id", "ts", "30 minutes", 2000)
    return left.select("user_id", F.unix_micros("last_access").alias("touched_us"))
