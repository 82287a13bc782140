"""Queries over what is stored: generations of chunks, the inverted index, ingests, and what follows from order in time.

Each makes its tables from the standard ones, in the shared folder, and reads them back.
"""

from __future__ import annotations

import io
import re
import zipfile
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import answering, chunk, graph_index, maintain, privacy, retrieval, state, timeline
from ..operators.ingest import ingest
from ..operators.inverted import InvertedIndex
from ..sources import files
from ..sources.logs import Log
from ..sources.shared import fresh_path
from ..sources.store import ChunkStore
from .queries import _BM25, _FEEDBACK, _NEAREST, NORMALIZED, _benchmark, _documents, _feedback, _vector_queries, _vectors, query, read


def _cut(docs: DataFrame) -> DataFrame:
    """Sliding chunks of (doc_id, text, tenant)."""
    return chunk.sliding_chunks(docs).join(docs.select("doc_id", "tenant"), "doc_id").select("tenant", "doc_id", "chunk_index", "content")


def _changed(docs: DataFrame) -> DataFrame:
    """One document in ten with another text: every other one of these with none at all."""
    text = F.when(F.col("doc_id") % 20 == 3, "").otherwise(F.concat(F.col("text"), F.lit(" "), F.col("text")))
    return docs.where("doc_id % 10 = 3").withColumn("text", text)


def _store(spark: SparkSession, sf_dir: str) -> ChunkStore:
    """Four generations: all documents; one in ten changed; one in ten deleted, by those who have them and by others; a tenant deleted."""
    docs = _documents(spark, sf_dir)
    store = ChunkStore(spark, fresh_path(spark, "chunks"), buckets=2)
    store.upsert(_cut(docs))
    changed = _changed(docs)
    store.upsert(_cut(changed), changed)
    gone = docs.where("doc_id % 10 = 7").select("tenant", "doc_id")
    store.delete(gone.unionByName(docs.select(F.lit("nobody").alias("tenant"), "doc_id")))
    store.delete_tenant("src4")
    return store


_GENERATIONS = """
d1 AS (SELECT source AS tenant, doc_id, text FROM documents WHERE source IS NOT NULL),
d2 AS (SELECT tenant, doc_id, CASE WHEN doc_id % 20 = 3 THEN '' WHEN doc_id % 10 = 3 THEN text || ' ' || text ELSE text END AS text FROM d1),
d3 AS (SELECT * FROM d2 WHERE doc_id % 10 <> 7),
d4 AS (SELECT * FROM d3 WHERE tenant <> 'src4'),
docs AS (SELECT 1 AS generation, * FROM d1 UNION ALL SELECT 2, * FROM d2 UNION ALL SELECT 3, * FROM d3 UNION ALL SELECT 4, * FROM d4),
cut AS (SELECT generation, tenant, doc_id, length(text) AS n, unnest(range(0, greatest(CAST(ceil((length(text) - 40) / 160.0) AS BIGINT), 1))) AS i FROM docs WHERE text <> '')
"""


@query(f"""
WITH {_GENERATIONS}
SELECT generation, tenant, count(DISTINCT doc_id) AS documents, count(*) AS chunks, CAST(sum(least(200, n - 160 * i)) AS BIGINT) AS chars FROM cut GROUP BY ALL
""")
def stored_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every generation of the stored chunks, read after all of them were written."""
    store = _store(spark, sf_dir)
    rows = [store.read(n).select(F.lit(n).alias("generation"), "tenant", "doc_id", F.char_length("content").alias("n")) for n in store.numbers()]
    counts = [F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum("n").alias("chars")]
    return reduce(DataFrame.unionByName, rows).groupBy("generation", "tenant").agg(*counts)


@query(f"WITH {_GENERATIONS} SELECT tenant, doc_id, count(*) AS chunks FROM cut WHERE generation = 2 AND tenant IN ('src4', 'src0') GROUP BY ALL")
def stored_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a tenant and the shared one hold in the second generation; the slots of others aren't opened."""
    return maintain.listing(_store(spark, sf_dir).read(2, ["src4", "src0"]).withColumn("title", F.lit("")).withColumn("seq", F.lit(0))).drop("title")


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best by an index that was built from three quarters of the documents and added to."""
    docs = _documents(spark, sf_dir)
    index = InvertedIndex(spark, fresh_path(spark, "index"))
    index.add(docs.where("doc_id % 4 <> 1"))
    index.add(docs.where("doc_id % 4 = 1"))
    return index.top(_benchmark(spark, sf_dir), 10)


@query("""
SELECT event_id, event_type, value, arg_max(value, append) OVER w AS value_before, round(value - arg_max(value, append) OVER w, 6) AS delta
FROM (SELECT *, event_id * 7919 % 100003 AS append FROM events)
WINDOW w AS (PARTITION BY event_type ORDER BY ts GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a run, against the run that was appended last among those of its kind that are older; events came in another order than their times.

    Places of appends repeat from 100,003 events on. Of runs at one place the oldest stands, as SQL's
    ``arg_max`` keeps the first it meets; of those of one time the one with the smallest id.
    """
    place = (F.col("event_id") * 7919 % 100003).alias("place")
    append = F.struct(place, (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("age"), (-F.col("event_id")).alias("id"))
    runs = read(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value", append.alias("append"))
    before = runs.select("event_type", "ts", "append", F.col("value").alias("value_before"))
    found = timeline.asof(runs.drop("append"), before, ["event_type"], "ts", ["value_before"], "append")
    return found.select("event_id", "event_type", "value", "value_before", F.round(F.col("value") - F.col("value_before"), 6).alias("delta"))


@query("""
WITH c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT e.event_id, c.click_id FROM (SELECT * FROM events WHERE event_type <> 'click') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts
""")
def click_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's last click up to each of their other events; of clicks at one time the one appended last."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return timeline.asof(events.where("event_type <> 'click'"), clicks, ["user_id"], "ts", ["click_id"], strict=False).select("event_id", "click_id")


_LRU = 48
_BOUNDED = f"""
e AS (SELECT event_id, event_type, event_type || ':' || (user_id % 40) AS key, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT *, lag(n) OVER (PARTITION BY key ORDER BY n) AS before, row_number() OVER (PARTITION BY key ORDER BY n) AS i FROM e),
far AS (SELECT p.n, count(DISTINCT x.key) AS others FROM p LEFT JOIN e x ON x.n > p.before AND x.n < p.n GROUP BY p.n),
s AS (SELECT p.*, before IS NOT NULL AND others < {_LRU} AS there FROM p JOIN far USING (n)),
r(key, i, event_type, written, hit) AS (
  SELECT key, i, event_type, us, false FROM s WHERE i = 1
  UNION ALL
  SELECT s.key, s.i, s.event_type, CASE WHEN s.there AND s.us - r.written <= 21600000000 THEN r.written ELSE s.us END, s.there AND s.us - r.written <= 21600000000
  FROM r JOIN s ON s.key = r.key AND s.i = r.i + 1
)
"""


@query(f"WITH RECURSIVE {_BOUNDED} SELECT event_type AS kind, count(*) FILTER (WHERE hit) AS hits, count(*) AS lookups FROM r GROUP BY 1")
def bounded_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a cache that holds 48 keys, each for six hours from when it is written."""
    events = read(spark, sf_dir, "events")
    lookups = events.select("event_id", F.concat_ws(":", "event_type", (F.col("user_id") % 40).cast("string")).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    hits = timeline.bounded_cache_hits(lookups, 21_600_000_000, _LRU)
    return hits.groupBy(F.split_part("key", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count_if("hit").alias("hits"), F.count("*").alias("lookups"))


@query("""
WITH d1 AS (SELECT source AS tenant, doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 13 <> 4),
d2 AS (SELECT source AS tenant, doc_id, CASE WHEN doc_id % 20 = 3 THEN '' WHEN doc_id % 10 = 3 THEN text || ' ' || text ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 7 <> 3),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.text AS old, b.text AS new FROM d1 a FULL JOIN d2 b ON a.doc_id = b.doc_id),
n AS (SELECT count(*) AS all1 FROM d1),
c AS (SELECT count(*) FILTER (WHERE new IS NOT NULL AND old IS DISTINCT FROM new) AS built, count(*) FILTER (WHERE new IS NULL) AS deleted, count(*) FILTER (WHERE old = new) AS kept FROM j),
size1 AS (SELECT CAST(sum(greatest(CAST(ceil((length(text) - 40) / 160.0) AS BIGINT), 1)) AS BIGINT) AS chunks FROM d1 WHERE text <> ''),
size2 AS (SELECT CAST(sum(greatest(CAST(ceil((length(text) - 40) / 160.0) AS BIGINT), 1)) AS BIGINT) AS chunks FROM d2 WHERE text <> '')
SELECT 1 AS run, 1 AS generation, all1 AS built, CAST(0 AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS kept, chunks FROM n, size1
UNION ALL SELECT 2, 1, 0, 0, all1, chunks FROM n, size1
UNION ALL SELECT 3, 2, built, deleted, kept, chunks FROM c, size2
""")
def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ingests: of most documents; of the same, which writes nothing; and after some were added, changed and removed."""
    docs, root = _documents(spark, sf_dir), fresh_path(spark, "ingest")
    store, contract = ChunkStore(spark, f"{root}/chunks", buckets=2), {"schema_version": 2, "chunk_size": 200, "chunk_overlap": 40}
    first, last = docs.where("doc_id % 13 <> 4"), docs.where("doc_id % 10 <> 3").unionByName(_changed(docs)).where("doc_id % 7 <> 3")
    rows = []
    for run, now in enumerate((first, first, last), 1):
        told = ingest(store, now, _cut, contract, f"{root}/manifest")
        rows.append((run, told["generation"], told["built"], told["deleted"], told["kept"]))
    counts = [store.read(n).agg(F.count("*").alias("chunks")).select(F.lit(n).alias("g"), "chunks") for n in store.numbers()]
    told = spark.createDataFrame(rows, "run int, generation int, built long, deleted long, kept long")
    return told.join(reduce(DataFrame.unionByName, counts), F.col("generation") == F.col("g")).drop("g")


def zipped(parts: dict[str, str]) -> bytes:
    """An archive of XML parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in parts.items():
            archive.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def _xml(text: str) -> str:
    return escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", text))


def docx_of(text: str) -> bytes:
    """A text as a DOCX, a paragraph for each line."""
    paragraphs = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_xml(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    return zipped({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{paragraphs}</w:body></w:document>'})


def xlsx_of(title: str, rows: list[list[str]]) -> bytes:
    """Rows of cells as a workbook of one sheet."""
    cells = lambda row: "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{_xml(c)}</t></is></c>' for c in row)
    main, odf = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return zipped(
        {
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{odf}"><sheets><sheet name="{_xml(title)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{"".join(f"<row>{cells(r)}</row>" for r in rows)}</sheetData></worksheet>',
        }
    )


@query(f"""
WITH documents AS (SELECT doc_id, lang, source, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM documents),
{NORMALIZED}
SELECT doc_id || '.docx' AS path, nullif(t, '') AS text, CASE WHEN t = '' THEN 'no text' END AS error FROM f
UNION ALL SELECT doc_id || '.xlsx', '【工作表: ' || lang || '】' || chr(10) || 'doc_id: ' || doc_id || '; source: ' || source, NULL FROM documents
""")
def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a DOCX, a paragraph for each line, and what is known of it as an XLSX; made in tasks, and read back as files are."""

    @F.pandas_udf("binary")
    def as_docx(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: docx_of(t or ""))

    @F.pandas_udf("binary")
    def as_xlsx(ids: pd.Series, langs: pd.Series, sources: pd.Series) -> pd.Series:
        return pd.Series([xlsx_of(lang or "", [["doc_id", "source"], [str(i), s or ""]]) for i, lang, s in zip(ids, langs, sources, strict=True)])

    docs = read(spark, sf_dir, "documents")
    texts = docs.select(F.concat("doc_id", F.lit(".docx")).alias("path"), as_docx("text").alias("content"))
    tables = docs.select(F.concat("doc_id", F.lit(".xlsx")).alias("path"), as_xlsx("doc_id", "lang", "source").alias("content"))
    return files.extract(texts.unionByName(tables)).select("path", "text", "error")


def _graph(spark: SparkSession, sf_dir: str) -> graph_index.GraphIndex:
    """A graph of all vectors, added in two parts."""
    index = graph_index.GraphIndex(spark, fresh_path(spark, "graph"))
    index.add(_vectors(spark, sf_dir).where("id % 3 <> 1"))
    index.add(_vectors(spark, sf_dir).where("id % 3 = 1"))
    return index


@query(f"WITH {_NEAREST} SELECT query_id, id, similarity, rank FROM nearest WHERE rank <= 5")
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest by a walk whose beam holds a whole block, which finds all."""
    return _graph(spark, sf_dir).nearest(_vector_queries(spark, sf_dir), 5, beam=graph_index.BLOCK * 2)


@query(f"WITH {_NEAREST} SELECT count(*) AS neighbours, true AS enough FROM nearest WHERE rank <= 10")
def knn_graph_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a walk with the usual beam finds at least 0.95 of the ten nearest."""
    asked = _vector_queries(spark, sf_dir)
    told = graph_index.recall(_graph(spark, sf_dir).nearest(asked, 10), retrieval.nearest(_vectors(spark, sf_dir), asked, 10))
    return told.select("neighbours", (F.col("recall") >= 0.95).alias("enough"))


@query(f"""
WITH {_FEEDBACK}
SELECT event_id, coalesce(tenant, '-') AS tenant, rating FROM f ORDER BY event_id % 5 DESC, event_id DESC LIMIT 700
""")
def compacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 700 ratings of a log of five appends that is rewritten after every second one."""
    rows = _feedback(spark, sf_dir).select("event_id", "tenant", "rating")
    log = Log(spark, fresh_path(spark, "log"), "event_id long, tenant string, rating long", ["event_id"], keep=700, every=2)
    for i in range(5):
        log.append(rows.where(F.col("event_id") % 5 == i))
    return log.read().select("event_id", F.coalesce("tenant", F.lit("-")).alias("tenant"), "rating")


@query("""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id || ':doc/' || doc_id AS path, count(*) FILTER (WHERE regexp_matches(line, 'token = "[0-9a-f]{16,}"')) AS n FROM lines GROUP BY doc_id
HAVING count(*) FILTER (WHERE regexp_matches(line, 'token = "[0-9a-f]{16,}"')) > 0
""")
def scanned_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the added lines of commits; keys by file, however the history stands."""
    docs = read(spark, sf_dir, "documents").where("text is not null")
    patch = F.concat(F.lit("+++ b/doc/"), F.col("doc_id"), F.lit("\n+"), F.regexp_replace("text", "\n", "\n+"))
    hits = privacy.scan_history(docs.select(F.col("doc_id").cast("string").alias("path"), patch.alias("text")), {"token": tx.MORE_RULES["token"]})
    return hits.groupBy("path").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id * 1000 + turn AS answer_id, nullif(trim(string_split(text, chr(10))[-1]), '') AS answer, CASE WHEN trim(string_split(text, chr(10))[-1]) = '' THEN 'degraded' ELSE 'direct' END AS intent
FROM conversations WHERE role = 'user' AND (contains(lower(text), 'the') OR contains(lower(text), 'que'))
""")
def direct_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that are answered without looking anything up, by the plain stand-in for a model that writes."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user'").withColumn("intent", answering.intent(F.col("text"), (), ("the", "que")))
    asked = turns.where("intent = 'direct'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "text")
    return answering.generated(asked, "answer_id")


@query("""
WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type <> 'view' THEN event_type || event_id END AS text FROM events),
g AS (SELECT *, ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR AS gap FROM e),
b AS (SELECT user_id, max(ts) FILTER (WHERE gap) AS begun FROM g GROUP BY user_id)
SELECT e.user_id AS conv_id, least(count(text), 3) AS n, arg_max(text, (ts, event_id)) FILTER (WHERE text IS NOT NULL) AS newest
FROM e JOIN b USING (user_id) WHERE begun IS NULL OR ts >= begun GROUP BY 1
""")
def session_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store of sessions holds of each user in the end: three messages at most, gone after twelve hours without an event; views only touch."""
    events = read(spark, sf_dir, "events")
    text = F.when(F.col("event_type") != "view", F.concat("event_type", "event_id"))
    log = events.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), text.alias("text"))
    return state.session_store(log, 3, "12 hours")
