"""Queries over the standard tables. Each is registered with the SQL that gives the same rows, where SQL can.

Stand-ins: documents are the knowledge base and ``source`` is a tenant; benchmark items are the
queries; events serve as logs of calls, feedback and metrics; conversations as sessions. Tables
are read whole and texts are used whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import answering, chunk, evaluate, maintain, memory, privacy, retrieval, state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The tenant whose documents all others see.
_SHARED = "src0"
#: Words of the test tables that stand in for tags and keywords.
WORDS = ("the", "les", "und", "que", "ation")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("tenant"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), "text", F.concat(F.lit("src"), F.col("item_id") % 20).alias("tenant"))


_DELETED = "[" + tx.character_class(tx.PUNCTUATION).replace("'", "''") + r"\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _bigrams(column: str) -> str:
    """SQL for the bigrams of a text column, as a list."""
    chars = f"list_filter(string_split(regexp_replace({column}, '{_DELETED}', '', 'g'), ''), lambda x: x <> '')"
    return f"(SELECT CASE WHEN len(c) > 1 THEN list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]) ELSE c END FROM (SELECT {chars} AS c))"


_BM25 = f"""
toks AS (SELECT doc_id, {_bigrams("coalesce(text, '')")} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS (SELECT doc_id, tok, any_value(dl) AS dl, count(*) AS f FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS tok FROM toks) GROUP BY doc_id, tok),
asked AS (SELECT query_id, tok, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_bigrams("text")}) AS tok FROM benchmark) GROUP BY query_id, tok),
vocab AS (SELECT tok, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, stats GROUP BY tok),
weighed AS (
  SELECT doc_id, p.tok, idf * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) AS weight
  FROM post p JOIN vocab v ON v.tok = p.tok, stats WHERE p.tok IN (SELECT tok FROM asked)
),
scores AS (SELECT query_id, doc_id, round(sum(weight * times), 6) AS score FROM weighed JOIN asked USING (tok) GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
"""


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25_top(_documents(spark, sf_dir), _benchmark(spark, sf_dir), 10)


@query(f"WITH {_BM25} SELECT tok, df, round(idf, 6) AS idf FROM vocab")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return retrieval.vocabulary(retrieval.postings(docs), retrieval.corpus_stats(docs)).withColumn("idf", F.round("idf", 6))


@query(f"""
WITH {_BM25},
cut AS (SELECT r.*, d.source FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 30),
own AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cut WHERE source IN ('src' || (query_id % 20), 'src0'))
SELECT query_id, doc_id, rank, round(0.4 + 0.5 * score / max(score) OVER (PARTITION BY query_id), 4) AS similarity FROM own WHERE rank <= 10
""")
def bm25_norm_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _documents(spark, sf_dir), _benchmark(spark, sf_dir)
    ranked = retrieval.within_tenant(retrieval.bm25_top(docs, asked, 30), docs, asked, 10, shared="src0")
    return retrieval.normalised_scores(ranked).select("query_id", "doc_id", "rank", "similarity")


_COSINE = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
_NEAREST = f"""
v AS (SELECT vec_id AS id, label AS tenant, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (
  SELECT q.id AS query_id, v.id, round({_COSINE.format("v.e", "q.e")}, 6) AS similarity
  FROM v JOIN v q ON v.tenant = q.tenant WHERE q.id % 100 = 0
),
nearest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM near)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("tenant"), F.col("embedding").alias("vector"))


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100, against all rows."""
    return _vectors(spark, sf_dir).where("id % 100 = 0").withColumnRenamed("id", "query_id")


@query(f"WITH {_NEAREST} SELECT query_id, id, similarity, rank FROM nearest WHERE rank <= 5")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 5)


@query(f"""
WITH {_BM25}, {_NEAREST},
bv AS (SELECT query_id, CAST(id AS VARCHAR) AS content, rank AS v_rank, NULL::BIGINT AS w_rank, similarity, NULL::DOUBLE AS score FROM nearest WHERE rank <= 9),
bw AS (SELECT query_id * 100 AS query_id, CAST(doc_id AS VARCHAR) AS content, NULL::BIGINT AS v_rank, rank AS w_rank, NULL::DOUBLE AS similarity, score FROM ranked WHERE rank <= 9),
best AS (SELECT query_id, greatest(max(score), 1.0) AS best FROM bw GROUP BY query_id),
fused AS (
  SELECT query_id, content, round(sum(coalesce(1.0 / (60 + v_rank), 0) + coalesce(1.0 / (60 + w_rank), 0)), 9) AS fused,
         min(v_rank) AS v_rank, min(w_rank) AS w_rank, arg_min(similarity, v_rank) AS cosine, max(score) AS score
  FROM (SELECT * FROM bv UNION ALL SELECT * FROM bw) GROUP BY query_id, content
),
out AS (SELECT f.*, best, row_number() OVER (PARTITION BY f.query_id ORDER BY fused DESC, v_rank NULLS LAST, w_rank) AS rank FROM fused f LEFT JOIN best USING (query_id))
SELECT query_id, content, fused, rank, CASE WHEN v_rank IS NOT NULL THEN round(cosine, 4) ELSE round(0.4 + 0.5 * score / best, 4) END AS similarity,
       CASE WHEN v_rank IS NOT NULL THEN 'cosine' ELSE 'bm25_norm' END AS score_kind
FROM out WHERE rank <= 3
""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents are ids here; vectors and documents share ids only for the sake of the test."""
    by_vector = retrieval.nearest(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 9).withColumn("content", F.col("id").cast("string"))
    by_word = retrieval.bm25_top(_documents(spark, sf_dir), _benchmark(spark, sf_dir), 9)
    by_word = by_word.select((F.col("query_id") * 100).alias("query_id"), F.col("doc_id").cast("string").alias("content"), "rank", "score")
    return retrieval.retrieve("hybrid", by_vector, by_word, 3)


@query(f"""
WITH {_NEAREST},
idx AS (SELECT query_id, id, similarity, rank, rank - 1 AS idx FROM nearest WHERE rank <= 12),
given AS (SELECT query_id, idx, round(((query_id + idx * 7) % 10) / 10.0, 4) AS relevance FROM idx WHERE idx % 3 <> 1),
j AS (SELECT i.*, relevance, count(relevance) OVER w AS usable, count(*) OVER w AS n FROM idx i LEFT JOIN given USING (query_id, idx) WINDOW w AS (PARTITION BY query_id)),
s AS (SELECT *, CASE WHEN usable > 0 AND n > 1 THEN round(coalesce(relevance, 0.0), 4) END AS rerank_score FROM j)
SELECT query_id, id, rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, idx) AS new_rank FROM s
""")
def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.nearest(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), retrieval.over_fetch(5, True))
    idx = F.col("rank") - 1
    scores = hits.where(idx % 3 != 1).select("query_id", idx.alias("idx"), F.lit(0).alias("seq"), (((F.col("query_id") + idx * 7) % 10) / 10).alias("relevance"))
    return retrieval.rerank(hits, scores).select("query_id", "id", "rank", "rerank_score", "new_rank")


@query(f"""
WITH {_NEAREST},
hits AS (SELECT query_id, rank AS seq, 'd' || (id % 4) AS doc_id, CASE WHEN id % 5 > 0 THEN id % 5 END AS chunk_index, 'c' || (id % 3) AS content, similarity,
                CASE WHEN id % 2 = 0 THEN round((id % 7) / 7.0, 6) END AS rerank_score FROM nearest WHERE rank <= 20),
k AS (SELECT *, coalesce(rerank_score, similarity) AS by_score,
             row_number() OVER (PARTITION BY query_id, doc_id, coalesce(CAST(chunk_index AS VARCHAR), content) ORDER BY coalesce(rerank_score, similarity) DESC, seq) AS n FROM hits)
SELECT query_id, seq, doc_id, chunk_index, content, similarity, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY by_score DESC, seq) AS rank FROM k WHERE n = 1
""")
def multihop_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.nearest(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 20)
    hits = near.select(
        "query_id", F.col("rank").alias("seq"), F.concat(F.lit("d"), F.col("id") % 4).alias("doc_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("chunk_index"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("content"), "similarity", F.when(F.col("id") % 2 == 0, F.round((F.col("id") % 7) / 7, 6)).alias("rerank_score"),
    )
    return retrieval.best_per_chunk(hits)


@query("""
WITH c AS (SELECT DISTINCT source AS tenant, doc_id % 500 AS doc_id, min(doc_id) AS seq FROM documents WHERE source IN ('src3', 'src0') GROUP BY ALL),
x AS (SELECT source AS tenant, doc_id % 500 AS doc_id, count(*) AS chunks FROM documents WHERE source IN ('src3', 'src0') GROUP BY ALL)
SELECT tenant, x.doc_id, c.seq AS title, chunks FROM x JOIN c USING (tenant, doc_id)
""")
def tenant_visible_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    seen = maintain.visible(docs, "src3", "src0").select("tenant", (F.col("doc_id") % 500).alias("doc_id"), F.col("doc_id").alias("title"), F.col("doc_id").alias("seq"))
    return maintain.listing(seen)


#: SQL that normalises the texts of documents: f (doc_id, t).
NORMALIZED = r"""
a AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
b AS (SELECT doc_id, regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t FROM a),
c AS (SELECT doc_id, replace(replace(t, chr(160), ' '), chr(12288), ' ') AS t FROM b),
d AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([\x{4e00}-\x{9fff}])[ \t]+([\x{4e00}-\x{9fff}])', '\1\2', 'g'), '([\x{4e00}-\x{9fff}])[ \t]+([\x{4e00}-\x{9fff}])', '\1\2', 'g') AS t FROM c),
e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM d),
f AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda l: trim(l)), chr(10)), '^\s+|\s+$', '', 'g') AS t FROM e)
"""


@query(f"WITH {NORMALIZED} SELECT doc_id, t AS text, length(t) AS chars FROM f")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", tx.normalize(F.col("text")).alias("text"))
    return docs.withColumn("chars", F.char_length("text").cast("long"))


@query(f"""
SELECT doc_id, CASE WHEN len(t) > 0 THEN array_to_string(t, ' + ') ELSE '{tx.OTHER_TAG}' END AS tags
FROM (SELECT doc_id, list_filter({list(WORDS)}, lambda w: contains(text, w)) AS t FROM documents)
""")
def tag_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.tags(F.col("text"), WORDS).alias("tags"))


@query(r"""
WITH n AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)\.[^.]+$', '\1')) AS s FROM pages)
SELECT page_id, CASE WHEN s = '' THEN 'document' WHEN regexp_matches(s, '^[A-Za-z0-9_.\-]+$') THEN s ELSE 'doc_' || substr(sha1(s), 1, 10) END AS doc_id,
       CASE WHEN url = '' THEN 'doc' ELSE regexp_replace(url, '[^A-Za-z0-9_.\-]', '_', 'g') END AS safe_id
FROM n
""")
def derive_doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", tx.doc_id_of(F.col("url")).alias("doc_id"), tx.safe_id(F.col("url")).alias("safe_id"))


@query("SELECT doc_id, sha256('7|' || coalesce(source, '') || '|' || coalesce(lang, '') || '|' || coalesce(text, '')) AS key FROM documents")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", tx.cache_key(F.lit(7), F.col("source"), F.col("lang"), F.col("text")).alias("key"))


@query(f"SELECT doc_id, len(t) AS n, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_bigrams("coalesce(text, '')")} AS t FROM documents)")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = read(spark, sf_dir, "documents").select("doc_id", tx.bigrams(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


_MANIFESTS = """
after_ AS (SELECT doc_id, sha1(coalesce(text, '')) AS sha1 FROM documents WHERE doc_id % 7 <> 3),
before_ AS (SELECT doc_id, CASE WHEN doc_id % 11 = 2 THEN 'old' ELSE sha1(coalesce(text, '')) END AS sha1, doc_id % 5 AS chunks FROM documents WHERE doc_id % 13 <> 4),
diff AS (
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id,
         CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.sha1 = b.sha1 THEN 'same' ELSE 'changed' END AS change,
         CASE WHEN a.sha1 = b.sha1 THEN b.chunks END AS chunks
  FROM after_ a FULL JOIN before_ b ON a.doc_id = b.doc_id
)
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the documents, made by rule."""
    docs = read(spark, sf_dir, "documents")
    whole = maintain.manifest(docs)
    old = F.when(F.col("doc_id") % 11 == 2, "old").otherwise(F.col("sha1")).alias("sha1")
    return whole.where("doc_id % 13 <> 4").select("doc_id", old, (F.col("doc_id") % 5).alias("chunks")), whole.where("doc_id % 7 <> 3")


@query(f"WITH {_MANIFESTS} SELECT doc_id, change, chunks FROM diff")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.diff(*_snapshots(spark, sf_dir))


@query(f"""
WITH {_MANIFESTS}
SELECT doc_id, change, CASE WHEN change = 'removed' THEN 'delete' WHEN change = 'same' THEN 'keep' WHEN doc_id % 17 = 5 THEN 'failed' ELSE 'build' END AS action FROM diff
""")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _snapshots(spark, sf_dir)
    return maintain.plan(before, after, rebuild=False, failed=F.col("doc_id") % 17 == 5)


@query("""
WITH d AS (SELECT doc_id, string_split(text, '') AS c, length(text) AS n FROM documents WHERE text <> ''),
s AS (SELECT doc_id, c, unnest(range(0, greatest(CAST(ceil((n - 40) / 160.0) AS BIGINT), 1))) AS chunk_index FROM d)
SELECT doc_id, chunk_index, chunk_index * 160 AS start, array_to_string(c[chunk_index * 160 + 1 : chunk_index * 160 + 200], '') AS content FROM s
""")
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.sliding_chunks(read(spark, sf_dir, "documents"))


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.recursive_chunks(read(spark, sf_dir, "documents"))


_HITS = f"""
{_BM25},
hits AS (SELECT query_id, rank, d.text AS content, [b.text] AS keywords FROM ranked r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 10),
firsts AS (SELECT query_id, min(rank) FILTER (WHERE contains(content, keywords[1])) AS first_rank FROM hits GROUP BY query_id)
"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, asked = _documents(spark, sf_dir), _benchmark(spark, sf_dir)
    ranked = retrieval.bm25_top(docs, asked, 10)
    joined = ranked.join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    return joined.join(asked.select("query_id", F.array("text").alias("keywords")), "query_id")


@query(f"""
WITH {_HITS}
SELECT k, count(*) AS n_cases, round(avg(CASE WHEN coalesce(first_rank <= k, false) THEN 1.0 ELSE 0.0 END), 6) AS recall
FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN firsts USING (query_id), (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k
""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall(_benchmark(spark, sf_dir), evaluate.first_relevant(_hits(spark, sf_dir)))


@query(f"""
WITH {_HITS}, j AS (SELECT query_id, string_agg(content, '' ORDER BY rank) AS all_text FROM hits GROUP BY query_id)
SELECT count(*) AS n_cases, round(coalesce(avg(CASE WHEN coalesce(contains(all_text, b.text), false) THEN 1.0 ELSE 0.0 END), 0.0), 6) AS hit_rate
FROM benchmark b LEFT JOIN j ON j.query_id = b.item_id WHERE b.item_id % 10 <> 9
""")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _benchmark(spark, sf_dir).select("query_id", F.array("text").alias("keywords"), (F.col("query_id") % 10 == 9).alias("expect_refusal"))
    return evaluate.hit_rate(cases, _hits(spark, sf_dir).drop("keywords"))


_RUNS = """
runs AS (SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS run, event_type = 'error' AS judge, round(avg(value), 6) AS hit_rate FROM events GROUP BY ALL)
"""


@query(f"WITH {_RUNS} SELECT run, judge, hit_rate, round(hit_rate - lag(hit_rate) OVER (PARTITION BY judge ORDER BY run), 4) AS hit_rate_delta FROM runs")
def eval_delta_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    run = F.unix_date(F.col("ts").cast("date")).cast("long").alias("run")
    runs = events.groupBy(run, (F.col("event_type") == "error").alias("judge")).agg(F.round(F.avg("value"), 6).alias("hit_rate"))
    return evaluate.against_previous(runs, "judge", "run", ["hit_rate"])


@query("SELECT d.lang, count(*) AS n, count(l.quality) AS judged, round(avg(l.quality), 6) AS average FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def judge_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluate.averages(scored, "quality", ["lang"])


_FEEDBACK = "f AS (SELECT event_id, ts, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN '' ELSE 't' || (user_id % 5) END AS tenant, 1 + CAST(floor(value) AS BIGINT) % 5 AS rating FROM events)"


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("user_id") % 5
    tenant = F.when(t == 0, None).when(t == 1, "").otherwise(F.concat(F.lit("t"), t))
    return read(spark, sf_dir, "events").select("event_id", "ts", tenant.alias("tenant"), (1 + F.floor("value") % 5).alias("rating"))


@query(f"""
WITH {_FEEDBACK}
SELECT coalesce(nullif(tenant, ''), 'default') AS tenant, count(*) AS n, round(avg(rating), 2) AS average, count(*) FILTER (WHERE rating <= 2) AS negative,
       round(count(*) FILTER (WHERE rating <= 2) / count(*), 4) AS negative_rate
FROM f GROUP BY 1
""")
def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.feedback_stats(_feedback(spark, sf_dir))


@query(f"""
WITH {_FEEDBACK}
SELECT tenant, event_id, rating, place FROM (
  SELECT coalesce(nullif(tenant, ''), 'default') AS tenant, event_id, rating, row_number() OVER (PARTITION BY coalesce(nullif(tenant, ''), 'default') ORDER BY ts DESC, event_id) AS place
  FROM f WHERE rating <= 2) WHERE place <= 10
""")
def recent_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest bad ratings of each tenant."""
    log = _feedback(spark, sf_dir).where("rating <= 2").withColumn("tenant", F.coalesce(F.nullif("tenant", F.lit("")), F.lit("default")))
    return retrieval.top(log, "tenant", [F.desc("ts"), F.asc("event_id")], 10, "place").select("tenant", "event_id", "rating", "place")


@query("""
WITH b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户: ' ELSE '助手: ' END || text, chr(10) ORDER BY back DESC) AS prompt, count(*) AS n FROM b WHERE back <= 6 GROUP BY conv_id
""")
def session_history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = state.last_messages(read(spark, sf_dir, "conversations"), 6).withColumn("line", tx.prompt_line(F.col("role"), F.col("text")))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "line")))  # six entries a conversation
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"), F.count("*").alias("n"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, k
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.sessions(read(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts")


_KEY = "CASE WHEN user_id % 10 = 9 THEN NULL WHEN user_id % 10 = 8 THEN 9007199254740992 + user_id // 10 % 3 ELSE user_id END"
_CALLS = f"""
calls AS (SELECT event_id, {_KEY} AS key, epoch_us(ts) AS us FROM events),
e AS (SELECT event_id, key, coalesce(key, -1) AS k, us, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS n FROM calls)
"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of users, some of whom have no key, and some neighbouring keys beyond 2 ** 53."""
    user = F.col("user_id")
    key = F.when(user % 10 == 9, None).when(user % 10 == 8, F.lit(2**53) + F.floor(user / 10) % 3).otherwise(user)
    return read(spark, sf_dir, "events").select("event_id", key.cast("long").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query(f"""
WITH RECURSIVE {_CALLS},
r(key, k, n, event_id, tokens, us, day, used, verdict, retry) AS (
  SELECT key, k, n, event_id, 2 * 21600000000, us, us // 86400000000, 1, 'ok', NULL::BIGINT FROM e WHERE n = 1
  UNION ALL
  SELECT key, k, n, event_id, CASE WHEN verdict = 'ok' THEN t - 21600000000 ELSE t END, us, us // 86400000000, CASE WHEN verdict = 'ok' THEN u + 1 ELSE u END, verdict,
         CASE WHEN verdict = 'rate' THEN greatest(1, CAST(ceil((21600000000 - t) / 1000000) AS BIGINT))
              WHEN verdict = 'quota' THEN greatest(1, CAST(ceil(((us // 86400000000 + 1) * 86400000000 - us) / 1000000) AS BIGINT)) END
  FROM (SELECT *, CASE WHEN t < 21600000000 THEN 'rate' WHEN u >= 2 THEN 'quota' ELSE 'ok' END AS verdict
        FROM (SELECT e.key, e.k, e.n, e.event_id, e.us, least(3 * 21600000000, r.tokens + e.us - r.us) AS t, CASE WHEN r.day = e.us // 86400000000 THEN r.used ELSE 0 END AS u
              FROM r JOIN e ON e.k = r.k AND e.n = r.n + 1))
)
SELECT event_id, key, verdict = 'ok' AS allowed, retry AS retry_after, CASE verdict WHEN 'ok' THEN 2 - used WHEN 'quota' THEN 0 END AS remaining FROM r
""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tokens a user, one more every six hours, two calls a day."""
    return state.rate_limit(_calls(spark, sf_dir), 3, 21_600_000_000, 2)


@query("""
WITH RECURSIVE e AS (SELECT event_id, event_type || ':' || (user_id % 40) AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type || ':' || (user_id % 40) ORDER BY ts, event_id) AS n FROM events),
r(key, n, event_id, written, hit) AS (
  SELECT key, n, event_id, us, false FROM e WHERE n = 1
  UNION ALL
  SELECT e.key, e.n, e.event_id, CASE WHEN e.us - r.written <= 7200000000 THEN r.written ELSE e.us END, e.us - r.written <= 7200000000 FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1
)
SELECT split_part(key, ':', 1) AS kind, count(*) FILTER (WHERE hit) AS hits, count(*) AS lookups, round(count(*) FILTER (WHERE hit) / count(*), 4) AS ratio FROM r GROUP BY 1
""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    lookups = events.select("event_id", F.concat_ws(":", "event_type", (F.col("user_id") % 40).cast("string")).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    hits = state.cache_hits(lookups, 7_200_000_000)
    n = F.count_if("hit")
    return hits.groupBy(F.split_part("key", F.lit(":"), F.lit(1)).alias("kind")).agg(n.alias("hits"), F.count("*").alias("lookups"), F.round(n / F.count("*"), 4).alias("ratio"))


_PII = r"""
lines AS (SELECT path, unnest(string_split(t, chr(10))) AS content, generate_subscripts(string_split(t, chr(10)), 1) AS line
          FROM (SELECT 'doc/' || doc_id AS path, regexp_replace(text, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g') AS t FROM documents
                UNION ALL SELECT 'page/' || page_id, regexp_replace(html, '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g') FROM pages)),
found AS (
  SELECT path, line, '邮箱' AS rule, regexp_extract(content, '[\w.+-]+@[\w-]+(\.[\w-]+)*\.[A-Za-z]{2,}') AS m FROM lines
  UNION ALL SELECT path, line, '手机号', regexp_extract(content, '(?:^|[^0-9])(1[3-9][0-9]{9})(?:$|[^0-9])', 1) FROM lines
  UNION ALL SELECT path, line, '身份证号', regexp_extract(content, '(?:^|[^0-9])([0-9]{17}[0-9Xx])(?:$|[^0-9])', 1) FROM lines
  UNION ALL SELECT path, line, '密钥样式', regexp_extract(content, 'sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----') FROM lines
  UNION ALL SELECT path, line, '本地绝对路径', regexp_extract(content, '/home/[A-Za-z0-9_.-]+/|/mnt/[a-z]/|[A-Za-z]:\\\\[Uu]sers\\\\') FROM lines
  UNION ALL SELECT path, line, 'card', regexp_extract(content, '(?:^|[^0-9])([0-9]{16})(?:$|[^0-9])', 1) FROM lines
  UNION ALL SELECT path, line, 'token', regexp_extract(content, 'token = "[0-9a-f]{16,}"') FROM lines
),
hits AS (SELECT path, line, rule, length(m) AS length FROM found
         WHERE m <> '' AND NOT (rule = '邮箱' AND (suffix(m, 'example.com') OR suffix(m, 'example.org') OR suffix(m, 'example.net') OR suffix(m, 'users.noreply.github.com') OR suffix(m, 'localhost'))))
"""


def _pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), "text")
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), "page_id").alias("path"), F.col("html").alias("text"))
    return privacy.scan(docs.unionByName(pages), {**tx.PRIVACY_RULES, **tx.MORE_RULES})


@query(f"WITH {_PII} SELECT path, line, rule, length FROM hits")
def pii_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in rules and two of our own ("card", "token") over documents and pages."""
    return _pii(spark, sf_dir)


@query(f"WITH {_PII} SELECT rule, count(*) AS n, count(DISTINCT path) AS n_paths, max(length) AS longest FROM hits GROUP BY rule")
def pii_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.summary(_pii(spark, sf_dir))


@query("SELECT event_type, user_id % 3 AS status, count(*) AS n FROM events GROUP BY ALL")
def metric_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.counters(read(spark, sf_dir, "events").withColumn("status", F.col("user_id") % 3), ["event_type", "status"])


@query("""
SELECT event_type, le, count(*) FILTER (WHERE le IS NULL OR value <= le) AS n
FROM events, (SELECT unnest([0.5, 1, 5, 10, 30, 60, 120, NULL]) AS le) WHERE value IS NOT NULL GROUP BY event_type, le
""")
def metric_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(read(spark, sf_dir, "events"), "value", [0.5, 1, 5, 10, 30, 60, 120], ["event_type"])


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY event_type")
def gauge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.last_value(read(spark, sf_dir, "events"), "value", F.struct("ts", "event_id"), ["event_type"])


@query("SELECT user_id, max(ts) AS last_access FROM events GROUP BY user_id ORDER BY last_access DESC, user_id LIMIT 20")
def lru_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty keys touched last."""
    return state.least_recently_used(read(spark, sf_dir, "events"), "user_id", "ts", 20)


@query("SELECT event_id, CAST(ceil((epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) - epoch_us(ts)) / 1000000.0) AS BIGINT) AS retry_after FROM events")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return events.select("event_id", state.seconds_to_midnight(F.col("t")).alias("retry_after"))


_MEMORY = """
turns AS (
  SELECT 't' || (conv_id % 4) AS tenant, 'u' || (conv_id % 9) AS "user", conv_id * 1000 + turn AS seq,
         CASE WHEN (conv_id + turn) % 7 = 5 THEN '' WHEN (conv_id + turn) % 7 = 4 THEN NULL ELSE 'slot' || (turn % 5) END AS key, text, round((conv_id % 10) / 10.0, 6) AS importance, conv_id, turn
  FROM conversations WHERE role = 'user'
),
stored AS (
  SELECT tenant, "user", 'm' || min(seq) AS memory_id, key, arg_min(text, seq) AS text, arg_min(importance, seq) AS importance,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(min(seq) % 300 AS INTEGER)) AS updated_at
  FROM turns WHERE turn < 2 GROUP BY tenant, "user", key
),
facts AS (SELECT * FROM turns WHERE turn >= 2 AND length(trim(text)) >= 5),
newest AS (SELECT *, row_number() OVER (PARTITION BY tenant, "user", key ORDER BY seq DESC) AS n FROM facts WHERE key <> ''),
ops AS (
  SELECT n.tenant, n."user", n.key, n.seq, n.text, n.importance, s.memory_id AS target_id, CASE WHEN s.memory_id IS NULL THEN 'ADD' WHEN s.text = n.text THEN 'NOOP' ELSE 'UPDATE' END AS op
  FROM newest n LEFT JOIN stored s ON s.tenant = n.tenant AND s."user" = n."user" AND s.key = n.key WHERE n.n = 1
  UNION ALL
  SELECT tenant, "user", key, seq, text, importance, NULL, 'ADD' FROM facts WHERE key IS NULL OR key = ''
),
merged AS (
  SELECT s.tenant, s."user", s.memory_id, s.key, coalesce(o.text, s.text) AS text, coalesce(o.importance, s.importance) AS importance,
         CASE WHEN o.op IS NULL THEN s.updated_at ELSE TIMESTAMP '2024-12-01 00:00:00' END AS updated_at
  FROM stored s LEFT JOIN (SELECT * FROM ops WHERE op = 'UPDATE') o ON o.target_id = s.memory_id AND o.tenant = s.tenant AND o."user" = s."user"
  UNION ALL
  SELECT tenant, "user", substr(md5(tenant || '|' || "user" || '|' || coalesce(key, '') || '|' || text || '|' || seq), 1, 16), key, text, importance, TIMESTAMP '2024-12-01 00:00:00' FROM ops WHERE op = 'ADD'
)
"""
_NOW = "2024-12-01 00:00:00"


def _memory(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored memories from the first turns of the conversations, and facts from the later ones; some of both without a slot."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    kind = (F.col("conv_id") + F.col("turn")) % 7
    key = F.when(kind == 5, "").when(kind != 4, F.concat(F.lit("slot"), F.col("turn") % 5))
    turns = turns.select(
        F.concat(F.lit("t"), F.col("conv_id") % 4).alias("tenant"), F.concat(F.lit("u"), F.col("conv_id") % 9).alias("user"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        key.alias("key"), "text", F.round((F.col("conv_id") % 10) / 10, 6).alias("importance"), "turn",
    )
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.min("seq") % 300).cast("int")).cast("timestamp")
    stored = turns.where("turn < 2").groupBy("tenant", "user", "key").agg(
        F.concat(F.lit("m"), F.min("seq")).alias("memory_id"), F.min_by("text", "seq").alias("text"), F.min_by("importance", "seq").alias("importance"), day.alias("updated_at")
    )
    return stored, turns.where("turn >= 2").drop("turn")


@query(f'WITH {_MEMORY} SELECT tenant, "user", memory_id, key, text, importance, CAST(updated_at AS VARCHAR) AS updated_at FROM merged')
def memory_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, facts = _memory(spark, sf_dir)
    merged = memory.merge(stored, memory.operations(facts, stored), F.lit(_NOW).cast("timestamp"))
    return merged.select("tenant", "user", "memory_id", "key", "text", "importance", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query(f"""
WITH {_MEMORY}
SELECT tenant, "user", count(*) AS extracted, count(*) FILTER (WHERE op = 'ADD') AS added, count(*) FILTER (WHERE op = 'UPDATE') AS updated,
       count(*) FILTER (WHERE op = 'DELETE') AS deleted, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (WHERE op = 'NOOP') AS unchanged
FROM (SELECT tenant, "user", op FROM ops UNION ALL SELECT tenant, "user", 'DELETE' FROM stored WHERE importance < 0.2) GROUP BY tenant, "user"
""")
def memory_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of a round that also takes away what is hardly important."""
    stored, facts = _memory(spark, sf_dir)
    gone = stored.where("importance < 0.2").select(*memory.OWNER, F.lit("DELETE").alias("op"))
    return memory.counts(memory.operations(facts, stored).unionByName(gone, allowMissingColumns=True))


@query(f"""
WITH {_MEMORY}
SELECT tenant, "user", memory_id, importance, place FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant, "user" ORDER BY importance DESC, updated_at DESC, memory_id) AS place FROM merged) WHERE place <= 3
""")
def memory_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best memories of each user."""
    stored, facts = _memory(spark, sf_dir)
    merged = memory.merge(stored, memory.operations(facts, stored), F.lit(_NOW).cast("timestamp"))
    return memory.capped(merged, 3).select("tenant", "user", "memory_id", "importance", "place")


@query(f"""WITH {_MEMORY} SELECT tenant, "user", memory_id FROM merged WHERE updated_at >= TIMESTAMP '{_NOW}' - INTERVAL 180 DAY""")
def memory_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, facts = _memory(spark, sf_dir)
    now = F.lit(_NOW).cast("timestamp")
    return memory.live(memory.merge(stored, memory.operations(facts, stored), now), now).select("tenant", "user", "memory_id")


@query(f"""
WITH {_NEAREST},
four AS (SELECT query_id, id, round(similarity, 4) AS similarity FROM nearest WHERE rank <= 20),
b AS (SELECT *, round(similarity + 0.15 * round((id % 11) / 11.0, 6), 6) AS boosted FROM four),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, id) AS place FROM b)
SELECT query_id, id, similarity, boosted, place FROM r WHERE place <= 5 AND similarity >= 0.1
""")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _vectors(spark, sf_dir).withColumn("importance", F.round((F.col("id") % 11) / 11, 6))
    return memory.recalled(memory.search(stored, _vector_queries(spark, sf_dir), 5), 0.1)


@query("""
WITH k AS (SELECT * FROM (VALUES ('key1', '', 1), ('key1', 'acme', 2), (' ', 'nobody', 3), ('key2', '', 4), ('key3', 'zeta', 5)) t(api_key, tenant_id, seq)),
u AS (SELECT api_key, arg_max(tenant_id, seq) AS tenant_id FROM k WHERE trim(api_key) <> '' GROUP BY api_key)
SELECT event_id, 'key' || (user_id % 6) AS api_key, CASE WHEN tenant_id = '' THEN 'default' ELSE tenant_id END AS tenant_id FROM events LEFT JOIN u ON u.api_key = 'key' || (user_id % 6)
""")
def tenant_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([("key1", "", 1), ("key1", "acme", 2), (" ", "nobody", 3), ("key2", "", 4), ("key3", "zeta", 5)], "api_key string, tenant_id string, seq int")
    calls = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("key"), F.col("user_id") % 6).alias("api_key"))
    return maintain.tenants_of(calls, keys).select("event_id", "api_key", "tenant_id")


@query(f"""
WITH {_BM25}, h AS (SELECT query_id, rank, doc_id, d.source, d.lang FROM ranked JOIN documents d USING (doc_id) WHERE rank <= 3)
SELECT query_id, string_agg('[参考文档 ' || rank || '] (来源: ' || source || ', 标签: ' || lang || ')' || chr(10) || 'doc ' || doc_id, chr(10) || chr(10) ORDER BY rank) AS prompt FROM h GROUP BY query_id
""")
def context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    ranked = retrieval.bm25_top(_documents(spark, sf_dir), _benchmark(spark, sf_dir), 3)
    hits = ranked.join(docs.select("doc_id", F.col("source").alias("title"), F.col("lang").alias("tags")), "doc_id").withColumn("content", F.concat(F.lit("doc "), "doc_id"))
    return retrieval.context_block(hits)


@query("""
SELECT doc_id, 'id: ' || doc_id || '; name: ' || source || '; ' || lang || chr(10) || 'name: ' || lang AS text FROM documents
""")
def render_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda *c: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in c])
    rows = F.array(cell("id", " name ", ""), cell("", " ", ""), cell(F.col("doc_id").cast("string"), F.col("source"), F.col("lang")), cell("", F.col("lang"), ""))
    return read(spark, sf_dir, "documents").select("doc_id", tx.render_rows(rows).alias("text"))


@query("SELECT identity, count(*) AS n FROM (SELECT DISTINCT event_id, identity FROM (SELECT event_id, 'u' || (user_id % 7) AS identity FROM events UNION ALL SELECT event_id, 'u' || (event_id % 7) FROM events)) GROUP BY identity")
def identity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id") % 7).alias("author"), F.concat(F.lit("u"), F.col("event_id") % 7).alias("committer"))
    return privacy.identities(commits)


@query("""
WITH old AS (SELECT source AS tenant, doc_id, lang FROM documents), new AS (SELECT source AS tenant, doc_id, 'xx' AS lang FROM documents WHERE doc_id % 3 = 0)
SELECT * FROM old WHERE doc_id % 3 <> 0 AND NOT (tenant = 'src1' AND doc_id % 2 = 0) UNION ALL SELECT * FROM new WHERE NOT (tenant = 'src1' AND doc_id % 2 = 0)
""")
def upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _documents(spark, sf_dir).drop("text").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("tenant", "doc_id", "lang")
    new = stored.where("doc_id % 3 = 0").withColumn("lang", F.lit("xx"))
    gone = stored.where("tenant = 'src1' and doc_id % 2 = 0")
    return maintain.delete(maintain.upsert(stored, new, ["tenant", "doc_id"]), gone, ["tenant", "doc_id"])


@query("SELECT count(quality) AS checked, count(*) AS total, round(avg(quality), 6) AS accuracy FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.doc_id % 9 = 4")
def refusal_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand in for cases; one in nine expects a refusal, and its label says whether it came."""
    cases = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return evaluate.refusals(cases.select((F.col("doc_id") % 9 == 4).alias("expect_refusal"), (F.col("quality") == 1).alias("refused")))


_SCORED_HITS = f"""
{_HITS},
best AS (SELECT query_id, round(0.4 + 0.5 * score / max(score) OVER (PARTITION BY query_id), 4) AS similarity, rank FROM ranked WHERE rank <= 10)
"""


@query(f"""
WITH {_SCORED_HITS}
SELECT k, round(avg(CASE WHEN coalesce(first_rank <= k, false) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(similarity), 6) AS mean_top
FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN firsts USING (query_id) LEFT JOIN (SELECT * FROM best WHERE rank = 1) USING (query_id), (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY k
""")
def topk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scan_cuts(_benchmark(spark, sf_dir), retrieval.normalised_scores(_hits(spark, sf_dir)))


@query(f"""
WITH {_HITS},
own AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, d.text AS content, b.text AS keyword
        FROM ranked r JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE rank <= 30 AND d.source IN ('src' || (query_id % 20), 'src0')),
own_first AS (SELECT query_id, min(rank) AS first_rank FROM own WHERE rank <= 10 AND contains(content, keyword) GROUP BY query_id),
both_ AS (SELECT 'all' AS mode, query_id, first_rank FROM firsts UNION ALL SELECT 'tenant', query_id, first_rank FROM own_first)
SELECT mode, k, round(avg(CASE WHEN coalesce(first_rank <= k, false) THEN 1.0 ELSE 0.0 END), 6) AS recall
FROM (SELECT item_id AS query_id, m AS mode FROM benchmark, (SELECT unnest(['all', 'tenant']) AS m)) LEFT JOIN both_ USING (query_id, mode), (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY mode, k
""")
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over all documents, and over those that the query's tenant may see."""
    docs, asked = _documents(spark, sf_dir), _benchmark(spark, sf_dir)
    own = retrieval.within_tenant(retrieval.bm25_top(docs, asked, 30), docs, asked, 10, shared="src0")
    words = asked.select("query_id", F.array("text").alias("keywords"))
    own_hits = own.select("query_id", "doc_id", "rank").join(docs.select("doc_id", F.col("text").alias("content")), "doc_id").join(words, "query_id")
    return evaluate.compare_modes(asked, {"all": _hits(spark, sf_dir), "tenant": own_hits})


@query("""
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'hello') OR contains(lower(text), 'thanks') THEN 'direct' WHEN contains(lower(text), 'und') OR contains(lower(text), 'and') THEN 'multi_hop' ELSE 'rag_qa' END AS intent
FROM conversations WHERE role = 'user'
""")
def intent_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", answering.intent(F.col("text"), ("und", "and"), ("hello", "thanks")).alias("intent"))


@query(r"""
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, turn, 'short' AS key, regexp_extract(text, '[A-Z][a-z]+\.') AS text FROM u UNION ALL SELECT conv_id, turn, 'pair', regexp_extract(text, '[a-z]+, [a-z]+') FROM u)
SELECT * FROM f WHERE text <> ''
""")
def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.facts(read(spark, sf_dir, "conversations"), {"short": r"[A-Z][a-z]+\.", "pair": r"[a-z]+, [a-z]+"})


@query(f"""
WITH {_NEAREST},
c AS (SELECT query_id AS fact_id, id AS memory_id, 0 AS part, rank AS n FROM nearest WHERE rank <= 8 AND id % 2 = 0 UNION ALL SELECT query_id, id, 1, rank FROM nearest WHERE rank <= 3),
one AS (SELECT *, row_number() OVER (PARTITION BY fact_id, memory_id ORDER BY part, n) AS k FROM c)
SELECT fact_id, memory_id, row_number() OVER (PARTITION BY fact_id ORDER BY part, n, memory_id) AS seq FROM one WHERE k = 1
""")
def consolidation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.nearest(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 8).select(F.col("query_id").alias("fact_id"), F.col("id").alias("memory_id"), F.col("rank").alias("n"))
    return answering.candidates(near.where("memory_id % 2 = 0"), near.where("n <= 3"))


@query("""
SELECT conv_id AS answer_id, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE turn % 4 <> 3), '') AS answer, bool_or(turn % 4 = 3) AS complete FROM conversations GROUP BY conv_id
""")
def assembled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("turn") % 4 == 3, "done").otherwise("delta")
    return answering.assembled(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("seq"), kind.alias("kind"), "text"))


@query(f"""
WITH tok AS (SELECT doc_id, unnest({_bigrams("coalesce(text, '')")}) AS tok FROM documents),
n AS (SELECT doc_id, CAST('0x' || substr(md5(tok), 1, 6) AS BIGINT) % 64 AS bucket, count(*) AS n FROM tok GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM n
""")
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.hashed_features(read(spark, sf_dir, "documents"))


@query(f"""
WITH {_NEAREST},
r1 AS (SELECT query_id, id, similarity, rank AS seq, rank FROM nearest WHERE rank <= 4),
sure AS (SELECT query_id FROM r1 WHERE rank = 1 AND similarity > 0.6),
r2 AS (SELECT query_id, id, similarity, rank - 4 + 1000000 AS seq FROM nearest WHERE rank BETWEEN 5 AND 8 AND query_id NOT IN (SELECT query_id FROM sure) AND query_id % 200 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, 'd' || (id % 3), id % 5 ORDER BY similarity DESC, seq) AS n FROM (SELECT query_id, id, similarity, seq FROM r1 UNION ALL SELECT * FROM r2))
SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, seq) AS rank FROM k WHERE n = 1
""")
def multi_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds over the vectors without the query itself as a sure hit; the second asks for the next four neighbours."""
    near = retrieval.nearest(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 8)
    chunk_of = [F.concat(F.lit("d"), F.col("id") % 3).alias("doc_id"), (F.col("id") % 5).alias("chunk_index"), F.col("id").cast("string").alias("content"), F.lit(None).cast("double").alias("rerank_score"), F.lit("cosine").alias("score_kind")]

    def round_of(asked: DataFrame) -> DataFrame:
        # the text of a query is the first rank that its round looks at
        met = near.join(asked.select("query_id", F.col("text").cast("int").alias("from_rank")), "query_id")
        met = met.where((F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + 4))
        return met.select("query_id", "id", "similarity", (F.col("rank") - F.col("from_rank") + 1).alias("rank"), *chunk_of)

    def rewrite(asked: DataFrame) -> DataFrame:
        return asked.select("query_id", F.when(F.col("query_id") % 200 != 0, "5").otherwise(F.col("text")).alias("text"))

    asked = _vector_queries(spark, sf_dir).select("query_id", F.lit("1").alias("text"))
    return answering.multi_hop(asked, round_of, rewrite).select("query_id", "id", "similarity", "rank")
