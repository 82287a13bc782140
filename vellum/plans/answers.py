"""Queries over chunks from retrieval to the prompt and its sources, and over memories and their judgement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import answering, chunk, evaluate, memory, memory_run, retrieval
from ..sources.shared import stored
from .queries import _MEMORY, _NOW, _SHARED, _benchmark, _bigrams, _documents, _hits, _HITS, _memory, query, read


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding chunks of all documents: id, doc_id, tenant, content, vector."""
    cut = chunk.sliding_chunks(_documents(spark, sf_dir), keep=("tenant",))
    return cut.select((F.col("doc_id") * 1_000_000 + F.col("chunk_index")).alias("id"), "doc_id", "tenant", "content", answering.hashed_vector(F.col("content")).alias("vector"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir).withColumn("vector", answering.hashed_vector(F.col("text")))


def _vector_sql(source: str) -> str:
    """SQL for the hashed vectors of (id, tok)."""
    return f"(SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM (SELECT id, CAST('0x' || substr(md5(tok), 1, 6) AS BIGINT) % 64 AS bucket, count(*) AS n FROM {source} GROUP BY ALL))"


_CHUNK_SQL = f"""
d AS (SELECT doc_id, source, string_split(text, '') AS c, length(text) AS n FROM documents WHERE text <> ''),
s AS (SELECT doc_id, source, c, unnest(range(0, greatest(CAST(ceil((n - 40) / 160.0) AS BIGINT), 1))) AS i FROM d),
chunks AS (SELECT doc_id * 1000000 + i AS id, doc_id, source AS tenant, array_to_string(c[i * 160 + 1 : i * 160 + 200], '') AS content FROM s),
b AS (SELECT item_id AS query_id, text, 'src' || (item_id % 20) AS tenant FROM benchmark),
lists AS (SELECT id, {_bigrams("content")} AS t FROM chunks),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM lists),
ctok AS (SELECT id, len(t) AS dl, unnest(t) AS tok FROM lists),
qtok AS (SELECT query_id AS id, unnest({_bigrams("text")}) AS tok FROM b),
post AS (SELECT id, tok, any_value(dl) AS dl, count(*) AS f FROM ctok WHERE tok IN (SELECT tok FROM qtok) GROUP BY id, tok),
vocab AS (SELECT tok, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, stats GROUP BY tok),
times AS (SELECT id AS query_id, tok, count(*) AS times FROM qtok GROUP BY ALL),
scores AS (
  SELECT query_id, p.id, round(sum(times * idf * f * 2.5 / (f + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM post p JOIN vocab USING (tok) JOIN times USING (tok), stats GROUP BY query_id, p.id
),
words_all AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scores WHERE score > 0),
cv AS MATERIALIZED {_vector_sql("ctok")},
qv AS MATERIALIZED {_vector_sql("qtok")},
seen AS (SELECT c.id, b.query_id FROM chunks c JOIN b ON c.tenant IN (b.tenant, '{_SHARED}')),
cosines AS (SELECT query_id, s.id, round(sum(cv.w * qv.w), 6) AS similarity FROM seen s JOIN cv ON cv.id = s.id JOIN qv ON qv.id = s.query_id AND qv.bucket = cv.bucket GROUP BY query_id, s.id),
zeros AS (SELECT query_id, id, 0.0 AS similarity FROM seen s WHERE EXISTS (SELECT 1 FROM cv WHERE cv.id = s.id) AND EXISTS (SELECT 1 FROM qv WHERE qv.id = s.query_id)
          AND NOT EXISTS (SELECT 1 FROM cosines c WHERE c.query_id = s.query_id AND c.id = s.id)),
vectors AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT * FROM cosines UNION ALL SELECT * FROM zeros)),
"""


def _words_sql(k: int) -> str:
    return f"words AS (SELECT w.query_id, w.id, score, row_number() OVER (PARTITION BY w.query_id ORDER BY score DESC, w.id) AS rank FROM words_all w JOIN seen USING (query_id, id) WHERE r <= {3 * k}),"


def _hybrid_sql(k: int) -> str:
    return f"""
{_words_sql(k)}
part AS (
  SELECT query_id, content, v.id, rank AS v_rank, NULL::BIGINT AS w_rank, similarity, NULL::DOUBLE AS score FROM vectors v JOIN chunks USING (id) WHERE rank <= {3 * k}
  UNION ALL SELECT query_id, content, w.id, NULL, rank, NULL, score FROM words w JOIN chunks USING (id)
),
best AS (SELECT query_id, greatest(max(score), 1.0) AS best FROM words GROUP BY query_id),
fused AS (
  SELECT query_id, content, round(sum(coalesce(1.0 / (60 + v_rank), 0) + coalesce(1.0 / (60 + w_rank), 0)), 9) AS fused, min(v_rank) AS v_rank, min(w_rank) AS w_rank,
         arg_min(similarity, v_rank) AS cosine, max(score) AS score, arg_max(id, (v_rank IS NOT NULL, coalesce(v_rank, w_rank))) AS id
  FROM part GROUP BY query_id, content
),
hybrid AS (
  SELECT f.query_id, id, content, row_number() OVER (PARTITION BY f.query_id ORDER BY fused DESC, v_rank NULLS LAST, w_rank) AS rank,
         CASE WHEN v_rank IS NOT NULL THEN round(cosine, 4) ELSE round(0.4 + 0.5 * score / best, 4) END AS similarity, CASE WHEN v_rank IS NOT NULL THEN 'cosine' ELSE 'bm25_norm' END AS score_kind
  FROM fused f LEFT JOIN best USING (query_id) QUALIFY rank <= {k}
),
"""


@query(f"WITH {_CHUNK_SQL} {_hybrid_sql(3)} x AS (SELECT 1) SELECT query_id, id, content, rank, similarity, score_kind FROM hybrid")
def hybrid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chunks a question by vectors and words, within the question's tenant and the shared one."""
    return retrieval.retrieve_chunks("hybrid", _chunks(spark, sf_dir), _asked(spark, sf_dir), 3, _SHARED)


_MODES = ("hybrid", "vector", "bm25")
_KEYWORDS = "[substr(text, 1, 25), right(text, 25)]"


@query(f"""
WITH {_CHUNK_SQL} {_hybrid_sql(10)}
hits AS (
  SELECT 'hybrid' AS mode, query_id, content, rank FROM hybrid
  UNION ALL SELECT 'vector', query_id, content, rank FROM vectors JOIN chunks USING (id) WHERE rank <= 10
  UNION ALL SELECT 'bm25', query_id, content, rank FROM words JOIN chunks USING (id) WHERE rank <= 10
),
firsts AS (SELECT mode, h.query_id, min(rank) AS first_rank FROM hits h JOIN b USING (query_id) WHERE len(list_filter({_KEYWORDS}, lambda w: contains(content, w))) > 0 GROUP BY ALL)
SELECT mode, k, round(avg(CASE WHEN coalesce(first_rank <= k, false) THEN 1.0 ELSE 0.0 END), 6) AS recall
FROM (SELECT query_id, m AS mode FROM b, (SELECT unnest({list(_MODES)}) AS m)) LEFT JOIN firsts USING (query_id, mode), (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY mode, k
""")
def mode_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of hybrid, vector and word retrieval over the same chunks; a hit holds the beginning or the end of the passage asked for."""
    chunks, asked = _chunks(spark, sf_dir), _asked(spark, sf_dir)
    words = asked.select("query_id", F.array(F.left("text", F.lit(25)), F.right("text", F.lit(25))).alias("keywords"))
    found = retrieval.retrieve_modes(_MODES, chunks, asked, 10, _SHARED)
    return evaluate.compare_modes(asked, {m: hits.join(words, "query_id") for m, hits in found.items()})


_ASK_SQL = f"""
{_CHUNK_SQL} {_hybrid_sql(12)}
idx AS (SELECT *, rank - 1 AS idx FROM hybrid),
given AS (SELECT query_id, idx, round(((query_id + idx * 7) % 10) / 10.0, 4) AS relevance FROM idx WHERE idx % 3 <> 1),
j AS (SELECT i.*, relevance, count(relevance) OVER w AS usable, count(*) OVER w AS n FROM idx i LEFT JOIN given USING (query_id, idx) WINDOW w AS (PARTITION BY query_id)),
sc AS (SELECT *, CASE WHEN usable > 0 AND n > 1 THEN round(coalesce(relevance, 0.0), 4) END AS rerank_score FROM j),
used AS (SELECT u.*, d.source, d.lang FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, idx) AS place FROM sc) u JOIN documents d ON d.doc_id = u.id // 1000000 WHERE place <= 3)
"""


def _ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-fetch, rerank by given scores, cut to three; with what a prompt and its sources show."""
    hits = stored(retrieval.retrieve_chunks("hybrid", _chunks(spark, sf_dir), _asked(spark, sf_dir), retrieval.over_fetch(3, True), _SHARED), "hits")
    shown = retrieval.candidate_texts(hits)
    scores = shown.where("idx % 3 <> 1").select("query_id", "idx", F.lit(0).alias("seq"), (((F.col("query_id") + F.col("idx") * 7) % 10) / 10).alias("relevance"))
    ranked = retrieval.rerank(hits, scores).where("new_rank <= 3").drop("rank").withColumnRenamed("new_rank", "rank")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("tags"))
    return stored(ranked.withColumn("doc_id", F.floor(F.col("id") / 1_000_000)).withColumn("chunk_index", F.col("id") % 1_000_000).join(docs, "doc_id"), "used")


@query(f"""
WITH {_ASK_SQL},
p AS (SELECT query_id, string_agg('[参考文档 ' || place || '] (来源: ' || source || ', 标签: ' || lang || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY place) AS prompt, arg_min(content, place) AS answer FROM used GROUP BY query_id)
SELECT query_id, coalesce(prompt, '{retrieval.NO_HITS}') AS prompt, coalesce(answer, '{tx.REFUSAL_MARKERS[0]}') AS answer FROM b LEFT JOIN p USING (query_id)
""")
def ask_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked for each question, and the plain answer that stands for its own."""
    hits, asked = _ask(spark, sf_dir), _benchmark(spark, sf_dir)
    return retrieval.context_block(hits, asked).join(answering.extractive_answer(hits, asked), "query_id")


@query(f"WITH {_ASK_SQL} SELECT query_id, place AS rank, content, CAST(id // 1000000 AS VARCHAR) AS doc_id, source AS title, lang AS tags, id % 1000000 AS chunk_index, round(similarity, 4) AS similarity FROM used")
def ask_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.citations(_ask(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")))


@query(f"""
WITH {_HITS}, c AS (SELECT query_id, rank - 1 AS idx, substr(content, 1, 300) AS text, count(*) OVER (PARTITION BY query_id) AS n FROM hits)
SELECT query_id, idx, text FROM c WHERE n > 1
""")
def rerank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scorer is shown: 300 characters of each candidate."""
    return retrieval.candidate_texts(_hits(spark, sf_dir))


_REFUSALS = ("not", "nicht")


@query("""
WITH c AS (SELECT conv_id, turn, text, conv_id % 3 = 1 AS expect_refusal FROM conversations WHERE role = 'assistant')
SELECT count(r) AS checked, count(*) AS total, round(avg(CAST(r AS INTEGER)), 6) AS accuracy
FROM (SELECT CASE WHEN text <> '' THEN contains(text, 'not') OR contains(text, 'nicht') END AS r FROM c WHERE expect_refusal)
""")
def refusal_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the conversations, one case in three of which expects a refusal, told by marker words."""
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    refused = F.when(F.col("text") != "", tx.is_refusal(F.col("text"), _REFUSALS))
    return evaluate.refusals(turns.select((F.col("conv_id") % 3 == 1).alias("expect_refusal"), refused.alias("refused")))


_PROBE_SQL = """
u AS (SELECT conv_id, turn, conv_id * 1000 + turn AS step, text FROM conversations WHERE role = 'user'),
probes AS (
  SELECT step, conv_id, CASE WHEN turn % 6 = 4 THEN 'no_memory' ELSE 'check' END AS kind, ['recall', 'isolation', 'conflict'][1 + (conv_id + turn) % 3] AS dimension,
         CASE WHEN conv_id % 4 = 0 THEN [] ELSE ['the', 'und', 'que'] END AS expect_any, CASE WHEN conv_id % 3 = 0 THEN ['ation'] ELSE [] END AS expect_none,
         CASE WHEN conv_id % 5 = 1 THEN ['er', 'ie'] ELSE [] END AS memory_any, CASE WHEN conv_id % 7 = 2 THEN ['ing', 'heit'] ELSE [] END AS memory_none
  FROM u
),
answers AS (SELECT u.step, c.text FROM u JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.turn + 1 AND c.role = 'assistant'),
memories AS (SELECT u.step, m.text FROM u JOIN u m ON m.conv_id = u.conv_id AND m.turn <= u.turn),
stored AS (SELECT step, string_agg(text, chr(10) ORDER BY text) AS stored FROM memories GROUP BY step),
judged AS (
  SELECT p.*, kind <> 'check' OR ((len(expect_any) = 0 OR len(list_filter(expect_any, lambda w: contains(coalesce(a.text, ''), w))) > 0) AND len(list_filter(expect_none, lambda w: contains(coalesce(a.text, ''), w))) = 0
         AND (len(memory_any) = 0 OR len(list_filter(memory_any, lambda w: contains(coalesce(stored, ''), w))) > 0) AND len(list_filter(memory_none, lambda w: contains(coalesce(stored, ''), w))) = 0) AS passed
  FROM probes p LEFT JOIN answers a USING (step) LEFT JOIN stored USING (step)
),
counts AS (SELECT u.conv_id, u.step, count(DISTINCT m.text) AS memories FROM u JOIN u m ON m.conv_id = u.conv_id AND m.turn <= u.turn GROUP BY ALL),
growth AS (SELECT step, coalesce(lag(memories) OVER (PARTITION BY conv_id ORDER BY step), 0) AS memories_before, memories AS memories_after FROM counts)
"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users as the steps of a run: what each expects of the answer that follows and of what is stored by then."""
    turns = read(spark, sf_dir, "conversations")
    u = turns.where("role = 'user'").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("step"), "text")
    words = lambda when, *w: F.when(when, F.array(*map(F.lit, w))).otherwise(F.array().cast("array<string>"))
    conv = F.col("conv_id")
    probes = u.select(
        "step", "conv_id", F.when(F.col("turn") % 6 == 4, "no_memory").otherwise("check").alias("kind"), F.element_at(F.array(*map(F.lit, ("recall", "isolation", "conflict"))), (1 + (conv + F.col("turn")) % 3).cast("int")).alias("dimension"),
        words(conv % 4 != 0, "the", "und", "que").alias("expect_any"), words(conv % 3 == 0, "ation").alias("expect_none"),
        words(conv % 5 == 1, "er", "ie").alias("memory_any"), words(conv % 7 == 2, "ing", "heit").alias("memory_none"),
    )
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    spoken = u.select("conv_id", "turn", "step", F.col("text").alias("said")).join(said, ["conv_id", "turn"], "left").select("step", "said", "answer")
    return probes.withColumnRenamed("conv_id", "user").join(spoken, "step")


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    steps = _probes(spark, sf_dir)
    return steps, memory_run.run(steps, cap=1000)


@query(f"WITH {_PROBE_SQL} SELECT step, kind, dimension, passed, memories_before, memories_after FROM judged JOIN growth USING (step)")
def memory_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a step of a run: judged by its answer and by what the operations so far have left remembered."""
    steps, results = _run(spark, sf_dir)
    return results.join(steps.select("step", "kind", "dimension"), "step").select("step", "kind", "dimension", "passed", "memories_before", "memories_after")


@query(f"""
WITH {_PROBE_SQL}
SELECT dimension, count(*) FILTER (WHERE kind = 'check') AS n, round(avg(CAST(passed AS INTEGER)) FILTER (WHERE kind = 'check'), 6) AS rate,
       round(avg(CAST(memories_after > memories_before AS INTEGER)) FILTER (WHERE kind = 'no_memory'), 6) AS false_memory_rate
FROM judged JOIN growth USING (step) GROUP BY dimension
""")
def memory_probe_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory_run.rates(*_run(spark, sf_dir))


@query(f"""WITH {_MEMORY} SELECT tenant, "user", seq, key, importance, max(importance) OVER (PARTITION BY tenant, "user") AS fallback FROM facts WHERE importance >= 0.3""")
def memory_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts worth keeping of each user's round, and the importance that stands in for a missing one."""
    facts = _memory(spark, sf_dir)[1].where(tx.good_fact(F.col("text"), F.lit(None)))
    return memory.fallback_importance(memory.important(facts), memory.OWNER).select("tenant", "user", "seq", "key", "importance", "fallback")


_LISTED = """SELECT tenant, "user", memory_id, text, row_number() OVER (PARTITION BY tenant, "user" ORDER BY updated_at DESC, memory_id) AS place FROM merged"""


@query(f"""WITH {_MEMORY}, listed AS ({_LISTED}) SELECT tenant, "user", memory_id, place FROM listed WHERE place <= 100""")
def memory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's memories, newest first, a hundred at most."""
    return memory.newest(_merged(spark, sf_dir)).select("tenant", "user", "memory_id", "place")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, facts = _memory(spark, sf_dir)
    return memory.merge(stored, memory.operations(facts, stored), F.lit(_NOW).cast("timestamp"))


@query(f"""
WITH {_MEMORY}, listed AS ({_LISTED})
SELECT tenant || '/' || "user" AS query_id, '{memory.REMEMBERED[0]}2024-12-01{memory.REMEMBERED[1]}' || chr(10) || string_agg('- [fact] ' || text, chr(10) ORDER BY place) AS prompt FROM listed WHERE place <= 5 GROUP BY ALL
""")
def memory_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = memory.newest(_merged(spark, sf_dir), 5).select(F.concat_ws("/", "tenant", "user").alias("query_id"), F.lit("fact").alias("kind"), "text", "place")
    return memory.prompt_block(found, F.lit(_NOW).cast("timestamp"))


@query(f"""
WITH {_MEMORY}, one AS (SELECT tenant, "user", memory_id FROM merged WHERE importance < 0.2), every AS (SELECT DISTINCT tenant, "user" FROM merged WHERE "user" = 'u3')
SELECT m.tenant, m."user", m.memory_id FROM merged m WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.tenant = m.tenant AND o."user" = m."user" AND o.memory_id = m.memory_id)
  AND NOT EXISTS (SELECT 1 FROM every e WHERE e.tenant = m.tenant AND e."user" = m."user")
""")
def memory_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single memories forgotten, then all of some users; rows that name no user, or another's memory, forget nothing."""
    merged = _merged(spark, sf_dir)
    one = merged.where("importance < 0.2").select(*memory.OWNER, "memory_id")
    others = merged.where("importance >= 0.2").select("tenant", F.lit("").alias("user"), "memory_id").unionByName(merged.select("tenant", F.lit("nobody").alias("user"), "memory_id"))
    every = merged.where("user = 'u3'").select(*memory.OWNER).unionByName(merged.select("tenant", F.lit(None).cast("string").alias("user")))
    return memory.forget(memory.forget(merged, one.unionByName(others)), every, one=False).select("tenant", "user", "memory_id")


@query("""
WITH a AS (SELECT conv_id AS answer_id, CASE WHEN conv_id % 2 = 0 THEN 'm' || conv_id END AS memory, CASE conv_id % 5 WHEN 1 THEN 'error' WHEN 2 THEN 'timeout' WHEN 3 THEN NULL ELSE 'ok' END AS outcome, list(text ORDER BY turn) AS deltas
           FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
e AS (SELECT answer_id, list_concat(list_concat(CASE WHEN memory IS NULL THEN [] ELSE [{'kind': 'memory', 'text': memory}] END, [{'kind': 'intent', 'text': 'rag_qa'}]),
      list_concat(list_transform(deltas, lambda d: {'kind': 'delta', 'text': d}), CASE WHEN coalesce(outcome, 'ok') = 'ok' THEN [{'kind': 'sources', 'text': 's' || answer_id}, {'kind': 'done', 'text': NULL}] ELSE [{'kind': outcome, 'text': NULL}] END)) AS e FROM a)
SELECT answer_id, i - 1 AS seq, e[i].kind AS kind, e[i].text AS text FROM (SELECT answer_id, e, unnest(range(1, len(e) + 1)) AS i FROM e)
""")
def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])  # one conversation's turns
    conv = F.col("answer_id")
    answers = turns.groupBy(F.col("conv_id").alias("answer_id")).agg(said.alias("deltas")).select(
        "answer_id", F.when(conv % 2 == 0, F.concat(F.lit("m"), conv)).alias("memory"), F.lit("rag_qa").alias("intent"), "deltas", F.concat(F.lit("s"), conv).alias("sources"),
        F.when(conv % 5 == 1, "error").when(conv % 5 == 2, "timeout").when(conv % 5 != 3, "ok").alias("outcome"),
    )
    return answering.chat_events(answers)
