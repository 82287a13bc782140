import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import answering, evaluate, maintain, memory, retrieval


def test_bm25_finds_the_sentence(spark):
    docs = spark.createDataFrame([(0, "违规罚款500元的处理办法"), (1, "包裹遗失的理赔流程"), (2, "拦截件的退回时限"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "500元罚款怎么处理"), (2, "、、"), (3, None)], "query_id long, text string")
    got = retrieval.bm25_top(docs, asked, 3).collect()
    assert {r["query_id"] for r in got} == {1} and min(got, key=lambda r: r["rank"])["doc_id"] == 0
    best = retrieval.normalised_scores(retrieval.bm25_top(docs, asked, 3)).where("rank = 1").first()
    assert best["similarity"] == 0.9


def test_fusion_by_content(spark):
    by_vector = spark.createDataFrame([(1, "A", 1, 0.95), (1, "C", 2, 0.9)], "query_id long, content string, rank int, similarity double")
    by_word = spark.createDataFrame([(1, "C", 1, 5.0), (1, "D", 2, 3.0)], "query_id long, content string, rank int, score double")
    got = {r["content"]: r for r in retrieval.retrieve("hybrid", by_vector, by_word, 3).collect()}
    assert got["C"]["rank"] == 1 and got["C"]["score_kind"] == "cosine" and got["C"]["similarity"] == 0.9
    assert 0.4 < got["D"]["similarity"] <= 0.9 and got["D"]["score_kind"] == "bm25_norm"
    assert [r["content"] for r in retrieval.retrieve("anything", by_vector, by_word, 1).collect()] == ["A"]


def test_tenant_cut_comes_after_the_ranking(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "s")], "doc_id long, tenant string")
    ranked = spark.createDataFrame([(9, d, 10.0 - d, d) for d in (1, 2, 3)], "query_id long, doc_id long, score double, rank int")
    asked = spark.createDataFrame([(9, "a")], "query_id long, tenant string")
    got = retrieval.within_tenant(ranked, docs, asked, 5, shared="s").collect()
    assert sorted((r["doc_id"], r["rank"]) for r in got) == [(1, 1), (3, 2)]


def test_rerank_rules(spark):
    hits = spark.createDataFrame([(q, f"c{i}", i + 1) for q in (1, 2, 3) for i in range(4)] + [(4, "c0", 1)], "query_id long, content string, rank int")
    scores = spark.createDataFrame([(1, 2, 0, 0.1), (1, 2, 1, 0.9), (1, 9, 2, 1.0), (1, 0, 3, 0.5), (2, 7, 0, 0.4), (4, 0, 0, 0.9)], "query_id long, idx int, seq int, relevance double")
    order = {}
    for r in retrieval.rerank(hits, scores).collect():
        order.setdefault(r["query_id"], []).append((r["new_rank"], r["content"], r["rerank_score"]))
    assert [c for _, c, _ in sorted(order[1])] == ["c2", "c0", "c1", "c3"] and [s for _, _, s in sorted(order[1])] == [0.9, 0.5, 0.0, 0.0]
    assert [c for _, c, _ in sorted(order[2])] == [c for _, c, _ in sorted(order[3])] == ["c0", "c1", "c2", "c3"] and order[4][0][2] is None
    assert retrieval.over_fetch(20, True) == 20 and retrieval.over_fetch(5, True) == 12 and retrieval.over_fetch(5, False) == 5


def test_rounds_keep_the_best_of_a_chunk(spark):
    rows = [(1, 1, "X", 1, "t", 0.6, None), (1, 2, "X", 9, "t", 0.8, None), (1, 3, "Y", 9, "t", 0.7, None), (1, 4, "X", 1, "t", 0.65, None), (1, 5, "Z", None, "t", 0.1, 0.99), (1, 6, "Z", None, "t", 0.1, 0.99)]
    got = retrieval.best_per_chunk(spark.createDataFrame(rows, "query_id long, seq int, doc_id string, chunk_index int, content string, similarity double, rerank_score double")).orderBy("rank").collect()
    assert [(r["doc_id"], r["chunk_index"], r["seq"]) for r in got] == [("Z", None, 5), ("X", 9, 2), ("Y", 9, 3), ("X", 1, 4)]


def test_manifest_changes(spark):
    before = spark.createDataFrame([("a", "1", 3), ("b", "2", 4), ("c", "3", 5)], "doc_id string, sha1 string, chunks int")
    after = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "doc_id string, sha1 string")
    assert {r["doc_id"]: (r["change"], r["chunks"]) for r in maintain.diff(before, after).collect()} == {"a": ("same", 3), "b": ("changed", None), "c": ("removed", None), "d": ("added", None)}
    plan = {r["doc_id"]: r["action"] for r in maintain.plan(before, after, True, F.col("doc_id") == "d").collect()}
    assert plan == {"a": "build", "b": "build", "c": "delete", "d": "failed"}
    contract = {"schema_version": 2, "chunk_size": 200, "chunk_overlap": 40}
    assert maintain.same_contract(contract, dict(contract)) and not maintain.same_contract(contract, None) and not maintain.same_contract(contract, {**contract, "chunk_size": 100})


def test_deletes_stay_in_a_tenant(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "tenant string, doc_id int")
    gone = spark.createDataFrame([("a", 1)], "tenant string, doc_id int")
    assert sorted(map(tuple, maintain.delete(rows, gone, ["tenant", "doc_id"]).collect())) == [("a", 2), ("b", 1)]
    try:
        maintain.delete(rows, gone, ["doc_id"])
    except ValueError:
        return
    raise AssertionError("a delete without a tenant must be refused")


def test_unmeasured_is_null_but_for_the_hit_rate(spark):
    none = spark.createDataFrame([], "query_id long, keywords array<string>, expect_refusal boolean")
    hits = spark.createDataFrame([], "query_id long, rank int, content string")
    assert evaluate.hit_rate(none, hits).first()["hit_rate"] == 0.0
    scores = spark.createDataFrame([("a", None), ("a", None), ("b", 0.5), ("b", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["judged"], r["average"]) for r in evaluate.averages(scores, "v", ["g"]).collect()}
    assert got == {"a": (2, 0, None), "b": (2, 1, 0.5)}
    probes = spark.createDataFrame([("isolation", "check", False, 1, 1), ("recall", "check", True, 1, 1), ("false", "no_memory", True, 1, 2)], "dimension string, kind string, passed boolean, memories_before int, memories_after int")
    rates = {r["dimension"]: (r["rate"], r["false_memory_rate"]) for r in evaluate.probe_rates(probes).collect()}
    assert rates == {"isolation": (0.0, None), "recall": (1.0, None), "false": (None, 1.0)}


def test_memories_of_others_are_not_touched(spark):
    stored = spark.createDataFrame([("t", "u", "m1", "city", "lives in Rome", 0.5, None), ("t", "v", "m2", "city", "lives in Oslo", 0.5, None)], "tenant string, user string, memory_id string, key string, text string, importance double, updated_at timestamp")
    ops = spark.createDataFrame([("t", "u", "city", "x", 0.9, "m2", "DELETE"), ("t", "u", None, "lives in Bern", None, "m1", "UPDATE")], "tenant string, user string, key string, text string, importance double, target_id string, op string")
    got = {r["memory_id"]: (r["text"], r["importance"], r["key"]) for r in memory.merge(stored, ops, F.current_timestamp()).collect()}
    assert got == {"m1": ("lives in Bern", 0.5, "city"), "m2": ("lives in Oslo", 0.5, "city")}
    six = spark.createDataFrame([("t", "u", f"m{i}", i / 10, None) for i in range(6)], "tenant string, user string, memory_id string, importance double, updated_at timestamp")
    assert sorted(r["importance"] for r in memory.capped(six, 3).collect()) == [0.3, 0.4, 0.5]


def test_a_fact_without_a_slot_matches_nothing(spark):
    stored = spark.createDataFrame([("t", "u", "m1", "", "has no slot", 0.5, None), ("t", "u", "m2", None, "has none either", 0.5, None), ("t", "u", "m3", "city", "lives in Rome", 0.5, None)], "tenant string, user string, memory_id string, key string, text string, importance double, updated_at timestamp")
    facts = spark.createDataFrame([("t", "u", i, k, f"a fact {i}", 0.5) for i, k in enumerate(["", "", None, None, "city", "city"])], "tenant string, user string, seq int, key string, text string, importance double")
    ops = memory.operations(facts, stored)
    assert sorted((r["seq"], r["op"], r["target_id"]) for r in ops.collect()) == [(0, "ADD", None), (1, "ADD", None), (2, "ADD", None), (3, "ADD", None), (5, "UPDATE", "m3")]
    merged = {r["memory_id"]: r["text"] for r in memory.merge(stored, ops, F.current_timestamp()).collect()}
    assert len(merged) == 7 and merged["m1"] == "has no slot" and merged["m2"] == "has none either" and merged["m3"] == "a fact 5"
    assert memory.merge(stored, memory.operations(facts.limit(0), stored), F.current_timestamp()).count() == 3


def test_expectations(spark):
    rows = [("the cat", ["cat", "dog"], [], True), ("the cat", ["dog"], [], False), ("the cat", ["cat"], ["the"], False), ("", [], [], True), (None, None, ["x"], True), (None, ["x"], None, False)]
    got = spark.createDataFrame([r[:3] for r in rows], "t string, a array<string>, n array<string>").select(evaluate.expected(F.col("t"), F.col("a"), F.col("n"))).collect()
    assert [r[0] for r in got] == [r[3] for r in rows]


def test_bm25_in_batches_equals_the_whole_ranking(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé日x😀") for _ in range(rng.randint(1, 4)))
    docs = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(900, None), (901, "a"), (902, "")], "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(0, 5)))) for i in range(30)] + [(77, "a"), (78, None)], "query_id long, text string")
    want = sorted(map(tuple, retrieval.top(retrieval.bm25(docs, asked), "query_id", [F.desc("score"), F.asc("doc_id")], 7).select("query_id", "doc_id", "score", "rank").collect()))
    for size in (2_000_000, 40):
        monkeypatch.setattr(retrieval, "BATCH_TOKENS", size)
        assert sorted(map(tuple, retrieval.bm25_top(docs, asked, 7).select("query_id", "doc_id", "score", "rank").collect())) == want
    assert retrieval.bm25_top(docs.limit(0), asked, 3).count() == retrieval.bm25_top(docs, asked.limit(0), 3).count() == 0


def test_nearest_in_blocks_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, f"t{i % 3}" if i % 11 else None, [float(x) for x in rng.normal(size=4 if i % 7 else 3)]) for i in range(200)]
    rows += [(500, "t1", [0.0] * 4), (501, "t1", None), (502, "t1", []), (503, "t1", rows[1][2]), (504, "t1", rows[1][2])]
    vectors = spark.createDataFrame(rows, "id long, tenant string, vector array<double>")
    queries = vectors.where("id % 10 < 3 or id > 499").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 13)
    got = sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in retrieval.nearest(vectors, queries, 5).collect())
    want = []
    for q, tenant, v in rows:
        if (q % 10 < 3 or q > 499) and v and any(v) and tenant:
            near = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), i) for i, t, w in rows if t == tenant and w and len(w) == len(v) and any(w))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near[:5])]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
    assert retrieval.nearest(vectors.limit(0), queries, 3).count() == 0


def test_queries_of_a_tenant_are_dealt_to_blocks(spark, monkeypatch):
    """Many queries and many vectors of one tenant, ties included, against all pairs."""
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 40)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 30)
    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (150, 4)).astype(float)
    q = rng.integers(-2, 3, (100, 4)).astype(float)
    rows = [(i, "t" if i % 5 else "u", [float(c) for c in v]) for i, v in enumerate(x)]
    asked = [(i, "t" if i % 7 else "u", [float(c) for c in v]) for i, v in enumerate(q)]
    want = set()
    for name, tenant, v in asked:
        near = sorted((-round(float(np.dot(w, v) / (np.linalg.norm(w) * np.linalg.norm(v))), 6), i) for i, t, w in rows if t == tenant and any(w) and any(v))
        want |= {(name, i, -s + 0.0, k) for k, (s, i) in enumerate(near[:6], 1)}
    got = retrieval.nearest(spark.createDataFrame(rows, "id long, tenant string, vector array<double>"), spark.createDataFrame(asked, "query_id long, tenant string, vector array<double>"), 6)
    assert {(r["query_id"], r["id"], r["similarity"] + 0.0, r["rank"]) for r in got.collect()} == want


def _chunks_and_questions(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdé日x😀-") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = [(i, f"t{i % 4}" if i % 9 else None, rng.choice(texts)) for i in range(400)] + [(900, "t1", ""), (901, "t0", "a"), (902, "t1", "-")]
    questions = [(i, f"t{i % 5}", " ".join(word() for _ in range(rng.randint(0, 9)))) for i in range(30)] + [(77, "t0", "a"), (78, "t1", None), (79, None, texts[0])]
    chunks = spark.createDataFrame(rows, "id long, tenant string, content string").repartition(5).withColumn("vector", answering.hashed_vector(F.col("content")))
    return rows, questions, chunks, spark.createDataFrame(questions, "query_id long, tenant string, text string").withColumn("vector", answering.hashed_vector(F.col("text")))


@pytest.mark.parametrize(("batch", "places"), [(8_192, 16_000_000), (7, 0)])
def test_chunks_are_scanned_where_they_are_made(spark, monkeypatch, batch, places):
    """Rankings equal those of the blocks and of the plain joins; chunks are worked out once for the vectors and twice for the words, whatever the modes."""
    for module in (retrieval, answering):
        monkeypatch.setattr(module, "PAIR_PLACES", places)
    monkeypatch.setattr(retrieval, "BATCH_QUERIES", batch)
    rows, questions, chunks, asked = _chunks_and_questions(spark)
    own = asked.select("query_id", F.explode(F.array_distinct(F.array("tenant", F.lit("t0")))).alias("tenant"), "vector")
    tuples = lambda df: sorted(map(tuple, df.select("query_id", "id", "similarity", "rank").collect()))
    near = tuples(retrieval.nearest(chunks, own, 6))
    assert len(near) > 100 and tuples(retrieval.nearest_scan(chunks, own, 6)) == near
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    found = retrieval.retrieve_modes(("hybrid", "vector", "bm25"), chunks.withColumn("content", counted("content")), asked, 2, "t0")
    got = {m: sorted((r["query_id"], r["rank"], r["id"], r["content"]) for r in df.collect()) for m, df in found.items()}
    if batch > len(questions):
        assert seen.value <= 3 * len(rows)
    content = {i: c for i, _, c in rows}
    assert got["vector"] == sorted((q, r, i, content[i]) for q, i, _, r in near if r <= 2)
    docs = chunks.select(F.col("id").alias("doc_id"), "tenant", F.col("content").alias("text"))
    ranked = retrieval.top(retrieval.bm25(docs, asked), "query_id", [F.desc("score"), F.asc("doc_id")], 6)
    words = retrieval.within_tenant(ranked, docs, asked, 2, "t0").collect()
    assert got["bm25"] == sorted((r["query_id"], r["rank"], r["doc_id"], content[r["doc_id"]]) for r in words) and words
    assert got["hybrid"] and all(content[i] == c for _, _, i, c in got["hybrid"])
