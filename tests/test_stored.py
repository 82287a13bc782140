"""Stored chunks, the inverted index and manifests: what readers see, what is written, and what is passed over."""

import os
import random

import pytest

from vellum.operators import ingest, maintain, memory_run, retrieval
from vellum.operators.inverted import InvertedIndex
from vellum.sources.logs import Log
from vellum.sources.shared import Folder
from vellum.sources.store import ChunkStore

CHUNK = "tenant string, doc_id long, chunk_index int, content string"


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _seen(store, number=None, tenants=None):
    return sorted(map(tuple, store.read(number, tenants).select("tenant", "doc_id", "chunk_index", "content").collect()))


def test_generations_of_chunks(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/store", buckets=4)
    assert store.read().count() == 0
    rows = [(t, d, i, f"{t}{d}.{i}") for t in ("a", "b/ü=1") for d in range(40) for i in range(d % 3 + 1)]
    assert store.upsert(spark.createDataFrame(rows, CHUNK)) == 1
    first = _files(tmp_path)
    new = [("a", 5, 0, "new"), ("a", 99, 0, "more"), ("c", 1, 0, "c")]
    documents = spark.createDataFrame([("a", 5), ("a", 6), ("a", 99), ("c", 1)], "tenant string, doc_id long")
    assert store.upsert(spark.createDataFrame(new, CHUNK), documents) == 2
    after = sorted([r for r in rows if (r[0], r[1]) not in {("a", 5), ("a", 6)}] + new)
    assert _seen(store) == after and _seen(store, 1) == sorted(rows)  # a pinned reader sees what it saw
    second = _files(tmp_path)
    before, now = store.generation(1), store.generation(2)
    touched = {s for s in now.slots if now.slots[s] != before.slots.get(s)}
    assert first < second and len(touched) <= 4 and {f.split("slot=")[1].split("/")[0] for f in second - first} == touched
    assert all(now.slots[s] == before.slots[s] for s in before.slots if s not in touched)
    # one tenant's rows, from its own slots
    mine = store.read(2, ["a"])
    assert {r["tenant"] for r in mine.select("tenant").distinct().collect()} == {"a"} and len(mine.inputFiles()) < len(store.read(2).inputFiles())
    # deletes: another tenant's documents stay, and nothing is written for what isn't there
    assert store.delete(spark.createDataFrame([("nobody", 5), (None, 5)], "tenant string, doc_id long")) == 2
    assert store.delete(spark.createDataFrame([("a", 5), ("c", 1)], "tenant string, doc_id long")) == 3
    assert _seen(store) == [r for r in after if (r[0], r[1]) not in {("a", 5), ("c", 1)}]
    files = _files(tmp_path)
    assert store.delete_tenant("a") == 4 and _files(tmp_path) == files and {r[0] for r in _seen(store)} == {"b/ü=1"}
    assert store.delete_tenant("a") == 4
    with pytest.raises(ValueError, match="tenant"):
        store.upsert(spark.createDataFrame([(None, 1, 0, "x")], CHUNK))
    # the folders that no kept generation names go, the rest can be read
    assert store.expire(2) and _files(tmp_path) < files and store.numbers() == [3, 4]
    assert _seen(store, 3) == [r for r in after if (r[0], r[1]) not in {("a", 5), ("c", 1)}] and {r[0] for r in _seen(store)} == {"b/ü=1"}
    with pytest.raises(LookupError):
        store.read(1)


def test_two_writers_of_one_generation(spark, tmp_path, monkeypatch):
    one, other = (ChunkStore(spark, f"{tmp_path}/store") for _ in range(2))
    stale = other.generation()
    one.upsert(spark.createDataFrame([("a", 1, 0, "one")], CHUNK))
    monkeypatch.setattr(other, "generation", lambda number=None: stale)
    with pytest.raises(FileExistsError):
        other.upsert(spark.createDataFrame([("a", 1, 0, "other")], CHUNK))
    assert _seen(one) == [("a", 1, 0, "one")]


def test_columns_may_be_added(spark, tmp_path):
    store = ChunkStore(spark, f"{tmp_path}/store", buckets=1)
    store.upsert(spark.createDataFrame([("a", 1, 0, "one")], CHUNK))
    store.upsert(spark.createDataFrame([("a", 2, 0, "two", 7)], CHUNK + ", n int"))
    assert sorted(map(tuple, store.read().select("doc_id", "n").collect())) == [(1, None), (2, 7)]


def _docs(rng, n):
    words = ["".join(rng.choice("abcdefgh語") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    return [(i, " ".join(rng.choices(words, weights=range(1, 61), k=rng.choice((1, 4, 30, 200))))) for i in range(n)]


@pytest.mark.parametrize("k", [1, 7])
def test_index_equals_scan(spark, tmp_path, monkeypatch, k):
    from vellum.operators import inverted

    monkeypatch.setattr(inverted, "SHARD_DOCS", 150)
    rng = random.Random(k)
    docs = [*_docs(rng, 900), (-5, None), (2**60, "abc abc"), (2**60 + 1, "abc abc"), (-7, ""), (-8, "a")]
    queries = spark.createDataFrame([(1, docs[10][1]), (2, docs[11][1][:9]), (3, "nothing of that: ζζζ"), (4, None), (5, "abc"), (6, "a")], "query_id long, text string")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = InvertedIndex(spark, f"{tmp_path}/index")
    assert index.top(queries, k).count() == 0
    index.add(frame(docs[:500]))
    pinned = index.top(queries, k)
    index.add(frame(docs[500:]))
    index.add(frame([]))
    assert len(index.segments()) == 2
    want = lambda rows: sorted(map(tuple, retrieval.bm25_top(frame(rows), queries, k).collect()))
    assert sorted(map(tuple, index.top(queries, k).collect())) == want(docs)
    assert sorted(map(tuple, pinned.collect())) == want(docs[:500])  # planned before the second segment was there
    one = queries.where("query_id = 5")
    assert sorted(map(tuple, index.top(one, k).collect())) == [r for r in want(docs) if r[0] == 5]


def test_index_passes_blocks_over(spark, tmp_path):
    """Where a few documents hold what is asked for, most blocks are known not to matter."""
    rng = random.Random(3)
    docs = _docs(rng, 4000)
    docs += [(10_000 + i, "zyxwvu tsrqpo " * 3 + docs[i][1][:20]) for i in range(12)]
    index = InvertedIndex(spark, f"{tmp_path}/index")
    index.add(spark.createDataFrame(docs, "doc_id long, text string"))
    queries = spark.createDataFrame([(1, "zyxwvu tsrqpo ab"), (2, docs[3][1])], "query_id long, text string")
    got = {r["query_id"]: (r["blocks"], r["scored"]) for r in index.reads(queries, 5).collect()}
    assert got[1][0] > 20 and got[1][1] <= 3 and got[2][1] <= got[2][0]
    plan = index.top(queries.where("query_id = 1"), 5)._jdf.queryExecution().toString()
    assert "In(tok" in plan


def test_empty_and_broken_manifests(spark, tmp_path):
    contract = {"schema_version": 2, "chunk_size": 200, "chunk_overlap": 40}
    rows = lambda r: spark.createDataFrame(r, "doc_id string, sha1 string, chunks int")
    path = f"{tmp_path}/manifest"
    maintain.save_manifest(rows([("a", "x", 1)]), contract, path)
    maintain.save_manifest(rows([]), contract, path)
    docs, found = maintain.load_manifest(spark, path)
    assert docs.count() == 0 and found == contract  # nothing is left, which isn't what was there before
    maintain.save_manifest(rows([("b", "y", 2)]), {**contract, "chunk_size": 100}, path)
    docs, found = maintain.load_manifest(spark, path)
    assert [tuple(r) for r in docs.collect()] == [("b", "y", 2)] and not maintain.same_contract(contract, found)
    parts = sorted((f for f in _files(f"{path}/rows")), key=os.path.getmtime)
    with open(parts[-1], "r+b") as f:  # the newest version's rows are damaged
        f.seek(4)
        f.write(b"\x00" * (os.path.getsize(parts[-1]) - 12))
    for crc in (os.path.join(os.path.dirname(p), f".{os.path.basename(p)}.crc") for p in parts):
        if os.path.exists(crc):
            os.remove(crc)
    assert maintain.load_manifest(spark, path) is None
    other = f"{tmp_path}/other"
    Folder(spark, f"{other}/versions").put("000000000001.json", "{not json")
    assert maintain.load_manifest(spark, other) is None


def test_files_appear_once(spark, tmp_path):
    folder = Folder(spark, f"{tmp_path}/folder")
    assert folder.names() == []
    folder.put("a.json", "ü")
    with pytest.raises(FileExistsError):
        folder.put("a.json", "b")
    assert folder.read("a.json") == "ü" and folder.names() == ["a.json"]
    folder.remove("a.json")
    assert folder.names() == []


CONTRACT = {"schema_version": 2, "chunk_size": 200, "chunk_overlap": 40}


def _lines(docs):
    """A chunk for each line."""
    return docs.selectExpr("tenant", "doc_id", "posexplode(filter(split(text, '\\n'), x -> x <> '')) as (chunk_index, content)")


def test_ingest_writes_what_changed(spark, tmp_path, monkeypatch):
    store, path = ChunkStore(spark, f"{tmp_path}/chunks", 2), f"{tmp_path}/manifest"
    frame = lambda rows: spark.createDataFrame(rows, "tenant string, doc_id long, text string")
    docs = [("a", 1, "x\ny"), ("a", 2, "z"), ("b", 1, "w"), ("b", 3, None)]
    told = ingest.ingest(store, frame(docs), _lines, CONTRACT, path)
    assert told == {"built": 4, "deleted": 0, "kept": 0, "generation": 1}
    files = _files(tmp_path)
    assert ingest.ingest(store, frame(docs), _lines, CONTRACT, path) == {"built": 0, "deleted": 0, "kept": 4, "generation": 1}
    assert _files(tmp_path) == files  # a second run writes nothing
    changed = [("a", 1, "x"), ("b", 1, "w"), ("b", 3, ""), ("c", 9, "n")]
    # a run that dies between the chunks and the manifest is repeated to the same end
    with monkeypatch.context() as m:
        m.setattr(ingest, "save_manifest", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            ingest.ingest(store, frame(changed), _lines, CONTRACT, path)
    told = ingest.ingest(store, frame(changed), _lines, CONTRACT, path)
    assert told == {"built": 2, "deleted": 1, "kept": 2, "generation": 3}
    assert _seen(store) == _seen(store, 2) == [("a", 1, 0, "x"), ("b", 1, 0, "w"), ("c", 9, 0, "n")]
    assert {(r["doc_id"], r["chunks"]) for r in maintain.load_manifest(spark, path)[0].collect()} == {('{"t":"a","d":"1"}', 1), ('{"t":"b","d":"1"}', 1), ('{"t":"b","d":"3"}', 0), ('{"t":"c","d":"9"}', 1)}
    # another contract builds everything, and what is in no manifest goes
    store.upsert(spark.createDataFrame([("z", 5, 0, "stray")], CHUNK))
    assert ingest.ingest(store, frame(changed), _lines, {**CONTRACT, "chunk_size": 100}, path)["built"] == 4 and len(_seen(store)) == 3


def test_ingest_of_a_stream(spark, tmp_path):
    store, schema = ChunkStore(spark, f"{tmp_path}/chunks", 2), "tenant string, doc_id long, text string, seq long"
    batches = [[("a", 1, "x", 1), ("a", 2, "y", 2), ("a", 1, "x2", 3)], [("a", 2, "y", 4)], [("a", 2, "", 5), ("b", 1, "w\nv", 6)]]
    generations = []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = ingest.ingest_stream(stream, store, _lines, CONTRACT, f"{tmp_path}/manifest", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        generations.append(store.generation().number)
    assert generations == [1, 1, 2] and _seen(store) == [("a", 1, 0, "x2"), ("b", 1, 0, "w"), ("b", 1, 1, "v")]


def test_memory_runs(spark):
    """Slots are updated, equal texts change nothing, the cap holds, and users don't see each other's memories."""
    extract = lambda said: None if said.startswith("?") else tuple(said.split("=", 1)) if "=" in said else (None, said)
    rows = [
        (1, 1, "name=I am Ann", "hello", "no_memory", [], [], [], []),
        (1, 2, "?what am I called", "you are Ann", "check", ["Ann"], ["Bob"], ["Ann"], ["Bob"]),
        (2, 1, "?what am I called", "no idea", "check", ["idea"], [], [], ["Ann"]),
        (1, 3, "name=I am Bob", "fine", "check", ["fine"], [], ["Bob"], ["Ann"]),
        (1, 4, "name=I am Bob", None, "check", [], [], [], []),
        (1, 5, "tea", "ok", "check", ["no"], [], [], []),
        (1, 6, "milk", "ok", "check", ["ok"], [], ["milk"], ["Bob"]),
    ]
    schema = "user long, step long, said string, answer string, kind string, expect_any array<string>, expect_none array<string>, memory_any array<string>, memory_none array<string>"
    steps = spark.createDataFrame(rows, schema)
    got = {(r["user"], r["step"]): tuple(r)[2:] for r in memory_run.run(steps, extract, cap=2).collect()}
    assert got == {
        (1, 1): ("ADD", None, True, 0, 1), (1, 2): (None, "I am Ann", True, 1, 1), (2, 1): (None, None, True, 0, 0), (1, 3): ("UPDATE", "I am Ann", True, 1, 1),
        (1, 4): ("NOOP", "I am Bob", True, 1, 1), (1, 5): ("ADD", None, False, 1, 2), (1, 6): ("ADD", None, True, 2, 2),
    }


def test_log_is_rewritten(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log", "n long, text string", ["n"], keep=7, every=3)
    assert log.read().count() == 0
    rows = lambda a, b: spark.createDataFrame([(i, f"ü{i}") for i in range(a, b)], "n long, text string")
    log.append(rows(50, 55))
    log.append(rows(0, 4))
    early = log.read()
    assert [r["n"] for r in early.collect()] == [52, 53, 54, 0, 1, 2, 3]  # in the order of the appends, not of n
    log.append(rows(20, 22))  # the third append has the log rewritten
    assert [r["n"] for r in log.read().collect()] == [54, 0, 1, 2, 3, 20, 21] and len(log._told()["folders"]) == 1
    assert [r["n"] for r in early.collect()] == [52, 53, 54, 0, 1, 2, 3]  # a reader that had begun sees its version
    broken = next((tmp_path / "log" / "parts" / log._told()["folders"][0]).glob("*.json"))
    broken.with_name("part-x.json").write_text("{not json\n\n")
    assert [r["n"] for r in log.read().collect()] == [54, 0, 1, 2, 3, 20, 21]
    log.append(rows(9, 10))
    log.expire()
    assert [r["n"] for r in log.read().collect()] == [0, 1, 2, 3, 20, 21, 9] and len(log._versions.names()) == 1


def test_several_hops_store_their_rounds(spark):
    """Only the questions that aren't answered go on, each round is retrieved once, and a round without questions doesn't happen."""
    from vellum.operators import answering

    asked = spark.createDataFrame([(1, "sure"), (2, "vague"), (3, "stuck")], "query_id long, text string")
    seen = []

    def retrieve(q):
        seen.append(sorted(r["text"] for r in q.collect()))
        hits = q.selectExpr("query_id", "1 as rank", "if(text = 'vague', 0.3, if(text = 'stuck', 0.2, 0.9)) as similarity", "text as content")
        return hits.selectExpr("*", "'cosine' as score_kind", "'d' as doc_id", "cast(null as int) as chunk_index", "cast(null as double) as rerank_score")

    def rewrite(q):
        return q.selectExpr("query_id", "if(text = 'vague', 'clear', text) as text")

    got = answering.multi_hop(asked, retrieve, rewrite, rounds=4).collect()
    assert seen == [["stuck", "sure", "vague"], ["clear"]]
    assert sorted((r["query_id"], r["content"], r["rank"]) for r in got) == [(1, "sure", 1), (2, "clear", 1), (2, "vague", 2), (3, "stuck", 1)]
