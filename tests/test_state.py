import random
import tempfile

from pyspark.sql import functions as F

from vellum.operators import answering, maintain, state
from vellum.sources import files, logs
from vellum.streaming import state as streams


def _by_hand(calls, capacity, per_token, quota):
    held, out = {}, {}
    for us, event_id, key in sorted((us, e, k) for e, k, us in calls):
        tokens, last, day, used = held.get(key, (capacity * per_token, us, us // state.DAY_US, 0))
        tokens, used = min(capacity * per_token, tokens + us - last), used if day == us // state.DAY_US else 0
        ok = tokens >= per_token and used < quota
        out[event_id] = ok
        held[key] = (tokens - per_token, us, us // state.DAY_US, used + 1) if ok else (tokens, us, us // state.DAY_US, used)
    return out


def _calls(n=600):
    rng = random.Random(2)
    return [(i, rng.choice([1, 1, 1, 2, 3]), i * 200_000_000 + rng.randint(0, 10**8)) for i in range(n)]


def test_rate_limit_equals_a_plain_loop_for_any_partitions(spark):
    calls = _calls()
    want = _by_hand(calls, 3, 900_000_000, 40)
    assert 0 < sum(want.values()) < len(want)
    for parts in (1, 6):
        got = state.rate_limit(spark.createDataFrame(calls, "event_id long, key long, us long").repartition(parts), 3, 900_000_000, 40).collect()
        assert {r["event_id"]: r["allowed"] for r in got} == want
        assert all((r["retry_after"] is None) == r["allowed"] and (r["retry_after"] or 1) >= 1 for r in got)


def test_calls_under_a_null_key_share_one_bucket(spark):
    calls = [(i, None, i) for i in range(6)] + [(10, 2**53, 0), (11, 2**53 + 1, 0), (12, 2**53, 1), (13, 2**53 + 1, 1)]
    got = state.rate_limit(spark.createDataFrame(calls, "event_id long, key long, us long").repartition(1), 3, 3_000_000_000, 10).collect()
    assert {r["event_id"] for r in got if not r["allowed"]} == {3, 4, 5}
    assert [r["event_id"] for r in got if r["key"] is None] == list(range(6))
    hits = state.cache_hits(spark.createDataFrame([(i, None, i) for i in range(3)], "event_id long, key string, us long"), 300).collect()
    assert [r["hit"] for r in hits] == [False, True, True]


def test_denied_calls_take_nothing_of_the_quota(spark):
    calls = [(i, 1, i) for i in range(5)] + [(9, 1, 3_600_000_000)]
    got = {r["event_id"]: r for r in state.rate_limit(spark.createDataFrame(calls, "event_id long, key long, us long"), 2, 3_000_000_000, 3).collect()}
    assert [got[i]["allowed"] for i in (0, 1, 2, 3, 4, 9)] == [True, True, False, False, False, True] and got[9]["remaining"] == 0


def test_stream_decides_as_the_batch_does(spark):
    calls = sorted(_calls(300), key=lambda c: (c[2], c[0]))
    where = tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")
    frame = spark.createDataFrame(calls, "event_id long, key long, us long")
    for i in range(3):
        frame.where(F.col("event_id").isin([c[0] for c in calls[i * 100 : i * 100 + 100]])).coalesce(1).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{where}/in")
        limited = streams.rate_limit_stream(stream, 3, 900_000_000, 40)
        query = limited.writeStream.format("parquet").option("checkpointLocation", f"{where}/state").option("path", f"{where}/out").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(f"{where}/out").collect()}
    assert got == _by_hand(calls, 3, 900_000_000, 40)


def test_only_real_answers_are_written_back(spark, tmp_path):
    rows = [(1, "rag_qa", "ok", "a"), (2, "degraded", "ok", "b"), (3, "rag_qa", "error", "c"), (4, "rag_qa", None, "d"), (5, None, "timeout", "e")]
    frame = spark.createDataFrame(rows, "answer_id long, intent string, outcome string, text string")
    for i in range(2):
        frame.where(F.col("answer_id") % 2 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
        query = streams.write_back(stream, lambda x: x.select("answer_id", "text"), f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(r["answer_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 4]


def test_manifests_are_saved_and_loaded(spark, tmp_path):
    contract = {"schema_version": 2, "chunk_size": 200, "chunk_overlap": 40}
    where = f"{tmp_path}/manifest"
    assert maintain.load_manifest(spark, where) is None
    for chunks in (3, 5):
        maintain.save_manifest(spark.createDataFrame([("a", "x", chunks), ("b", "y", 1)], "doc_id string, sha1 string, chunks int"), contract, where)
    docs, found = maintain.load_manifest(spark, where)
    assert found == contract and sorted(map(tuple, docs.collect())) == [("a", "x", 5), ("b", "y", 1)]
    assert tuple(maintain.total_chunks(docs).first()) == (2, 6) and tuple(maintain.total_chunks(docs.limit(0)).first()) == (0, 0)
    after = spark.createDataFrame([("b", "z"), ("c", "w")], "doc_id string, sha1 string")
    assert [tuple(r) for r in maintain.to_rebuild_and_remove(maintain.diff(docs, after)).collect()] == [("b", "rebuild"), ("c", "rebuild"), ("a", "remove")]
    (tmp_path / "other").mkdir()
    assert maintain.load_manifest(spark, f"{tmp_path}/other") is None
    gone = spark.createDataFrame([("t", "a"), ("t", "q")], "tenant string, doc_id string")
    stored = spark.createDataFrame([("t", "a"), ("t", "a"), ("u", "a")], "tenant string, doc_id string")
    assert sorted(map(tuple, maintain.removed(stored, gone, ["tenant", "doc_id"]).collect())) == [("t", "a", 2), ("t", "q", 0)]


def test_models_come_in_batches(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    assert {r["id"]: r["vector"] for r in answering.embedded(texts, "id", lambda batch: [[len(t), 1] for t in batch]).collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0]}
    pairs = spark.createDataFrame([(1, 0, "x"), (1, 1, "yy")], "query_id long, idx int, text string")
    got = answering.scored(pairs, lambda batch: [0.5 if t == "x" else "bad" for t in batch["text"]]).collect()
    assert {r["idx"]: r["relevance"] for r in got} == {0: 0.5, 1: None}


def test_cache_ages_from_the_write(spark):
    rows = [(i, "k", us) for i, us in enumerate([0, 100, 300, 301, 500, 700])]
    got = {r["event_id"]: r["hit"] for r in state.cache_hits(spark.createDataFrame(rows, "event_id long, key string, us long"), 300).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False}


def test_files_become_rows_or_errors(spark):
    rows = [
        ("/a/u.txt", "理赔 流程".encode()), ("/a/g.TXT", "理赔流程".encode("gb18030")), ("/a/b.md", b"\xef\xbb\xbfhi"), ("/a/w.log", "hi".encode("utf-16")), ("/a/t.csv", "k,v\n1,\"x, y\"\n".encode()),
        ("/a/x.exe", b"MZ"), ("/a/e.txt", b""), ("/a/s.txt", b" \n "), ("/a/l.txt", b"12345678"), ("/a/big.txt", b"x" * 60), ("/a/none.pdf", b"not a pdf"),
    ]
    got = {r["path"]: r for r in files.extract(spark.createDataFrame(rows, "path string, content binary"), max_bytes=50, max_chars=5).collect()}
    assert [got[f"/a/{p}"]["encoding"] for p in ("u.txt", "g.TXT", "b.md", "w.log")] == ["utf-8", "gb18030", "utf-8-sig", "utf-16"]
    assert got["/a/u.txt"]["text"] == "理赔流程" == got["/a/g.TXT"]["text"] and got["/a/t.csv"]["text"] == "k: 1;" and got["/a/t.csv"]["truncated"]
    assert [got[f"/a/{p}"]["error"] for p in ("x.exe", "e.txt", "s.txt", "big.txt")] == ["unsupported format: .exe", "empty file", "no text", "file too large"]
    assert "Error" in got["/a/none.pdf"]["error"]  # the parser is missing, or can't read it
    assert (got["/a/l.txt"]["chars_raw"], got["/a/l.txt"]["chars"], got["/a/l.txt"]["truncated"]) == (8, 5, True)
    assert files.formats(spark).count() == 10


def test_parsers_can_be_added_and_tables_keep_their_headers(spark):
    def _sheets(raw):
        if raw == b"broken":
            raise ValueError("no sheets")
        return [("First:\n", [["k", "v"], ["", " "], ["1", "x"]]), ("Blank:\n", [["", " "]]), ("", "a paragraph"), ("Header:\n", [["a", "", "b"]])]

    parsers = {".sheet": files.Parser(_sheets, "\n\n")}
    rows = [("/a/b.sheet", b"x"), ("/a/c.sheet", b"broken"), ("/a/d.pdf", b"x"), ("/a/理赔.txt", b"ok")]
    found = files.extract(spark.createDataFrame(rows, "path string, content binary"), parsers=parsers)
    got = {r["path"]: r for r in found.collect()}
    assert got["/a/b.sheet"]["text"] == "First:\nk: 1; v: x\n\na paragraph\n\nHeader:\na | | b" and got["/a/b.sheet"]["encoding"] is None
    assert got["/a/c.sheet"]["error"] == "ValueError: no sheets" and got["/a/d.pdf"]["error"] == "unsupported format: .pdf"
    assert files.formats(spark, parsers).count() == 7
    stored = {r["title"]: r["doc_id"] for r in files.uploads(found).collect()}
    assert stored["b"] == "b" and stored["理赔"].startswith("doc_")


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, raw in (("a.txt", b"hello"), ("deep/b.csv", b"k,v\n1,2\n"), (".hidden.txt", b"no"), ("none", b"no suffix")):
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.extract(files.files(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": "hello", "b.csv": "k: 1; v: 2"}


def test_logs_skip_what_they_cannot_read(spark):
    where = tempfile.mkdtemp(prefix="spark-log-", dir="/tmp")
    rows = spark.createDataFrame([(i, f"q{i}") for i in range(5)], "ts long, question string")
    logs.append(rows.coalesce(1), f"{where}/log")
    with open(f"{where}/log/more.json", "w", encoding="utf-8") as f:
        f.write('{"ts": 9, "question": "问"}\n\nbroken {\n')
    log = logs.read_log(spark, f"{where}/log", "ts long, question string")
    assert [r["ts"] for r in logs.newest(log, "ts", 3).collect()] == [9, 4, 3]
    logs.compact(log, "ts", 2, f"{where}/small")
    assert logs.read_log(spark, f"{where}/small", "ts long, question string").count() == 2


def test_late_calls_credit_no_time_twice(spark):
    """One call a micro-batch: the second is older than the state, and the third comes before a token is back."""
    where = tempfile.mkdtemp(prefix="spark-late-", dir="/tmp")
    day = state.DAY_US
    calls = [(1, 1, 1000), (2, 1, 500), (3, 1, 1050), (4, 1, 1100), (5, 2, day + 10), (6, 2, 10), (7, 2, day + 500)]
    schema = "event_id long, key long, us long"
    for call in calls:
        spark.createDataFrame([call], schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(schema).parquet(f"{where}/in")
        query = streams.rate_limit_stream(stream, 1, 100, 1 if call[1] == 2 else 40).writeStream.format("parquet")
        query = query.option("checkpointLocation", f"{where}/state").option("path", f"{where}/out").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = {r["event_id"]: r["allowed"] for r in spark.read.parquet(f"{where}/out").collect()}
    # key 2 has a quota of one a day: a call of the day before opens no new day, and gives the later one nothing back
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False}


def test_generated_answers_that_fail_are_degraded(spark):
    from vellum.operators import answering

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]

    rows = [(1, "one"), (2, "bad"), (3, None), (4, "two")]
    got = sorted(map(tuple, answering.generated(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", model).collect()))
    assert got == [(1, "ONE", "direct"), (2, None, "degraded"), (3, None, "degraded"), (4, "TWO", "direct")]


def test_versions_of_a_large_tenant(spark):
    """One tenant spans several ranges; numbers run on through all of them."""
    from vellum.operators import maintain

    rows = [("hot", i * 3) for i in range(2000)] + [("b", 5), ("b", 2), (None, 1), (None, 9)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["tenant"], r["seq"]): r["kb_version"] for r in maintain.versions(spark.createDataFrame(rows, "tenant string, seq long").repartition(3)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {**{("hot", i * 3): i + 1 for i in range(2000)}, ("b", 2): 1, ("b", 5): 2, (None, 1): 1, (None, 9): 2}
