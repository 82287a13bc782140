import pytest
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators import chunk, privacy


def value(spark, column, text, kind="string"):
    return spark.createDataFrame([(text,)], f"t {kind}").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("破损,遗失。", ["破损", "损遗", "遗失"]), ("、、", []), ("", []), (None, []), ("a", ["a"]), ("a b", ["ab"]), ("aaa", ["aa", "aa"]), ("Ab1", ["Ab", "b1"]), ("\n a-b_c\t", ["ab", "bc"]), ("😀x", ["😀x"])],
)
def test_bigrams(spark, text, want):
    assert value(spark, tx.bigrams, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("理 赔 流 程", "理赔流程"),
        ("SOP 文 档 说明", "SOP 文档说明"),
        ("Java 21 / Spring Boot", "Java 21 / Spring Boot"),
        ("a\r\n\r\n\r\n\r\nb", "a\n\nb"),
        ("a\x00b\x07c", "abc"),
        ("x y　z", "x y z"),
        ("a\n \n \nb", "a\n\n\nb"),
        ("  a  b \n  c  ", "a b\nc"),
        (None, None),
    ],
)
def test_normalize(spark, text, want):
    assert value(spark, tx.normalize, text) == want


@pytest.mark.parametrize(
    ("rows", "want"),
    [([], ""), ([["", " "]], ""), ([["a", "", "b"]], "a |  | b"), ([["k", "v"], ["", ""], ["1", " 2 "]], "k: 1; v: 2"), ([["k", ""], ["1", "x", "y"]], "k: 1; x; y"), ([["k"], [None], ["2"]], "k: 2")],
)
def test_render_rows(spark, rows, want):
    assert value(spark, tx.render_rows, rows, "array<array<string>>") == want


def test_names_keys_and_tags(spark):
    assert value(spark, tx.doc_id_of, "/a/report_1.v2.txt") == "report_1.v2"
    assert value(spark, tx.doc_id_of, "/a/理赔.txt").startswith("doc_") and value(spark, tx.doc_id_of, "") == "document"
    assert value(spark, tx.safe_id, "a/b c") == "a_b_c" and value(spark, tx.safe_id, "") == "doc"
    assert value(spark, tx.tags, "遗失和破损") == "破损 + 遗失" and value(spark, tx.tags, "x") == "其他"
    assert value(spark, tx.is_refusal, "此问题无法回答") and not value(spark, tx.is_refusal, None)
    one = spark.range(1)
    assert one.select(tx.cache_key(F.lit("a"), F.lit(None), F.lit("b"))).first() != one.select(tx.cache_key(F.lit("a"), F.lit("b"), F.lit(""))).first()
    facts = spark.createDataFrame([("居住地", "居住地"), ("住在杭州市", "居住地"), ("居住地: 杭", "居住地"), (None, "k"), ("k", None)], "t string, k string")
    assert [r[0] for r in facts.select(tx.good_fact(F.col("t"), F.col("k"))).collect()] == [False, True, True, False, False]
    assert [r[0] for r in facts.select(tx.good_update(F.col("t"), F.col("k"))).collect()] == [False, True, False, False, False]
    assert [value(spark, tx.is_binary, bytearray(b), "binary") for b in (b"a\x00", b"ab", b"\x10\x0f", b"", b"\xff\x00", b"x" * 8192 + b"\x00")] == [True, False, False, False, True, False]


@pytest.mark.parametrize(("n", "starts"), [(0, []), (1, [0]), (200, [0]), (201, [0, 160]), (360, [0, 160]), (361, [0, 160, 320])])
def test_sliding_chunks(spark, n, starts):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = chunk.sliding_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert [r["start"] for r in got] == starts and all(r["content"] == text[r["start"] : r["start"] + 200] for r in got)


def test_windows_of_a_long_text_take_time_in_proportion(spark):
    import time

    seconds = []
    for n in (80_000, 80_000, 320_000):
        docs = spark.createDataFrame([(1, "aé😀\n" * (n // 4))], "doc_id long, text string")
        began = time.time()
        got = chunk.sliding_chunks(docs).agg(F.sum(F.char_length("content"))).first()[0]
        seconds.append(time.time() - began)
        assert got == n + 40 * (n // 160 - 1)
    assert seconds[2] < 12 * seconds[1] + 2


def test_recursive_splitting():
    text = "\n\n".join(f"段落{i}。" + "内容" * 45 for i in range(6))
    parts = chunk.split_text(text, 200, 0)
    assert len(parts) >= 2 and all(len(p) <= 200 for p in parts) and "".join(parts).replace("\n", "") == text.replace("\n", "")
    assert chunk.split_text("", 200, 40) == [] and chunk.split_text("x" * 450, 200, 40)[1][:40] == "x" * 40
    assert all(len(p) <= 200 for p in chunk.split_text("word " * 500, 200, 40))


def test_privacy_scan_is_masked(spark):
    phone, mail, key = "138" + "00138000", "someone@corp.example", "sk-" + "a" * 24
    text = f"ok\ncall {phone} or {mail}\n{key}\nx@notexample.com y@z.org\n1{phone}2\na@example.com b@corp.test"
    files = spark.createDataFrame([("f.txt", text), ("n.txt", None)], "path string, text string")
    hits = privacy.scan(files)
    assert hits.columns == ["path", "line", "rule", "length"]
    assert sorted((r["line"], r["rule"], r["length"]) for r in hits.collect()) == sorted([(2, "手机号", 11), (2, "邮箱", len(mail)), (3, "密钥样式", 27)])
    strict = {(r["line"], r["rule"]) for r in privacy.scan(files, strict=True).collect()}
    assert {(4, "邮箱"), (6, "邮箱")} <= strict
    assert privacy.summary(hits).where("rule = '手机号'").first()["n"] == 1


def test_scans_of_files_messages_histories_and_identities(spark):
    phone, mail = "138" + "00138000", "someone@corp.example"
    raw = spark.createDataFrame([("a/Resume.txt", b"x"), ("b.bin", f"\0{phone}".encode()), ("c.txt", f"\xff {phone}".encode("latin-1")), ("简历.md", b"\0")], "path string, content binary")
    assert {(r["path"], r["line"], r["rule"]) for r in privacy.scan_files(raw).collect()} == {("a/Resume.txt", 0, tx.PRIVATE_NAME_RULE), ("简历.md", 0, tx.PRIVATE_NAME_RULE), ("c.txt", 1, "手机号")}
    message = spark.createDataFrame([("m", f"fix\n  # {mail}\nby {mail}")], "path string, text string")
    assert [(r["line"], r["rule"]) for r in privacy.scan_messages(message).collect()] == [(3, "邮箱")]
    diff = f"fix {phone}\n+++ b/x/y.py\n+@app.get\n-call {phone}\n+++ b/{mail}\n unchanged"
    found = privacy.scan_history(spark.createDataFrame([("abc1234", diff)], "path string, text string")).collect()
    assert {(r["path"], r["line"], r["rule"]) for r in found} == {("abc1234:(commit message)", 1, "手机号"), ("abc1234:x/y.py", 4, "手机号")}
    people = spark.createDataFrame([(f"A <{mail}>",), (f"B {phone}",), ("c <C@x.org>",)], "identity string")
    assert {(r["identity"], r["rule"]) for r in privacy.identity_hits(people).collect()} == {(f"B {phone}", "身份含手机号")}
    allowed = spark.createDataFrame([(f"a <{mail}>",), (" C <c@X.org>",)], "identity string")
    assert {r["identity"] for r in privacy.identity_hits(people, allowed).collect()} == {f"B {phone}"}
    assert privacy.identity_hits(people, allowed.limit(0)).count() == 1


def test_route_labels(spark):
    for url, want in (("http://h:80/chat/12/x?q=1", "/chat/{id}/x"), ("/a/b#c", "/a/b"), ("https://h", "/"), ("", "/")):
        assert value(spark, tx.route_label, url) == want


def _spans(text, start, end, size, overlap, separators):
    """A plain splitter over places in the text: (start, end) of every chunk, before its blanks are cut off."""
    used = next((i for i, s in enumerate(separators) if s and s in text[start:end]), len(separators) - 1)
    mark = separators[used]
    borders = [start, *(i for i in range(start + 1, end) if (text.startswith(mark, i) if mark else True)), end]
    if mark:  # an occurrence doesn't begin inside another
        kept = [start]
        at = text.find(mark, start, end)
        while at >= 0:
            if at > start:
                kept.append(at)
            at = text.find(mark, at + len(mark), end)
        borders = [*kept, end]
    out, run = [], []

    def flush():
        queue = []
        for a, b in run:
            if queue and b - queue[0][0] > size:
                out.append((queue[0][0], queue[-1][1]))
                while queue and (queue[-1][1] - queue[0][0] > overlap or b - queue[0][0] > size):
                    queue.pop(0)
            queue.append((a, b))
        if queue:
            out.append((queue[0][0], queue[-1][1]))
        run.clear()

    for a, b in zip(borders, borders[1:], strict=False):
        if b - a < size:
            run += [(a, b)] if b > a else []
            continue
        flush()
        out += _spans(text, a, b, size, overlap, separators[used + 1 :]) if used + 1 < len(separators) else [(a, b)]
    flush()
    return out


def test_chunks_are_pieces_of_their_texts(spark):
    """Every chunk of every document against places in the text; line ends inside a chunk stay."""
    import os

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()} if os.path.isdir(folder) else {}
    docs |= {-1: "ab\n" + "x" * 95 + " " + "y" * 120 + "\n\n\ncd", -2: "。".join("内容" * 30 for _ in range(9)), -3: " \n" * 300, -4: "w " * 500 + "z" * 900 + " end"}
    made = {}
    for r in chunk.recursive_chunks(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect():
        made.setdefault(r["doc_id"], []).append(r["content"])
    for doc_id, text in docs.items():
        want = [c for a, b in _spans(text or "", 0, len(text or ""), chunk.SIZE, chunk.OVERLAP, chunk.SEPARATORS) if (c := text[a:b].strip())]
        assert made.get(doc_id, []) == want and all(c in text and len(c) <= chunk.SIZE for c in want)
