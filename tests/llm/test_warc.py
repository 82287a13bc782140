import hashlib
import random
from collections import Counter

import pandas as pd
import pytest

from vellum.llm import warc
from vellum.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, file string, value string"


def _pages(spark, rows):
    """With extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def _round_trip(spark, rows, per_file=4, compression="gzip"):
    path = scratch_path(spark, "warc")
    warc.write_archives(warc.with_revisits(_pages(spark, rows)).repartition(per_file, "page_id"), path, compression)
    return path


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize(("block", "compression"), [("128m", "gzip"), ("128m", "none"), ("700b", "none")])
def test_magic_inside_payloads_is_no_record(spark, monkeypatch, block, compression):
    monkeypatch.setattr(warc, "SPAN_BYTES", 128_000_000 if compression == "gzip" else 900)
    rows = [(1, "http://a/", FAKE), (2, None, None), (3, "http://b/", ""), (4, "u", "WARC/1."), (5, "u v", "x" * 3000 + FAKE * 3 + "é" * 500 + "WARC/1.1\r\n"), (6, "u", "\r\n\r\nWARC/1.0\r\nContent-Length: 2\r\n\r\n")]
    rows += [(i, f"http://h/{i}", f"line {i}\r\n\r\nWARC/1.1\r\n" * (i % 7) + "y" * i) for i in range(10, 80)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = {r["page_id"]: r for r in warc.read_pages(spark, _round_trip(spark, rows, 2, compression)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(rows)
    for page_id, _, html in rows:
        r = got[page_id]
        assert bytes(r["payload"]) == (html or "").encode() and r["record_type"] == "response" and r["payload_bytes"] == len((html or "").encode())
        assert r["digest"] == hashlib.sha1((html or "").encode()).hexdigest()


def test_equal_payloads_become_revisits_of_the_largest_id(spark):
    big, small = "b" * 1000, "s" * 999
    rows = [(1, "u", big), (7, "u", big), (3, "u", big), (4, "u", small), (5, "u", small), (7, "u", big), (None, "u", big), (None, "u", "c" * 2000), (None, "u", "c" * 2000)]
    got = warc.read_pages(spark, _round_trip(spark, rows)).collect()
    want = [(1, "revisit", 7, 1000), (7, "response", None, 1000), (3, "revisit", 7, 1000), (4, "response", None, 999), (5, "response", None, 999), (7, "response", None, 1000)]
    want += [(None, "revisit", 7, 1000), (None, "response", None, 2000), (None, "response", None, 2000)]
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"])) for r in got)


def test_the_query_doubles_pointers_and_rejects_planted_records(spark, tmp_path, monkeypatch):
    """Whole records stand in payloads; archives of several spans; rows as the SQL gives them."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    fill = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    rows = []
    for i in range(1500):
        html = fill(rng.randint(0, 3000))
        if i % 3 == 0:
            html = fill(50) + FAKE * rng.randint(1, 4) + html + "WARC/1."
        rows.append((i, f"http://h/{i}", html))
    rows += [(5000 + i, "u", rows[i][2]) for i in range(0, 90, 3)] + [(9001, None, None), (9002, "u", ""), (9003, "u", FAKE * 20_000), (9004, "u", "é" * 10_000_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    rounds = []
    monkeypatch.setattr(warc, "doublings", lambda nodes, real=warc.doublings: (rounds.append(real(nodes)), rounds[-1])[1])
    got = warc.op4_boundary_chain(spark, str(tmp_path)).toPandas()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(warc.ORACLE_SQL).fetchdf()
    plain = lambda f: Counter(tuple(None if pd.isna(x) else x for x in r) for r in f[sorted(f.columns)].itertuples(index=False, name=None))
    assert plain(got) == plain(want) and rounds[0] >= 3 and (got["record_type"] == "revisit").sum() > 10


def test_empty_table(spark):
    assert warc.read_pages(spark, _round_trip(spark, [])).count() == 0
