"""As-of joins and bounded caches against plain loops."""

import random
from collections import Counter, OrderedDict

import pytest

from vellum.operators import timeline
from vellum.plans import all as plans


@pytest.mark.parametrize(("strict", "appended"), [(True, None), (False, None), (True, "n"), (False, "n")])
def test_asof_equals_a_loop(spark, strict, appended):
    rng = random.Random(strict + 2 * bool(appended))
    stamp = lambda: rng.choice([None, *range(60)])
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    left = [(i % 290, key(), stamp()) for i in range(300)]
    right = [(key(), stamp(), i, rng.choice((None, i * 10))) for i in rng.sample(range(1000), 200)] + [("b", 7, 5, 1), ("b", 7, 5, 1)]

    def expected(k, at):
        before = [r for r in right if r[0] == k and at is not None and r[1] is not None and (r[1] < at if strict else r[1] <= at)]
        rank = (lambda r: (r[2], r[3] or -1)) if appended else (lambda r: (r[1], r[2], r[3] or -1))
        return tuple(max(before, key=rank)[2:]) if before else (None, None)

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = timeline.asof(spark.createDataFrame(left, "id int, k string, at int"), spark.createDataFrame(right, "k string, at int, n int, v int"), ["k"], "at", ["n", "v"], appended, strict)
        assert got.columns == ["id", "k", "at", "n", "v"]
        assert Counter(map(tuple, got.collect())) == Counter((i, k, at, *expected(k, at)) for i, k, at in left)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_of_nothing(spark):
    left, right = spark.createDataFrame([(1, "a", 2)], "id int, k string, at int"), spark.createDataFrame([], "k string, at int, v int")
    assert [tuple(r) for r in timeline.asof(left, right, ["k"], "at", ["v"]).collect()] == [(1, "a", 2, None)]
    assert timeline.asof(left.where("id = 2"), right, ["k"], "at", ["v"]).count() == 0


def test_previous_run_where_places_repeat(spark, tmp_path):
    """Of two events appended at one place the older one stands, whatever its value, as in SQL."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(8)
    ids = [i + 100_003 * c for i in range(60) for c in range(4)]
    times = rng.sample(range(10_000), len(ids))
    rows = [(e, t, "ab"[e % 2], float(rng.randrange(1000))) for e, t in zip(ids, times, strict=True)]
    events = spark.createDataFrame(rows, "event_id long, us long, event_type string, value double").selectExpr("event_id", "timestamp_micros(us) ts", "event_type", "value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in plans.QUERIES["previous_run"](spark, str(tmp_path)).select("event_id", "value_before", "delta").collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(db.execute(f"SELECT event_id, value_before, delta FROM ({plans.ORACLE_SQL['previous_run']})").fetchall())


def _lookups(rng, n, keys):
    return [(i, rng.choice(keys) if rng.random() < 0.8 else f"one{rng.randrange(n)}", i // 3 * 1000) for i in range(n)]


@pytest.mark.parametrize(("capacity", "keys", "ttl"), [(1, 3, 10**9), (8, 12, 40_000), (64, 100, 300_000), (512, 30, 5_000), (40, 4, 10**9)])
def test_cache_equals_a_loop(spark, capacity, keys, ttl):
    """Several ranges of time, also such that hold fewer keys than the cache."""
    rng = random.Random(capacity)
    lookups = _lookups(rng, 1500, [None, *(f"k{i}" for i in range(keys))])
    held, want = OrderedDict(), {}
    for event_id, key, us in lookups:
        hit = key in held and us - held[key] <= ttl
        want[event_id] = hit
        if not hit:
            held[key] = us
        held.move_to_end(key)
        if len(held) > capacity:
            held.popitem(last=False)
    frame = spark.createDataFrame(rng.sample(lookups, len(lookups)), "event_id long, key string, us long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r["event_id"]: r["hit"] for r in timeline.bounded_cache_hits(frame, ttl, capacity).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want
    if capacity == 8:
        assert timeline.bounded_cache_hits(frame.where("false"), ttl, capacity).count() == 0
