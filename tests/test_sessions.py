import random
from datetime import UTC, datetime

from vellum.streaming import sessions


def test_session_store_over_a_stream(spark, tmp_path):
    """Batches of events against a plain store that is swept at the watermark after each of them."""
    rng = random.Random(5)
    schema = "conv_id long, seq long, ts timestamp, role string, text string"
    minute, rows = 60, []
    for b in range(5):
        batch = []
        for _ in range(60):
            conv, at = rng.randrange(8) if b != 2 else rng.randrange(4), b * 20 * minute + rng.randrange(600)
            batch.append((conv, len(rows) * 100 + len(batch), datetime.fromtimestamp(at, UTC), "user", None if rng.random() < 0.2 else f"t{b}.{len(batch)}"))
        rows.append(batch)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", sessions.PROVIDER)
    got, want, held, watermark = [], [], {}, 0
    try:
        for batch in rows:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
            made = sessions.session_store(stream, keep=6, idle_ms=15 * minute * 1000)
            out = made.writeStream.outputMode("update").foreachBatch(lambda x, _: got.extend(map(tuple, x.collect())))
            query = out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
            for conv in sorted({r[0] for r in batch}):
                mine = sorted((r for r in batch if r[0] == conv), key=lambda r: (r[2], r[1]))
                texts, last = held.get(conv, ([], 0))
                texts = [*texts, *(r[4] for r in mine if r[4] is not None)][-6:]
                held[conv] = (texts, max(last, max(int(r[2].timestamp()) for r in mine)))
                want.append((conv, len(texts), texts[-1] if texts else None, False))
            watermark = max(watermark, max(int(r[2].timestamp()) for r in batch))
            for conv in [c for c, (_, last) in held.items() if last + 15 * minute <= watermark]:
                del held[conv]
                want.append((conv, 0, None, True))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[3] for w in want)
