"""Streams with state: timers, expiry, heartbeats and upserts, batch by batch."""

import random
import time
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quern.streaming import stateful, upserts

START = datetime(2024, 1, 1)
CALLS = "key long, id long, at timestamp"


def drained(stream, base, name="out"):
    query = stream.writeStream.option("checkpointLocation", f"{base}/c").trigger(availableNow=True).format("parquet").start(f"{base}/{name}")
    query.awaitTermination()
    return query


def brute_limit(calls, limit, seconds):
    held, out = defaultdict(list), {}
    for at, i, key in sorted((at, i, key) for key, i, at in calls):
        held[key] = [t for t in held[key] if t > at - timedelta(seconds=seconds)]
        out[key, i] = len(held[key]) < limit
        held[key] += [at] * out[key, i]
    return out


def test_limiter_decides_in_order_of_time_across_batches_and_forgets_idle_keys(spark, tmp_path):
    draw = random.Random(7)
    calls = [(draw.randrange(5), i, START + timedelta(seconds=draw.random() * 400)) for i in range(300)]
    calls += [(9, 1000 + i, START + timedelta(seconds=200, microseconds=i % 3)) for i in range(60)]  # many at one time
    ordered = sorted(calls, key=lambda c: c[2])
    near = sorted(ordered, key=lambda c: c[2] + timedelta(seconds=draw.random() * 8))  # late by less than is waited for
    stateful.stateful(spark)
    stream = lambda: stateful.rate_limited(spark.readStream.schema(CALLS).parquet(str(tmp_path / "in")), 3, 60.0)
    for part in (near[:120], near[120:250], near[250:]):
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = drained(stream(), str(tmp_path))
    before = spark.read.parquet(str(tmp_path / "out")).count()
    assert 0 < before < len(calls) and query.lastProgress.stateOperators[0].numRowsTotal > 0
    odd = [(1, None, START + timedelta(hours=2)), (None, 5, START + timedelta(seconds=390)), (2, 6, None), (3, 5000, START + timedelta(seconds=1))]
    spark.createDataFrame(odd, CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = drained(stream(), str(tmp_path))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    wanted = brute_limit(calls, 3, 60)
    assert {(r.key, r.id): r.allowed for r in rows} == wanted and len(rows) == len(calls)
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 0  # no call, no timer, no time is kept


def test_a_silent_run_gets_a_heartbeat_for_each_interval(spark, tmp_path):
    ddl = "run_id string, seq int, event string, data string"
    write = lambda rows: spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([("a", 0, "run_started", "a"), ("b", 0, "run_started", "b"), ("b", 1, "done", "b")])
    events = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    made = stateful.frames_with_heartbeats(events, 1.0)
    query = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start(str(tmp_path / "out"))
    seen = lambda: spark.read.parquet(str(tmp_path / "out")) if query.lastProgress else spark.createDataFrame([], "run_id string, seq int, frame string")
    try:
        end = time.time() + 120
        while time.time() < end and seen().filter("seq is null").count() < 3:
            time.sleep(0.5)
        beats = seen().filter("seq is null").collect()
        assert len(beats) >= 3 and {(r.run_id, r.frame) for r in beats} == {("a", ": heartbeat\n\n")}
        write([("a", 1, "delta", "x\ny"), ("a", 2, "done", "a")])
        while time.time() < end and seen().filter("seq = 2").count() < 1:
            time.sleep(0.5)
        after = seen().filter("seq is null").count()
        time.sleep(4)
        assert seen().filter("seq is null").count() == after and query.lastProgress.stateOperators[0].numRowsTotal == 0
    finally:
        query.stop()
    frames = {(r.run_id, r.seq): r.frame for r in seen().filter("seq is not null").collect()}
    assert frames["a", 1] == "event: delta\ndata: x\ndata: y\n\n" and len(frames) == 5


ASKED = "tenant_id string, question string, asked_at long, metadata map<string,string>"


def table_rows(table):
    return sorted((r.tenant_id, r.question, r.n, tuple(sorted(r.metadata.items()))) for r in table.read().collect())


def test_upserts_merge_and_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(upserts, "BUCKETS", 4)
    table = upserts.UpsertTable(spark, str(tmp_path / "t"))
    assert table.read().count() == 0
    first = spark.createDataFrame([("t", " a ", 1, {"x": "1", "y": "old"}), ("t", "a", 2, {"y": "new"}), ("u", "a", 1, None), ("t", "b", 5, {})] + [("t", "hot", i, {"i": str(i)}) for i in range(50)], ASKED)
    second = spark.createDataFrame([("t", "a", 0, {"y": "last", "z": "3"}), ("v", "c", 1, {"k": "v"})], ASKED)
    table.merge(first, 0)
    one = table_rows(table)
    assert one == [("t", "a", 2, (("x", "1"), ("y", "new"))), ("t", "b", 1, ()), ("t", "hot", 50, (("i", "49"),)), ("u", "a", 1, ())]
    table.merge(second, 1)
    two = table_rows(table)
    assert two == [("t", "a", 3, (("x", "1"), ("y", "last"), ("z", "3"))), ("t", "b", 1, ()), ("t", "hot", 50, (("i", "49"),)), ("u", "a", 1, ()), ("v", "c", 1, (("k", "v"),))]
    table.merge(second, 1)
    assert table_rows(table) == two
    (tmp_path / "t" / "batch=1" / "_SUCCESS").unlink()  # a batch whose write has not ended is not read
    assert table_rows(table) == one
    table.merge(second, 1)
    assert table_rows(table) == two
    table.merge(second.limit(0), 2)
    assert table_rows(table) == two
    assert {b for b, v in table.versions().items() if v == 1} == {r["b"] for r in second.select(F.pmod(F.xxhash64(upserts.question_hash(F.col("tenant_id"), F.col("question"))), F.lit(4)).alias("b")).collect()}


def test_a_stream_of_upserts_goes_on_after_a_failed_batch(spark, tmp_path):
    table = upserts.UpsertTable(spark, str(tmp_path / "t"))
    merge, failed = table.merge, []

    def flaky(rows, number):
        merge(rows, number)
        if not failed:
            failed.append(number)
            raise ConnectionError  # after the table is written, before the stream knows

    stream = lambda: spark.readStream.schema(ASKED).parquet(str(tmp_path / "in"))
    spark.createDataFrame([("t", "a", i, {"k": str(i)}) for i in range(5)], ASKED).write.parquet(str(tmp_path / "in"))
    table.merge = flaky
    for _ in range(2):
        try:
            table.follow(stream(), str(tmp_path / "c"))
        except Exception:
            continue
    assert failed == [0] and table_rows(table) == [("t", "a", 5, (("k", "4"),))]


def test_a_key_has_one_timer_however_many_calls_wait(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "FEW", 40)
    draw = random.Random(3)
    calls = [(k, i, START + timedelta(seconds=draw.random() * n)) for k, n in ((1, 30), (2, 300), (3, 3)) for i in range(39 if k == 1 else 400)]  # one below FEW
    stateful.stateful(spark)
    stream = lambda: stateful.rate_limited(spark.readStream.schema(CALLS).parquet(str(tmp_path / "in")), 2, 2.5, "1 hour")
    spark.createDataFrame(calls, CALLS).repartition(3).write.parquet(str(tmp_path / "in"))
    drained(stream(), str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 0
    more = [(1, 5000, START + timedelta(seconds=1)), (1, 5001, START + timedelta(seconds=2)), (4, 0, START + timedelta(seconds=9))]
    spark.createDataFrame(more, CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = drained(stream(), str(tmp_path))
    timers = query.lastProgress.stateOperators[0].customMetrics
    assert timers["numRegisteredTimers"] <= 4
    spark.createDataFrame([(1, None, START + timedelta(hours=3))], CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = drained(stream(), str(tmp_path))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.key, r.id): r.allowed for r in rows} == brute_limit(calls + more, 2, 2.5) and len(rows) == len(calls) + len(more)
    assert query.recentProgress[-1].stateOperators[0].numRowsTotal == 0


def test_a_span_that_ends_within_a_slot_counts_to_its_end(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    stateful.stateful(spark)
    stream = lambda: stateful.rate_limited(spark.readStream.schema(CALLS).parquet(str(tmp_path / "in")), 1, 60.5, "1 second")
    calls = [(1, 0, at(0)), (1, 1, at(60.4)), (1, 2, at(60.6))]
    ticks = [(0, None, at(30)), (0, None, at(61.7)), (0, None, at(61.8)), (0, None, at(7200))]
    for part in ([calls[0]], [ticks[0]], [*calls[1:], ticks[1]], [ticks[2]], [ticks[3]]):
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drained(stream(), str(tmp_path))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.key, r.id): r.allowed for r in rows} == brute_limit(calls, 1, 60.5) == {(1, 0): True, (1, 1): False, (1, 2): True}


def test_streams_read_tables_of_one_file_and_of_many(spark, tmp_path):
    from hashlib import sha256

    from quern.plans import pipelines  # noqa: F401
    from quern.plans.queries import QUERIES

    ddl = "conv_id long, turn long, role string, text string"
    rows = [(0, 0, "user", "a"), (2, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", "c"), (3, 0, "user", None), (None, 0, "user", "a")]
    folder = tmp_path / "many"
    spark.createDataFrame(rows, ddl).repartition(3).write.parquet(str(folder / "conversations.parquet"))
    one = tmp_path / "one"
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "part"))
    one.mkdir()
    next((tmp_path / "part").glob("*.parquet")).rename(one / "conversations.parquet")
    h = lambda text: sha256(text.encode()).hexdigest()
    wanted = {("t0", h("t0:a"), 2), ("t1", h("t1:b"), 1), ("t1", None, 1), (None, None, 1)}
    for place in (folder, one):
        assert set(map(tuple, QUERIES["str7_missed_counts"](spark, str(place)).collect())) == wanted
