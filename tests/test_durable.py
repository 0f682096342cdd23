"""Snapshots, rebuilds and logged model calls: what readers see meanwhile, and what is left of a run that dies."""

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quern.operators import indexing, qa
from quern.operators.results import call_key, call_log, finished_calls, logged_calls, logged_vectors
from quern.operators.snapshots import Collection, Conflict, RebuildError, changed_documents, rebuild

DDL = "document_id long, chunk_id string, chunk_index int, chunk_level string, status string, version string, content string"


def chunks(spark, documents, version="v1"):
    rows = []
    for d in documents:
        rows += [(d, f"{d}-{i}", i, "CHILD", "ACTIVE", version, f"text {d} {i}") for i in range(3)] + [(d, f"{d}-p", 0, "PARENT", "ACTIVE", version, "whole")]
    return spark.createDataFrame(rows, DDL)


def seen(rows):
    return sorted(str(tuple(r)) for r in rows.select("document_id", "chunk_id", "status").collect())


def test_readers_see_all_of_a_publish_or_nothing(spark, tmp_path):
    held = Collection(spark, str(tmp_path / "c"))
    with pytest.raises(LookupError):
        held.read()
    held.create(chunks(spark, [1, 2, 3]))
    with pytest.raises(Conflict):
        held.create(chunks(spark, [1]))
    pinned = held.read(0)
    before = seen(pinned)
    staged = chunks(spark, [2, 4], "v2").withColumn("status", F.lit("STAGING"))
    dead = held._segment(staged)  # a writer that dies before its switch
    assert seen(held.read()) == before and held.versions() == [0]
    assert held.publish(staged, expected=0) == 1
    assert seen(pinned) == before == seen(held.read(0))
    wanted = indexing.publish(chunks(spark, [1, 2, 3]), staged)
    assert seen(held.read()) == seen(wanted) and Counter(r.status for r in held.read().collect()) == {"ACTIVE": 16, "SUPERSEDED": 4}
    with pytest.raises(Conflict):
        held.publish(chunks(spark, [1]), expected=0)
    assert held.head() == 1 and held.publish(chunks(spark, [3]).filter("false")) == 2  # nothing staged: the same rows
    assert seen(held.read()) == seen(wanted)
    assert {r.document_id for r in changed_documents(held, 0, 2).collect()} == {2, 4} and changed_documents(held, 1, 1).count() == 0
    assert held.compact() == 3 and len(held.manifest()["segments"]) == 1 and seen(held.read()) == seen(wanted)
    gone = held.expire(keep=2)
    assert dead["name"] in gone and held.versions() == [2, 3] and seen(held.read(2)) == seen(held.read(3)) == seen(wanted)


def test_a_publish_that_loses_the_race_is_tried_again_on_top(spark, tmp_path, monkeypatch):
    held = Collection(spark, str(tmp_path / "c"))
    held.create(chunks(spark, [1, 2]))
    other = Collection(spark, str(tmp_path / "c"))
    switch, raced = held._switch, []

    def late(manifest):
        if not raced:
            raced.append(other.publish(chunks(spark, [1], "other")))
        switch(manifest)

    monkeypatch.setattr(held, "_switch", late)
    assert held.publish(chunks(spark, [2], "mine")) == 2 and raced == [1]
    active = {(r.document_id, r.version) for r in held.read().filter("status = 'ACTIVE'").collect()}
    assert active == {(1, "other"), (2, "mine")}
    assert not [p for p in (tmp_path / "c" / "manifests").iterdir() if p.name.startswith("_")]


def test_a_killed_rebuild_goes_on_behind_its_last_page(spark, tmp_path):
    held = Collection(spark, str(tmp_path / "c"))
    held.create(chunks(spark, range(1, 8)).unionByName(chunks(spark, [8, 9], "v2")).unionByName(chunks(spark, [10]).filter("chunk_level = 'PARENT'")))
    built = []

    def build(active, fail_at=None):
        ids = sorted(r.document_id for r in active.select("document_id").distinct().collect())
        if ids[0] == fail_at:
            raise InterruptedError
        built.append(ids)
        return active.withColumn("content", F.concat(F.lit(" "), "content"))

    with pytest.raises(InterruptedError):
        rebuild(held, "run", "v2", lambda a: build(a, 5), page=2)
    assert built == [[1, 2], [3, 4]] and held.manifest()["run"] == {"id": "run", "after": 4}
    assert rebuild(held, "run", "v2", build, page=2) == 2
    assert built == [[1, 2], [3, 4], [5, 6], [7]]
    active = held.read().filter("status = 'ACTIVE' and chunk_level = 'CHILD'")
    assert {(r.document_id, r.version) for r in active.collect()} == {(d, "v2") for d in range(1, 10)} and active.count() == 27
    assert rebuild(held, "again", "v2", build, page=2) == 0
    with pytest.raises(RebuildError):
        rebuild(held, "bad", "v3", lambda a: a.withColumn("content", F.lit("lost")), page=5)
    assert {r.version for r in held.read().filter("status = 'ACTIVE' and chunk_level = 'CHILD'").collect()} == {"v2"}


def counted(folder):
    return Counter(line for p in Path(folder).iterdir() for line in p.read_text().splitlines())


def test_a_job_that_dies_asks_no_finished_call_again(spark, tmp_path):
    log, calls = str(tmp_path / "log"), tmp_path / "calls"
    calls.mkdir()

    def call(texts, poison="t17"):
        import os
        import uuid

        if poison in texts:
            raise ConnectionError(poison)
        (calls / f"{os.getpid()}-{uuid.uuid4().hex}").write_text("\n".join(texts))
        return [t.upper() for t in texts]

    asked = spark.createDataFrame([(i, f"t{i % 30}") for i in range(45)], "id int, payload string")  # 15 texts twice
    asked = asked.withColumn("key", call_key("m", F.col("payload")))
    with pytest.raises(Exception, match="t17"):
        logged_calls(asked, log, call, batch=2).count()
    done = finished_calls(spark, log).count()
    assert 0 < done < 30 and done == sum(counted(calls).values())
    got = {r.id: json.loads(r.result) for r in logged_calls(asked, log, lambda t: call(t, None), batch=2).collect()}
    assert got == {i: f"T{i % 30}" for i in range(45)}
    assert counted(calls) == Counter(f"t{i}" for i in range(30))
    assert logged_calls(asked, log, lambda t: call(t, None)).count() == 45 and sum(counted(calls).values()) == 30
    other = asked.withColumn("key", call_key("other", F.col("payload")))
    logged_calls(other, log, lambda t: call(t, None)).count()
    assert sum(counted(calls).values()) == 60  # another model is asked itself
    assert logged_calls(asked.limit(0), log, call).count() == 0


def test_a_task_that_runs_again_reads_its_finished_batches(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def call(texts):
        import uuid

        (calls / uuid.uuid4().hex).write_text("\n".join(texts))
        return texts

    asked = spark.createDataFrame([(f"k{i}", f"t{i}") for i in range(20)], "key string, payload string")
    twice = logged_calls(asked, str(tmp_path / "log"), call, batch=3)
    assert twice.count() == 20 and twice.count() == 20 and set(counted(calls).values()) == {1}
    assert call_log(spark, str(tmp_path / "log")).count() == 20


def test_the_embedding_job_asks_once_for_each_text(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def embed(texts, fails=False):
        import uuid

        (calls / uuid.uuid4().hex).write_text("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    records = spark.createDataFrame([(i, None) for i in range(12)], "id int, search_text string")
    targets = spark.createDataFrame([("QA", i, "v1", f"text {i % 10}", "s") for i in range(12)], "target_type string, id int, template_version string, input_text string, search_text string")
    stored = spark.createDataFrame([], "target_type string, id int, template_version string, input_hash string, model_key string, vector array<float>")
    by_log = lambda df: logged_vectors(df, str(tmp_path / "log"), "m", embed, 4)
    turns = iter(("g1", "g1", "g2"))  # the chunks change while records are written
    same, stage = indexing.embed_job({"QA": (records, targets)}, stored, by_log, "m", lambda: next(turns))
    assert stage == "FAILED" and same["QA"] is records
    made, stage = indexing.embed_job({"QA": (records, targets)}, stored, by_log, "m", lambda: "g2")
    assert stage == "COMPLETED" and {r.id: r.embedding for r in made["QA"].collect()} == {i: [float(len(f"text {i % 10}")), 1.0] for i in range(12)}
    assert counted(calls) == Counter(f"text {i}" for i in range(10))


def test_a_run_whose_job_dies_keeps_its_finished_batches(spark, tmp_path):
    calls, folder = tmp_path / "calls", str(tmp_path / "runs")
    calls.mkdir()

    def model(ids, poison=None):
        import uuid

        if ids[0] == poison:
            raise MemoryError(poison)  # not an error of the provider: the job ends
        (calls / uuid.uuid4().hex).write_text(ids[0])
        return "ok"

    batches = spark.createDataFrame([(d, 0, [f"c{d}"]) for d in range(8)], "document_id long, batch_index int, chunk_ids array<string>").coalesce(1)
    with pytest.raises(Exception, match="c3"):
        qa.checkpointed_run(batches, folder, lambda ids: model(ids, "c3"))
    kept = sum(counted(calls).values())
    rows = qa.checkpointed_run(batches, folder, model)
    assert rows.count() == 8 and counted(calls) == Counter(f"c{d}" for d in range(8)) and kept < 8
    assert all(r.ready for r in qa.publishable(batches, rows).collect())


def test_a_log_of_many_batches_has_few_files_and_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("quern.operators.results.MERGED", 3)
    folder = str(tmp_path / "log")
    asked = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("string").alias("payload"))
    got = logged_calls(asked, folder, lambda texts: [f"<{t}>" for t in texts], batch=1)
    assert {r.key: json.loads(r.result) for r in got.collect()} == {f"k{i}": f"<{i}>" for i in range(500)}
    files = [p for p in Path(folder).rglob("*") if p.is_file() and p.name.endswith((".jsonl", ".draft"))]
    assert 1 < len(files) <= 8 and call_log(spark, folder).count() == 500


def test_another_attempt_of_a_task_takes_up_its_log(tmp_path, monkeypatch):
    from quern.operators import results

    monkeypatch.setattr(results, "MERGED", 3)
    first = results._TaskLog(str(tmp_path), "run", 7)
    lines = [json.dumps({"key": f"k{i}", "run": "run", "done": True, "result": str(i)}) for i in range(11)]
    for line in lines:
        first.add([line])  # and then the worker dies
    assert results._TaskLog(str(tmp_path), "run", 7).earlier() == {f"k{i}": str(i) for i in range(11)}
    assert results._TaskLog(str(tmp_path), "run", 8).earlier() == {}
