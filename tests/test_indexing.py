"""Question-answer runs, the embedding job, publishing and files: what happens when something fails."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import filters, indexing, qa
from quern.operators import retrieval as R
from quern.sources import files
from quern.storage import keep, materialize, temporary


def batches_of(spark, rows):
    return spark.createDataFrame(rows, "document_id long, batch_index int, chunk_ids array<string>")


def test_timeouts_halve_and_other_errors_are_tried_again(spark, tmp_path):
    log = tmp_path / "calls"

    def model(ids):
        with open(log, "a") as out:
            out.write(",".join(ids) + "\n")
        if ids == ["d"] and open(log).read().splitlines().count("d") < 2:
            raise qa.ProviderError("INFERENCE", retryable=True)
        if "x" in ids:
            raise qa.ProviderError("REJECTED")
        if len(ids) > 1:
            raise qa.ProviderError("TIMEOUT", retryable=True)
        return ids[0].upper()

    rows = batches_of(spark, [(1, 0, ["a", "b", "c"]), (1, 1, ["d"]), (2, 0, ["x"]), (3, 0, [f"n{i}" for i in range(40)])])
    got = {(r.document_id, r.path): (r.output, r.error) for r in qa.generate(rows.coalesce(1), model, depth=2).collect()}
    assert got[1, "0.0"] == ("A", None) and got[1, "0.1.0"] == ("B", None) and got[1, "0.1.1"] == ("C", None)
    assert got[1, "1"] == ("D", None) and got[2, "0"] == (None, "REJECTED")
    deep = [k for k in got if k[0] == 3]
    assert sorted(deep) == [(3, f"0.{a}.{b}") for a in (0, 1) for b in (0, 1)] and all(got[k] == (None, "TIMEOUT") for k in deep)


def test_a_second_run_asks_only_for_what_is_left(spark, tmp_path):
    log, folder = tmp_path / "calls", str(tmp_path / "runs")
    batches = batches_of(spark, [(d, b, [f"{d}-{b}"]) for d in (1, 2) for b in (0, 1)]).coalesce(1)

    def model(ids, broken="2-1"):
        with open(log, "a") as out:
            out.write(ids[0] + "\n")
        if ids[0] == broken:
            raise qa.ProviderError("DOWN")
        return "ok"

    first = qa.checkpointed_run(batches, folder, model)
    assert {r.document_id: r.ready for r in qa.publishable(batches, first).collect()} == {1: True, 2: False}
    log.unlink()
    qa.checkpointed_run(batches, folder, lambda ids: model(ids, ""))
    assert open(log).read().split() == ["2-1"]
    log.unlink()
    assert qa.checkpointed_run(batches, folder, model).count() == 5 and not log.exists()


def test_token_batches(spark):
    rows = [(1, f"c{i}", i, n, "g") for i, n in enumerate((30, 30, 30, 90, 10))] + [(2, "x", 0, 5, "g1"), (2, "y", 1, 5, "g2")]
    chunks = spark.createDataFrame(rows, "document_id int, chunk_id string, chunk_index int, tokens int, generation string")
    read = lambda df: sorted((r.document_id, r.batch_index, r.chunk_ids, r.size, r.error) for r in df.collect())
    assert read(qa.token_batches(chunks, 90, 10, splits=False)) == [
        (1, 0, ["c0", "c1"], 70, None), (1, 1, ["c2"], 40, None), (1, 2, ["c3"], 100, "OVERSIZE"), (1, 3, ["c4"], 20, None), (2, 0, ["x", "y"], 20, "GENERATIONS")
    ]
    cut = read(qa.token_batches(chunks.filter("document_id = 1"), 60, 10, splits=True))
    assert [(ids, size) for _, _, ids, size, _ in cut] == [(["c0"], 40), (["c1"], 40), (["c2"], 40), (["c3#0"], 60), (["c3#1"], 50), (["c4"], 20)]


def test_the_embedding_job_writes_all_or_nothing(spark):
    records = spark.createDataFrame([(1, "old"), (2, None)], "id int, search_text string")
    targets = spark.createDataFrame([("QA", 1, "v1", "one", "s one"), ("QA", 2, "v1", "two words", "s two words")], "target_type string, id int, template_version string, input_text string, search_text string")
    stored = spark.createDataFrame([("QA", 1, "v1", "x", "m", [1.0])], "target_type string, id int, template_version string, input_hash string, model_key string, vector array<float>")
    stored = stored.withColumn("input_hash", F.sha2(F.lit("one"), 256))
    groups = {"QA": (records, targets)}
    embed = lambda df: R.embed_batches(df, lambda xs: [[float(len(x))] for x in xs], 1)
    made, stage = indexing.embed_job(groups, stored, embed, "m", lambda: "g")
    rows = {r.id: r for r in made["QA"].collect()}
    assert stage == "COMPLETED" and rows[1].search_text == "old" and rows[1].embedding is None  # its vector is current
    assert (rows[2].embedding, rows[2].search_text, rows[2].token_count) == ([9.0], "s two words", 3)
    assert json.loads(rows[2].metadata)["modelKey"] == "m"
    turns = iter(("g1", "g2"))
    same, stage = indexing.embed_job(groups, stored, embed, "m", lambda: next(turns))
    assert stage == "FAILED" and same["QA"] is records
    lost = lambda df: embed(df).filter("id <> 2")
    assert indexing.embed_job(groups, stored, lost, "m", lambda: "g")[1] == "FAILED"
    assert {r.id for r in filters.stale_targets(targets, stored, "other").collect()} == {1, 2}


def test_a_failing_batch_of_vectors_is_tried_again(spark, tmp_path):
    mark = tmp_path / "failed"

    def embed(texts):
        if not mark.exists():
            mark.touch()
            raise ConnectionError
        return [[1.0] for _ in texts]

    texts = spark.createDataFrame([(1, "a")], "id int, text string").coalesce(1)
    assert R.embed_batches(texts, embed, 1, attempts=2).count() == 1


def test_publishing_supersedes_only_what_is_replaced(spark):
    current = spark.createDataFrame([(1, "a", "ACTIVE"), (1, "b", "STAGING"), (2, "c", "ACTIVE")], "document_id int, chunk_id string, status string")
    staged = spark.createDataFrame([(1, "n", "STAGING")], "document_id int, chunk_id string, status string")
    got = sorted(tuple(r) for r in indexing.publish(current, staged).collect())
    assert got == [(1, "a", "SUPERSEDED"), (1, "b", "STAGING"), (1, "n", "ACTIVE"), (2, "c", "ACTIVE")]
    assert indexing.publish(current, staged.limit(0)).collect() == current.collect()


def test_files_are_checked(spark, tmp_path):
    objects = spark.createDataFrame([("a/b.bin", b"xyz"), ("c.bin", None)], "key string, data binary")
    assert {r.key: r.size for r in files.put_objects(objects, str(tmp_path / "o")).collect()} == {"a/b.bin": 3, "c.bin": 0}
    files.put_objects(objects, str(tmp_path / "o")).collect()  # again: the same files
    assert {r.key: bytes(r.data) for r in files.get_objects(spark, str(tmp_path / "o")).collect()} == {"a/b.bin": b"xyz"}  # the empty one has no row
    with pytest.raises(Exception, match="no key"):
        files.put_objects(spark.createDataFrame([("../x", b"")], "key string, data binary"), str(tmp_path / "o")).collect()
    (tmp_path / "good.jsonl").write_text('{"id": 1, "q": "a"}\n')
    (tmp_path / "bad.jsonl").write_text('{"id": 1, "q": "a"}\n{"id": "x"\n')
    (tmp_path / "less.jsonl").write_text('{"id": 1}\n')
    read = lambda name: files.read_json_lines(spark, str(tmp_path / name), "id int, q string", ("q",)).collect()
    assert [tuple(r) for r in read("good.jsonl")] == [(1, "a")]
    for name in ("bad.jsonl", "less.jsonl"):
        with pytest.raises(Exception):
            read(name)
    document = {"sourceIdentity": "s", "title": "t", "blocks": [{"page": 1, "titlePath": ["a"], "structuralId": "b1", "blockType": "TEXT", "content": "c"}]}
    (tmp_path / "m.json").write_text(json.dumps({"schemaVersion": "1", "documents": [document]}))
    assert [(r.source_identity, r["index"], r.content) for r in files.read_manifest(spark, str(tmp_path / "m.json"), "1").collect()] == [("s", 0, "c")]
    with pytest.raises(Exception, match="schema version"):
        files.read_manifest(spark, str(tmp_path / "m.json"), "2").collect()


def test_search_tokens_and_normal_forms(spark):
    assert X.words_of("Ｆｕｌｌ ﬁne_x 中文 ok") == ["full", "fine", "x", "中", "文", "ok"]
    assert X.words_of("中文 ok", lambda t: ["中文", "ok"]) == ["中", "文", "ok"]
    got = spark.createDataFrame([(" éa\r\nb ",), (None,)], "t string").select(X.normalized_text(F.col("t")).alias("n")).collect()
    assert (got[0].n.text, got[0].n.places) == ("éa\nb", [1, 3, 4, 6, 7]) and got[1].n.text is None


def test_temporary_tables_go_and_results_stay(spark):
    from pathlib import Path

    with temporary():
        inner = materialize(spark.range(3), "inner")
        with temporary():
            result = keep(inner.filter("id > 0"), "result")
        assert result.count() == 2
        out = keep(result, "out")
    assert out.count() == 2
    path = lambda df: Path(df._quern_path.split(":", 1)[-1])
    assert path(out).exists() and not path(inner).exists() and not path(result).exists()


def test_the_driver_lists_no_objects(spark, tmp_path):
    objects = spark.createDataFrame([(f"d/{i}.txt" if i % 3 else f"{i}/x/{i}.bin", bytes([i % 251]) * (i % 7)) for i in range(300)], "key string, data binary")
    folder = str(tmp_path / "o")
    files.put_objects(objects, folder).count()
    (tmp_path / "o" / "_attempts" / "dead.txt").write_bytes(b"cut")  # of a task that died
    for pattern, name in (("*", "."), ("*.txt", ".txt")):
        got = files.get_objects(spark, folder, pattern)
        assert got.inputFiles() == []
        wanted = {r.key: bytes(r.data) for r in objects.collect() if r.data and name in r.key}
        rows = got.collect()
        assert {r.key: bytes(r.data) for r in rows} == wanted and len(rows) == len(wanted)
