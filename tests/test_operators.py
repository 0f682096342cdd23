"""Operators on small cases worked out by hand."""

import hashlib
import json
import random

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern.config import ChunkPolicy, RetrievalConfig
from quern.functions import scalar as S
from quern.operators import access as A
from quern.operators import analytics as N
from quern.operators import chunking as C
from quern.operators import qa, redaction, search
from quern.operators import retrieval as R
from quern.sources import blocks as B
from quern.streaming import logs


def test_policies_reject_bad_bounds():
    with pytest.raises(ValueError):
        ChunkPolicy(min_tokens=900)
    with pytest.raises(ValueError):
        ChunkPolicy(overlap_tokens=100)
    with pytest.raises(ValueError):
        RetrievalConfig(weights={"qa_vector": -1.0})
    with pytest.raises(ValueError):
        RetrievalConfig(weights={"other": 1.0})
    assert ChunkPolicy().config_hash() == ChunkPolicy().config_hash() != ChunkPolicy(target_tokens=400).config_hash()


def test_scope_needs_its_ancestors():
    with pytest.raises(ValueError):
        A.Scope(department="d")
    with pytest.raises(ValueError):
        A.Scope(space="s", category="c")


def test_access_never_leaks(spark):
    docs = spark.createDataFrame(
        [(1, "t", "READY", None), (2, "t", "READY", None), (3, "t", "READY", None), (4, "u", "READY", None), (5, "t", "FAILED", None)],
        "id int, tenant_id string, status string, deleted_at date",
    )
    rules = spark.createDataFrame(
        [(1, "ALL_AUTHENTICATED", "*"), (1, "USER", "me"), (2, "ROLE", "hr"), (3, "DEPARTMENT", "d1"), (4, "ALL_AUTHENTICATED", "*"), (5, "ALL_AUTHENTICATED", "*")],
        "document_id int, subject_type string, subject_id string",
    )
    seen = lambda p, s=None: sorted(r.id for r in A.visible_documents(docs, rules, p, s).collect())
    assert seen(A.Principal("t", "me")) == [1]
    assert seen(A.Principal("t", "me", ("d1",), ("hr",))) == [1, 2, 3]
    assert seen(A.Principal("t", "x", is_admin=True)) == [1, 2, 3]
    assert seen(A.Principal("t", "me"), A.Scope(document_ids=frozenset())) == []


def test_scalar_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert get(S.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0)))) == 0.0
    assert get(S.char_overlap(S.characters(F.lit("ab c")), S.characters(F.lit("ABx")))) == pytest.approx(2 / 3)
    assert get(S.char_overlap(S.characters(F.lit("")), S.characters(F.lit("a")))) == 0.0
    assert get(S.json_slice(F.lit('```json\n{"a": 1}\n``` thanks'))) == '{"a": 1}'
    assert get(S.retry_delay(F.lit(20))) == 600.0
    assert get(S.token_count(F.lit("Hello, 中文 w0rld"))) == 4
    assert get(S.fallback_embedding(F.lit("ab"))) == [ord("a") % 29 + 1, ord("b") % 29 + 1, 0.0, 0.0]


def test_markdown_blocks():
    text = "# A\n\nfirst\nsecond\n\n## B\n- x\n  y\n\n```py z\ncode\n\nmore\n```\n> q\n|a|b|\n\n|a|b|\n|---|:---:|\n|1|2|\n"
    got = [(b["block_type"], b["content"], b["title_path"], b["line_start"], b["line_end"]) for b in B.markdown_blocks(text)]
    assert got == [
        ("TEXT", "first\nsecond", ["A"], 3, 4),
        ("LIST", "- x\n  y", ["A", "B"], 7, 8),
        ("CODE", "```py z\ncode\n\nmore\n```", ["A", "B"], 10, 14),
        ("QUOTE", "> q\n|a|b|", ["A", "B"], 15, 16),
        ("TABLE", "|a|b|\n|---|:---:|\n|1|2|", ["A", "B"], 18, 20),
    ]
    assert json.loads(B.markdown_blocks(text)[2]["metadata"]) == {"language": "py"}
    assert B.markdown_blocks("") == []
    again = B.markdown_blocks(B.blocks_to_markdown(B.markdown_blocks(text)))
    assert [b["content"] for b in again] == [b["content"] for b in B.markdown_blocks(text)]


def test_csv_blocks_pack_rows():
    text = "﻿id;name\n\n" + "\n".join(f"{i};n|{i}" for i in range(1, 400))
    got = B.csv_blocks(text, 500)
    assert got[0]["line_start"] == 2 and got[-1]["line_end"] == 400
    assert all(a["line_end"] + 1 == b["line_start"] for a, b in zip(got, got[1:]))
    assert all(b["content"].startswith("| id | name |\n| --- | --- |\n") for b in got)
    assert r"n\|1" in got[0]["content"] and B.csv_blocks("") == []


def test_json_sources():
    items = [{"type": "text", "text": "T", "text_level": 1}, {"type": "text", "text": "body", "page_idx": 2}, {"type": "image"}]
    got = B.content_list_blocks(json.dumps(items))
    assert [(b["content"], b["page_no"], b["title_path"]) for b in got] == [("body", 3, ["T"])]
    tree = {
        "body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/texts/1"}, {"$ref": "#/tables/0"}]},
        "texts": [{"label": "title", "text": "T"}, {"label": "page_header", "text": "no"}],
        "tables": [{"label": "table", "data": {"grid": [[{"text": "a"}], [{"text": "1"}]]}, "prov": [{"page_no": 4}]}],
    }
    assert [(b["content"], b["page_no"]) for b in B.tree_blocks(json.dumps(tree))] == [("| a |\n| --- |\n| 1 |", 4)]


def test_unknown_and_broken_files_become_errors(spark):
    files = spark.createDataFrame([(1, "a.exe", "x"), (2, "a.list.json", "{"), (3, "a.md", "ok")], "id int, name string, content string")
    got = {r.id: r.error for r in B.parse_files(files).collect()}
    assert got[1] == "UNSUPPORTED" and got[2].startswith("BROKEN") and got[3] is None


SMALL = ChunkPolicy(min_tokens=5, target_tokens=12, max_tokens=20, overlap_tokens=4, parent_max_tokens=40)


def test_chunking_is_the_same_on_any_partitioning(spark):
    rows = [(d, i, f"Sentence {i} of {d}. " * 30, "TEXT", 1, ["a"]) for d in range(6) for i in range(4)]
    frame = spark.createDataFrame(rows, "id int, index int, content string, block_type string, page_no int, title_path array<string>")
    results = [sorted(map(str, C.chunk_documents(frame.repartition(n), SMALL).collect())) for n in (1, 5)]
    assert results[0] == results[1] and results[0]


def test_evidence_dedup_keeps_the_strongest(spark):
    rows = [
        ("q", 1, "a", 0.9, "h1", "b", 0, 10), ("q", 1, "b", 0.8, "h2", "b", 1, 10), ("q", 2, "c", 0.7, "h1", "b", 0, 10),
        ("q", 1, "d", 0.6, "h3", "b", 8, 30), ("q", 1, "e", 0.5, "h4", "c", 0, 10), ("r", 1, "a", 0.1, "h1", "b", 0, 10),
    ]
    frame = spark.createDataFrame(rows, "query_id string, document_id int, item_id string, fused_score double, content_hash string, block string, span_start int, span_end int")
    got = sorted((r.query_id, r.item_id, r.merged) for r in R.deduplicate(frame).collect())
    assert got == [("q", "a", 3), ("q", "d", 1), ("q", "e", 1), ("r", "a", 1)]


def brute_top(items, queries, k, score):
    """The k best (score, item) of each query by score, then by document, index and item."""
    out = {}
    for q, asked in queries:
        scored = [(-round(score(asked, item), 6), d, i, n) for d, n, i, item in items if score(asked, item) is not None]
        out[q] = [(n, -s) for s, d, i, n in sorted(scored)[:k]]
    return out


def found_top(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.rank):
        out.setdefault(r.query_id, []).append((r.item_id, r.score))
    return out


@pytest.mark.parametrize("block,pairs", [(1000, 1 << 21), (4, 40)])
def test_channels_equal_brute_force_in_any_number_of_blocks(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(search, "QUERY_BLOCK", block)  # 4: the nine questions take several blocks
    monkeypatch.setattr(search, "PAIRS", pairs)
    draw = random.Random(3)
    vectors = [[float(draw.randint(-3, 3)) for _ in range(draw.choice((3, 3, 3, 2)))] for _ in range(60)]
    texts = ["".join(draw.choice("abcdef É\n") for _ in range(draw.randint(0, 12))) for _ in range(60)]
    items = [(n % 5, f"i{n}", n % 7, vectors[n] if n % 9 else None, texts[n] if n % 11 else None) for n in range(60)]
    frame = spark.createDataFrame(items, "document_id int, item_id string, item_index int, embedding array<float>, search_text string").repartition(5)
    asked = [(i, [float(draw.randint(-3, 3)) for _ in range(3)] if i else None, "".join(draw.choice("abcXÉ ") for _ in range(6))) for i in range(9)]
    queries = spark.createDataFrame(asked, "query_id int, vector array<float>, query string")
    assert len(search.query_blocks(queries)) == (1 if block > 9 else 5)

    def cosine(a, b):
        if a is None or not b:
            return None
        norm = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / norm if len(a) == len(b) and norm else 0.0

    def characters(a, b):
        own = set("".join(a.lower().split()))
        return len(own & set((b or "").lower())) / max(1, len(own)) or None

    got = found_top(R.vector_channel(frame, queries, 4).collect())
    wanted = brute_top([(d, n, i, v) for d, n, i, v, _ in items], [(q, v) for q, v, _ in asked], 4, cosine)
    assert got == {q: top for q, top in wanted.items() if top}
    got = found_top(R.text_channel(frame, queries, 4).collect())
    assert got == {q: top for q, top in brute_top([(d, n, i, x) for d, n, i, _, x in items], [(q, x) for q, _, x in asked], 4, characters).items() if top}
    words = spark.createDataFrame([(0, 0, 0, "red Blue red"), (0, 1, 1, "blue"), (1, 2, 0, "green")], "document_id int, item_id int, item_index int, search_text string")
    asked = spark.createDataFrame([(0, "Red, blue."), (1, None)], "query_id int, query string")
    assert found_top(R.token_channel(words, asked, 5).collect()) == {0: [(0, 1.0), (1, 0.5)]}


def test_passages_are_found_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    draw = random.Random(9)
    texts = [(i, None if i == 5 else "".join(draw.choice("ab") for _ in range(40))) for i in range(30)]
    passages = [(i, "".join(draw.choice("ab") for _ in range(draw.randint(1, 7)))) for i in range(12)] + [(12, ""), (13, None), (14, "ab"), (15, "ab")]
    got = search.passage_matches(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(passages, "passage_id int, passage string"))
    wanted = sorted((p, i) for p, x in passages for i, t in texts if x is not None and t is not None and x in t)
    assert sorted((r.passage_id, r.id) for r in got.collect()) == wanted


def corpus(spark):
    """Three documents of one tenant, of which one is for another role; a chunk of each, and pairs."""
    docs = spark.createDataFrame([(1, "t", "READY", None), (2, "t", "READY", None), (3, "t", "READY", None)], "id int, tenant_id string, status string, deleted_at date")
    rules = spark.createDataFrame([(1, "ALL_AUTHENTICATED", "*"), (2, "ALL_AUTHENTICATED", "*"), (3, "ROLE", "payroll")], "document_id int, subject_type string, subject_id string")
    chunks = [(d, f"c{d}{k}", f"p{d}", k, f"text {k} of refunds {d}" if k else "salary table refund") for d in (1, 2, 3) for k in range(3)]
    chunks = spark.createDataFrame(chunks, "document_id int, chunk_id string, parent_chunk_id string, chunk_index int, content string")
    chunks = chunks.selectExpr("*", "array('Refunds') AS title_path", "content AS search_text", "array(1D, CAST(chunk_index AS DOUBLE)) AS embedding")
    pairs = spark.createDataFrame([(1, "q1", 0, "c11", "how are refunds paid"), (3, "q3", 0, "c31", "refund of salary"), (2, "q2", 0, None, "refund without a chunk")], "document_id int, item_id string, item_index int, chunk_id string, question string")
    pairs = pairs.selectExpr("*", "'answer' AS answer", "question AS search_text", "array(1D, 0.5D) AS embedding")
    queries = spark.createDataFrame([(0, "refund salary", [1.0, 0.0])], "query_id int, query string, vector array<double>")
    return docs, rules, chunks, pairs, queries


def scoped(frame, docs, rules, principal):
    seen = A.visible_documents(docs, rules, principal).select(F.col("id").alias("document_id"))
    return frame.join(seen, "document_id", "left_semi")


def test_retrieval_never_shows_what_the_principal_may_not_see(spark):
    docs, rules, chunks, pairs, queries = corpus(spark)
    config = RetrievalConfig(confidence=0.1)
    parents = chunks.groupBy("document_id", "parent_chunk_id").agg(F.array_join(F.sort_array(F.collect_list("content")), " ").alias("content")).withColumnRenamed("parent_chunk_id", "chunk_id")
    seen = {}
    for name, principal in (("me", A.Principal("t", "me")), ("boss", A.Principal("t", "boss", role_ids=("payroll",)))):
        own = [scoped(x, docs, rules, principal) for x in (pairs, chunks, parents)]
        final = R.hybrid_retrieve(queries, own[0], own[1], config)
        context = R.hydrate(final, own[1], own[2])
        qa = R.qa_retrieve(queries, own[0], config)
        seen[name] = {r.document_id for r in final.collect()}, {r.context_id[1] for r in context.collect()}, {r.document_id for r in qa.collect()}
        assert all(r.has_answer for r in final.collect())
    assert seen["me"][0] == {1, 2} and seen["me"][2] == {1, 2} and "3" not in seen["me"][1]
    assert 3 in seen["boss"][0] and 3 in seen["boss"][2]


def test_missing_chunks_and_failing_rerankers_degrade(spark):
    docs, rules, chunks, pairs, queries = corpus(spark)
    config = RetrievalConfig()
    lost = R.hybrid_retrieve(queries, pairs, lambda: spark.read.parquet("/nowhere/chunks"), config).collect()
    assert {r.item_id for r in lost} == {"q1", "q2", "q3"} and all(r.chunk_degraded for r in lost)
    with pytest.raises(AnalysisException):  # a wrong column is no outage
        R.hybrid_retrieve(queries, pairs, lambda: chunks.select("no_such_column"), config)

    def broken(candidates):
        raise ConnectionError

    plain = R.hybrid_retrieve(queries, pairs, chunks, config, broken).collect()
    assert plain and all(r.rerank_degraded and r.rerank_score == r.fused_score for r in plain)
    own = R.hybrid_retrieve(queries, pairs, chunks, config, lambda c: c.withColumn("rerank_score", F.when(F.col("item_id") == "c10", 9.0))).collect()
    assert {r.item_id: r.rerank_degraded for r in own}["c10"] is False and min(r.final_rank for r in own if r.item_id == "c10") == 1


def test_fusion_adds_both_ranks_of_two_pairs_of_one_chunk(spark):
    hits = spark.createDataFrame(
        [("qa_vector", 0, 1, 1, 0.9, "a"), ("qa_vector", 0, 1, 4, 0.5, "a"), ("chunk_text", 0, 1, 2, 0.7, "a"), ("qa_text", 0, 1, 1, 0.3, "b")],
        "channel string, query_id int, document_id int, rank int, score double, chunk_id string",
    )
    got = {r.chunk_id: r for r in R.fuse(hits, RetrievalConfig(), "chunk_id").collect()}
    assert got["a"].fused_score == round(1 / 61 + 1 / 64 + 1 / 62, 9) and (got["a"].qa_vector_rank, got["a"].qa_vector_score) == (4, 0.5)
    assert got["b"].fused_score == round(1 / 61, 9) and got["b"].chunk_text_rank is None


def test_hydration_skips_what_is_held(spark):
    final = spark.createDataFrame([(1, "c1", 1, "p", 1, 1, 0.9, "alpha beta"), (1, "c9", 2, None, 0, 2, 0.5, "other")], "query_id int, item_id string, document_id int, parent_chunk_id string, chunk_index int, final_rank int, fused_score double, content string")
    chunks = spark.createDataFrame([(1, "p", 0, "c0", "before  it"), (1, "p", 1, "c1", "alpha beta"), (1, "p", 2, "c2", "quite new"), (1, "p", 3, "c3", "far")], "document_id int, parent_chunk_id string, chunk_index int, chunk_id string, content string")
    parents = spark.createDataFrame([(1, "p", "before it\nalpha \n beta gamma"), (2, "p", "another document's")], "document_id int, chunk_id string, content string")
    got = [(r.item_id, r.kind, r.context_id, r.content) for r in R.hydrate(final, chunks, parents).collect()]
    assert got == [("c1", "PARENT", "p", "before it gamma"), ("c1", "NEIGHBOR", "c2", "quite new")]


def test_context_window_takes_half_of_the_budget_on_each_side(spark):
    get = lambda p, c, n: spark.range(1).select(S.context_window(F.lit(p), F.lit(c), n)).first()[0]
    assert get("a b c d, e CHILD x f. g h i j", "CHILD  x", 4) == "e f. g"  # the left side's last part: a b | c d | e
    assert get("CHILD", "CHILD", 4) == "" and get("nothing", "CHILD", 4) == "" and get("x", "", 4) == ""


def test_snapshots_hold_ranks_and_no_texts(spark):
    stage = spark.createDataFrame([(1, i, f"e{i}", 0.5, "secret text") for i in range(1, 5)], "query_id int, rank int, evidenceId string, score double, content string")
    made = R.snapshots({"rrf": stage}, 3, ("evidenceId", "score", "content"))
    whole = F.concat(F.lit('{"question": "secret", "chunkerConfigHashes": [" b", "a", "a", ""], "stages": '), "snapshot", F.lit("}"))
    got = json.loads(made.select(redaction.sanitized_snapshot(whole, 2)).first()[0])
    assert got == {"chunkerConfigHashes": ["a", "b"], "stages": {"rrf": [{"evidenceId": f"e{i}", "rank": i, "score": 0.5} for i in (1, 2)]}}
    clean = lambda f, text: json.loads(spark.range(1).select(f(F.lit(text))).first()[0])
    assert clean(redaction.sanitized_item, '{"documentId": "d", "quote": "secret", "rank": 3}') == {"documentId": "d", "rank": 3}
    assert clean(redaction.sanitized_filters, '{"scopeSpaceId": "s", "query": "secret"}') == {"scopeSpaceId": "s"}
    assert clean(redaction.sanitized_parameters, '{"k": 60, "weights": {"qa_text": 1.5}, "note": "secret"}') == {"k": 60.0, "weights": {"qa_text": 1.5}}


def test_redaction(spark):
    get = lambda c: spark.range(1).select(c).first()[0]
    assert get(S.redacted(F.lit("GET /?access_token=abc&x=1 and sk-ABCDEFGHIJKLMNOP"))) == "GET /?access_token=***REDACTED***&x=1 and ***REDACTED***"
    assert get(S.redacted(F.lit("sent Bearer abc"))) == "***REDACTED***" and get(S.redacted(F.lit("nothing here"))) == "nothing here"
    payload = F.create_map(*(F.lit(x) for x in ("API-Key", "x", "keyPrefix", "sk-ABCDEFGHIJKLMNOP", "note", "password=1 b", "n", "7")))
    assert get(S.redacted_payload(payload)) == {"API-Key": "***REDACTED***", "keyPrefix": "sk-ABCDEFGHIJKLMNOP", "note": "password=***REDACTED*** b", "n": "7"}


def test_quality_metrics(spark):
    ranked = spark.createDataFrame([("a", 1, 1, "xx"), ("a", 2, 2, "has key"), ("b", 3, 1, "secret")], "query_id string, document_id int, rank int, content string")
    expected = spark.createDataFrame([("a", 2, "key", True), ("b", 3, "secret", False), ("c", 4, "z", True)], "query_id string, document_id int, anchor string, visible boolean")
    got = N.retrieval_quality(ranked, expected).first()
    assert (got.recall_at_5, got.mrr_at_10, got.empty_rate, got.permission_leak_rate, got.evaluated) == (0.5, 0.25, 0.5, 1.0, 2)


def test_answers_are_validated(spark):
    good = {"items": [{"question": "q", "answer": "a", "quote": "two  words", "pageNo": 1, "chunkIndex": 0}], "coveredChunkIndexes": [0], "skippedChunks": [{"chunkIndex": 1, "reason": "r"}]}
    bad = {**good, "skippedChunks": []}
    rows = [(1, 1, [0, 1], f"```\n{json.dumps(good)}\n```"), (2, 1, [0, 1], json.dumps(bad)), (3, 1, [0, 1], "nothing")]
    answers = spark.createDataFrame(rows, "batch_id int, document_id int, expected array<int>, output string")
    chunks = spark.createDataFrame([(1, 0, "a two words b", 1, 1), (1, 1, "x", 1, 1)], "document_id int, chunk_index int, content string, page_start int, page_end int")
    got = {r.batch_id: r.error for r in qa.validate_answers(answers, chunks).collect()}
    assert got == {1: None, 2: "COVERAGE", 3: "INVALID_JSON"}


def test_answers_with_odd_pages_quotes_and_no_items(spark):
    def answer(quote="two words", covered=(0, 1), skipped=(), items=None, **more):
        item = {"question": "q", "answer": "a", "quote": quote, "chunkIndex": 0, **more}
        return json.dumps({"items": [item] if items is None else items, "coveredChunkIndexes": list(covered), "skippedChunks": [{"chunkIndex": i, "reason": "r"} for i in skipped]})

    cases = [
        (answer(pageNo=2), None), (answer(), "PAGE_RANGE"), (answer(pageNo="x"), "PAGE_RANGE"), (answer(pageNo="2"), "PAGE_RANGE"), (answer(pageNo=0), "PAGE_RANGE"),
        (answer(pageNo=2.5), "PAGE_RANGE"), (answer(pageNo=True), "PAGE_RANGE"), (answer(pageNo=None), "PAGE_RANGE"), (answer(pageNo=4), "PAGE_RANGE"), (answer("\u3000", pageNo=2), "MISSING_FIELD"),
        (answer("cafe\u0301\u00a0au lait", pageNo=2), None), (answer("caf au", pageNo=2), "QUOTE_NOT_FOUND"), (answer(pageNo=2, chunkIndex=5), "UNKNOWN_CHUNK"), (answer(pageNo=2, chunkIndex=None), "UNKNOWN_CHUNK"),
        (answer(items=[], covered=(), skipped=(0, 1)), None), (answer(items=[], covered=(), skipped=(0,)), "COVERAGE"), (answer(items=[], covered=(0, 1)), None), ("{}", "INVALID_JSON"), ("[1]", "INVALID_JSON"),
    ]
    answers = spark.createDataFrame([(i, 1, [0, 1], text) for i, (text, _) in enumerate(cases)], "batch_id int, document_id int, expected array<int>, output string")
    chunks = spark.createDataFrame([(1, 0, "a two words, caf\u00e9 au\nlait", 2, 3), (1, 1, "x", 1, 1)], "document_id int, chunk_index int, content string, page_start int, page_end int")
    got = {r.batch_id: r.error for r in qa.validate_answers(answers, chunks).collect()}
    assert got == {i: error for i, (_, error) in enumerate(cases)}


def test_all_white_space_of_unicode_counts(spark):
    get = lambda c: spark.range(1).select(c).first()[0]
    white = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    text = "a" + "b".join(white) + "c"
    assert get(S.normalized(F.lit(text))) == "a" + "b" * (len(white) - 1) + "c" and get(S.collapsed(F.lit("".join(white) + "x\u3000\u00a0y"))) == "x y"
    assert sorted(get(S.characters(F.lit(text)))) == ["a", "b", "c"]
    items = spark.createDataFrame([(1, "i", 0, "\u3000 z"), (2, "j", 0, "ab")], "document_id int, item_id string, item_index int, search_text string")
    asked = spark.createDataFrame([(1, "a\u3000\u00a0")], "query_id int, query string")
    assert [(r.item_id, r.score) for r in R.text_channel(items, asked, 5).collect()] == [("j", 1.0)]


def test_context_without_a_token_is_left_out(spark):
    final = spark.createDataFrame([(1, "c1", 1, "p", 1, 1, 0.5, "one two")], "query_id int, item_id string, document_id int, parent_chunk_id string, chunk_index int, final_rank int, fused_score double, content string")
    chunks = spark.createDataFrame([("c0", 1, "p", 0, "---"), ("c1", 1, "p", 1, "one two"), ("c2", 1, "p", 2, "three")], "chunk_id string, document_id int, parent_chunk_id string, chunk_index int, content string")
    parents = spark.createDataFrame([("p", 1, "*** one two ***")], "chunk_id string, document_id int, content string")
    assert [(r.kind, r.content) for r in R.hydrate(final, chunks, parents).collect()] == [("NEIGHBOR", "three")]


def test_archive_is_repeatable(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00"), (3, "2024-02-01 00:00:00")], "id int, t string").selectExpr("id", "CAST(t AS TIMESTAMP_NTZ) AS t")
    for _ in range(2):
        N.write_archive(rows, str(tmp_path / "a"), "t", "2024-01-15")
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "a")).collect()) == [1, 2]
    assert [r.id for r in N.kept_after_archive(rows, "t", "2024-01-15").collect()] == [3]


def test_rate_limit_ignores_rejected_calls(spark, tmp_path):
    calls = [(1, i, float(t)) for i, t in enumerate([0, 10, 20, 61, 62, 130])]
    spark.createDataFrame(calls, "key int, id int, at double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key int, id int, at double").parquet(str(tmp_path / "in"))
    limited = logs.rate_limited(stream, 2)
    query = limited.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.id: r.allowed for r in spark.table("limited").collect()}
    held, expected = [], {}
    for _, i, at in calls:
        held = [t for t in held if t > at - 60]
        expected[i] = len(held) < 2
        held += [at] * expected[i]
    assert got == expected


def test_embedding_batches_check_sizes(spark):
    texts = spark.createDataFrame(pd.DataFrame({"id": range(5), "text": list("abcde")}))
    got = R.embed_batches(texts, lambda xs: [[float(ord(x)), 0.0] for x in xs], 2, batch=2).collect()
    assert sorted(r.vector[0] for r in got) == [97.0, 98.0, 99.0, 100.0, 101.0]
    with pytest.raises(Exception, match="another number"):
        R.embed_batches(texts, lambda xs: xs[:1], 2).collect()


def test_the_digest_of_a_query_set_takes_every_text_whole(spark):
    texts = [f"question {i % 700}" for i in range(1500)] + ["", None, None, "é", "é", "é"]
    ranked = spark.createDataFrame([(1, 7, 1)], "query_id int, document_id int, rank int")
    expected = ranked.select("query_id", "document_id")

    def digest(texts):
        queries = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, query string").repartition(5)
        return [r.dataset_hash for r in N.comparison({"m": ranked}, expected, queries).collect()]

    wanted = ",".join(sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts if t is not None))
    assert digest(texts) == [hashlib.sha256(wanted.encode()).hexdigest()]
    assert digest([None]) == digest([]) == [None]


def test_roles_are_expanded_once_for_each_group(spark):
    users = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2), (5, None)], "user_id int, region int")
    grants = spark.createDataFrame([(0, "b", "y"), (0, "a", "x"), (0, "a", "y"), (1, "c", None)], "region int, role string, permission string")
    made = A.expanded_roles(users, grants, "region")
    assert sorted(map(tuple, made.collect()), key=str) == [(1, ["a", "b"], ["x", "y"]), (2, ["a", "b"], ["x", "y"]), (3, ["c"], None)]


def test_no_list_of_permissions_is_sorted_for_a_user(spark):
    from quern.plans import operations  # noqa: F401
    from quern.plans.queries import QUERIES

    plan = QUERIES["joi13_rbac_expansion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    users = plan[: plan.index("Join")]
    assert not any(name in users for name in ("sort", "distinct", "flatten"))
