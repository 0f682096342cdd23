"""Chunking: bounds and losslessness on any blocks, and each type's handler on small cases worked out by hand."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.config import ChunkPolicy
from quern.operators import chunking as C
from quern.operators import handlers as H

SMALL = ChunkPolicy(min_tokens=5, target_tokens=12, max_tokens=20, overlap_tokens=4, parent_max_tokens=40)
KINDS = ["TEXT", "QUOTE", "LIST", "TABLE", "CODE", "FORMULA", "IMAGE"]


def block(index, kind, content, path=("s",), **metadata):
    return {"index": index, "content": content, "block_type": kind, "page_no": index + 1, "title_path": list(path), "metadata": json.dumps(metadata)}


def children(blocks, policy=SMALL, **more):
    return [r for r in C.chunk_document(blocks, policy, **more) if r["chunk_level"] == "CHILD"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(KINDS), st.text("ab c.\n|-1é中`$\\\\", max_size=300)), max_size=6))
def test_chunks_are_bounded_and_prose_is_lossless(blocks):
    rows = [block(i, k, c) for i, (k, c) in enumerate(blocks)]
    got = C.chunk_document(rows, SMALL)
    assert all(r["token_count"] <= SMALL.max_tokens for r in got if r["chunk_level"] == "CHILD")
    assert all(r["token_count"] <= SMALL.parent_max_tokens + SMALL.max_tokens for r in got)
    flat = lambda text: "".join(text.split())
    if all(k in C.PROSE for k, _ in blocks):
        own = [r["content"][r["prefix_chars"] :] for r in got if r["chunk_level"] == "CHILD"]
        assert flat("".join(own)) == flat("".join(c for _, c in blocks))


@settings(max_examples=100, deadline=None)
@given(st.text("ab c.,\n", max_size=400), st.integers(1, 9))
def test_hard_cuts_fit_a_counter_that_does_not_rise_evenly(text, limit):
    count = lambda t: max(1, len(t) // 3 - t.count("ab")) if t else 0  # noqa: E731  falls where "ab" is completed
    parts = list(H.hard_cut(text, limit, count))
    assert "".join(parts) == text and all(count(p) <= limit or len(p) == 1 for p in parts)


def test_blocks_must_have_their_own_index():
    with pytest.raises(ValueError):
        C.chunk_document([block(1, "TEXT", "a"), block(1, "TEXT", "b")], SMALL)
    told = []
    C.chunk_document([block(0, "TEXT", "  "), block(1, "TEXT", "tiny"), block(2, "IMAGE", "")], SMALL, warnings=told)
    assert told == ["EMPTY:0", "TINY:1", "SKIPPED:2"]


def test_small_prose_merges_forward_then_backward():
    words = lambda n, w: " ".join([w] * n)
    got = children([block(0, "TEXT", words(3, "a")), block(1, "TEXT", words(10, "b")), block(2, "QUOTE", words(2, "c")), block(3, "TABLE", "x"), block(4, "TEXT", words(8, "d"), ("t",))])
    assert [(r["block_indexes"], r["block_type"]) for r in got] == [([0, 1, 2], "TEXT"), ([3], "TABLE"), ([4], "TEXT")]
    assert (got[0]["page_start"], got[0]["page_end"]) == (1, 3)


def test_a_short_tail_takes_words_from_the_part_before():
    parts = [("sentence", "one two three four. five six seven eight. nine ten. "), ("sentence", "end. ")]
    got = C.balanced_tail(parts, SMALL, C.count_tokens)
    assert "".join(p for _, p in got) == "".join(p for _, p in parts) and all(SMALL.min_tokens <= C.count_tokens(p) for _, p in got)
    whole = " ".join(f"Sentence {i} has five words." for i in range(5))
    assert all(r["token_count"] >= SMALL.min_tokens for r in children([block(0, "TEXT", whole)]))


def test_table_repeats_caption_and_header():
    text = "Caption here\n| a | b |\n| --- | --- |\n" + "\n".join(f"| row {i} | value number {i} |" for i in range(5))
    parts = H.table(text, SMALL, C.count_tokens, H.Context(metadata={"rowStart": 2}))
    assert [m["rows"] for _, m in parts] == [[2, 3], [4, 5], [6, 6]] or [m["rows"] for _, m in parts] == [[i, i] for i in range(2, 7)]
    assert all(p.startswith("Caption here\n| a | b |\n| --- | --- |\n| row") for p, _ in parts)


def test_wide_rows_are_cut_by_columns_then_by_cells():
    head = "| one | two | three |\n| --- | --- | --- |\n"
    long = " ".join(["w"] * 30)
    parts = H.table(head + f"| {' '.join(['x'] * 10)} | {' '.join(['y'] * 10)} | {long} |", SMALL, C.count_tokens, H.Context())
    assert [m.get("columns") for _, m in parts] == [[0, 0], [1, 1], [2, 2], [2, 2]]
    assert parts[0][0].startswith("| one |\n| --- |\n| x") and parts[2][0].startswith("three: w") and all(C.count_tokens(p) <= 20 for p, _ in parts)


def test_code_is_cut_by_symbols_and_gaps_within_its_fences():
    text = "```py\nimport x\n\ndef f():\n    return 1\n\ndef g():\n    return 2\n```"
    symbols = [{"signature": "f", "lineStart": 3, "lineEnd": 4}, {"signature": "g", "lineStart": 6, "lineEnd": 7}, {"signature": "bad", "lineStart": 9, "lineEnd": 8}]
    parts = H.code(text, SMALL, C.count_tokens, H.Context(metadata={"symbols": symbols}))
    assert [(m["lines"], m["reason"], m.get("signature")) for _, m in parts] == [([1, 2], "symbol_gap", None), ([3, 4], "symbol", "f"), ([6, 7], "symbol", "g")]
    assert all(p.startswith("```py\n") and p.endswith("\n```") for p, _ in parts)
    long = "~~~\n" + "\n".join(f"line {i} of code" for i in range(12)) + "\n~~~"
    parts = H.code(long, SMALL, C.count_tokens, H.Context())
    assert [m["lines"] for _, m in parts] == [[1, 3], [4, 6], [7, 9], [10, 12]] and all(p.startswith("~~~\n") for p, _ in parts)


def test_images_say_each_thing_once():
    context = H.Context(("Doc", "Figures"), {"ocr": "A  chart", "alt": "a chart"}, "before it", "after it")
    section = "Section: Doc / Figures\n"
    assert H.image("Caption one", SMALL, C.count_tokens, context) == [(f"{section}Caption: Caption one\nOCR: A chart\nContext: before it", {}), (f"{section}Context: after it", {})]
    assert H.image("", SMALL, C.count_tokens, H.Context(before="text around")) == []


def test_formulas_are_cut_at_line_ends_within_their_environment():
    rows = " \\\\\n".join(f"a_{i} &= b_{i} + c_{i} + d_{i}" for i in range(6))
    parts = H.formula(f"\\begin{{align}}\n{rows}\n\\end{{align}}", SMALL, C.count_tokens, H.Context())
    assert len(parts) > 1 and all(p.startswith("\\begin{align}\n") and p.endswith("\n\\end{align}") and C.count_tokens(p) <= 20 for p, _ in parts)
    assert H.formula("E = mc^2", SMALL, C.count_tokens, H.Context(before="Energy  is")) == [("E = mc^2\n\nEnergy is", {})]


def test_lists_repeat_their_introduction():
    text = "Steps to take:\n" + "\n".join(f"- item {i} with words\n  and more" for i in range(5))
    parts = H.items(text, SMALL, C.count_tokens, H.Context())
    assert [m["items"] for _, m in parts] == [[0, 0], [1, 1], [2, 2], [3, 3], [4, 4]] and all(p.startswith("Steps to take:\n- item") for p, _ in parts)
    long = H.items("- " + " ".join(["w"] * 45) + "\n- x", SMALL, C.count_tokens, H.Context())
    assert all(C.count_tokens(p) <= 20 for p, _ in long) and sum(p.count("w") for p, _ in long) == 45


def test_a_deployment_may_bring_its_own_handler():
    own = {**C.HANDLERS, "TABLE": lambda text, policy, count, context: [("mine", {"k": 1})]}
    got = children([block(0, "TABLE", "| a |")], handlers=own)
    assert [(r["content"], json.loads(r["metadata"])) for r in got] == [("mine", {"k": 1})]
    with pytest.raises(ValueError):
        children([block(0, "TABLE", "x")], handlers={"TABLE": lambda *a: [("w " * 99, {})]})


def test_counters_and_services():
    import public_tokenizers

    from quern.config import Services, canonical_hash

    made = Services.of({"chunking": {"max_tokens": 900}, "retrieval": {"rrf_k": 10}, "vocabulary": public_tokenizers.path("byte_bpe_50k.json")})
    assert (made.policy.max_tokens, made.retrieval.rrf_k, made.counter.name, made.counter.version) == (900, 10, "byte-pairs", "byte_bpe_50k.json")
    text = "Unbelievable tokenization, naïve café 中文 " * 20
    parts = made.counter.split(text, 9)
    assert "".join(parts) == text and all(made.counter(p) <= 9 for p in parts)
    rows = children([block(0, "TEXT", text)], SMALL, count=made.counter)
    assert len(rows) > 3 and all(made.counter(r["content"]) <= 20 for r in rows)
    assert Services.of({}).counter("Hello, 中文 w0rld") == 4
    with pytest.raises(ValueError):
        Services.of({"other": 1})
    assert canonical_hash({"b": 1, "a": "é"}) == canonical_hash({"a": "é", "b": 1}) != canonical_hash({"a": "é", "b": 1}, ascii_only=False)
    with pytest.raises(ValueError):
        canonical_hash(float("nan"))


@settings(max_examples=100, deadline=None)
@given(st.text("ab_ c.\n-1é中文", max_size=60))
def test_places_count_any_part_as_the_counter_does(text):
    places = H.Places(text, C.count_tokens)
    for low in range(len(text) + 1):
        for high in range(low, len(text) + 1):
            assert places.tokens(low, high) == C.count_tokens(text[low:high])


def test_a_long_text_is_counted_a_few_times_only(spark):
    class Counting:
        read = 0

        def __call__(self, text):
            self.read += len(text)
            return C.count_tokens(text)

        def places(self, text):
            self.read += len(text)
            return C.count_tokens.places(text)

    count, text = Counting(), " ".join(f"word{i}." for i in range(20_000))
    assert len(children([block(0, "TEXT", text)], count=count)) > 1000
    assert count.read < 12 * len(text)


def test_documents_are_chunked_many_at_a_time(spark):
    rows = [(i, j, f"word {i} {j}. " * 30, "TEXT", 1, ["s"]) for i in (None, *range(40)) for j in range(3)]
    blocks = spark.createDataFrame(rows, "id long, index int, content string, block_type string, page_no int, title_path array<string>")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # documents go over the ends of batches
    made = C.chunk_documents(blocks.repartition(3), SMALL)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    names = [c for c in made.columns if c != "id"]
    wanted = [(i, *(c[n] for n in names)) for i in (None, *range(40)) for c in C.chunk_document([dict(zip(blocks.columns[1:], r[1:])) for r in rows if r[0] == i], SMALL)]
    got = sorted(map(str, map(tuple, made.collect())))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert got == sorted(map(str, wanted))
