"""Indexes against scans of all rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import text_index, vector_index
from quern.operators.search import search
from quern.operators.text_index import build_text_index, places, search_text_index
from quern.operators.vector_index import build_index, search_index

DDL = "document_id long, item_id long, item_index int, embedding array<float>"


def clustered(n, seed=1, centres=30, spread=0.2, dimension=33):
    draw = np.random.default_rng(seed)
    around = draw.normal(size=(centres, dimension))
    return (around[draw.integers(0, centres, n)] + spread * draw.normal(size=(n, dimension))).astype("f4")


def found(rows):
    return sorted((r.query_id, r["rank"], r.document_id, r.item_id, round(r.score, 6)) for r in rows.collect())


def test_vector_index_gives_the_rows_of_a_scan_and_reads_a_tenth(spark):
    vectors = clustered(12_000)
    items = spark.createDataFrame([(i % 97, i, i % 5, v.tolist()) for i, v in enumerate(vectors)], DDL).repartition(6)
    asked = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(3)] + [(9, clustered(1, 5)[0].tolist())], "query_id int, vector array<double>")
    index = build_index(items)
    assert index.cells.agg(F.sum("n")).first()[0] == 12_000 and index.cells.agg(F.max("n")).first()[0] <= vector_index.CELL
    read = {}
    got = found(search_index(index, asked.filter("query_id < 1"), 20, read))
    assert got == found(search(items, asked.filter("query_id < 1"), {"v": ("vector", 20)}))
    size = index.cells.select("list", "cell", (F.length("codes") + F.length("errors")).alias("codes"), F.length("vectors").alias("vectors"))
    bytes_read = sum(size.join(read[c], ["list", "cell"]).agg(F.sum(c)).first()[0] for c in ("codes", "vectors"))
    assert bytes_read < size.agg(F.sum("vectors")).first()[0] / 10
    assert found(search_index(index, asked, 7)) == found(search(items, asked, {"v": ("vector", 7)}))  # a question far from all
    assert "list" in index.cells.filter("list in (1, 2)")._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_vector_index_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "CELL", 16)
    monkeypatch.setattr(vector_index, "FIRST", 1)
    monkeypatch.setattr(vector_index, "GROUP", 2)
    draw = random.Random(2)
    rows = [(i % 7, i, 0, [draw.gauss(0, 1) for _ in range(5)]) for i in range(150)]
    rows += [(1, 200 + i, i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(90)]  # one vector many times
    rows += [(2, 300, 0, None), (2, 301, 0, []), (2, 302, 0, [0.0] * 5), (2, 303, 0, [1.0, 2.0]), (None, 304, None, [1.0, None, 3.0, 0.0, 0.0]), (3, 305, 0, [1.0] * 9)]
    items = spark.createDataFrame([(*r, "x") for r in rows], DDL + ", list string").repartition(3)
    asked = spark.createDataFrame(
        [(0, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, [0.0] * 5), (2, None), (3, []), (4, [-1.0, 0.5, 0.0, 2.0, 1.0]), (5, [3.0, 4.0]), (6, [-1.0, -2.0, -3.0, -4.0, -5.0])], "query_id int, vector array<double>"
    )
    index = build_index(items)
    for k in (1, 20, 400):
        wanted = [r for r in found(search(items, asked, {"v": ("vector", k)})) if r[0] != 5]
        assert [r for r in found(search_index(index, asked, k)) if r[0] != 5] == wanted
    assert len(found(search_index(index, asked, 3))) == 5 * 3
    assert search_index(build_index(items.limit(0)), asked, 5).count() == 0 and search_index(index, asked.limit(0), 5).count() == 0


@pytest.mark.parametrize("lists", [1, 3])
def test_vector_index_with_few_lists(spark, lists):
    vectors = clustered(400, seed=3, dimension=4)
    items = spark.createDataFrame([(i, i, i, v.tolist()) for i, v in enumerate(vectors)], DDL)
    asked = spark.createDataFrame([(i, vectors[i * 3].tolist()) for i in range(10)], "query_id int, vector array<double>")
    assert found(search_index(build_index(items, lists=lists), asked, 5)) == found(search(items, asked, {"v": ("vector", 5)}))


def plain_rank(items, asked, k):
    """All items against all questions, one by one."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = []
    for q, query in asked:
        terms = set(words(query))
        scored = []
        for document, item, index, text in items:
            counts = [min(words(text).count(w), 256) for w in terms]
            if any(counts):
                score = round(sum(0.1 * sum(1 / i**2 for i in range(1, c + 1)) / 1.64493406685 for c in counts) / len(terms), 6)
                scored.append((-score, document is not None, document or 0, index is not None, index or 0, item))
        out += [(q, rank, d if known else None, item, -s) for rank, (s, known, d, _, _, item) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def text_items(n, seed=4):
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.7)) % 900}" for _ in range(4000)]
    rows = [(i % 53, i, i % 4, " ".join(draw.choice(words) for _ in range(draw.randint(0, 30)))) for i in range(n)]
    return rows + [(1, n, 0, None), (1, n + 1, 0, ""), (None, n + 2, None, "w1 w2 W3"), (2, n + 3, 1, "w5 " * 700), (2, n + 4, 1, "w5 " * 300), *((3, n + 10 + i, i, "w7 w8 w9") for i in range(30))]


TEXTS = "document_id long, item_id long, item_index int, search_text string"


@pytest.mark.parametrize(("block", "k"), [(2048, 10), (7, 10), (16, 1), (64, 500)])
def test_text_index_gives_the_rows_of_a_scan(spark, monkeypatch, block, k):
    monkeypatch.setattr(text_index, "BLOCK", block)
    rows = text_items(300)
    asked = [(0, "w1 w7 w8"), (1, "w5"), (2, None), (3, ""), (4, "nothing"), (5, "w3, W3! w200 w41 w9"), (6, " ".join(f"w{i}" for i in range(60)))]
    items = spark.createDataFrame([(*r, "x") for r in rows], TEXTS + ", block string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id int, query string")
    index = build_text_index(items)
    got = search_text_index(index, queries, k)
    assert sorted(((r.query_id, r["rank"], r.document_id, r.item_id, round(r.score, 6)) for r in got.collect()), key=str) == plain_rank(rows, asked, k)
    assert search_text_index(build_text_index(items.limit(0)), queries, k).count() == 0


def test_text_index_reads_only_blocks_that_may_matter(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 32)
    rows = text_items(3000, seed=6)
    rows += [(9, 9000 + i, 0, "w77 w77 w77 w77 w78 w78 w78 w78") for i in range(40)]  # the best of the first question, in few blocks
    index = build_text_index(spark.createDataFrame(rows, TEXTS).coalesce(1))
    queries = spark.createDataFrame([(0, "w77 w78 w1")], "query_id int, query string")
    read = {}
    found = search_text_index(index, queries, 10, read)
    assert [r.item_id for r in found.orderBy("rank").collect()] == list(range(9000, 9010))
    assert read["matching"].count() > 80 and read["scored"].count() < read["matching"].count() / 10
    plan = index.postings.filter("term in ('w77', 'w78')")._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan
    at = {(r.item_id, r.term): r.positions for r in places(index, found, queries).collect()}
    assert at[9000, "w78"] == [4, 5, 6, 7] and (9000, "w1") not in at
