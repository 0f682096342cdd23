"""Every registered query against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import numpy as np
import pytest

from quern.config import ChunkPolicy
from quern.operators.chunking import chunk_document
from quern.plans import catalog, operations, pipelines, retrieval  # noqa: F401
from quern.plans import queries as knowledge
from quern.sources import blocks as B

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value in one form for both engines."""
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return [plain(v) for v in value]
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()[:19]
    return value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def _texts(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()


def _blocks(duck):
    return [(i, b) for i, text, _ in _texts(duck) for b in B.markdown_blocks(text)]


def _chunks(duck, parsed):
    out = []
    for i, text, lang in _texts(duck):
        own = B.markdown_blocks(text) if parsed else [{"index": 0, "content": text, "block_type": "TEXT", "page_no": 1, "title_path": [lang]}]
        out += [{"id": i, **c} for c in chunk_document(own, ChunkPolicy())]
    return out


def _pages(duck):
    rows = duck.execute("SELECT page_id, html FROM pages").fetchall()
    return [{"id": i, "error": None, **b} for i, html in rows for b in B.html_blocks(html)]


#: What SQL can't express: the plain functions, file by file and document by document, in one process.
BRUTE = {
    "src3_block_types": lambda duck: [{"id": i, "error": None, **b} for i, b in _blocks(duck)],
    "src11_html_pages": _pages,
    "chk1_chunks": lambda duck: _chunks(duck, False),
    "chk_block_chunks": lambda duck: _chunks(duck, True),
}


@pytest.mark.parametrize("name", sorted(knowledge.QUERIES))
def test_query(name, spark, duck):
    got = knowledge.QUERIES[name](spark, FOLDER)
    names = sorted(got.columns)
    rows = sorted(str([plain(r[c]) for c in names]) for r in got.collect())
    if name in BRUTE:
        assert rows == sorted(str([plain(r[c]) for c in names]) for r in BRUTE[name](duck))
        return
    result = duck.execute(knowledge.ORACLE_SQL[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    order = [found.index(c) for c in names]
    assert rows == sorted(str([plain(r[i]) for i in order]) for r in result.fetchall())
