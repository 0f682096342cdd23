"""Posting lists in blocks with the highest frequency of each, and the database's text rank over them with block-max pruning.

Items are numbered within blocks. A row of the index is one term in one block: the items that hold it, how often and
where, and the highest number of times. A question is bounded in each block by its terms' highest frequencies there, so
blocks that can't reach its k-th score are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import query_tokens, tokens
from quern.operators.search import TIES
from quern.session import configure, ship
from quern.storage import materialize

#: Items of a block; blocks that each question begins with; terms that go into a scan's filter, at most.
BLOCK, FIRST, FILTERED = 2048, 2, 5000
#: Bytes of a row group of the postings, which are sorted by term: a filter by term skips most of a file.
ROW_GROUP = 4 << 20
#: Fixed values of the rank: the weight of a lexeme without a label, the limit of its series, and the occurrences counted.
WEIGHT, SERIES, OCCURRENCES = 0.1, 1.64493406685, 256
#: Parts of a score are whole numbers of this share, so that their sum has no order.
_UNIT = 1e-12


@dataclass(frozen=True)
class TextIndex:
    """postings: term, block, top (highest frequency), slots, counts, positions; items: block, slot and the columns of
    TIES."""

    postings: DataFrame
    items: DataFrame


def _part(count: Column) -> Column:
    """What a term that is so often in an item adds: WEIGHT times the sum of 1/i^2 over its occurrences, over SERIES."""
    sums = np.cumsum(1.0 / np.arange(1, OCCURRENCES + 1) ** 2) * WEIGHT / SERIES / _UNIT
    return F.element_at(F.lit(np.rint(sums).astype(np.int64).tolist()), F.least(count, F.lit(OCCURRENCES)).cast("int"))


def build_text_index(items: DataFrame) -> TextIndex:
    """The index of items (search_text and the columns of TIES), written to the shared folder.

    A task numbers its items in blocks of BLOCK and inverts each block, with no shuffle; then the posting rows, not the
    texts, are dealt and sorted by term. Null texts have no terms; a very long text is one item of its block.
    """
    spark = items.sparkSession
    ship(configure(spark))
    types = dict(items.dtypes)
    slim = materialize(items.select(*TIES, tokens(F.col("search_text")).alias("tokens")), "items")
    inverted = pa.schema([("term", pa.string()), ("block", pa.int64()), ("top", pa.int32()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("positions", pa.list_(pa.list_(pa.int32())))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
        """Number of the block, number of the first slot and the rows of each part of a block."""
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                part = batch.slice(low, min(batch.num_rows - low, BLOCK - size))
                yield number, size, part
                low, size = low + part.num_rows, size + part.num_rows
                if size == BLOCK:
                    number, size = number + 1, 0

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[int, list[int]]]] = {}
        now = None

        def closed() -> Iterator[pa.RecordBatch]:
            terms = sorted(held)
            for k in range(0, len(terms), 4096):
                part = terms[k : k + 4096]
                rows = [held[t] for t in part]
                columns = [part, [now] * len(part), [max(len(p) for _, p in r) for r in rows], [[s for s, _ in r] for r in rows], [[len(p) for _, p in r] for r in rows], [[p for _, p in r] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, inverted, strict=True)], schema=inverted)

        for number, first, part in blocks(batches):
            if number != now:
                yield from closed()
                held, now = {}, number
            for slot, words in enumerate(part.column("tokens").to_pylist(), first):
                own: dict[str, list[int]] = {}
                for at, word in enumerate(words or ()):
                    own.setdefault(word, []).append(at)
                for word, places in own.items():
                    held.setdefault(word, []).append((slot, places))
        yield from closed()

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, first, part in blocks(batches):
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(first, first + n, dtype=np.int32)), *(part.column(c) for c in TIES)], ["block", "slot", *TIES])

    rows = slim.mapInArrow(invert, "term string, block bigint, top int, slots array<int>, counts array<int>, positions array<array<int>>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(rows, "inverted").repartitionByRange(parts, "term", "block").sortWithinPartitions("term", "block")
    postings = materialize(rows, "postings", **{"parquet.block.size": str(ROW_GROUP)})
    keys = ", ".join(f"{c} {types[c]}" for c in TIES)
    return TextIndex(postings, materialize(slim.mapInArrow(numbered, f"block bigint, slot int, {keys}"), "numbered"))


def _of_terms(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """postings of the questions' terms. Up to FILTERED of them go into the scan's filter; with more, the join decides."""
    terms = [r["term"] for r in asked.select("term").distinct().limit(FILTERED + 1).collect()]
    return postings.filter(F.col("term").isin(*terms)) if 0 < len(terms) <= FILTERED else postings


def _scored(postings: DataFrame, blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, block, slot and units: the scores of all items with one of the question's terms in these blocks of it."""
    rows = asked.join(blocks.select("query_id", "block"), "query_id")
    met = rows.join(postings.select("term", "block", "slots", "counts"), ["term", "block"])
    each = met.select("query_id", "block", F.explode(F.arrays_zip("slots", "counts")).alias("x"))
    return each.groupBy("query_id", "block", F.col("x.slots").alias("slot")).agg(F.sum(_part(F.col("x.counts"))).alias("units"))


def _floors(scored: DataFrame, k: int) -> DataFrame:
    """query_id and floor: the k-th highest score so far, where there are k."""
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("units")))
    best = scored.select("query_id", "units", turn.alias("turn")).filter(F.col("turn") <= k)
    return best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("units").alias("floor")).filter(F.col("n") == k).drop("n")


def _slack() -> Column:
    """Units within which two scores of a question of `size` terms may be one after rounding to six places."""
    return F.col("size") * F.lit(int(1e-6 / _UNIT))


def question_terms(queries: DataFrame) -> DataFrame:
    """query_id, term and size: the distinct search tokens of each question (query_id, query) and their number."""
    held = queries.select("query_id", query_tokens(F.col("query")).alias("terms"))
    return held.select("query_id", F.size("terms").alias("size"), F.explode("terms").alias("term"))


def search_text_index(index: TextIndex, queries: DataFrame, k: int, read: dict[str, DataFrame] | None = None) -> DataFrame:
    """query_id, document_id, item_id, item_index, score and rank: the k best items of each question by the text rank that
    a database gives for any of the terms.

    The rank of an item is, over the question's distinct terms, the mean of WEIGHT times the sum of 1/i^2 over a term's
    occurrences, over SERIES; items without any are left out. Bounds of blocks come from the postings' top column alone.
    The FIRST blocks of the highest bounds give each question a floor, its k-th score; blocks whose bound is below are not
    read. No row is lost: a bound is at least the score of any item in its block. read, if given, gets the table of
    (query_id, block) that were scored and the table of all that match.
    """
    ship(configure(queries.sparkSession))
    asked = materialize(question_terms(queries), "question_terms")
    postings = _of_terms(index.postings, asked)
    heads = postings.select("term", "block", "top").join(asked, "term")
    bounds = materialize(heads.groupBy("query_id", "block").agg(F.sum(_part(F.col("top"))).alias("bound")), "bounds")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    first = materialize(bounds.withColumn("turn", best).filter(F.col("turn") <= FIRST).drop("turn"), "first")
    begun = materialize(_scored(postings, first, asked), "begun")
    floors = _floors(begun, k).join(asked.select("query_id", "size").distinct(), "query_id")
    left = bounds.join(floors, "query_id", "left").filter(F.col("floor").isNull() | (F.col("bound") + _slack() >= F.col("floor"))).drop("floor", "size")
    left = materialize(left.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti"), "left")
    scored = materialize(begun.unionByName(_scored(postings, left, asked)), "scored")
    if read is not None:
        read |= {"scored": first.select("query_id", "block").union(left.select("query_id", "block")), "matching": bounds}
    sizes = asked.select("query_id", "size").distinct()
    top = scored.join(_floors(scored, k), "query_id", "left").join(sizes, "query_id")
    top = top.filter(F.col("floor").isNull() | (F.col("units") + _slack() >= F.col("floor")))
    named = top.join(index.items, ["block", "slot"])
    score = F.round(F.col("units") * F.lit(_UNIT) / F.col("size"), 6).alias("score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *TIES)
    ranked = named.select("query_id", *TIES, score).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def places(index: TextIndex, found: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, item_id, term and positions (from 0, in tokens) of each term of a question in the items found for it."""
    asked = question_terms(queries).join(found.select("query_id", "item_id"), "query_id")
    at = asked.join(index.items.select("item_id", "block", "slot"), "item_id")
    met = at.join(index.postings.select("term", "block", "slots", "positions"), ["term", "block"])
    own = F.array_position("slots", F.col("slot")).cast("int")
    return met.filter(own > 0).select("query_id", "item_id", "term", F.element_at("positions", own).alias("positions"))
