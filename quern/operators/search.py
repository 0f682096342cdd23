"""Exact top rows of a table of questions against a table of items: one pass over the items for all questions.

A block of questions is a matrix, a batch of items another one, and their product scores all pairs of both. Each task
keeps the best rows of each question, so only those are shuffled, and a window picks the best of all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import query_tokens
from quern.session import configure, ship

#: Questions in a block, about; a larger table is taken in blocks, each against all rows. Pairs scored at once.
QUERY_BLOCK, PAIRS = 1000, 1 << 21
#: Order of equal scores.
TIES = ("document_id", "item_index", "item_id")
#: Scores are whole millionths inside a task.
_ONE = 1_000_000


class _Vectors:
    """Cosine similarity. Items without a vector are left out; other lengths than the question's score 0."""

    column = "embedding"

    def __init__(self, block: pa.Table):
        vectors = block["vector"].to_pylist()
        self.missing = np.array([not v for v in vectors], bool)
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(v or ()) for v in vectors])
        for n in set(lengths.tolist()) - {0}:
            at = np.flatnonzero(lengths == n)
            self.groups[n] = at, _unit(np.array([[x or 0.0 for x in vectors[i]] for i in at], float))

    def scores(self, column: pa.Array, n_queries: int) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
        out = np.zeros((n_queries, len(column)))
        for n, (at, vectors) in self.groups.items():
            rows = np.flatnonzero(lengths == n)
            if len(rows):
                flat = pc.fill_null(pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64()), 0.0)
                out[np.ix_(at, rows)] = vectors @ _unit(np.asarray(flat).reshape(-1, n)).T
        return out, (lengths > 0)[None, :] & ~self.missing[:, None]


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


class _Characters:
    """Share of the question's distinct characters that the item has. Items with none of them are left out."""

    column = "_plain"

    def __init__(self, block: pa.Table):
        sets = [{c for c in q or "" if not c.isspace()} for q in block["_plain"].to_pylist()]
        known = sorted(set().union(*sets)) if sets else []
        self.place = np.full(0x110000, -1, np.int32)
        self.place[[ord(c) for c in known]] = range(len(known))
        self.sizes, self.marks = _marks(sets, known)

    def scores(self, column: pa.Array, n_queries: int) -> tuple[np.ndarray, np.ndarray]:
        texts = [t or "" for t in column.to_pylist()]
        at = self.place[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
        rows = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        return _shares(self, rows[at >= 0], at[at >= 0], len(texts))


class _Tokens:
    """Share of the question's distinct search tokens that the item has. Items with none of them are left out."""

    column = "_tokens"

    def __init__(self, block: pa.Table):
        sets = [set(q or ()) for q in block["_tokens"].to_pylist()]
        known = sorted(set().union(*sets)) if sets else []
        self.known = pa.array(known, pa.string())
        self.sizes, self.marks = _marks(sets, known)

    def scores(self, column: pa.Array, n_queries: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.asarray(pc.fill_null(pc.index_in(pc.list_flatten(column), self.known), -1))
        rows = np.asarray(pc.list_parent_indices(column))
        return _shares(self, rows[at >= 0], at[at >= 0], len(column))


def _marks(sets: list[set], known: list) -> tuple[np.ndarray, np.ndarray]:
    place = {x: i for i, x in enumerate(known)}
    marks = np.zeros((len(sets), len(known)), np.float32)
    for i, s in enumerate(sets):
        marks[i, [place[x] for x in s]] = 1
    return np.array([max(1, len(s)) for s in sets], float), marks


def _shares(kind, rows: np.ndarray, columns: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray]:
    held = np.zeros((n_items, kind.marks.shape[1]), np.float32)
    held[rows, columns] = 1
    shared = kind.marks @ held.T
    return shared / kind.sizes[:, None], shared > 0


KINDS = {"vector": _Vectors, "text": _Characters, "token": _Tokens}


class _Best:
    """The best rows of each question so far in one task, by score, then by TIES."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.n = k, n_queries
        self.floor = np.full(n_queries, -2 * _ONE, np.int64)
        self.held: list[pa.Table] = []
        self.rows = 0

    def add(self, keys: pa.Table, score: np.ndarray, allowed: np.ndarray) -> None:
        """keys are in the order of TIES."""
        whole = (np.sign(score) * np.floor(np.abs(score) * _ONE + 0.5)).astype(np.int64)
        n = keys.num_rows
        allowed = allowed & (whole >= self.floor[:, None])
        if n > self.k:
            rank = np.where(allowed, (whole << 21) + (n - 1 - np.arange(n)), np.iinfo(np.int64).min)
            top = np.argpartition(rank, n - self.k, axis=1)[:, n - self.k :]
            query = np.repeat(np.arange(self.n), self.k)
            row = top.reshape(-1)
            fits = allowed[query, row]
            query, row = query[fits], row[fits]
        else:
            query, row = np.nonzero(allowed)
        if len(row):
            found = keys.take(pa.array(row))
            found = found.append_column("_query", pa.array(query, pa.int32())).append_column("_score", pa.array(whole[query, row]))
            self.held.append(found)
            self.rows += len(row)
            if self.rows > 4 * self.n * self.k + 4096:
                self.cut()

    def cut(self) -> pa.Table:
        table = pa.concat_tables(self.held).combine_chunks()
        keys = [("_query", "ascending"), ("_score", "descending"), *((t, "ascending") for t in TIES)]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        query = np.asarray(table["_query"])
        first = np.searchsorted(query, np.arange(self.n))
        place = np.arange(len(query)) - first[query]
        last = place == self.k - 1
        self.floor[query[last]] = np.asarray(table["_score"])[last]
        self.held = [table.take(pa.array(np.flatnonzero(place < self.k)))]
        self.rows = self.held[0].num_rows
        return self.held[0]


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The questions in blocks that a task can hold: parted by a hash of query_id, half full on average."""
    n = queries.count()
    parts = 1 if n <= QUERY_BLOCK else math.ceil(2 * n / QUERY_BLOCK)
    turn = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    return [queries.filter(turn == i) for i in range(parts)] if parts > 1 else [queries]


def search(items: DataFrame, queries: DataFrame, channels: dict[str, tuple[str, int]]) -> DataFrame:
    """channel, query_id, document_id, item_id, item_index, score and rank: the k best items of each question by channel.

    channels gives for each name a kind and k. Kinds: vector (items.embedding by queries.vector), text and token
    (items.search_text by queries.query). items has document_id, item_id and item_index, and query_id is unique in
    queries. Scores have six places; equal ones go by TIES. Null texts have no characters and no tokens. The pass over
    the items is repeated for each block of questions.
    """
    spark = items.sparkSession
    ship(configure(spark))
    kinds = {kind for kind, _ in channels.values()}
    made = {"_plain": ("text", F.lower), "_tokens": ("token", query_tokens)}
    extra = lambda text: [f(F.col(text)).alias(c) for c, (kind, f) in made.items() if kind in kinds]
    vectors = lambda name: [F.col(name).cast("array<double>").alias(name)] if "vector" in kinds else []
    slim = items.select(*TIES, *vectors("embedding"), *extra("search_text"))
    asked = queries.select("query_id", *vectors("vector"), *extra("query"))
    types = dict(items.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    ddl = f"channel string, query_id {types['query_id']}, " + ", ".join(f"{c} {types[c]}" for c in TIES) + ", score double"

    def of(block: pa.Table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = block.num_rows
            scorers = {kind: KINDS[kind](block) for kind in kinds}
            best = {name: _Best(k, n) for name, (_, k) in channels.items()}
            width = max(1, PAIRS // max(1, n))
            for whole in batches:
                for low in range(0, whole.num_rows if n else 0, width):
                    batch = pa.Table.from_batches([whole.slice(low, width)])
                    order = pc.sort_indices(batch, sort_keys=[(t, "ascending") for t in TIES], null_placement="at_start")
                    batch = batch.take(order).combine_chunks()
                    keys = batch.select(list(TIES))
                    scored = {kind: s.scores(batch[s.column].combine_chunks(), n) for kind, s in scorers.items()}
                    for name, (kind, _) in channels.items():
                        best[name].add(keys, *scored[kind])
            for name, held in best.items():
                if held.held:
                    table = held.cut()
                    columns = [pa.array([name] * table.num_rows, pa.string()), block["query_id"].combine_chunks().take(table["_query"].combine_chunks())]
                    columns += [table[t].combine_chunks() for t in TIES] + [pa.array(np.asarray(table["_score"]) / _ONE)]
                    yield pa.RecordBatch.from_arrays(columns, ["channel", "query_id", *TIES, "score"])

        return run

    found = reduce(DataFrame.unionByName, (slim.mapInArrow(of(b.toArrow()), ddl) for b in query_blocks(asked)))
    order = Window.partitionBy("channel", "query_id").orderBy(F.desc("score"), *TIES)
    limit = F.element_at(F.create_map(*(F.lit(x) for name, (_, k) in channels.items() for x in (name, k))), F.col("channel"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def passage_matches(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """passage_id and id of every text that holds a passage, letter by letter: one pass over the texts for a block of passages.

    texts has id and text, passages has passage_id and passage. An empty passage is in every text; null is in none. A
    block's passages are compiled to one automaton, so a text is read once however many passages there are.
    """
    ship(configure(texts.sparkSession))
    types = dict(passages.dtypes)["passage_id"], dict(texts.dtypes)["id"]

    def of(block: pa.Table):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            places: dict[str, list[int]] = {}
            for i, p in enumerate(block["passage"].to_pylist()):
                if p is not None:
                    places.setdefault(p, []).append(i)
            always = places.pop("", [])
            machine = ahocorasick.Automaton()
            for p, at in places.items():
                machine.add_word(p, at)
            if places:
                machine.make_automaton()
            for batch in batches:
                passage, row = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    if text is not None:
                        found = {x for _, at in machine.iter(text) for x in at} if places else set()
                        found.update(always)
                        passage += found
                        row += [i] * len(found)
                names = block["passage_id"].combine_chunks().take(pa.array(passage, pa.int64()))
                yield pa.RecordBatch.from_arrays([names, batch.column("id").take(pa.array(row, pa.int64()))], ["passage_id", "id"])

        return run

    asked = passages.select(F.col("passage_id").alias("query_id"), "passage")
    blocks = (b.withColumnRenamed("query_id", "passage_id").toArrow() for b in query_blocks(asked))
    slim = texts.select("id", "text")
    return reduce(DataFrame.unionByName, (slim.mapInArrow(of(b), f"passage_id {types[0]}, id {types[1]}") for b in blocks))
