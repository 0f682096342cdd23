"""Best-fit packing of token pieces into sequences of a fixed length."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.automaton import transducer
from quern.llm.common import arrow_map, batch_of, texts_of

#: Documents whose pieces one task packs, bins that it holds open, and pieces that it looks ahead.
DOCS_PER_TASK, OPEN_BINS, LOOK_AHEAD = 100_000, 1024, 4096
#: States of the tokenizer's table: 33 MB in a worker, and about twice that for what they stand for.
STATES = 64_000


class BestFit:
    """Bounded-space online best fit.

    Open bins are stacked by their free space, and a bitset has a bit for each free space that some bin has. A piece
    goes to the bin with the least space that suffices: the lowest bit at or above its length. When more than
    `open_bins` are open, the fullest closes: the lowest bit of all.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def _pop(self, free: int) -> int:
        stack = self.stacks[free]
        bin_ = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        return bin_

    def add(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it for a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._pop(free)
            self.open -= 1
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
        if rest := free - length:
            if self.open == self.limit:
                self._pop((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            self.stacks[rest].append(bin_)
            self.bits |= 1 << rest
            self.open += 1
        return bin_, self.capacity - free


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
_PACKED = pa.schema([*_PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """The pieces of each document: its ids and end_id, cut only if longer than capacity.

    All pieces of a cut document but its first have `capacity` ids. A null text counts as empty and gives one piece
    with end_id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary, STATES)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), machine.ids(texts_of(batch)), strict=True):
                raw = np.append(ids, end_id).astype("<u4").tobytes()
                total = len(raw) // 4
                start, stop, piece = 0, total % capacity or min(total, capacity), 0
                while start < total:
                    crc = zlib.crc32(raw[4 * start : 4 * stop])
                    for column, value in zip(rows, (doc_id, piece, start, stop - start, crc), strict=True):
                        column.append(value)
                    start, stop, piece = stop, stop + capacity, piece + 1
            yield batch_of(_PIECES, rows)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), cut, _DDL)


def pack(pieces: DataFrame, tasks: int, capacity: int = 2048, open_bins: int = OPEN_BINS, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """pieces with sequence_id and offset. Each of `tasks` partitions packs its share with its own open bins.

    Pieces arrive in the order of a hash, so that a task that runs again repeats its packing. Of the next `look_ahead`
    pieces the longest go first, so that short ones fill what long ones leave; a piece that is packed is never moved.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40

        def placed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            rows = rows.take(pa.array(np.argsort(-np.asarray(rows["length"]), kind="stable")))
            places = [bins.add(n) for n in rows["length"].to_pylist()]
            ids, offsets = pa.array([base + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())
            yield from rows.append_column("sequence_id", ids).append_column("offset", offsets).cast(_PACKED).to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = look_ahead - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(min(room, batch.num_rows))
                if sum(b.num_rows for b in held) == look_ahead:
                    yield from placed(held)
                    held = []
        if held:
            yield from placed(held)

    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.repartition(tasks, "doc_id", "piece", "ids_crc32").sortWithinPartitions(order, "doc_id", "piece", "start")
    return arrow_map(dealt, fill, f"{_DDL}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, capacity: int = 2048, docs_per_task: int = DOCS_PER_TASK) -> DataFrame:
    """Packs whole documents into sequences of at most `capacity` tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null texts are empty documents of
    one token. Repeated rows are packed each for itself; a null doc_id stays null; an empty table gives no rows; other
    columns are not read. Only numbers are shuffled, once, and the number of tasks follows the number of documents. A task
    holds at most LOOK_AHEAD pieces and OPEN_BINS open bins, however many pieces it packs.
    """
    tasks = max(1, math.ceil(docs.count() / docs_per_task))
    return pack(token_pieces(docs, capacity), tasks, capacity)
