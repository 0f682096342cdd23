"""Token ids in binary shards with a minimal perfect hash index from document key to payload.

A shard file holds, in this order: the ids of its documents in ascending doc_id order, two bytes an id, little-endian;
the index (a perfect hash over the keys, then per slot a 32-bit fingerprint, the first id's place and the number of
ids); and 32 bytes of footer: the magic bytes, documents, ids and the index's length. A document's ids are found by its
key in constant time: slot, fingerprint, place.
"""

from __future__ import annotations

import math
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.automaton import transducer
from quern.llm.common import arrow_map, batch_of, materialize, open_store, scratch, texts_of
from quern.llm.mph import PerfectHash, fingerprints, mix

#: Documents in a shard, about; bytes read at once.
DOCS_PER_SHARD, READ_BYTES = 16_384, 4 << 20
MAGIC = b"QUERNTK1"
_NULL_KEY = np.uint64(0xA5A5A5A5A5A5A5A5)


def document_keys(doc_ids: list[int | None], seen: dict) -> np.ndarray:
    """64-bit keys of (doc_id, which of its rows). seen carries the last doc_id and its count from batch to batch."""
    known = np.array([0 if d is None else d for d in doc_ids], np.int64).view(np.uint64)
    null = np.array([d is None for d in doc_ids], bool)
    turn = np.zeros(len(doc_ids), np.uint64)
    for i, d in enumerate(doc_ids):
        seen["n"] = seen["n"] + 1 if "n" in seen and seen["id"] == d else 0
        seen["id"] = d
        turn[i] = seen["n"]
    return np.where(null, _NULL_KEY, mix(known, np.uint64(1))) + mix(turn, np.uint64(2))


class ShardWriter:
    """Streams one shard's ids to a file, then its index. The file takes its name only when it is whole."""

    def __init__(self, uri: str):
        self.store, self.path = open_store(uri)
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.attempt = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.store.open_output_stream(self.attempt, compression=None)
        self.keys: list[np.ndarray] = []
        self.lengths: list[int] = []

    def add(self, keys: np.ndarray, payloads: list[bytes]) -> None:
        self.keys.append(keys)
        self.lengths += [len(p) // 2 for p in payloads]
        self.out.write(b"".join(payloads))

    def close(self) -> tuple[int, int]:
        keys, lengths = np.concatenate(self.keys), np.array(self.lengths, "<u4")
        starts = np.concatenate(([0], np.cumsum(lengths.astype(np.int64)))).astype("<i8")
        index = PerfectHash.of(keys)
        order = np.argsort(index.slots(keys))
        packed = index.to_bytes()
        body = [len(packed).to_bytes(8, "little"), packed, fingerprints(keys)[order].astype("<u4").tobytes()]
        body += [starts[:-1][order].tobytes(), lengths[order].tobytes()]
        size = sum(map(len, body))
        footer = MAGIC + np.array([len(keys), starts[-1], size], "<i8").tobytes()
        self.out.write(b"".join([*body, footer]))
        self.out.close()
        self.store.move(self.attempt, self.path)
        return len(keys), int(starts[-1])


class ShardReader:
    """Keyed access to one shard. The index is held in memory, ids are read in ranges."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        footer = self.file.read_at(32, size - 32)
        if footer[:8] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        n, self.ids, length = np.frombuffer(footer, "<i8", 3, 8).tolist()
        raw = self.file.read_at(length, size - 32 - length)
        packed = int.from_bytes(raw[:8], "little")
        self.hash, at = PerfectHash.from_bytes(raw[8 : 8 + packed]), 8 + packed
        self.prints = np.frombuffer(raw, "<u4", n, at)
        self.starts = np.frombuffer(raw, "<i8", n, at + 4 * n)
        self.lengths = np.frombuffer(raw, "<u4", n, at + 12 * n)
        self.block, self.first = b"", 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id's place and number of ids of each key."""
        slots = self.hash.slots(keys)
        if len(keys) and ((slots < 0).any() or (self.prints[slots] != fingerprints(keys)).any()):
            raise KeyError("a key is not in this shard")
        return self.starts[slots], self.lengths[slots]

    def read(self, start: int, length: int) -> np.ndarray:
        """ids from start on. Neighbours in ascending order come from one block."""
        low, high = 2 * start, 2 * (start + length)
        if low < self.first or high > self.first + len(self.block):
            self.block = self.file.read_at(max(READ_BYTES, high - low), low)
            self.first = low
        return np.frombuffer(self.block, "<u2", length, low - self.first)


_KEY = np.dtype([("known", "i1"), ("doc_id", "<i8"), ("salt", "<i8")])


def _salted(docs: DataFrame) -> DataFrame:
    """doc_id, a salt that parts rows of one doc_id, and text. A task that runs again salts its rows alike."""
    salt = F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("salt")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), salt, "text")


def _places(doc_ids: pa.Array, salts: pa.Array) -> np.ndarray:
    """(known, doc_id, salt) of rows, in the order of shards: null doc_ids come first."""
    out = np.zeros(len(doc_ids), _KEY)
    out["known"] = np.asarray(doc_ids.is_valid())
    out["doc_id"] = np.asarray(doc_ids.fill_null(0))
    out["salt"] = np.asarray(salts)
    return out


def shard_bounds(docs: DataFrame, docs_per_shard: int) -> np.ndarray:
    """The least (known, doc_id, salt) of each shard but the first, ascending: one row for docs_per_shard documents.

    Spark's range partitioning of doc_id and salt alone gives them, so no text is read and a frequent doc_id is parted.
    """
    shards = max(1, math.ceil(docs.count() / docs_per_shard))
    if shards == 1:
        return np.zeros(0, _KEY)
    keys = _salted(docs).select(F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "salt")
    dealt = keys.repartitionByRange(shards, "known", "doc_id", "salt")
    least = dealt.groupBy(F.spark_partition_id().alias("shard")).agg(F.min(F.struct("known", "doc_id", "salt")).alias("least"))
    return np.array(sorted(tuple(r["least"]) for r in least.collect())[1:], _KEY)


_STORED = "shard int, path string, doc_id long, turn_key long, n_docs long, n_ids long"


def write_token_store(
    docs: DataFrame, folder: str, bounds: np.ndarray, vocabulary: str = "word_bpe_49k.json", end_id: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Writes the shards below folder. Returns the manifest (shard, path, n_docs, n_ids) and the keys (shard, path, doc_id
    and the document's 64-bit key), both in shared storage.

    Ids must be below 65536. Shards are ranges of doc_id, dealt one to a task by their number; rows are sorted by doc_id,
    nulls first. Rows with one doc_id are told apart by their place among each other in the shard.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        out = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("salt", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            ids = [np.append(x, end_id).astype("<u2").tobytes() for x in machine.ids(texts_of(batch))]
            places = _places(batch.column("doc_id"), batch.column("salt"))
            shards = np.searchsorted(bounds, places, side="right").astype(np.int32)
            yield batch_of(out, [shards, batch.column("doc_id"), batch.column("salt"), ids])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("doc_id", pa.int64()), ("turn_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        shard, writer, seen = None, None, {}

        def done():
            return batch_of(out, [[shard], [_name(folder, shard)], [None], [None], *([x] for x in writer.close())])

        for batch in batches:
            shards = np.array(batch.column("shard"))
            for part in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
                if not len(part):
                    continue
                if int(shards[part[0]]) != shard:
                    if writer:
                        yield done()
                    shard, seen = int(shards[part[0]]), {}
                    writer = ShardWriter(_name(folder, shard))
                rows = batch.slice(int(part[0]), len(part))
                ids, nothing = rows.column("doc_id"), pa.nulls(len(part), pa.int64())
                keys = document_keys(ids.to_pylist(), seen)
                writer.add(keys, rows.column("ids").to_pylist())
                names = pa.array([_name(folder, shard)] * len(part))
                yield batch_of(out, [shards[part], names, ids, keys.view(np.int64), nothing, nothing])
        if writer:
            yield done()

    encoded = arrow_map(_salted(docs), encode, "shard int, doc_id long, salt long, ids binary")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "salt")
    stored = materialize(arrow_map(dealt, save, _STORED), "manifest")
    keys = stored.filter("turn_key is not null").select("shard", "path", "doc_id", "turn_key")
    return stored.filter("turn_key is null").select("shard", "path", "n_docs", "n_ids"), keys


def _name(folder: str, shard: int) -> str:
    return f"{folder}/tokens-{shard:06d}.bin"


def read_token_store(keys: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of keys (shard, path, doc_id, turn_key), read by key.

    start counts the ids of all documents before: those of earlier shards come from the manifest, a row per shard.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        path, reader = None, None
        for batch in batches:
            shards = np.array(batch.column("shard"))
            for part in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
                if not len(part):
                    continue
                rows = batch.slice(int(part[0]), len(part))
                if rows.column("path")[0].as_py() != path:
                    path = rows.column("path")[0].as_py()
                    reader = ShardReader(path)
                starts, lengths = reader.find(np.asarray(rows.column("turn_key")).view(np.uint64))
                pairs = zip(starts.tolist(), lengths.tolist(), strict=True)
                crc = [zlib.crc32(reader.read(s, n).astype("<u4").tobytes()) for s, n in pairs]
                yield batch_of(out, [shards[part], rows.column("doc_id"), starts, lengths.astype(np.int64), crc])

    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("shard", before.alias("before"))  # a row per shard
    found = arrow_map(keys.select("shard", "path", "doc_id", "turn_key"), look_up, "shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return found.join(files, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_store(docs: DataFrame, docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Encodes, writes and reads back whole documents: doc_id, start, n_tokens (with the end id), ids_crc32.

    Null texts are empty and have the end id alone. Null doc_ids come before all others; rows with the same doc_id
    follow each other and may lie in several shards. An empty table gives no rows; other columns are not read. The ids
    are shuffled once, by shard; keys are read where they were written.
    """
    bounds = shard_bounds(docs, docs_per_shard)
    manifest, keys = write_token_store(docs, scratch(docs.sparkSession, "tokens"), bounds)
    return read_token_store(keys, manifest)
