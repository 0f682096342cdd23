"""Exact repeated passages by prefix-free parsing of a distributed corpus.

A rolling hash over ANCHOR bytes is taken at every byte; the least hash in a string of LENGTH bytes is its trigger, so
every such string has one, and equal strings have it at the same place. Phrases are the runs of string starts that share
a trigger, with the bytes that their strings reach; they overlap by LENGTH - 1 bytes as the phrases of a prefix-free
parse do. A text becomes a parse: a row per phrase with the trigger's hash and the phrase's hash.

- A trigger that occurs once in the corpus can't be in a repeated string: its phrases are done.
- A phrase that occurs twice or more repeats in all its strings.
- The other phrases of a repeated trigger are the dictionary: each is fetched once, and a suffix array over the phrases
  of a trigger, by prefix doubling of ranks up to LENGTH bytes, puts equal strings side by side.
- A trigger with very many phrases is not gathered: its strings are named by 128-bit hashes, and names are counted.

Bytes move only for phrases of the dictionary; all else that is shuffled is a number for each phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, batch_of, keep, materialize, quoted, temporary, texts_of

#: Bytes of a repeated string, and of a trigger.
LENGTH, ANCHOR = 200, 64
#: Bytes of text hashed at once; bytes of phrases in one suffix array; phrases of a trigger that are gathered.
HASH_BYTES, ARRAY_BYTES, GATHERED = 512 << 10, 2 << 20, 4096
_U = np.uint64


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def _join(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    return _stir(a * _U(0x9E3779B97F4A7C15) + (b ^ _U(seed)) * _U(0xC2B2AE3D27D4EB4F))


def _ahead(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    out[: max(0, len(x) - by)] = x[by:]
    return out


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, in byte order."""
    word = data.astype(np.uint64)
    for width in (1, 2, 4):
        word = word << _U(8 * width) | _ahead(word, width)
    return word


class RollingHash:
    """Karp-Rabin hashes modulo 2^64 of any substrings, from prefix sums.

    The sum of value[byte] * base^place up to each place gives a substring's hash by one difference, brought to place 0
    by a power of the base's inverse. Values are random odd numbers, so equal hashes of unequal texts are left to chance.
    """

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.values = draw.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        self.base = int(draw.integers(1 << 40, 1 << 62)) * 8 + 5
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, base % (1 << 64), np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums, one more than there are bytes."""
        self._reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, prefixes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hashes of data[low:high]."""
        return _stir((prefixes[high] - prefixes[low]) * self.inverses[low])

    def windows(self, prefixes: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all substrings of a width."""
        n = len(prefixes) - width
        return _stir((prefixes[width:] - prefixes[:n]) * self.inverses[:n])


_ROLLING = RollingHash(11), RollingHash(23)


def least_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of x[i : i + width] for each i with a whole window."""
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    table = padded.reshape(blocks, width)
    before = np.minimum.accumulate(table, axis=1).reshape(-1)
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = len(x) - width + 1
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def parse(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Phrases of texts that lie one after another in data: text number, trigger hash, phrase hash, place in the text of
    the first string, number of strings."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    if len(data) < LENGTH:
        return empty
    first_hash, second_hash = _ROLLING
    prefixes = first_hash.prefixes(data)
    anchor = first_hash.windows(prefixes, ANCHOR)
    packed = anchor & _U(0xFFFFFFFF00000000)
    packed |= np.arange(len(anchor), dtype=np.uint64)
    owner = (least_in_window(packed, LENGTH - ANCHOR + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - LENGTH + 1, 0))
    if not len(text):
        return empty
    counts = np.bincount(text, minlength=len(sizes))
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[text] + place
    own = owner[at]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(own) != 0) | (np.diff(text) != 0))))
    n = np.diff(np.append(first, len(text)))
    low, high = at[first], at[first] + n - 1
    shape = (n.astype(np.uint64) << _U(32)) | (own[first] - low).astype(np.uint64)
    other = second_hash.of(second_hash.prefixes(data), low, high + LENGTH)
    ctx = _join(_join(first_hash.of(prefixes, low, high + LENGTH), other, 7), shape, 9)
    return text[first], anchor[own[first]], ctx, place[first], n


def repeated_starts(data: np.ndarray, valid: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """True at each valid place whose LENGTH bytes are at another valid place too, or have a weight over 1.

    Ranks of 8 bytes, then of twice as many from ranks of the halves, and at last of LENGTH from two overlapping
    halves; sorted by rank the places are the suffix array cut at LENGTH, where equal neighbours have a common prefix
    of LENGTH bytes. Only bytes of a valid place's own string count, so phrases need no separators.
    """
    rank = np.unique(words_at(data), return_inverse=True)[1].astype(np.int64)
    width = 8
    while width < LENGTH:
        step = min(width, LENGTH - width)
        pair = rank * (int(rank.max()) + 1) + _ahead(rank, step)
        width += step
        if width < LENGTH:
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        else:
            rank = pair
    places = np.flatnonzero(valid)
    order = places[np.argsort(rank[places], kind="stable")]
    same = rank[order[1:]] == rank[order[:-1]]
    out = np.zeros(len(data), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out & valid | (valid & (weight > 1))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edges[::2], edges[1::2]


#: m1 and m2 name a text: two 64-bit hashes. What repeats in a text depends on its bytes alone, so copies share one name.
_PHRASE = "key long, ctx long, m1 long, m2 long, at int, n int"
_SPAN = "m1 long, m2 long, at int, n int"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _groups(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def phrases(docs: DataFrame) -> DataFrame:
    """The parse of every text: a row per phrase. docs has m1 and m2, the text's name, and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _schema(_PHRASE)
        for batch in batches:
            raw = [t.encode() for t in texts_of(batch)]
            for a, b in _groups(list(map(len, raw)), HASH_BYTES):
                sizes = np.fromiter(map(len, raw[a:b]), np.int64, b - a)
                data = np.frombuffer(b"".join(raw[a:b]), np.uint8)
                text, key, ctx, at, n = parse(data, np.cumsum(sizes) - sizes, sizes)
                rows = batch.select(["m1", "m2"]).slice(a, b - a).take(pa.array(text))  # not the texts
                yield batch_of(out, [key.view(np.int64), ctx.view(np.int64), *rows.columns, at.astype(np.int32), n.astype(np.int32)])

    return arrow_map(docs.select("m1", "m2", "text"), run, _PHRASE)


def _named(docs: DataFrame) -> DataFrame:
    """docs with the name of each text."""
    return docs.withColumns({"m1": F.xxhash64("text"), "m2": F.xxhash64(F.lit(1), "text")})


def _dictionary(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, hot, copies, m1, m2, at, n) with the bytes of each phrase.

    Bytes are read from one row of each text, that with the least doc_id; where several have it they lie side by side
    after the join, and the first is read.
    """
    ddl = "key long, hot int, copies int, m1 long, m2 long, at int, n int, bytes binary"
    lists = wanted.groupBy("m1", "m2").agg(
        F.collect_list(F.struct("key", F.col("hot").cast("int").alias("hot"), F.least("copies", F.lit(2)).cast("int").alias("copies"), "at", "n")).alias("ps")
    )
    first = docs.groupBy("m1", "m2").agg(F.min("doc_id").alias("least"))
    lists = lists.join(first, ["m1", "m2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, last = _schema(ddl), None
        for batch in batches:
            rows: list[list] = [[] for _ in out]
            columns = (batch.column(c).to_pylist() for c in ("m1", "m2", "text", "ps"))
            for m1, m2, text, ps in zip(*columns, strict=True):
                if last == (m1, m2):
                    continue
                raw, last = (text or "").encode(), (m1, m2)
                for p in ps:
                    part = raw[p["at"] : p["at"] + p["n"] - 1 + LENGTH]
                    for column, value in zip(rows, (p["key"], p["hot"], p["copies"], m1, m2, p["at"], p["n"], part), strict=True):
                        column.append(value)
            yield batch_of(out, rows)

    held = docs.join(lists, ["m1", "m2"]).filter(F.col("doc_id").eqNullSafe(F.col("least")))
    return arrow_map(held.select("m1", "m2", "text", "ps"), run, ddl)


def _by_suffix_array(dictionary: DataFrame) -> DataFrame:
    """Repeated strings among the phrases of each trigger. Few phrases have one trigger, so a task takes many triggers
    at a time and sorts the suffixes of their phrases."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[5]) for r in rows], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        n = np.array([r[4] for r in rows], np.int64)
        valid, weight = np.zeros(len(data), bool), np.zeros(len(data), np.int8)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
        valid[inner] = True
        weight[inner] = np.repeat(np.array([r[0] for r in rows], np.int8), n)
        low, high = _runs(repeated_starts(data, valid, weight))
        phrase = np.searchsorted(starts, low, side="right") - 1  # strings that start in one phrase never reach the next's
        at = np.array([r[3] for r in rows], np.int64)[phrase] + low - starts[phrase]
        pick = phrase.tolist()
        return batch_of(_schema(_SPAN), [[rows[p][1] for p in pick], [rows[p][2] for p in pick], at.astype(np.int32), (high - low).astype(np.int32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last and size > ARRAY_BYTES:
                    yield solve(held)
                    held, size = [], 0
                held.append(tuple(row))
                size += len(row[-1])
                last = key
        if held:
            yield solve(held)

    dealt = dictionary.filter("hot = 0").select("key", "copies", "m1", "m2", "at", "n", "bytes")
    return arrow_map(dealt.repartition("key").sortWithinPartitions("key"), run, _SPAN)


def _by_names(dictionary: DataFrame) -> DataFrame:
    """The same for triggers with very many phrases: strings are named, and names counted, over all tasks."""
    ddl = "h1 long, h2 long, copies int, m1 long, m2 long, at int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _schema(ddl)
        for batch in batches:
            for copies, m1, m2, at, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(raw, np.uint8)
                names = [h.windows(h.prefixes(data), LENGTH).view(np.int64) for h in _ROLLING]
                yield batch_of(out, [*names, [copies] * n, [m1] * n, [m2] * n, np.arange(at, at + n, dtype=np.int32)])

    picked = dictionary.filter("hot = 1").select("copies", "m1", "m2", "at", "n", "bytes")
    named = arrow_map(picked, run, ddl)
    often = named.groupBy("h1", "h2").agg(F.sum("copies").alias("c")).filter("c > 1")
    return named.join(often, ["h1", "h2"]).select("m1", "m2", "at", F.lit(1).alias("n"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """m1, m2, at, n: in the text of that name, each of the n strings of LENGTH bytes from byte `at` on is elsewhere too."""
    rows = phrases(docs)
    keys = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).filter("c > 1")
    # written first, so that the join deals out both sides itself and may split the rows of a frequent trigger
    keys = materialize(keys.select("key", F.expr("lo = hi").alias("one")), "triggers")
    met = materialize(rows.join(keys, "key"), "phrases")
    whole = met.filter("one").select("m1", "m2", "at", "n")
    mixed = met.filter("not one")
    first = F.min(F.struct("m1", "m2", "at", "n")).alias("first")
    distinct = mixed.groupBy("key", "ctx").agg(F.count("*").alias("copies"), first)
    distinct = materialize(distinct, "dictionary")
    # written by themselves, so that their size is known when the join is planned: few are broadcast, many may be split
    twice = materialize(distinct.filter("copies > 1").select("key", "ctx"), "repeated-phrases")
    often = mixed.join(twice, ["key", "ctx"], "left_semi").select("m1", "m2", "at", "n")
    sizes = distinct.groupBy("key").agg(F.count("*").alias("phrases"))
    wanted = distinct.join(sizes, "key").select("key", (F.col("phrases") > GATHERED).alias("hot"), "copies", "first.*")
    dictionary = materialize(_dictionary(docs, wanted), "phrase-bytes")
    return whole.union(often).union(_by_suffix_array(dictionary)).union(_by_names(dictionary))


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int, int]:
    """What is left of raw, bytes removed and maximal runs removed, for spans of string starts (at, n)."""
    kept, removed, runs, done = [], 0, 0, 0
    low = high = -1
    for at, n in [*sorted(spans), (len(raw) + 1, 0)]:
        stop = at + n - 1 + LENGTH
        if high >= 0 and at <= high:
            high = max(high, stop)
            continue
        if high >= 0:
            kept.append(raw[done:low])
            removed, runs, done = removed + high - low, runs + 1, high
        low, high = at, stop
    kept.append(raw[done:])
    return kept, removed, runs


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id as long, text and others) with m1, m2 and spans, null where nothing repeats.

    Copies of a text find the same spans; the set keeps them once, before and after the shuffle.
    """
    named = _named(docs)
    with temporary():
        spans = repeated_spans(named.select("doc_id", "m1", "m2", "text"))
        spans = keep(spans.groupBy("m1", "m2").agg(F.collect_set(F.struct("at", "n")).alias("spans")), "spans")
    return named.join(spans, ["m1", "m2"], "left")


def _whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of raw when only characters that lie wholly in a removed run go."""
    kept, done, runs = [], 0, []
    for at, n in sorted(spans):
        if runs and at <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], at + n - 1 + LENGTH)
        else:
            runs.append([at, at + n - 1 + LENGTH])
    for low, high in runs:
        kept.append(raw[done:low])
        while low < high and raw[low] & 0xC0 == 0x80:
            kept.append(raw[low : low + 1])
            low += 1
        while low < high < len(raw) and raw[high] & 0xC0 == 0x80:
            high -= 1
        done = high
    kept.append(raw[done:])
    return b"".join(kept)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row, after removing each byte covered by a string of
    LENGTH bytes that starts anywhere else in the corpus too.

    Texts are judged as UTF-8 bytes on the input; null is empty. Repeated rows repeat each other, so all their bytes go
    if there are LENGTH or more; rows with a null doc_id are rows like others; an empty table gives no rows; other
    columns are not read.
    """
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _schema(ddl)
        for batch in batches:
            rows: list[list] = [[] for _ in out]
            for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                kept, removed, runs = _cut(raw, [(s["at"], s["n"]) for s in spans or ()])
                digest = hashlib.sha256(b"".join(kept)).hexdigest()
                for column, value in zip(rows, (doc_id, len(raw), removed, runs, digest), strict=True):
                    column.append(value)
            yield batch_of(out, rows)

    joined = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return arrow_map(joined.select("doc_id", "text", "spans"), run, ddl)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with all their columns, their texts without repeated strings; rows with nothing but white space left go.

    Bytes at a removed run's edge that are part of a character stay. Texts without repeats stay as they are, null too.
    Repeated rows repeat each other and go if they have LENGTH bytes or more; rows with a null doc_id are rows like
    others; an empty table gives an empty table.
    """
    others = [c for c in docs.columns if c != "text"]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*map(quoted, others)).alias("others"))
    joined = _with_spans(slim).select("text", "spans", "others")
    kinds = dict(docs.dtypes)
    ddl = f"text string, others struct<{', '.join(f'{quoted(c)}: {kinds[c]}' for c in others)}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for row, (text, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "spans")), strict=True)):
                if spans:
                    text = _whole_characters(text.encode(), [(s["at"], s["n"]) for s in spans]).decode()
                    if not text.strip():
                        continue
                texts.append(text)
                keep.append(row)
            rest = batch.column("others").take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), rest], ["text", "others"])

    cleaned = arrow_map(joined, run, ddl)
    return cleaned.select(*(F.col("text") if c == "text" else F.col(f"others.{quoted(c)}") for c in docs.columns))
