"""SimHash fingerprints, pigeonhole blocks and components of near copies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, batch_of, keep, materialize, quoted, temporary, texts_of
from quern.llm.components import connected_components

#: A block with more fingerprints than this is linked through one-bit neighbours, not through its pairs.
BLOCK_PAIRS = 32
#: Fingerprints are cut into this many blocks.
BLOCKS = 4


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words of the text with A-Z lowered; of all words where there are fewer."""
    import xxhash

    split = text.encode().lower().split()  # of bytes: lowers A-Z alone and splits at ASCII white space alone
    if not split:
        return np.zeros(0, np.uint64)
    joined, sizes = b" ".join(split), [len(w) + 1 for w in split]
    starts = np.concatenate(([0], np.cumsum(sizes))).tolist()
    n, digest = max(1, len(split) - words + 1), xxhash.xxh64_intdigest
    ends = starts[words:] if len(split) >= words else [starts[-1]]
    return np.fromiter((digest(joined[a : b - 1], 42) for a, b in zip(starts[:n], ends, strict=True)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit SimHash: a bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (as a signed long) of each row. Null texts are empty: fingerprint zero."""
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(out, [batch.column("doc_id"), [fingerprint(shingle_hashes(t, words)) for t in texts_of(batch)]])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(distance: int, blocks: int) -> list[int]:
    """Bits kept by each choice of blocks - distance blocks: fingerprints within the distance agree on one choice."""
    width = 64 // blocks
    each = [((1 << (width if i < blocks - 1 else 64 - width * (blocks - 1))) - 1) << (width * i) for i in range(blocks)]
    return [sum(choice) for choice in combinations(each, blocks - distance)]


def fingerprint_links(distinct: DataFrame, distance: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """Pairs a, b of distinct fingerprints (column fp) that connect just those within `distance` bits, 1 or 2.

    Fingerprints are cut into blocks, those that agree on all but `distance` blocks meet, and pairs are verified. In a
    block of over BLOCK_PAIRS fingerprints, each is written with its one-bit neighbours among the free bits instead:
    two fingerprints within two bits share a neighbour or are one, and two that share one are within two bits. All that
    share it are linked to the least of them, so a large block gives rows in proportion to its size.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    masks = block_masks(distance, blocks)
    choice = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks))))
    rows = distinct.select("fp", choice.alias("block")).select("fp", "block.c", "block.key")
    sizes = rows.groupBy("c", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialize(rows.join(sizes, ["c", "key"]), "blocks")
    few = met.filter(F.col("n") <= BLOCK_PAIRS).select("c", "key", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["c", "key"]).filter(F.col("a") < F.col("b"))
    pairs = pairs.filter(near).select("a", "b")
    flips = [0, *(_signed(1 << i) for i in range(64))]
    free = F.element_at(F.lit([_signed(~m & (1 << 64) - 1) for m in masks]), F.col("c") + 1)
    probes = F.filter(F.lit(flips), lambda x: x.bitwiseAND(free) == x)
    many = met.filter(F.col("n") > BLOCK_PAIRS).select("fp", F.explode(probes).alias("flip"))
    many = many.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("probe")).distinct()
    least = many.groupBy("probe").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    stars = many.join(least, "probe").filter(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    if distance == 1:
        stars = stars.filter(near)
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    Rows whose fingerprints differ in at most `distance` bits are linked; component_id is the smallest doc_id that links
    reach. Null texts are empty; texts without words have fingerprint zero and are linked as any other. Repeated rows
    keep their number; a row with a null doc_id takes part and stays null. Empty tables give no rows; other columns are
    not read. Equal fingerprints are one node, so exact copies of any number cost nothing in the joins.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    with temporary():
        nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
        joined = connected_components(fingerprint_links(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
        named = joined.join(nodes, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
        linked = joined.join(named, "component").select("fp", "component_id")
        names = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
        names = keep(names, "names")  # so that the join may split the rows of a frequent fingerprint
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Similarity mode: a fingerprint of SYMBOLS symbols, cut into SYMBOLS / BAND bands.
SYMBOLS, BAND = 126, 3
#: As BLOCK_PAIRS, for bands; orders from which a larger band's head is taken. No result depends on these: what larger bands
#: don't link is found by shared shingles.
BAND_PAIRS, HEADS = 6, 12
_MIX = np.random.default_rng(42).integers(1, 1 << 63, (2, SYMBOLS), dtype=np.uint64) | np.uint64(1)


def symbols(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS min-wise symbols: the share of equal ones in two texts is their shingles' similarity, in expectation."""
    out = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096, None]
        np.minimum(out, ((part ^ (part >> np.uint64(31))) * _MIX[0] + _MIX[1]).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def _row_key(docs: DataFrame) -> Column:
    """128 bits of a row's doc_id and text: rows that differ in either have another key."""
    return F.md5(F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("-")), F.coalesce(docs["text"], F.lit(""))))


def _symbol_rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, key (of the row), node (a hash of the set of shingles) and the key of each band. Texts of fewer words are
    their own shingle."""
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, bands = [], []
            for text in texts_of(batch):
                hashes = np.unique(shingle_hashes(text, words))
                raw = symbols(hashes).tobytes()
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                bands.append([xxhash.xxh64_intdigest(raw[i : i + 4 * BAND], i) for i in range(0, 4 * SYMBOLS, 4 * BAND)])
            keys = np.array(bands, np.uint64).view(np.int64).tolist()
            yield batch_of(out, [batch.column("doc_id"), batch.column("key"), np.array(nodes, np.uint64).view(np.int64), keys])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key(docs).alias("key"), "text")
    return arrow_map(slim, run, "doc_id long, key string, node long, bands array<long>")


#: Bits of the filter by doc_id that stands before shingles are made again: 2 MB at any size of the input.
FILTER_BITS = 24


def _slot(doc_id: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc_id), 64 - FILTER_BITS)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bit for each slot that some doc_id of ids has. Spark sets the bits; 512 parts of 4 KB come to the driver."""
    slots = ids.select((_slot(F.col("least")) + 1).alias("s"))  # bit positions count from 1
    parts = slots.groupBy(F.bitmap_bucket_number("s").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits"))
    out = np.zeros((1 << FILTER_BITS - 15, 1 << 12), np.uint8)
    for row in parts.collect():
        out[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and its sorted distinct shingles, 8 bytes each, of the wanted nodes (node, least). Other texts are not shuffled:
    a filter of fixed size leaves most of them out before their shingles are made; the join decides."""
    bits = _bitmap(wanted)
    out = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            at = np.asarray(batch.column("slot"))
            hit = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
            batch = batch.take(pa.array(np.flatnonzero(hit)))
            sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in texts_of(batch)]
            nodes = np.array([xxhash.xxh64_intdigest(x) for x in sets], np.uint64).view(np.int64)
            yield batch_of(out, [batch.column("doc_id"), nodes, sets])

    doc_id = F.col("doc_id").cast("long")
    made = arrow_map(docs.select(doc_id.alias("doc_id"), _slot(doc_id).alias("slot"), "text"), run, "doc_id long, node long, shingles binary")
    found = made.join(wanted.withColumnRenamed("node", "n"), (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    return found.select("node", "shingles").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of nodes whose sets of shingles (node, shingles) have this Jaccard similarity or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            near = []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                left, right = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                shared = len(np.intersect1d(left, right, assume_unique=True))
                if shared / max(1, len(left) + len(right) - shared) >= similarity:
                    near.append(i)
            picked = batch.take(pa.array(near, pa.int64()))
            yield batch_of(out, [picked.column("a"), picked.column("b")])

    a, b = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}")) for n in "ab")
    return arrow_map(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb"), run, "a long, b long")


def _front(sets: DataFrame, similarity: float) -> DataFrame:
    """node, size, shingle and rest of the shingles at each node's front.

    With shingles in one order, the rarest first, similar sets have their first common one near the front of both: what
    follows it must suffice for the similarity. rest is how many shingles a set has from this one on. Those that no other
    set has come before all and are left out.
    """
    out = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                hashes = np.frombuffer(raw, "<i8")
                yield batch_of(out, [np.full(len(hashes), node, np.int64), np.full(len(hashes), len(hashes), np.int32), hashes])

    each = materialize(arrow_map(sets.select("node", "shingles"), run, "node long, size int, shingle long"), "shingles")
    counts = each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    order = F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("common")
    known = each.join(counts, "shingle").groupBy("node", "size").agg(order).withColumn("own", F.col("size") - F.size("common"))
    front = known.select("node", "size", "own", F.posexplode("common").alias("k", "s"))
    front = front.select("node", "size", F.col("s.shingle").alias("shingle"), (F.col("size") - F.col("own") - F.col("k")).alias("rest"))
    return materialize(front.filter(F.col("rest") >= F.ceil(F.col("size") * similarity - 1e-9)), "front")


def _mixed_front(front: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of front (with component) whose shingle stands at the front in several components."""
    known = front.join(labels, "node")
    mixed = known.groupBy("shingle").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l <> h")
    return materialize(known.join(mixed.select("shingle"), "shingle"), "mixed")


def _reachable(x: dict[str, Column], y: dict[str, Column], similarity: float) -> Column:
    """Whether sets whose first common shingle is this one may have the similarity: what follows it suffices in both, and
    so does the smaller set."""
    least = F.ceil((x["size"] + y["size"]) * (similarity / (1 + similarity)) - 1e-9)
    return (x["component"] != y["component"]) & (F.least(x["rest"], y["rest"], x["size"], y["size"]) >= least)


def _all_apart(front: DataFrame, similarity: float) -> DataFrame:
    """All pairs a, b of nodes of different components that may be similar. The test of the front holds for every similar
    pair, so none is left out."""
    a, b = (front.select("shingle", *(F.col(c).alias(f"{c}_{n}") for c in ("node", "size", "rest", "component"))) for n in "ab")
    x, y = ({c: F.col(f"{c}_{n}") for c in ("component", "size", "rest")} for n in "ab")
    met = (a["shingle"] == b["shingle"]) & (F.col("node_a") < F.col("node_b")) & _reachable(x, y, similarity)
    return a.join(b, met).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _meetings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of nodes that share a band: all of them in small bands, those with a head in large ones, which differs
    from band to band; and the rows of large bands."""
    head = F.min_by("node", F.xxhash64("node", F.col("band") % HEADS)).alias("head")
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("n"), head).filter("n > 1")
    met = materialize(rows.join(sizes, ["band", "key"]), "bands")
    few = met.filter(F.col("n") <= BAND_PAIRS).select("band", "key", "node")
    pairs = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), ["band", "key"]).filter("a < b")
    many = met.filter(F.col("n") > BAND_PAIRS)
    stars = many.filter("node <> head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))
    return pairs.select("a", "b").union(stars), many.select("band", "key", "node")


#: Bands in a group, for pairs of bands: two near fingerprints agree on more bands than there are groups, so on two in one.
GROUP = 6


def _band_pairs() -> Column:
    """The keys of all pairs of bands within groups."""
    bands = range(SYMBOLS // BAND)
    pairs = [(i, j) for i in bands for j in bands if i < j and i // GROUP == j // GROUP]
    key = lambda i, j: F.xxhash64(F.get("bands", F.lit(i)), F.get("bands", F.lit(j)))
    return F.array(*(F.struct(F.lit(k).alias("band"), key(i, j).alias("key")) for k, (i, j) in enumerate(pairs)))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after links a, b of nodes: their components become one."""
    ends = labels.select(F.col("node").alias("n"), F.col("component").alias("c"))
    pairs = links.join(ends, links["a"] == ends["n"]).select("b", F.col("c").alias("a"))
    pairs = pairs.join(ends, pairs["b"] == ends["n"]).select("a", F.col("c").alias("b")).distinct()
    names = connected_components(pairs).select(F.col("node").alias("component"), F.col("component").alias("name"))
    named = labels.join(names, "component", "left").select("node", F.coalesce("name", "component").alias("component"))
    return materialize(named, "labels")


def _labelled(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, key, node, bands) and the component of each node, to be called in a block of temporary()."""
    rows = materialize(_symbol_rows(docs, words), "symbols")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")
    least = nodes.select("node", "least")
    pairs, crowded = _meetings(nodes.select("node", F.posexplode("bands").alias("band", "key")))
    again = nodes.join(crowded.select("node").distinct(), "node", "left_semi").select("node", F.explode(_band_pairs()).alias("p"))
    near = materialize(pairs.union(_meetings(again.select("node", "p.band", "p.key"))[0]).distinct(), "candidates")
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(_shingle_sets(docs, ends.join(least, "node"), words), "sets")
    links = materialize(_verified(near, sets, similarity), "links")
    labels = _joined(nodes.select("node", F.col("node").alias("component")), links)
    seen = crowded.join(labels, "node")
    mixed = seen.groupBy("band", "key").agg(F.min("component").alias("l"), F.max("component").alias("h")).filter("l <> h")
    left = materialize(seen.join(mixed.select("band", "key"), ["band", "key"]).select("node").distinct(), "left")
    if not left.isEmpty():
        sets = materialize(_shingle_sets(docs, left.join(least, "node"), words), "sets")
        near = materialize(_all_apart(_mixed_front(_front(sets, similarity), labels), similarity), "apart")
        labels = _joined(labels, materialize(_verified(near, sets, similarity), "links"))
    return rows, labels


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id of each row: rows whose shingles of `words` words are similar by `similarity` or more.

    Similarity is the Jaccard similarity of the sets of shingles (of their 64-bit hashes), and every linked pair has it
    exactly. At 0.8 two 64-bit SimHashes differ in about 10 bits, which no pigeonhole of few blocks finds. So candidates
    come from a fingerprint of SYMBOLS min-wise symbols, cut into bands and joined on bands; a pair at similarity 0.8
    meets in no band with chance 1e-13. Bands of over BAND_PAIRS fingerprints, as of thousands of near copies, are not
    compared pair by pair: there each is compared with a head, the least of them by one of HEADS orders, and its pairs of
    bands are joined in the same way. Fingerprints of such bands that hold several components after that are compared by
    the shingles at their front, of which every two similar ones share one: all pairs of two components that may be
    similar. So this second step leaves out no similar pair.

    Null and wordless texts are equal to each other. Rows with a null doc_id take part and stay null. Repeated rows keep
    their number; an empty table gives no rows; other columns are not read.
    """
    with temporary():
        rows, labels = _labelled(docs, words, similarity)
        least = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
        named = labels.join(least, "node").groupBy("component").agg(F.min("least").alias("component_id"))
        names = materialize(labels.join(named, "component").select("node", "component_id"), "names")
        return keep(rows.select("doc_id", "node").join(names, "node").select("doc_id", "component_id"), "components")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, but of each component of similar rows only one: of the least doc_id, null
    last, and of the least hash of the text where several have it.

    Rows are chosen by doc_id and text: different texts under one doc_id are different rows, and a row with a null doc_id
    goes if a similar one stays. Of rows equal in both one stays.
    """
    with temporary():
        rows, labels = _labelled(docs, words, similarity)
        order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")
        by_node = rows.groupBy("node").agg(F.min(order).alias("first"))
        chosen = labels.join(by_node, "node").groupBy("component").agg(F.min("first").alias("first"))
        chosen = keep(chosen.select(F.col("first.key").alias("_chosen")), "chosen")
    packed = docs.select(F.struct(*(docs[quoted(c)] for c in docs.columns)).alias("_row"), _row_key(docs).alias("_key"))
    found = packed.join(chosen, packed["_key"] == chosen["_chosen"], "left_semi")
    turn = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))  # the join has dealt and sorted the rows by it
    return found.withColumn("_turn", turn).filter("_turn = 1").select("_row.*")
