"""Ranked lexical search by pipelined term partitioning: bundles of items travel from one owner of terms to the next."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, batch_of, keep, materialize, temporary, texts_of

#: Documents of a block and bytes of their texts, at most but for a longer text; items of a bundle, on average.
BLOCK_DOCS, BLOCK_BYTES, ITEMS = 2048, 16 << 20, 64
#: Owners of terms by weight, the heaviest first: the least weight of each but the last. A bundle visits them in order.
OWNERS = (5000, 2500, 1000)
#: Fixed values of the score.
SCALE, DAMPING, LENGTH_SHARE = 10**9, 1000, 75

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TERMS = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_INDEX = "block long, term string, slots array<int>, counts array<int>, ids array<long>"
_BUNDLE = "block long, bundle int, item_ids array<long>, rest array<long>, ids array<long>, ns array<int>, rows array<int>, slots array<int>, sums array<long>"


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters, digits and characters beyond ASCII, A-Z lowered."""
    return text.encode().translate(_TERMS).lower().split()


def _lists(sizes: list[int], values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def posting_blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents in blocks of at most BLOCK_DOCS: for each block and term the slots of the documents that hold it and how
    often; and for each block a row with no term: the documents' term counts and ids by slot. No shuffle."""
    out = pa.schema([("block", pa.int64()), ("term", pa.string()), ("slots", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])

    def block(number: int, ids: list, texts: list[str]) -> pa.RecordBatch:
        found: dict[bytes, list[int]] = {}
        totals = []
        for slot, text in enumerate(texts):
            words = terms_of(text)
            totals.append(len(words))
            for term, count in Counter(words).items():
                found.setdefault(term, []).extend((slot, count))
        pairs = np.fromiter((x for v in found.values() for x in v), np.int32).reshape(-1, 2)
        sizes = [len(v) // 2 for v in found.values()]
        n = len(found) + 1
        terms = pa.concat_arrays([pa.array([None], pa.string()), pa.array(list(found), pa.binary()).cast(pa.string())])
        slots = _lists([0, *sizes], pairs[:, 0], pa.int32())
        counts = _lists([len(ids), *sizes], np.concatenate((np.array(totals, np.int32), pairs[:, 1])), pa.int32())
        listed = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * n, pa.int32()), pa.array(ids, pa.int64()))
        return batch_of(out, [np.full(n, number, np.int64), terms, slots, counts, listed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                if ids and (len(ids) == BLOCK_DOCS or size + len(text) > BLOCK_BYTES):
                    yield block(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if ids:
            yield block(number, ids, texts)

    return arrow_map(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")), run, _INDEX)


def _item_terms(items: DataFrame) -> tuple[DataFrame, int]:
    """bundle, row, item_id, term and count of the distinct items with terms; rows count from 0 in each bundle. And the
    number of bundles."""
    out = pa.schema([("bundle", pa.int32()), ("row", pa.int32()), ("item_id", pa.int64()), ("term", pa.string()), ("count", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, row, item_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counted = Counter(terms_of(text or ""))
                n = len(counted)
                terms = pa.array(list(counted), pa.binary()).cast(pa.string())
                yield batch_of(out, [[bundle] * n, [row] * n, [item_id] * n, terms, list(counted.values())])

    distinct = materialize(items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), "items")
    bundles = max(1, -(-distinct.count() // ITEMS))
    dealt = distinct.withColumn("bundle", F.pmod(F.xxhash64("item_id", "text"), F.lit(bundles)).cast("int"))
    turn = F.row_number().over(Window.partitionBy("bundle").orderBy("item_id", "text")) - 1
    rows = dealt.select("bundle", turn.alias("row"), "item_id", "text")
    return materialize(arrow_map(rows, run, "bundle int, row int, item_id long, term string, count long"), "item_terms"), bundles


def _owner(weight: Column) -> Column:
    """The number of the owner of terms with this weight."""
    out = F.lit(len(OWNERS))
    for k in reversed(range(len(OWNERS))):
        out = F.when(weight >= OWNERS[k], k).otherwise(out)
    return out


def _visit(owner: int, k: int, n_docs: int, n_terms: int):
    """The work of one owner on a bundle and a block: adds its terms' contributions to the bundle's accumulators.

    An accumulator is dropped only where it can't reach the k highest: it is below the k-th highest of the same item in
    the same block even with the highest possible contributions of all owners still to come. The last owner leaves k.
    """
    last = owner == len(OWNERS)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        flat = lambda c: np.asarray(pc.list_flatten(left.column(c)))  # noqa: E731  the bundle is one row
        ids, item_ids = (pc.list_flatten(left.column(c)).to_pylist() for c in ("ids", "item_ids"))
        n, items = len(ids), len(item_ids)
        length = flat("ns").astype(np.int64)
        damping = 8 * (100 - LENGTH_SHARE + (LENGTH_SHARE * length * n_docs) // n_terms)
        sums = np.zeros((items, n), np.int64)
        sums[flat("rows"), flat("slots")] = flat("sums")
        for slots, counts, rows, weights in zip(*(right.column(c) for c in ("slots", "counts", "rows", "weights")), strict=True):
            at, tf = (np.asarray(x.values).astype(np.int64) for x in (slots, counts))
            parts = (SCALE * tf) // (DAMPING * tf + damping[at])
            sums[np.ix_(np.asarray(rows.values), at)] += np.asarray(weights.values)[:, None] * parts
        rest = flat("rest").reshape(len(OWNERS) + 1, items)[owner]
        least = np.partition(sums, n - k, axis=1)[:, n - k] if n > k else np.zeros(items, np.int64)
        rows, slots = np.nonzero((sums > 0) & (sums + rest[:, None] >= least[:, None]))
        kept = sums[rows, slots]
        if not last:
            columns = {c: left.column(c) for c in left.column_names[:6]}
            more = {"rows": (rows, pa.int32()), "slots": (slots, pa.int32()), "sums": (kept, pa.int64())}
            return pa.table(columns | {c: _lists([len(v)], v, t) for c, (v, t) in more.items()})
        order = np.array(sorted(range(n), key=lambda s: (ids[s] is not None, ids[s] or 0)))
        turn = np.empty(n, np.int64)
        turn[order] = np.arange(n)
        best = np.lexsort((turn[slots], -kept, rows))
        rows, slots, kept = rows[best], slots[best], kept[best]
        first = np.searchsorted(rows, rows)
        top = np.arange(len(rows)) - first < k
        rows, slots, kept = rows[top], slots[top], kept[top]
        return pa.table({
            "bundle": pa.array(np.full(len(rows), left.column("bundle")[0].as_py()), pa.int32()), "row": pa.array(rows, pa.int32()),
            "item_id": pa.array([item_ids[r] for r in rows], pa.int64()), "doc_id": pa.array([ids[s] for s in slots], pa.int64()),
            "score": pa.array(kept, pa.int64()),
        })

    return run


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score: the k highest-scoring rows of docs (doc_id, text) for each of items (item_id, text).

    The index has a row for each block of documents and term, with whole posting lists of that block. Terms are dealt to
    owners by weight, rare ones first. A bundle of items visits the owners in order, one cogroup each, on every block of
    documents; it carries the block's sparse accumulators, to which an owner adds the contributions of its terms in
    64-bit integers. Rare terms come first, so that most accumulators are known not to reach the k highest and are not
    carried on (see _visit; that loses no row). The best k of each block are ranked at the end. A task holds a bundle's
    accumulators on one block: neither a frequent term nor many documents make it larger.

    Null texts have no terms: such documents and items give no rows, nor does an empty table. Item rows equal in id and
    text count once; different texts under one id are items of their own, each ranked from 1. Repeated documents are
    ranked each; equal scores ascend by doc_id, null first. Other columns are not read.
    """
    with temporary():
        index = materialize(posting_blocks(docs), "postings")
        blocks = index.filter("term IS NULL").select("block", "ids", F.col("counts").alias("ns"))
        lengths = F.filter("ns", lambda x: x > 0)
        total = blocks.select(F.size(lengths).alias("n"), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("m")).agg(F.sum("n"), F.sum("m")).first()
        n_docs, n_terms = total[0] or 0, total[1] or 1
        wanted, n_bundles = _item_terms(items)
        vocabulary = wanted.select("term").distinct()
        found = materialize(index.filter("term IS NOT NULL").select("block", "term", "slots", "counts").join(vocabulary, "term"), "found")
        held = found.groupBy("term").agg(F.sum(F.size("slots")).alias("df"))
        weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
        known = held.withColumn("weight", weight).filter("weight > 0").select("term", "weight", _owner(F.col("weight")).alias("owner"))
        owned = materialize(wanted.join(known, "term").withColumn("weight", F.col("weight") * F.col("count")), "owned")
        most = SCALE // DAMPING
        rest = F.array(*(F.coalesce(F.sum(F.when(F.col("owner") > o, F.col("weight") * most)), F.lit(0)) for o in range(len(OWNERS) + 1)))
        by_row = owned.groupBy("bundle", "row", "item_id").agg(rest.alias("rest"))
        listed = by_row.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("row", "item_id", "rest"))).alias("x"))
        bundles = materialize(listed, "bundles")
        # an item none of whose terms weigh anything has no row there: rows are numbered anew
        numbers = bundles.select("bundle", F.posexplode("x").alias("at", "x")).select("bundle", F.col("x.row").alias("row"), "at")
        owners = owned.join(numbers, ["bundle", "row"]).groupBy("owner", "bundle", "term")
        pair = F.array_sort(F.collect_list(F.struct("at", "weight")))
        owners = materialize(owners.agg(pair.alias("x")).select("owner", "bundle", "term", F.col("x.at").alias("rows"), F.col("x.weight").alias("weights")), "owners")
        by_owner = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(OWNERS))), lambda o: F.transform("x", lambda v: F.get(v["rest"], o))))
        nothing = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("rows", "int"), ("slots", "int"), ("sums", "bigint"))]
        ready = bundles.select("bundle", F.col("x.item_id").alias("item_ids"), by_owner.alias("rest"))
        each = F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle")
        state = blocks.select("block", "ids", "ns", each).join(ready, "bundle").select("block", "bundle", "item_ids", "rest", "ids", "ns", *nothing)
        result = "bundle int, row int, item_id long, doc_id long, score long"
        for owner in range(len(OWNERS) + 1):
            own = owners.filter(F.col("owner") == owner).select("bundle", "term", "rows", "weights")
            lists = found.join(own, "term").select("block", "bundle", "slots", "counts", "rows", "weights")
            meeting = state.groupBy("block", "bundle").cogroup(lists.groupBy("block", "bundle"))
            state = meeting.applyInArrow(_visit(owner, k, n_docs, n_terms), result if owner == len(OWNERS) else _BUNDLE)
        best = Window.partitionBy("bundle", "row").orderBy(F.desc("score"), "doc_id")
        ranked = state.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return keep(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")


def lexical_sql(k: int = 10) -> str:
    """The same rows in DuckDB SQL."""
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS ts FROM documents WHERE text IS NOT NULL),
    l AS (SELECT *, len(ts) AS n FROM d WHERE len(ts) > 0), s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
    p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM l) GROUP BY ALL),
    df AS (SELECT t, count(*) AS df FROM p GROUP BY t),
    q AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT row_number() OVER () AS i, item_id, unnest({terms}) AS t
          FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)) GROUP BY ALL),
    w AS (SELECT q.*, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df USING (t), s),
    x AS (SELECT i, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
          FROM w JOIN p USING (t), s GROUP BY i, item_id, r, doc_id),
    o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM o WHERE rank <= {k}
    """
