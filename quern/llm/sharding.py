"""Sharding by longest-processing-time scheduling: groups that stay together go, largest first, to the least loaded shard."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import keep, materialize, temporary

#: A group of over 1 / (SHARE * shards) of all bytes or of all rows is scheduled by itself. The others go by size class:
#: sizes that agree in their first CLASS_BITS bits, so at most 1 in 64 apart.
SHARE, CLASS_BITS = 256, 7


def longest_first(sizes: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """The shard of each unit: by falling size, always to the least loaded shard, through a heap. Ties go by the key."""
    heap, out = [(0, s) for s in range(shards)], {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        load, shard = heap[0]
        out[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return out


def deal_class(heap: list[tuple[float, int]], n: int, size: float) -> list[int]:
    """How many of n groups of one size each shard of the heap gets from the schedule; the heap is brought up to date.

    The heap would hand them out one by one until all shards are at one level. So shards are filled up to that level at
    once, as far as whole groups go, and the few left go through the heap.
    """
    loads = sorted(heap)
    held = 0.0
    for k, (load, _) in enumerate(loads, 1):
        held += load
        level = (held + n * size) / k
        if k == len(loads) or level <= loads[k][0]:
            break
    counts = [0] * len(heap)
    for load, shard in loads[:k]:
        counts[shard] = int(max(0.0, level - load) / size)
    left = n - sum(counts)
    heap[:] = [(load + counts[shard] * size, shard) for load, shard in loads]
    heapq.heapify(heap)
    for _ in range(left):
        load, shard = heap[0]
        counts[shard] += 1
        heapq.heapreplace(heap, (load + size, shard))
    return counts


def _size_class(size: Column) -> Column:
    """A number that rises with the size: sizes of one class agree in their first CLASS_BITS bits."""
    cut = F.greatest(F.length(F.bin(size)) - CLASS_BITS, F.lit(0))
    return (cut * (1 << CLASS_BITS) + (size / F.pow(F.lit(2.0), cut)).cast("long")).cast("int")


def lpt_shards(docs: DataFrame, shards: int = 16, slot_parts: int | None = None) -> DataFrame:
    """All rows dealt to shards of nearly equal bytes, rows with equal texts together.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, law ('bytes'), shard, slot (gapless from 0 in
    each shard) and grown_shard (null). Null texts have 0 bytes and count as one group with empty ones. Repeated rows
    are rows of their own; null doc_ids are kept; an empty table gives no rows; other columns are not read.

    Every group goes by the heap's schedule. The driver holds at most 2 * SHARE * shards large groups and a count for
    each size class, some 64 for each doubling of the size, whatever the input's size; group sizes are summed before the
    shuffle. A group's turn in its class, and a row's slot in its shard, are counted in parts and offset by a table of
    parts, so no task holds a class or a shard. Texts are read once.
    """
    spark = docs.sparkSession
    with temporary():
        text = F.coalesce(F.col("text"), F.lit(""))
        rows = docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
            F.monotonically_increasing_id().alias("row"),  # written, so that it stays what it is
        )
        rows = materialize(rows, "rows")
        parts = slot_parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        groups = materialize(groups.select("*", _size_class(F.col("bytes")).alias("class"), F.pmod("group", F.lit(parts)).alias("part")), "groups")
        total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
        big = (F.col("bytes") > (total["bytes"] or 0) / (SHARE * shards)) | (F.col("n") > total["n"] / (SHARE * shards))
        large = [(r["bytes"], r["group"]) for r in groups.filter(big).collect()]
        place = longest_first(large, shards)
        loads = [0.0] * shards
        for size, group in large:
            loads[place[group]] += size
        heap = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        small = groups.filter(~big)
        ends = []
        for r in sorted(small.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect(), key=lambda r: -r["class"]):
            stops, stop = [], 0
            for count in deal_class(heap, r["n"], r["bytes"] / r["n"]):
                stop += count
                stops.append(stop)
            ends.append((r["class"], stops))
        # both tables have a bounded number of rows: 2 * SHARE * shards, and one for each class
        by_group = spark.createDataFrame(list(place.items()), "group long, shard int")
        by_class = spark.createDataFrame(ends, "class int, ends array<long>")
        first = F.coalesce(F.sum("k").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        before = small.groupBy("class", "part").agg(F.count("*").alias("k")).select("class", "part", first.alias("before"))
        turn = F.row_number().over(Window.partitionBy("class", "part").orderBy("group")) - 1
        ranked = small.select("group", "class", "part", turn.alias("turn")).join(before, ["class", "part"])
        ranked = ranked.join(F.broadcast(by_class), "class").withColumn("turn", F.col("turn") + F.col("before"))
        own = ranked.select("group", F.size(F.filter("ends", lambda e: e <= F.col("turn"))).alias("shard"))
        own = materialize(own, "shards")
        of_large = rows.join(F.broadcast(by_group), "group")
        of_small = rows.join(F.broadcast(by_group), "group", "left_anti").join(own, "group")
        part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part")
        dealt = of_large.unionByName(of_small).select("doc_id", "size", "text_crc32", "shard", "row", part)
        dealt = keep(dealt, "dealt")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return dealt.withColumn("at", at).join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
