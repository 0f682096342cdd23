"""Dashboards, logs, classification statistics, chunk health and retrieval quality."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import linear_percentile, percent
from quern.session import configure, ship


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    """Rows by status."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def stage_outcomes(rows: DataFrame, stage: str = "stage", good: tuple[str, ...] = ("SUCCESS", "COMPLETED")) -> DataFrame:
    """Per stage: success, failure, total and success_rate."""
    won, lost = F.count_if(F.col("status").isin(*good)), F.count_if(F.col("status") == "FAILED")
    counted = rows.groupBy(stage).agg(won.alias("success"), lost.alias("failure"), F.count("*").alias("total"))
    return counted.withColumn("success_rate", percent(F.col("success"), F.col("total")))


def document_stats(documents: DataFrame, *keys: str) -> DataFrame:
    """Live documents by keys (a null key is a group): total, processing, ready, failed, unclassified."""
    status = F.col("status")
    return documents.filter(F.col("deleted_at").isNull()).groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(status.isin("UPLOADED", "PARSING", "QA_SPLITTING", "EMBEDDING")).alias("processing"),
        F.count_if(status == "READY").alias("ready"),
        F.count_if(status == "FAILED").alias("failed"),
        F.count_if(F.col("category_id").isNull()).alias("unclassified"),
    )


def with_zero_stats(dimension: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Every row of a dimension with its statistics, zeros where there are none."""
    names = [c for c in stats.columns if c != key]
    joined = dimension.join(stats, key, "left")
    return joined.select(*dimension.columns, *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def query_kpis(runs: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: query_count, citation_coverage, refusal_rate, hit_rate and mean first-token latency (zero and null left
    out, truncated). runs has has_answer, first_token_ms, latency_ms and status; citations has run_id."""
    cited = citations.select(F.col("run_id").alias("id"), F.lit(1).alias("_c")).distinct()
    refused = F.coalesce(~F.col("has_answer"), F.lit(False)) | F.col("status").isin("REFUSED", "NO_ANSWER")
    latency = F.when(F.coalesce("first_token_ms", F.lit(0)) != 0, F.col("first_token_ms")).otherwise(F.nullif("latency_ms", F.lit(0)))
    total = F.count("*")
    return runs.join(cited, "id", "left").agg(
        total.alias("query_count"),
        percent(F.count("_c"), total).alias("citation_coverage"),
        percent(F.count_if(refused), total).alias("refusal_rate"),
        percent(F.count_if(F.col("status").isin("COMPLETED", "SUCCESS")), total).alias("hit_rate"),
        F.coalesce(F.floor(F.avg(latency)), F.lit(0)).cast("long").alias("first_token_latency_ms"),
    )


def latest_per(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key, by the order columns descending."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def nearest_rank(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """Per key the value at index round((n - 1) * share), halves to even, in ascending order of the values that are not null.

    Values are counted first, so a group is held as its distinct values, and the running sum finds the place.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    placed = counts.withColumns({"_upto": F.sum("_n").over(order), "_all": F.sum("_n").over(whole)})
    place = F.bround((F.col("_all") - 1) * F.lit(share)).cast("long")
    return placed.filter((place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_n"))).select(key, value)


def merged_top(sources: list[DataFrame], time: str, tie: str, limit: int) -> DataFrame:
    """The newest rows of several sources of like columns: the newest `limit` of each, merged, the newest `limit` again.
    Equal times keep the sources' order."""
    tops = (s.orderBy(F.desc(time), F.desc(tie)).limit(limit).withColumn("source_order", F.lit(i)) for i, s in enumerate(sources))
    return reduce(DataFrame.unionByName, tops).orderBy(F.desc(time), "source_order", F.desc(tie)).limit(limit)


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """One page of a fixed order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def key_page(rows: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The rows that follow a key. The filter reaches the scan, so later pages cost no more than the first."""
    return rows.filter(F.col(key) > F.lit(after)).orderBy(key).limit(limit)


def histogram(rows: DataFrame, value: str, bounds: list[float], *labels: str) -> DataFrame:
    """Cumulative buckets: per label set and bound, the number of values at or under it, with +Inf last."""
    counts = rows.groupBy(*labels).agg(
        *(F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)), F.count(value).alias("_all")
    )
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return counts.select(*labels, F.explode(F.array(*pairs)).alias("_p")).select(*labels, "_p.le", "_p.n")


def exposition(metrics: DataFrame) -> DataFrame:
    """Lines of the text format of metrics: name, labels (a map) and value. Backslashes, quotes and line ends in a label's
    value are escaped."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    joined = F.array_join(F.array_sort(pairs), ",")
    shown = F.when(joined == "", F.col("name")).otherwise(F.concat("name", F.lit("{"), joined, F.lit("}")))
    return metrics.select(F.concat(shown, F.lit(" "), F.col("value").cast("string")).alias("line"))


def histogram_exposition(rows: DataFrame, name: str, value: str, bounds: list[float], *labels: str) -> DataFrame:
    """Lines of a histogram: _bucket for each bound and +Inf, cumulative, then _sum and _count, by label set."""
    own = F.map_filter(F.create_map(*(x for c in labels for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull()) if labels else F.create_map().cast("map<string,string>")
    buckets = histogram(rows, value, bounds, *labels)
    le = F.create_map(F.lit("le"), F.col("le"))
    lines = [exposition(buckets.select(F.lit(f"{name}_bucket").alias("name"), F.map_concat(own, le).alias("labels"), F.col("n").alias("value")))]
    totals = rows.groupBy(*labels).agg(F.sum(value).alias("_sum"), F.count(value).alias("_count"))
    lines += [exposition(totals.select(F.lit(f"{name}{c}").alias("name"), own.alias("labels"), F.coalesce(c, F.lit(0)).alias("value"))) for c in ("_sum", "_count")]
    return reduce(DataFrame.unionByName, lines)


def ingestion_health(jobs: DataFrame) -> DataFrame:
    """The stage table with the rates of all jobs beside it: overall_success and overall_failure."""
    good, bad = F.count_if(F.col("status").isin("SUCCESS", "COMPLETED")), F.count_if(F.col("status") == "FAILED")
    overall = jobs.agg(percent(good, F.count("*")).alias("overall_success"), percent(bad, F.count("*")).alias("overall_failure"))
    return stage_outcomes(jobs).join(overall, F.lit(True))  # one row


def set_digest(texts: Column, rows: DataFrame) -> DataFrame:
    """dataset_hash: SHA-256 of the SHA-256 digests of all texts but null ones, in order, repeats included, joined by commas;
    no row without texts. That hash has no parts, so one task reads the digests of distinct texts in order and holds none."""
    ship(configure(rows.sparkSession))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, comma = hashlib.sha256(), b""
        for batch in batches:
            for digest, n in zip(batch.column("digest").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total.update(comma + digest.encode())
                comma = b","
                while n := n - 1:
                    total.update(comma + digest.encode())
        if comma:
            yield pa.RecordBatch.from_pydict({"dataset_hash": [total.hexdigest()]})

    counted = rows.select(F.sha2(texts, 256).alias("digest")).dropna().groupBy("digest").agg(F.count("*").alias("n"))
    return counted.repartition(1).sortWithinPartitions("digest").mapInArrow(whole, "dataset_hash string")


def comparison(modes: dict[str, DataFrame], expected: DataFrame, queries: DataFrame) -> DataFrame:
    """Each mode's recall_at_5, recall_at_10 and mrr_at_10 over the queries with an expectation, with their number and a
    digest of the query set. Modes are rankings (query_id, document_id, rank), expected has query_id and document_id."""
    asked = expected.select("query_id").distinct()
    found = []
    for name, ranked in modes.items():
        first = ranked.filter("rank <= 10").join(expected, ["query_id", "document_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
        found.append(asked.join(first, "query_id", "left").withColumn("mode", F.lit(name)))
    yes = lambda test: F.round(F.avg(F.when(test, 1.0).otherwise(0.0)), 6)
    rows = reduce(DataFrame.unionByName, found).groupBy("mode").agg(
        yes(F.col("first") <= 5).alias("recall_at_5"),
        yes(F.col("first").isNotNull()).alias("recall_at_10"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr_at_10"),
        F.count("*").alias("queries"),
    )
    return rows.join(set_digest(F.col("query"), queries), F.lit(True), "left")  # one row at most


def missed_questions(questions: DataFrame) -> DataFrame:
    """Unanswered questions by tenant and text: hash, count and last_asked."""
    key = F.sha2(F.concat_ws(":", "tenant_id", "question"), 256)
    return questions.groupBy("tenant_id", key.alias("question_hash")).agg(F.count("*").alias("n"), F.max("asked_at").alias("last_asked"))


def retrieval_quality(rankings: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: recall_at_5, recall_at_10, mrr_at_10, ndcg_at_10, empty_rate, citation_accuracy, duplicate_rate,
    permission_leak_rate and evaluated.

    rankings: query_id, document_id, rank, content. expected: query_id, document_id, anchor, visible. A query with an
    invisible expectation counts for leaks alone. A row matches an expectation of its document whose anchor it holds.
    """
    top = rankings.filter("rank <= 10")
    shown = expected.groupBy("query_id").agg(F.bool_and("visible").alias("visible"))
    pairs = top.join(expected.select("query_id", "document_id", "anchor"), ["query_id", "document_id"])
    first = pairs.filter(F.contains("content", "anchor")).groupBy("query_id").agg(F.min("rank").alias("first"))
    held = top.groupBy("query_id").agg(F.count("*").alias("held"), (F.count("*") - F.countDistinct("document_id", "content")).alias("repeats"))
    leaked = rankings.join(expected.select("query_id", "document_id"), ["query_id", "document_id"], "left_semi").select("query_id").distinct()
    each = shown.join(first, "query_id", "left").join(held, "query_id", "left").join(leaked.withColumn("leak", F.lit(1)), "query_id", "left")
    open_, rank = F.col("visible"), F.col("first")
    mean = lambda value: F.round(F.avg(F.when(open_, value)), 6)
    yes = lambda test: F.when(test, 1.0).otherwise(0.0)
    return each.agg(
        mean(yes(rank <= 5)).alias("recall_at_5"),
        mean(yes(rank.isNotNull())).alias("recall_at_10"),
        mean(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr_at_10"),
        mean(F.coalesce(1.0 / F.log2(rank + 1), F.lit(0.0))).alias("ndcg_at_10"),
        mean(yes(F.col("held").isNull())).alias("empty_rate"),
        mean(yes(rank == 1)).alias("citation_accuracy"),
        F.round(F.coalesce(F.sum("repeats") / F.sum("held"), F.lit(0.0)), 6).alias("duplicate_rate"),
        F.round(F.coalesce(F.avg(F.when(~open_, F.coalesce("leak", F.lit(0)))), F.lit(0.0)), 6).alias("permission_leak_rate"),
        F.count_if(open_).alias("evaluated"),
    )


def chunk_health(chunks: DataFrame, min_tokens: int, max_tokens: int) -> DataFrame:
    """One row on chunks (token_count, block_type, covered)."""
    n = F.col("token_count")
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.count_if(n < min_tokens).alias("tiny"),
        F.count_if((n > max_tokens) & F.col("block_type").isin("TEXT", "PROSE")).alias("oversized_prose"),
        F.min(n).cast("long").alias("min_tokens"),
        F.max(n).cast("long").alias("max_tokens"),
        F.round(F.avg(n), 6).alias("mean_tokens"),
        F.round(linear_percentile(n, 0.5), 6).alias("p50_tokens"),
        F.round(linear_percentile(n, 0.95), 6).alias("p95_tokens"),
        F.round(F.avg(F.when(F.col("covered"), 1.0).otherwise(0.0)), 6).alias("coverage"),
    )


def latency_gates(baseline: DataFrame, candidate: DataFrame, limit: float) -> DataFrame:
    """One row: p95 of both (latency_ms), their ratio, and passed."""
    p95 = lambda name: F.round(linear_percentile(F.col("latency_ms"), 0.95), 6).alias(name)
    both = baseline.agg(p95("baseline_p95")).join(candidate.agg(p95("candidate_p95")), F.lit(True))
    ratio = F.round(F.col("candidate_p95") / F.col("baseline_p95"), 6)
    return both.withColumn("ratio", ratio).withColumn("passed", F.col("ratio") <= limit)


def index_size(chunks: DataFrame, dimension: int = 1536) -> DataFrame:
    """Estimated bytes of the vector index."""
    return chunks.agg((F.count("*") * (dimension * 4 + 64)).alias("bytes"))


def archive_days(rows: DataFrame, time: str, cutoff: str) -> DataFrame:
    """Rows older than the cutoff with their day, for a write partitioned by dt."""
    return rows.filter(F.col(time) < F.lit(cutoff).cast("timestamp_ntz")).withColumn("dt", F.date_format(time, "yyyy-MM-dd"))


def write_archive(rows: DataFrame, folder: str, time: str, cutoff: str) -> None:
    """Writes days before the cutoff as gzip JSON lines, a folder a day. A second run replaces the same days."""
    days = archive_days(rows, time, cutoff)
    days.repartition("dt").write.option("partitionOverwriteMode", "dynamic").partitionBy("dt").mode("overwrite").option(
        "compression", "gzip"
    ).json(folder)


def kept_after_archive(rows: DataFrame, time: str, cutoff: str) -> DataFrame:
    """What stays in the hot table."""
    return rows.filter((F.col(time) >= F.lit(cutoff).cast("timestamp_ntz")) | F.col(time).isNull())
