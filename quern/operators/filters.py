"""Filters of logs and keys by whichever criteria are given, and the state that work is picked by."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(rows: DataFrame, time: str = "created_at", start: str | None = None, end: str | None = None, **equal) -> DataFrame:
    """Rows whose columns have the values that are given; None is no criterion. start and end bound the time, inclusive."""
    tests = [F.col(name) == value for name, value in equal.items() if value is not None]
    tests += [F.col(time) >= F.to_timestamp_ntz(F.lit(start))] if start else []
    tests += [F.col(time) <= F.to_timestamp_ntz(F.lit(end))] if end else []
    return rows.filter(reduce(Column.__and__, tests)) if tests else rows


def api_log(rows: DataFrame, tenant: str, path: str | None = None, **criteria) -> DataFrame:
    """Calls of a tenant, and those of none: by status_code, key_prefix, request_id, a part of the path, and time."""
    own = matching(rows, **criteria).filter((F.col("tenant_id") == tenant) | F.col("tenant_id").isNull())
    return own.filter(F.contains("path", F.lit(path))) if path else own


def audit_log(rows: DataFrame, actor=None, action=None, resource=None, request=None, start=None, end=None) -> DataFrame:
    """Audit rows by actor, action, resource, request and time."""
    return matching(rows, start=start, end=end, user_id=actor, action=action, resource_id=resource, request_id=request)


def model_calls(rows: DataFrame, start=None, end=None, **criteria) -> DataFrame:
    """Model calls by status, capability, run_id, batch_id, timeout_phase, provider_id, config_id and time."""
    known = {"status", "capability", "run_id", "batch_id", "timeout_phase", "provider_id", "config_id"}
    if unknown := set(criteria) - known:
        raise ValueError(f"unknown criteria: {sorted(unknown)}")
    return matching(rows, start=start, end=end, **criteria)


def task_runs(rows: DataFrame, status=None, task_type=None, resource=None, request=None, task=None, start=None, end=None) -> DataFrame:
    """Tasks by status, type, resource, request, id and time."""
    return matching(rows, start=start, end=end, status=status, task_type=task_type, resource_id=resource, request_id=request, id=task)


def key_decisions(requests: DataFrame, keys: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """request_id and reason of each request: null where its key is valid.

    In order: UNKNOWN_KEY, INACTIVE, EXPIRED, SCOPE, RATE_LIMITED. requests has request_id, key_id, scope and at (long
    microseconds); keys has key_id, active, expires_at (the same) and scopes. The rate counts a key's requests in the
    window before; streaming.logs.rate_limited leaves rejected ones out of the count.
    """
    window = Window.partitionBy("key_id").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    joined = requests.withColumn("_hits", F.count("*").over(window)).join(keys, "key_id", "left")
    reason = (
        F.when(F.col("active").isNull(), "UNKNOWN_KEY")
        .when(~F.col("active"), "INACTIVE")
        .when(F.col("expires_at") <= F.col("at"), "EXPIRED")
        .when(~F.array_contains("scopes", F.col("scope")), "SCOPE")
        .when(F.col("_hits") > limit, "RATE_LIMITED")
    )
    return joined.select("request_id", reason.alias("reason"))


def stale_targets(targets: DataFrame, stored: DataFrame, model_key: str) -> DataFrame:
    """Targets (target_type, id, template_version, input_text) to embed: without a vector, or with one of another type,
    template, input or model. stored has target_type, id, template_version, input_hash, model_key and vector."""
    wanted = targets.withColumns({"input_hash": F.sha2("input_text", 256), "model_key": F.lit(model_key)})
    current = stored.filter("vector is not null").select("target_type", "id", "template_version", "input_hash", "model_key")
    return wanted.join(current, ["target_type", "id", "template_version", "input_hash", "model_key"], "left_anti")


def backfill_eligible(chunks: DataFrame, source: str, target: str) -> DataFrame:
    """document_id and number of active children of documents that are to be rebuilt: all of them of the source version,
    and none of the target version in any state. chunks has chunk_level, status and version."""
    children = chunks.filter("chunk_level = 'CHILD'").groupBy("document_id").agg(
        F.count_if(F.col("status") == "ACTIVE").alias("chunks"),
        F.count_if((F.col("status") == "ACTIVE") & (F.col("version") != source)).alias("_others"),
        F.count_if(F.col("version") == target).alias("_done"),
    )
    return children.filter("chunks > 0 and _others = 0 and _done = 0").select("document_id", "chunks")


def prose_runs(blocks: DataFrame, same_page: bool = False) -> DataFrame:
    """blocks with run: a new one where neighbours may not be merged.

    Two neighbours of a document may if both are prose of one type, title path, structural parent and source, neither is
    marked as a hard boundary, and with same_page they are on one page. blocks has id, index, block_type, title_path,
    parent_id, source, hard and page_no.
    """
    order = Window.partitionBy("id").orderBy("index")
    equal = [F.lag(c).over(order).eqNullSafe(F.col(c)) for c in ("block_type", "title_path", "parent_id", "source", *(["page_no"] if same_page else []))]
    prose = F.col("block_type").isin("TEXT", "QUOTE")
    joins = reduce(Column.__and__, equal) & prose & ~F.col("hard") & ~F.lag("hard").over(order)
    marked = blocks.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    return marked.withColumn("run", F.sum("_new").over(order)).drop("_new")


def section_segments(blocks: DataFrame, key: str) -> DataFrame:
    """Runs of consecutive blocks of one section key: id, section, run, segment (which of its key's runs it is, from 0),
    first and last index."""
    order = Window.partitionBy("id").orderBy("index")
    marked = blocks.withColumn("_new", F.when(F.lag(key).over(order).eqNullSafe(F.col(key)) & (F.row_number().over(order) > 1), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("_new").over(order)).groupBy("id", "run", F.col(key).alias("section"))
    found = runs.agg(F.min("index").alias("first"), F.max("index").alias("last"))
    return found.withColumn("segment", F.row_number().over(Window.partitionBy("id", "section").orderBy("run")) - 1)


def upload_error(file_type: Column, size: Column, types: tuple[str, ...], most: int) -> Column:
    """Why a file can't be uploaded, UNSUPPORTED_TYPE or TOO_LARGE; null if it can. An unknown type or size can't."""
    known = F.coalesce(file_type.isin(*types), F.lit(False))
    return F.when(~known, "UNSUPPORTED_TYPE").when(~F.coalesce(size <= most, F.lit(False)), "TOO_LARGE")


def over_input_limit(text: Column, tokens: Callable[[Column], Column], limit: int) -> Column:
    """True where a text has more tokens than a model takes; a null text has none."""
    return F.coalesce(tokens(text) > limit, F.lit(False))
