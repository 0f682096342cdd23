"""Registered queries of retrieval: every channel reads pairs and chunks that are live and visible to the principal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import retrieval as R
from quern.operators.redaction import SNAPSHOT_DDL, sanitized_snapshot
from quern.operators.search import search
from quern.operators.text_index import build_text_index, search_text_index
from quern.plans.entities import Tables
from quern.plans.queries import CONFIG, EMPLOYEE, query
from quern.storage import materialize

def _final_pairs(t: Tables) -> DataFrame:
    return R.qa_retrieve(t.questions(), materialize(t.scoped_pairs(EMPLOYEE), "pair-items"), CONFIG)


@query("SELECT query_id, item_id, vr AS qa_vector_rank, xr AS qa_text_rank, fused_score FROM kb_fused_pairs")
def ret1_reciprocal_rank_fusion(t: Tables) -> DataFrame:
    k = CONFIG.qa_top_k
    fused = R.fuse(search(t.scoped_pairs(EMPLOYEE), t.questions(), {"qa_vector": ("vector", k), "qa_text": ("text", k)}), CONFIG)
    return fused.select("query_id", "item_id", *(F.col(c).cast("long").alias(c) for c in ("qa_vector_rank", "qa_text_rank")), "fused_score")


@query("SELECT query_id, item_id, rerank_score, final_rank FROM kb_final_pairs WHERE final_rank <= 5")
def ret1_qa_retrieval(t: Tables) -> DataFrame:
    return _final_pairs(t).select("query_id", "item_id", "rerank_score", F.col("final_rank").cast("long").alias("final_rank"))


@query("SELECT query_id, max(rerank_score) AS top_score, max(rerank_score) >= 1.35 AS has_answer FROM kb_final_pairs WHERE final_rank <= 5 GROUP BY query_id")
def fil18_answer_gate(t: Tables) -> DataFrame:
    return R.answer_gate(_final_pairs(t), CONFIG)


def _scoped(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, chunks and documents in scope, each written once as several steps read them: the rules are applied once, and
    a pair's chunk is looked up among the chunks that are live and visible already."""
    seen = materialize(t.seen(EMPLOYEE), "seen")
    chunks = materialize(t.scoped_chunks(EMPLOYEE, seen), "chunk-items")
    return materialize(t.scoped_pairs(EMPLOYEE, seen, chunks), "pair-items"), chunks, seen


def _hybrid(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The final evidence, the chunk items and the documents in scope."""
    pairs, chunks, seen = _scoped(t)
    return R.hybrid_retrieve(t.questions(), pairs, chunks, CONFIG), chunks, seen


@query("SELECT query_id, chunk_id AS item_id, document_id, rerank_score, final_rank, max(rerank_score) OVER (PARTITION BY query_id) >= 1.35 AS has_answer FROM kb_final")
def ret2_hybrid_retrieval(t: Tables) -> DataFrame:
    final, *_ = _hybrid(t)
    return final.select("query_id", "item_id", "document_id", "rerank_score", F.col("final_rank").cast("long").alias("final_rank"), "has_answer")


@query("SELECT query_id, chunk_id AS item_id, fused_score, round(coalesce(qv, 0), 6) AS qa_vector_score, merged FROM kb_kept")
def ret4_deduplicated_evidence(t: Tables) -> DataFrame:
    pairs, chunks, _ = _scoped(t)
    hits = materialize(R.hybrid_hits(t.questions(), pairs, chunks, CONFIG), "hits")
    kept = R.deduplicate(R.chunk_evidence(hits, pairs, chunks, CONFIG), CONFIG.overlap_share)
    return kept.select("query_id", "item_id", "fused_score", F.coalesce("qa_vector_score", F.lit(0.0)).alias("qa_vector_score"), "merged")


@query("SELECT query_id, chunk_id AS item_id, kind, context_id, content FROM kb_context")
def ret7_hydrated_context(t: Tables) -> DataFrame:
    final, chunks, seen = _hybrid(t)
    context = R.hydrate(materialize(final, "final"), chunks, t.scoped_parents(EMPLOYEE, seen))
    return context.select("query_id", "item_id", "kind", "context_id", "content")


@query("SELECT query_id, CASE channel WHEN 'qv' THEN 'qaVector' WHEN 'qx' THEN 'qaText' WHEN 'tv' THEN 'chunkVector' ELSE 'chunkText' END AS stage, rank, item_id AS evidence_id, score FROM kb_hits WHERE rank <= 4")
def ret9_snapshots(t: Tables) -> DataFrame:
    hits = materialize(R.hybrid_hits(t.questions(), t.scoped_pairs(EMPLOYEE), t.scoped_chunks(EMPLOYEE), CONFIG), "hits")
    names = {"qaVector": "qa_vector", "qaText": "qa_text", "chunkVector": "chunk_vector", "chunkText": "chunk_text"}
    items = hits.select("channel", "query_id", "rank", "score", F.col("item_id").alias("evidenceId"), F.lit("never kept").alias("content"))
    stages = {stage: items.filter(F.col("channel") == channel) for stage, channel in names.items()}
    made = R.snapshots(stages, 10, ("evidenceId", "score", "content"))
    whole = F.concat(F.lit('{"question":"not kept either","stages":'), "snapshot", F.lit("}"))
    read = made.select("query_id", F.from_json(sanitized_snapshot(whole, 4), SNAPSHOT_DDL).alias("s")).select("query_id", F.explode("s.stages").alias("stage", "items"))
    return read.select("query_id", "stage", F.explode("items").alias("i")).select("query_id", "stage", F.col("i.rank").cast("long").alias("rank"), F.col("i.evidenceId").alias("evidence_id"), "i.score")


@query(
    """SELECT round(greatest(0, (raw - fused) / raw), 6) AS dedup_ratio, hit FROM (SELECT (SELECT count(*) FROM kb_hits) AS raw, (SELECT count(*) FROM kb_kept) AS fused,
    (SELECT CASE WHEN count(DISTINCT channel) = 4 THEN 1.0 ELSE 0.0 END FROM kb_hits) AS hit)"""
)
def agg21_dedup_and_hit_ratio(t: Tables) -> DataFrame:
    pairs, chunks, _ = _scoped(t)
    hits = materialize(R.hybrid_hits(t.questions(), pairs, chunks, CONFIG), "hits")
    kept = R.deduplicate(R.chunk_evidence(hits, pairs, chunks, CONFIG), CONFIG.overlap_share)
    counted = hits.agg(F.count("*").alias("raw"), F.countDistinct("channel").alias("channels")).join(kept.agg(F.count("*").alias("fused")), F.lit(True))
    ratio = F.greatest(F.lit(0.0), (F.col("raw") - F.col("fused")) / F.col("raw"))
    return counted.select(F.round(ratio, 6).alias("dedup_ratio"), F.when(F.col("channels") == 4, 1.0).otherwise(0.0).alias("hit"))


@query(
    """SELECT query_id, document_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, item_index, item_id) AS rank FROM
    (SELECT q.query_id, t.document_id, t.pair_id AS item_id, t.pair_index AS item_index, round(len(list_intersect(w, v)) / len(w), 6) AS score FROM
     (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+')) AS w FROM kb_queries) q,
     (SELECT *, list_distinct(regexp_extract_all(lower(question || ' ' || answer), '[\\p{L}\\p{N}]+')) AS v FROM kb_qa_items) t) WHERE score > 0) WHERE rank <= 20"""
)
def srt3_token_top_k(t: Tables) -> DataFrame:
    found = R.token_channel(t.scoped_pairs(EMPLOYEE), t.questions(), 20)
    return found.select("query_id", "document_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


def _rank_sql(items: str, item_id: str, index: str, text: str) -> str:
    """The database's text rank of every item of a table for every question."""
    tokens = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
    part = "0.1 * list_sum(list_transform(range(1, least(tf, 256) + 1), lambda i: 1.0 / (i * i))) / 1.64493406685"
    return f"""SELECT query_id, document_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, item_index, item_id) AS rank FROM
    (SELECT query_id, document_id, item_id, item_index, round(sum({part}) / any_value(size), 6) AS score FROM
     (SELECT query_id, len(ws) AS size, unnest(ws) AS w FROM (SELECT query_id, list_distinct({tokens.format("query")}) AS ws FROM kb_queries)) q
     JOIN (SELECT document_id, {item_id} AS item_id, {index} AS item_index, w, count(*) AS tf FROM (SELECT *, unnest({tokens.format(text)}) AS w FROM {items}) GROUP BY ALL) t USING (w)
     GROUP BY query_id, document_id, item_id, item_index)) WHERE rank <= 20"""


def _by_rank(t: Tables, items: DataFrame) -> DataFrame:
    found = search_text_index(build_text_index(items), t.questions(), 20)
    return found.select("query_id", "document_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@query(_rank_sql("kb_qa_items", "pair_id", "pair_index", "question || ' ' || answer"))
def srt3_text_rank(t: Tables) -> DataFrame:
    """Live, visible pairs by the database's text rank, over posting lists."""
    return _by_rank(t, t.scoped_pairs(EMPLOYEE))


@query(_rank_sql("kb_text_items", "chunk_id", "chunk_index", "content"))
def srt3_chunk_text_rank(t: Tables) -> DataFrame:
    """Live, visible chunks by the database's text rank, over posting lists."""
    chunks = t.scoped_chunks(EMPLOYEE)
    return _by_rank(t, chunks.select("document_id", F.col("chunk_id").alias("item_id"), F.col("chunk_index").alias("item_index"), "search_text"))
