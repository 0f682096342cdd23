"""Batched retrieval: every question of a table against the corpus in one plan.

Items reach this module scoped: access rules and live filters are semi joins below the ranking (operators.access). Of the
few rows that are left for each question, fusion, rerank, gate and hydration are DataFrame expressions; only the greedy
dedup, where each row depends on which earlier ones stay, is a fold in Python over one question's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import CHANNELS, RetrievalConfig
from quern.functions.scalar import char_overlap, characters, collapsed, context_window, normalized, token_count
from quern.operators.search import TIES, passage_matches, search
from quern.storage import materialize

__all__ = ["passage_matches", "search"]
#: Error conditions of a missing chunk index. Others are raised.
UNAVAILABLE = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")


def vector_channel(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact nearest rows by cosine: query_id, document_id, item_id, item_index, score, rank."""
    return search(items, queries, {"qa_vector": ("vector", k)}).drop("channel")


def text_channel(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best rows by share of the question's characters; rows without any are left out."""
    return search(items, queries, {"qa_text": ("text", k)}).drop("channel")


def token_channel(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best rows by share of the question's search tokens; rows without any are left out."""
    return search(items, queries, {"qa_text": ("token", k)}).drop("channel")


def fuse(hits: DataFrame, config: RetrievalConfig, key: str = "item_id") -> DataFrame:
    """Reciprocal rank fusion by query and key: fused_score, scores and ranks per channel, first_seen for stable ties.

    hits has channel, query_id, document_id, the key, rank and score. Where a key is in a channel twice, both ranks add,
    and the later one is kept with its score.
    """
    order = {name: i for i, name in enumerate(CHANNELS)}
    place = F.element_at(F.create_map(*(F.lit(x) for pair in order.items() for x in pair)), F.col("channel"))
    later = lambda name: F.max(F.when(F.col("channel") == name, F.struct("rank", "score")))
    share = lambda name: F.sum(F.when(F.col("channel") == name, F.lit(float(config.weights[name])) / (config.rrf_k + F.col("rank"))))
    grouped = hits.groupBy("query_id", key).agg(
        F.min("document_id").alias("document_id"),
        F.min(place * 1000 + F.col("rank")).alias("first_seen"),
        *(share(c).alias(f"_w{i}") for c, i in order.items()),
        *(later(c).alias(f"_{c}") for c in CHANNELS),
    )
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col(f"_w{i}"), F.lit(0.0)) for i in range(len(CHANNELS))))
    own = [F.col(f"_{c}.{field}").alias(f"{c}_{field}") for c in CHANNELS for field in ("rank", "score")]
    return grouped.select("query_id", key, "document_id", "first_seen", *own, F.round(total, 9).alias("fused_score"))


def rerank(candidates: DataFrame, config: RetrievalConfig, ties: tuple = ("first_seen", *TIES)) -> DataFrame:
    """Lexical rerank to the final rows of each query.

    candidates has query, score_text, item_index, fused_score, vector_score and text_score, and the columns of ties.
    """
    query, text = normalized(F.col("query")), normalized(F.col("score_text"))
    exact = F.when((query != "") & F.contains(text, query), 1.2).otherwise(0.0)
    overlap = char_overlap(characters(F.col("query")), characters(F.col("score_text")))
    position = 0.15 / (1 + F.greatest("item_index", F.lit(0)))
    score = F.col("fused_score") * 8 + F.col("vector_score") * 0.35 + F.col("text_score") * 0.45 + exact + overlap * 0.5 + position
    return final_rows(candidates.withColumn("rerank_score", F.round(score, 6)), config, ties)


def final_rows(scored: DataFrame, config: RetrievalConfig, ties: tuple = ("first_seen", *TIES)) -> DataFrame:
    """The final rows of each query by rerank_score, then fused_score, text_score and the columns of ties."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("fused_score"), F.desc("text_score"), *ties)
    return scored.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= config.final_top_k)


def answer_gate(ranked: DataFrame, config: RetrievalConfig) -> DataFrame:
    """query_id, top_score and has_answer."""
    top = ranked.groupBy("query_id").agg(F.max("rerank_score").alias("top_score"))
    return top.withColumn("has_answer", F.col("top_score") >= config.confidence)


def qa_retrieve(queries: DataFrame, pairs: DataFrame, config: RetrievalConfig) -> DataFrame:
    """The final pairs of each question: both channels of the pairs, fusion, rerank on the pair's question.

    queries has query_id, query and vector. pairs has document_id, item_id, item_index, question, search_text and
    embedding, scoped and live.
    """
    fused = fuse(search(pairs, queries, {"qa_vector": ("vector", config.qa_top_k), "qa_text": ("text", config.qa_top_k)}), config)
    named = fused.drop("document_id").join(pairs.select("item_id", "document_id", "item_index", F.col("question").alias("score_text")), "item_id")
    return rerank(_with_scores(named).join(queries.select("query_id", "query"), "query_id"), config)


def _with_scores(rows: DataFrame) -> DataFrame:
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    return rows.withColumns({"vector_score": zero("qa_vector_score"), "text_score": zero("qa_text_score")})


def span_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap of two spans over the shorter one; 0 where either is empty."""
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    shorter = F.least(a_end - a_start, b_end - b_start)
    return F.when(shorter > 0, shared / shorter).otherwise(F.lit(0.0))


def deduplicate(evidence: DataFrame, share: float = 0.8) -> DataFrame:
    """Greedy dedup of each query's evidence in falling fused_score.

    Each row is tested against the rows kept so far: the same span of a document, then the same content hash, then spans
    of one block that overlap by `share` of the shorter. A kept row takes over the scores and ranks of channels (columns
    <channel>_score and <channel>_rank) of the rows it stands for, the last one's where several have them, but not their
    fused_score. Later rows depend on which earlier ones stay, so a query's few candidates are folded in Python, a group
    per query. Adds merged: how many rows the kept row stands for.
    """
    columns = evidence.columns
    channels = [c for c in columns if c.endswith(("_score", "_rank")) and c.rsplit("_", 1)[0] in CHANNELS]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.astype(object).where(rows.notna(), None).sort_values(["fused_score", "document_id", "item_id"], ascending=[False, True, True])
        kept: list[dict] = []
        for row in ordered.to_dict("records"):
            match = next((k for test in (_same_span, _same_hash, _overlaps(share)) for k in kept if test(k, row)), None)
            if match is None:
                kept.append(row | {"merged": 1})
            else:
                match.update({c: row[c] for c in channels if row[c] is not None})
                match["merged"] += 1
        return pd.DataFrame(kept, columns=[*columns, "merged"], dtype=object)

    ddl = ", ".join(f"`{n}` {t}" for n, t in evidence.dtypes)
    return evidence.groupBy("query_id").applyInPandas(fold, f"{ddl}, merged long")


def _same_span(a: dict, b: dict) -> bool:
    fields = ("document_id", "block", "span_start", "span_end")
    return b["span_end"] > b["span_start"] and all(a[f] == b[f] for f in fields)


def _same_hash(a: dict, b: dict) -> bool:
    return bool(a["content_hash"]) and a["content_hash"] == b["content_hash"]


def _overlaps(share: float):
    def test(a: dict, b: dict) -> bool:
        if a["document_id"] != b["document_id"] or a["block"] != b["block"]:
            return False
        shorter = min(a["span_end"] - a["span_start"], b["span_end"] - b["span_start"])
        shared = min(a["span_end"], b["span_end"]) - max(a["span_start"], b["span_start"])
        return shorter > 0 and max(0, shared) / shorter >= share

    return test


def hybrid_hits(queries: DataFrame, pairs: DataFrame, chunks: DataFrame | None, config: RetrievalConfig) -> DataFrame:
    """The ranked rows of all four channels: two passes, one over the pairs and one over the chunks. Without chunks, the
    pairs' channels alone."""
    k = config.hybrid_top_k
    hits = search(pairs, queries, {"qa_vector": ("vector", k), "qa_text": ("text", k)})
    if chunks is None:
        return hits
    items = chunks.select("document_id", F.col("chunk_id").alias("item_id"), F.col("chunk_index").alias("item_index"), "search_text", "embedding")
    return hits.unionByName(search(items, queries, {"chunk_vector": ("vector", k), "chunk_text": ("text", k)}))


def chunk_evidence(hits: DataFrame, pairs: DataFrame, chunks: DataFrame, config: RetrievalConfig) -> DataFrame:
    """Ranked rows as evidence on child chunks, fused by chunk.

    A pair stands for its chunk; pairs without one, or with one that is not live and visible, are left out. Of a chunk's
    rows, the first that comes from a pair (by channel and rank) gives question and item_index, else the chunk does.
    """
    source = pairs.select("item_id", "chunk_id", F.col("item_index").alias("pair_index"), "question")
    pair_rows = hits.filter(F.startswith("channel", F.lit("qa_"))).join(source, "item_id").filter("chunk_id is not null")
    chunk_rows = hits.filter(~F.startswith("channel", F.lit("qa_"))).withColumn("chunk_id", F.col("item_id"))
    rows = pair_rows.unionByName(chunk_rows, allowMissingColumns=True)
    fused = fuse(rows, config, "chunk_id").drop("document_id")
    order = F.struct(F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("channel")).alias("c"), "rank")
    first = F.min(F.when(F.startswith("channel", F.lit("qa_")), F.struct(order, "item_id", "pair_index", "question"))).alias("pair")
    named = fused.join(rows.groupBy("query_id", "chunk_id").agg(first), ["query_id", "chunk_id"]).join(chunks, "chunk_id")
    title = F.array_join("title_path", " / ")
    question = F.coalesce(F.nullif("pair.question", F.lit("")), F.nullif(title, F.lit("")), F.col("content"))
    return named.select(
        "query_id", "document_id", F.col("chunk_id").alias("item_id"), "chunk_index", "parent_chunk_id", "title_path", "content", "fused_score",
        F.sha2("content", 256).alias("content_hash"), F.col("chunk_index").cast("string").alias("block"), F.lit(0).alias("span_start"),
        F.length("content").alias("span_end"), F.col("pair.item_id").alias("pair_id"), question.alias("question"),
        F.coalesce("pair.pair_index", "chunk_index").cast("int").alias("item_index"),
        *(f"{c}_{field}" for c in CHANNELS for field in ("score", "rank")),
    )


Reranker = Callable[[DataFrame], DataFrame]


def hybrid_retrieve(
    queries: DataFrame,
    pairs: DataFrame,
    chunks: DataFrame | Callable[[], DataFrame],
    config: RetrievalConfig,
    reranker: Reranker | None = None,
) -> DataFrame:
    """The final evidence of each question with rerank_score, final_rank, has_answer, chunk_degraded and rerank_degraded.

    Four channels, fusion by chunk, greedy dedup, rerank, the final rows, and the gate on the best one. queries has
    query_id, query and vector. pairs as for qa_retrieve with chunk_id besides; chunks has document_id, chunk_id,
    chunk_index, parent_chunk_id, title_path, content, search_text and embedding; all scoped and live. Where chunks is a
    function and its table is missing, the pairs' channels remain: each pair that would need a chunk is its own evidence,
    as in qa_retrieve. A reranker takes candidates and adds rerank_score; if it can't be planned, or leaves null, the
    fused score is taken.
    """
    try:
        table = chunks() if callable(chunks) else chunks
    except AnalysisException as error:
        if error.getCondition() not in UNAVAILABLE:
            raise
        final = qa_retrieve(queries, pairs, config)
        return _gated(final, config).withColumns({"chunk_degraded": F.lit(True), "rerank_degraded": F.lit(False)})
    hits = materialize(hybrid_hits(queries, pairs, table, config), "hits")
    evidence = _with_scores(deduplicate(chunk_evidence(hits, pairs, table, config), config.overlap_share))
    text = F.concat_ws("\n", F.nullif(F.array_join("title_path", " / "), F.lit("")), "content")
    candidates = evidence.withColumn("score_text", text).join(queries.select("query_id", "query"), "query_id")
    ties, failed = ("document_id", "item_id"), F.lit(False)
    if reranker is None:
        final = rerank(candidates, config, ties)
    else:
        try:
            scored = reranker(candidates)
            own, failed = F.col("rerank_score"), F.col("rerank_score").isNull()
        except Exception:  # a reranker is optional: its failure leaves the fused order
            scored, own, failed = candidates, F.lit(None).cast("double"), F.lit(True)
        scored = scored.withColumn("rerank_degraded", failed).withColumn("rerank_score", F.coalesce(own, F.col("fused_score")))
        final, failed = final_rows(scored, config, ties), F.col("rerank_degraded")
    return _gated(final, config).withColumns({"chunk_degraded": F.lit(False), "rerank_degraded": failed})


def _gated(final: DataFrame, config: RetrievalConfig) -> DataFrame:
    best = F.max("rerank_score").over(Window.partitionBy("query_id"))
    return final.withColumn("has_answer", best >= config.confidence)


def neighbors(hits: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """Chunks of the same document and parent within `reach` places of each hit: an equi join on exploded places."""
    around = hits.withColumn("neighbor_index", F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)))
    around = around.filter("neighbor_index <> chunk_index")
    other = chunks.select("document_id", "parent_chunk_id", F.col("chunk_index").alias("neighbor_index"), F.col("chunk_id").alias("neighbor_id"), F.col("content").alias("neighbor_content"))
    return around.join(other, ["document_id", "parent_chunk_id", "neighbor_index"])


def context_pack(evidence: DataFrame, budget: int) -> DataFrame:
    """Evidence in rank order while its tokens fit the budget; the first that doesn't fit ends the context.

    A query's evidence is a retrieval's few final rows, so its running sum is one small group.
    """
    order = Window.partitionBy("query_id").orderBy("final_rank").rowsBetween(Window.unboundedPreceding, 0)
    running = evidence.withColumn("tokens_so_far", F.sum("token_count").over(order))
    return running.filter(F.col("tokens_so_far") <= budget)


def hydrate(final: DataFrame, chunks: DataFrame, parents: DataFrame, budget: int = 1200, reach: int = 1) -> DataFrame:
    """Context around each query's final chunks: query_id, item_id, final_rank, kind (PARENT or NEIGHBOR), context_id, content.

    For each chunk in order of fused_score: what stands around it in its parent (context_window, `budget` tokens), then
    its neighbours within `reach` places. A text is left out if it is equal to, within or around a final chunk's or one
    taken before, or has no token. chunks and parents are scoped and live. A query's few texts are folded in the JVM.
    """
    own = final.select("query_id", "item_id", "document_id", "parent_chunk_id", "chunk_index", "final_rank", "fused_score", "content")
    place = F.struct(F.negative("fused_score").alias("f"), "final_rank")
    held = parents.select("document_id", F.col("chunk_id").alias("parent_chunk_id"), F.col("content").alias("parent_content"))
    above = own.join(held, ["document_id", "parent_chunk_id"]).select(
        "query_id", "item_id", "final_rank", place.alias("place"), F.lit(0).alias("step"), F.lit("PARENT").alias("kind"),
        F.col("parent_chunk_id").alias("context_id"), context_window(F.col("parent_content"), F.col("content"), budget).alias("content"),
    )
    beside = neighbors(own.drop("content"), chunks, reach).select(
        "query_id", "item_id", "final_rank", place.alias("place"), (F.col("neighbor_index") - F.col("chunk_index") + reach + 1).alias("step"),
        F.lit("NEIGHBOR").alias("kind"), F.col("neighbor_id").alias("context_id"), collapsed(F.col("neighbor_content")).alias("content"),
    )
    part = F.struct("place", "step", "context_id", "kind", "item_id", "final_rank", "content")
    parts = above.unionByName(beside).groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    seeds = own.groupBy("query_id").agg(F.collect_set(collapsed(F.col("content"))).alias("seeds"))
    none = F.array_repeat(F.lit(False), 0)
    start = F.struct(F.filter("seeds", lambda x: x != "").alias("seen"), none.alias("taken"))

    def step(state: Column, p: Column) -> Column:
        text = p["content"]
        known = (token_count(text) == 0) | F.exists(state["seen"], lambda x: F.contains(x, text) | F.contains(text, x))
        seen = F.when(known, state["seen"]).otherwise(F.array_append(state["seen"], text))
        return F.struct(seen.alias("seen"), F.array_append(state["taken"], ~known).alias("taken"))

    folded = parts.join(seeds, "query_id").withColumn("taken", F.aggregate("parts", start, step, lambda s: s["taken"]))
    rows = folded.select("query_id", F.explode(F.arrays_zip("parts", "taken")).alias("r")).filter("r.taken")
    return rows.select("query_id", *(F.col(f"r.parts.{c}").alias(c) for c in ("item_id", "final_rank", "kind", "context_id", "content")))


def snapshots(stages: dict[str, DataFrame], cap: int, fields: tuple[str, ...]) -> DataFrame:
    """query_id and snapshot: JSON of each stage's first `cap` rows by rank, with the given fields. A ranked filter stands
    before the grouping, so no stage is gathered whole."""
    named = []
    for name, rows in stages.items():
        item = F.struct("rank", *(f for f in fields if f in rows.columns and f != "rank"))
        named.append(rows.filter(F.col("rank") <= cap).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias(name)))
    joined = reduce(lambda a, b: a.join(b, "query_id", "full"), named)
    return joined.select("query_id", F.to_json(F.struct(*stages)).alias("snapshot"))


def embed_batches(texts: DataFrame, embed, dimension: int, batch: int = 64, attempts: int = 1) -> DataFrame:
    """id and vector of each text through a callable that takes a list of texts. Batches keep order; sizes are checked, and
    a batch that fails is tried again, `attempts` times in all."""

    def vectors_of(part: list[str]) -> list:
        for attempt in range(attempts):
            try:
                found = embed(part)
                break
            except Exception:
                if attempt == attempts - 1:
                    raise
        if len(found) != len(part) or any(len(v) != dimension for v in found):
            raise ValueError("the provider returned another number of vectors or another dimension")
        return found

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = (frame["text"].iloc[k : k + batch].tolist() for k in range(0, len(frame), batch))
            yield pd.DataFrame({"id": frame["id"], "vector": [v for part in parts for v in vectors_of(part)]})

    return texts.select("id", "text").mapInPandas(run, f"id {dict(texts.dtypes)['id']}, vector array<float>")
