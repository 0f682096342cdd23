"""Registered queries of filters, projections, provenance, indexing, question-answer runs and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import ChunkPolicy
from quern.functions import scalar as S
from quern.functions import text as X
from quern.operators import access as A
from quern.operators import analytics as N
from quern.operators import chunking, filters, indexing, qa
from quern.operators import redaction, results, snapshots
from quern.operators import retrieval as R
from quern.plans.entities import Tables
from quern.plans.queries import CONFIG, EMPLOYEE, query
from quern.sources import files as sources
from quern.sources import objects
from quern.sources.blocks import parse_files
from quern.storage import materialize, scratch

# --- filters -------------------------------------------------------------------------------------------------------------


@query("SELECT id, path, status_code FROM kb_calls WHERE (tenant_id = 't1' OR tenant_id IS NULL) AND status_code = 500 AND contains(path, 'err') AND created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")
def fil9_api_log(t: Tables) -> DataFrame:
    return filters.api_log(t.calls(), "t1", "err", status_code=500, start="2024-01-05", end="2024-01-25").select("id", "path", "status_code")


@query("SELECT id, user_id, event_type FROM kb_calls WHERE user_id = 7 AND event_type = 'click' AND user_id % 10 = 7 AND 'r' || id % 3 = 'r1' AND created_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-20'")
def fil10_audit_log(t: Tables) -> DataFrame:
    rows = t.calls().withColumns({"action": F.col("event_type"), "resource_id": F.col("user_id") % 10, "request_id": F.concat(F.lit("r"), (F.col("id") % 3).cast("string"))})
    return filters.audit_log(rows, actor=7, action="click", resource=7, request="r1", start="2024-01-01", end="2024-01-20").select("id", "user_id", "event_type")


@query("SELECT id, latency_ms FROM kb_calls WHERE status = 'FAILED' AND id % 2 = 0 AND id % 3 = 0 AND id % 5 < 4 AND id % 7 = 1 AND created_at >= TIMESTAMP '2024-01-03'")
def fil11_model_calls(t: Tables) -> DataFrame:
    calls = t.calls().withColumns(
        {
            "capability": F.when(F.col("id") % 2 == 0, "CHAT").otherwise("EMBEDDING"), "run_id": F.col("id") % 3, "timeout_phase": F.when(F.col("id") % 5 < 4, "READ"),
            "provider_id": F.col("id") % 7, "batch_id": F.lit("b"), "config_id": F.lit("c"),
        }
    )
    found = filters.model_calls(calls, start="2024-01-03", status="FAILED", capability="CHAT", run_id=0, batch_id="b", timeout_phase="READ", provider_id=1, config_id="c")
    return found.select("id", "latency_ms")


@query("SELECT id, stage FROM kb_jobs WHERE status = 'FAILED' AND stage = '1-URGENT' AND document_id % 10 = 3 AND id % 2 = 1 AND created_at >= TIMESTAMP '1993-01-01' AND created_at <= TIMESTAMP '1997-12-31'")
def fil12_task_runs(t: Tables) -> DataFrame:
    jobs = t.jobs().withColumns({"task_type": F.col("stage"), "resource_id": F.col("document_id") % 10, "request_id": F.col("id") % 2})
    found = filters.task_runs(jobs, "FAILED", "1-URGENT", 3, 1, start="1993-01-01", end="1997-12-31")
    return found.select("id", "stage")


@query(
    """SELECT p.pair_id FROM kb_pairs p LEFT JOIN (SELECT pair_id, CASE WHEN pair_index % 3 = 0 THEN 'v0' ELSE 'v1' END AS v, sha256(question || CASE WHEN pair_index % 5 = 0 THEN '!' ELSE '' END) AS h,
    CASE WHEN pair_index % 7 = 0 THEN 'old' ELSE 'm' END AS m, CASE WHEN pair_index % 2 = 0 THEN 'x' END AS vector FROM kb_pairs) s ON s.pair_id = p.pair_id AND s.v = 'v1' AND s.h = sha256(p.question) AND s.m = 'm' AND s.vector IS NOT NULL
    WHERE s.pair_id IS NULL"""
)
def emb1_stale_targets(t: Tables) -> DataFrame:
    pairs = t.pairs().withColumn("id", F.col("pair_id"))
    targets = pairs.select(F.lit("QA").alias("target_type"), "id", F.lit(indexing.TEMPLATE).alias("template_version"), F.col("question").alias("input_text"))
    i = F.col("pair_index")
    asked = F.concat("question", F.when(i % 5 == 0, "!").otherwise(""))
    stored = pairs.select(
        F.lit("QA").alias("target_type"), "id", F.when(i % 3 == 0, "v0").otherwise("v1").alias("template_version"), F.sha2(asked, 256).alias("input_hash"),
        F.when(i % 7 == 0, "old").otherwise("m").alias("model_key"), F.when(i % 2 == 0, F.array(F.lit(1.0))).alias("vector"),
    )
    return filters.stale_targets(targets, stored, "m").select(F.col("id").alias("pair_id"))


_VERSIONED = "(SELECT *, CASE WHEN document_id % 4 = 0 THEN 'v2' WHEN document_id % 4 = 1 AND chunk_index = 0 THEN 'v0' ELSE 'v1' END AS version FROM kb_chunks)"


def _versioned(t: Tables) -> DataFrame:
    mixed = (F.col("document_id") % 4 == 1) & (F.col("chunk_index") == 0)
    return t.chunks().withColumn("version", F.when(F.col("document_id") % 4 == 0, "v2").when(mixed, "v0").otherwise("v1"))


@query(f"SELECT document_id, count(*) FILTER (status = 'ACTIVE') AS chunks FROM {_VERSIONED} WHERE chunk_level = 'CHILD' GROUP BY 1 HAVING count(*) FILTER (status = 'ACTIVE') > 0 AND count(*) FILTER (status = 'ACTIVE' AND version <> 'v1') = 0 AND count(*) FILTER (version = 'v2') = 0")
def fil20_backfill_eligible(t: Tables) -> DataFrame:
    return filters.backfill_eligible(_versioned(t), "v1", "v2")


@query(f"SELECT document_id FROM {_VERSIONED} WHERE chunk_level = 'CHILD' AND status = 'ACTIVE' AND document_id > 20 GROUP BY 1 HAVING count(*) FILTER (version = 'v2') = 0 ORDER BY 1 LIMIT 30")
def chk19_rebuild_page(t: Tables) -> DataFrame:
    return indexing.rebuild_targets(_versioned(t), "v2", 20, 30)


@query("SELECT document_id, document_id % 5 <> 2 AS verified FROM kb_chunks WHERE chunk_level = 'CHILD' GROUP BY document_id")
def chk19_rebuild_verified(t: Tables) -> DataFrame:
    before = t.chunks().filter("chunk_level = 'CHILD'").select("document_id", "chunk_index", "content")
    text = F.when(F.col("document_id") % 5 == 2, F.concat("content", F.lit("x"))).otherwise(F.concat(F.lit(" "), "content"))
    return indexing.rebuild_verified(before, before.withColumn("content", text))


@query(
    """SELECT request_id, CASE WHEN c_custkey IS NULL THEN 'UNKNOWN_KEY' WHEN c_mktsegment = 'MACHINERY' THEN 'INACTIVE' WHEN c_custkey % 4 = 0 AND us >= epoch_us(TIMESTAMP '2024-01-15') THEN 'EXPIRED'
    WHEN path LIKE '/api/%' AND c_custkey % 3 = 0 THEN 'SCOPE' WHEN hits > 2 THEN 'RATE_LIMITED' END AS reason FROM
    (SELECT id AS request_id, user_id, path, epoch_us(created_at) AS us, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(created_at) RANGE BETWEEN 36000000000 PRECEDING AND CURRENT ROW) AS hits FROM kb_calls)
    LEFT JOIN customer ON c_custkey = user_id"""
)
def fil23_key_decisions(t: Tables) -> DataFrame:
    scope = F.when(F.startswith("path", F.lit("/api/")), "api").otherwise("v1")
    requests = t.calls().select(F.col("id").alias("request_id"), F.col("user_id").alias("key_id"), scope.alias("scope"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    late = F.unix_micros(F.lit("2024-01-15").cast("timestamp"))
    keys = t.raw("customer").select(
        F.col("c_custkey").cast("long").alias("key_id"), (F.col("c_mktsegment") != "MACHINERY").alias("active"), F.when(F.col("c_custkey") % 4 == 0, late).alias("expires_at"),
        F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("v1"))).otherwise(F.array(F.lit("v1"), F.lit("api"))).alias("scopes"),
    )
    return filters.key_decisions(requests, keys, 2, 36_000)


# --- projections and joins -------------------------------------------------------------------------------------------------


@query("SELECT query_id, chunk_id AS item_id, round(coalesce(qv, 0), 6) AS vector_score, round(coalesce(qx, 0), 6) AS text_score, round(fused_score, 6) AS fused_score, round(rerank_score, 6) AS rerank_score FROM kb_final")
def prj2_candidate_snapshots(t: Tables) -> DataFrame:
    final = R.hybrid_retrieve(t.questions(), materialize(t.scoped_pairs(EMPLOYEE), "pair-items"), materialize(t.scoped_chunks(EMPLOYEE), "chunk-items"), CONFIG)
    six = lambda name, out: F.round(name, 6).alias(out)
    shown = F.to_json(F.struct(F.col("item_id").alias("chunkId"), six("vector_score", "vectorScore"), six("text_score", "textScore"), six("fused_score", "fusedScore"), six("rerank_score", "rerankScore"), F.col("content").alias("quote")))
    kept = F.from_json(redaction.sanitized_item(shown), redaction.ITEM_DDL)
    read = final.select("query_id", kept.alias("s"))
    return read.select("query_id", F.col("s.chunkId").alias("item_id"), *(F.col(f"s.{a}").alias(b) for a, b in (("vectorScore", "vector_score"), ("textScore", "text_score"), ("fusedScore", "fused_score"), ("rerankScore", "rerank_score"))))


@query(
    """SELECT e.query_id, e.chunk_id AS item_id, coalesce(p.question, c.title) AS question, coalesce(e.qv, 0) AS vector_score, coalesce(e.qx, 0) AS text_score, e.source_rank, sha256(c.content) AS content_hash
    FROM kb_evidence e JOIN kb_text_items c USING (chunk_id) LEFT JOIN kb_qa_items p ON p.pair_id = e.pair_id"""
)
def prj3_evidence_candidates(t: Tables) -> DataFrame:
    pairs, chunks = materialize(t.scoped_pairs(EMPLOYEE), "pair-items"), materialize(t.scoped_chunks(EMPLOYEE), "chunk-items")
    evidence = R.chunk_evidence(R.hybrid_hits(t.questions(), pairs, chunks, CONFIG), pairs, chunks, CONFIG)
    ranks = F.array(*(f"{c}_rank" for c in ("qa_vector", "qa_text", "chunk_vector", "chunk_text")))
    return evidence.select(
        "query_id", "item_id", "question", F.coalesce("qa_vector_score", F.lit(0.0)).alias("vector_score"), F.coalesce("qa_text_score", F.lit(0.0)).alias("text_score"),
        F.array_min(F.filter(ranks, lambda r: r.isNotNull())).cast("long").alias("source_rank"), "content_hash",
    )


@query(
    """SELECT chunk_id, CASE WHEN chunk_index % 3 = 0 THEN 1 + chunk_index % 4 ELSE 9 END AS page_start, sha256(content) AS content_hash, CASE WHEN chunk_index % 2 = 0 THEN 1 ELSE 0 END AS locators FROM kb_live WHERE content IS NOT NULL"""
)
def prj4_chunk_evidence(t: Tables) -> DataFrame:
    i, wrong = F.col("chunk_index"), F.when(F.col("chunk_index") % 2 == 0, F.lit(None)).otherwise(F.sha2(F.lit(""), 256))
    locator = F.when(i % 2 == 0, F.struct(F.col("chunk_id").alias("block"), F.lit(0).alias("start"), F.lit(5).alias("end")))
    chunks = A.live_chunks(t.chunks()).filter("content IS NOT NULL").withColumns(
        {
            "page_start": F.when(i % 3 == 0, 1 + i % 4), "page_end": F.lit(None).cast("int"), "page_no": F.lit(9), "content_hash": wrong,
            "source_locators": F.lit(None).cast("array<struct<block: string, start: int, end: int>>"), "source_locator": locator,
        }
    )
    made = indexing.evidence_of(chunks)
    return made.select("chunk_id", "page_start", "content_hash", F.coalesce(F.size("source_locators"), F.lit(0)).alias("locators"))


@query("SELECT id AS job_id, document_id, lower(status) AS state, stage, CASE status WHEN 'SUCCESS' THEN 100 WHEN 'FAILED' THEN 0 ELSE 50 END AS progress, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created FROM kb_jobs")
def prj5_job_rows(t: Tables) -> DataFrame:
    progress = F.when(F.col("status") == "SUCCESS", 100).when(F.col("status") == "FAILED", 0).otherwise(50)
    return t.jobs().select(F.col("id").alias("job_id"), "document_id", F.lower("status").alias("state"), "stage", progress.alias("progress"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created"))


@query("SELECT p.pair_id, array_to_string(regexp_extract_all(lower(d.title || ' ' || d.space_id || ' ' || p.question || ' ' || p.answer || ' '), '[\\p{L}\\p{N}]+'), ' ') AS search_text FROM kb_pairs p JOIN kb_documents d ON d.id = p.document_id")
def prj7_search_texts(t: Tables) -> DataFrame:
    named = t.pairs().join(t.documents().select(F.col("id").alias("document_id"), "title", "space_id"), "document_id")
    text = indexing.pair_search_text(F.col("title"), F.array("space_id"), F.col("question"), F.col("answer"), F.lit(None).cast("string"))
    return named.select("pair_id", text.alias("search_text"))


@query(
    f"""SELECT document_id, sha256('{indexing.PROMPT.replace("'", "''")}' || chr(10) || chr(10) || 'Document: ' || title || chr(10) || chr(10) || string_agg('[' || chunk_index || '] pages 1-' || (1 + chunk_index) || ' | ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY chunk_index)) AS prompt_hash
    FROM kb_live JOIN kb_documents ON id = document_id WHERE content IS NOT NULL GROUP BY document_id, title"""
)
def prj8_prompts(t: Tables) -> DataFrame:
    named = A.live_chunks(t.chunks()).filter("content IS NOT NULL").join(t.documents().select(F.col("id").alias("document_id"), "title"), "document_id")
    chunks = named.withColumns({"title_path": F.array("title"), "page_start": F.lit(1), "page_end": 1 + F.col("chunk_index")})
    return indexing.qa_prompts(chunks, "document_id").select("document_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query(
    """SELECT c_custkey AS user_id, list_sort(list(DISTINCT n_name)) AS roles, list_sort(list(DISTINCT s_name) FILTER (s_name IS NOT NULL)) AS permissions FROM customer JOIN nation ON n_regionkey = c_nationkey % 5
    LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"""
)
def joi13_rbac_expansion(t: Tables) -> DataFrame:
    users = t.raw("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 5).alias("n_regionkey"))
    grants = t.raw("nation").join(t.raw("supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return A.expanded_roles(users, grants.select("n_regionkey", F.col("n_name").alias("role"), F.col("s_name").alias("permission")), "n_regionkey")


@query(
    """SELECT p.pair_id, d.title, coalesce(s.content, c.content, '') AS source FROM kb_pairs p JOIN kb_documents d ON d.id = p.document_id
    LEFT JOIN kb_chunks s ON p.pair_index % 2 = 0 AND s.chunk_id = p.document_id || '-c1' AND s.document_id = p.document_id AND s.chunk_level = 'CHILD'
    LEFT JOIN kb_chunks c ON c.chunk_id = p.chunk_id AND c.document_id = p.document_id AND c.chunk_level = 'CHILD'"""
)
def joi20_citation_source(t: Tables) -> DataFrame:
    children = t.chunks().filter("chunk_level = 'CHILD'").select("chunk_id", "document_id", "content")
    shot = F.when(F.col("pair_index") % 2 == 0, F.concat(F.col("document_id").cast("string"), F.lit("-c1")))  # the chunk that the citation's snapshot names
    cited = t.pairs().withColumn("snapshot_chunk", shot).join(t.documents().select(F.col("id").alias("document_id"), "title"), "document_id")
    of = lambda key, name: children.select(F.col("chunk_id").alias(key), "document_id", F.col("content").alias(name))
    joined = cited.join(of("snapshot_chunk", "_s"), ["snapshot_chunk", "document_id"], "left").join(of("chunk_id", "_c"), ["chunk_id", "document_id"], "left")
    return joined.select("pair_id", "title", F.coalesce("_s", "_c", F.lit("")).alias("source"))


@query(
    """SELECT pair_id, CASE WHEN n = 1 THEN chunk_id END AS chunk_id, CASE WHEN n = 1 THEN NULL WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS error FROM (SELECT p.pair_id, count(c.chunk_id) AS n, max(c.chunk_id) AS chunk_id FROM
    (SELECT pair_id, document_id, pair_index % 3 + 1 AS page, substr(answer, 1, 12) AS quote FROM kb_pairs) p LEFT JOIN kb_live c ON c.document_id = p.document_id AND p.page BETWEEN 1 + c.chunk_index // 8 AND 2 + c.chunk_index // 8
      AND p.quote <> '' AND contains(trim(regexp_replace(c.content, '\\s+', ' ', 'g')), trim(regexp_replace(p.quote, '\\s+', ' ', 'g'))) GROUP BY 1)"""
)
def joi23_quote_attribution(t: Tables) -> DataFrame:
    quotes = t.pairs().select("pair_id", "document_id", (F.col("pair_index") % 3 + 1).alias("page"), F.substring("answer", 1, 12).alias("quote"))
    first = 1 + F.floor(F.col("chunk_index") / 8)
    chunks = A.live_chunks(t.chunks()).select("document_id", "chunk_id", "content", first.alias("page_start"), (first + 1).alias("page_end"))
    return qa.attributed_quotes(quotes, chunks, "pair_id").select("pair_id", "chunk_id", "error")


# --- aggregates and windows ---------------------------------------------------------------------------------------------


@query(
    """SELECT s.stage, s.success, s.failure, s.total, s.success_rate, a.success_rate AS overall_success, a.failure_rate AS overall_failure FROM (SELECT stage, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failure,
    count(*) AS total, round(count(*) FILTER (status = 'SUCCESS') * 100.0 / count(*), 2) AS success_rate FROM kb_jobs GROUP BY stage) s,
    (SELECT round(count(*) FILTER (status = 'SUCCESS') * 100.0 / count(*), 2) AS success_rate, round(count(*) FILTER (status = 'FAILED') * 100.0 / count(*), 2) AS failure_rate FROM kb_jobs) a"""
)
def agg11_ingestion_health(t: Tables) -> DataFrame:
    return N.ingestion_health(t.jobs())


def _mode_sql(name: str, cs: str) -> str:
    return f"""SELECT '{name}' AS mode, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr_at_10
        FROM (SELECT e.query_id, min(r.rank) AS first FROM (SELECT DISTINCT query_id FROM e) e LEFT JOIN (SELECT m.query_id, m.rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
        (SELECT q.query_id, d.doc_id, round(len(list_intersect(q.s, d.s)) / len(q.s), 6) AS score FROM (SELECT item_id AS query_id, {cs} AS s FROM benchmark) q, (SELECT doc_id, {cs} AS s FROM documents) d) WHERE score > 0) m
        JOIN e ON e.query_id = m.query_id AND e.doc_id = m.doc_id WHERE m.rank <= 10) r ON r.query_id = e.query_id GROUP BY 1)"""


@query(
    "WITH e AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), m AS ("
    + _mode_sql("characters", "list_distinct(string_split(regexp_replace(lower(text), '\\s', '', 'g'), ''))")
    + " UNION ALL "
    + _mode_sql("tokens", "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))")
    + ") SELECT *, (SELECT count(DISTINCT query_id) FROM e) AS queries, (SELECT sha256(string_agg(sha256(text), ',' ORDER BY sha256(text))) FROM benchmark) AS dataset_hash FROM m"
)
def agg18_comparison(t: Tables) -> DataFrame:
    docs = t.raw("documents").select(F.col("doc_id").alias("document_id"), "text")
    items = docs.select("document_id", F.col("document_id").alias("item_id"), F.col("document_id").alias("item_index"), F.col("text").alias("search_text"))
    asked = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    matches = R.passage_matches(docs.select(F.col("document_id").alias("id"), "text"), asked.select(F.col("query_id").alias("passage_id"), F.col("query").alias("passage")))
    expected = materialize(matches.select(F.col("passage_id").alias("query_id"), F.col("id").alias("document_id")), "expected")
    return N.comparison({"characters": R.text_channel(items, asked, 10), "tokens": R.token_channel(items, asked, 10)}, expected, asked)


_BLOCKS = """(SELECT doc_id AS id, pos AS idx, CASE WHEN pos % 9 = 4 THEN 'TABLE' WHEN pos % 9 = 7 THEN 'QUOTE' ELSE 'TEXT' END AS kind, pos // 5 AS section, pos // 10 AS parent, pos // 16 AS source, pos % 13 = 12 AS hard, pos // 20 + 1 AS page FROM kb_lines)"""


def _line_blocks(t: Tables) -> DataFrame:
    lines = t.raw("documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("index", "content"))
    i = F.col("index")
    part = lambda n: F.floor(i / n)
    return lines.withColumns(
        {
            "block_type": F.when(i % 9 == 4, "TABLE").when(i % 9 == 7, "QUOTE").otherwise("TEXT"), "title_path": F.array(part(5).cast("string")), "parent_id": part(10), "source": part(16),
            "hard": i % 13 == 12, "page_no": part(20) + 1, "section": part(5),
        }
    )


@query(
    f"""SELECT id, CAST(run AS BIGINT) AS run, min(idx) AS first, max(idx) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN lag(kind) OVER w = kind AND lag(section) OVER w = section AND lag(parent) OVER w = parent
    AND lag(source) OVER w = source AND lag(page) OVER w = page AND kind <> 'TABLE' AND NOT hard AND NOT lag(hard) OVER w THEN 0 ELSE 1 END AS new FROM {_BLOCKS} WINDOW w AS (PARTITION BY id ORDER BY idx))) GROUP BY 1, 2"""
)
def win6_prose_runs(t: Tables) -> DataFrame:
    runs = filters.prose_runs(_line_blocks(t), same_page=True)
    return runs.groupBy("id", "run").agg(F.min("index").cast("long").alias("first"), F.max("index").cast("long").alias("last"))


@query(
    f"""SELECT id, CAST(run AS BIGINT) AS run, section, min(idx) AS first, max(idx) AS last, row_number() OVER (PARTITION BY id, section ORDER BY run) - 1 AS segment FROM (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY idx) AS run FROM
    (SELECT id, idx, idx // 4 % 3 AS section, CASE WHEN lag(idx // 4 % 3) OVER (PARTITION BY id ORDER BY idx) = idx // 4 % 3 THEN 0 ELSE 1 END AS new FROM {_BLOCKS})) GROUP BY id, run, section"""
)
def win7_section_segments(t: Tables) -> DataFrame:
    blocks = _line_blocks(t).withColumn("section", F.floor(F.col("index") / 4) % 3)
    found = filters.section_segments(blocks, "section")
    return found.select("id", "run", "section", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("segment").cast("long").alias("segment"))


@query(
    """SELECT query_id, part, content FROM (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY part, final_rank, turn) AS used FROM (SELECT *, len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS n FROM
    (SELECT query_id, 0 AS part, final_rank, 0 AS turn, content FROM kb_final UNION ALL SELECT query_id, 1, final_rank, row_number() OVER (PARTITION BY query_id, final_rank ORDER BY content), content FROM kb_context))) WHERE used <= 300"""
)
def ret11_context_pack(t: Tables) -> DataFrame:
    pairs, chunks = materialize(t.scoped_pairs(EMPLOYEE), "pair-items"), materialize(t.scoped_chunks(EMPLOYEE), "chunk-items")
    final = materialize(R.hybrid_retrieve(t.questions(), pairs, chunks, CONFIG), "final")
    packed = indexing.context_parts(final, R.hydrate(final, chunks, t.scoped_parents(EMPLOYEE)), S.token_count, 300)
    return packed.select("query_id", "part", "content")


@query("SELECT query_id, final_rank AS rank, f.document_id, chunk_id AS item_id, d.title, array_to_string(list_filter([space_id, department_id, coalesce(category_id, '')], lambda x: x <> ''), ' / ') AS path FROM kb_final f JOIN kb_documents d ON d.id = f.document_id")
def ret12_citations(t: Tables) -> DataFrame:
    pairs, chunks = materialize(t.scoped_pairs(EMPLOYEE), "pair-items"), materialize(t.scoped_chunks(EMPLOYEE), "chunk-items")
    cited = indexing.citations(R.hybrid_retrieve(t.questions(), pairs, chunks, CONFIG), t.documents())
    return cited.withColumn("rank", F.col("rank").cast("long"))


@query("SELECT query_id, item_id, vr AS qa_vector_rank, true AS chunk_degraded FROM kb_final_pairs WHERE final_rank <= 5")
def ret5_missing_chunk_index(t: Tables) -> DataFrame:
    """The final pairs where the chunk table is missing: those of ret1_qa_retrieval."""
    lost = lambda: t.spark.read.parquet(f"{t.folder}/no-such-chunks.parquet")
    final = R.hybrid_retrieve(t.questions(), t.scoped_pairs(EMPLOYEE), lost, CONFIG)
    return final.select("query_id", "item_id", F.col("qa_vector_rank").cast("long").alias("qa_vector_rank"), "chunk_degraded")


@query("SELECT query_id, chunk_id AS item_id, fused_score, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, coalesce(qx, 0) DESC, document_id, chunk_id) AS final_rank FROM kb_kept JOIN (SELECT chunk_id, document_id FROM kb_text_items) USING (chunk_id)) WHERE final_rank <= 5")
def ret6_reranker_down(t: Tables) -> DataFrame:
    def down(candidates: DataFrame) -> DataFrame:
        raise ConnectionError("no reranker")

    pairs, chunks = materialize(t.scoped_pairs(EMPLOYEE), "pair-items"), materialize(t.scoped_chunks(EMPLOYEE), "chunk-items")
    final = R.hybrid_retrieve(t.questions(), pairs, chunks, CONFIG, down)
    return final.filter("rerank_degraded").select("query_id", "item_id", "fused_score", F.col("final_rank").cast("long").alias("final_rank"))


@query("SELECT item_id, list_transform(range(1, 5), lambda i: CASE WHEN length(text) >= i THEN CAST(unicode(substr(text, i, 1)) % 29 + 1 AS DOUBLE) ELSE 0.0 END) AS vector FROM benchmark")
def fun7_fallback_embedding(t: Tables) -> DataFrame:
    return t.raw("benchmark").select("item_id", S.fallback_embedding(F.col("text")).alias("vector"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') AS tokens FROM documents")
def fun8_search_tokens(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.array_join(X.search_tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT chunk_id, coalesce(CASE WHEN chunk_index % 2 = 0 THEN 's' || document_id END, 'd' || document_id) AS source FROM kb_live")
def fun16_source_identity(t: Tables) -> DataFrame:
    name = F.col("document_id").cast("string")
    explicit = F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("s"), name))
    derived = F.when(F.col("chunk_index") % 2 == 1, F.concat(F.lit("d"), name))
    return A.live_chunks(t.chunks()).select("chunk_id", S.source_identity(explicit, derived).alias("source"))


@query(
    """SELECT chunk_id, CASE WHEN chunk_index % 3 = 0 THEN 2 WHEN chunk_index % 3 = 1 THEN 7 END AS range_start, CASE WHEN chunk_index % 3 = 0 THEN 9 WHEN chunk_index % 3 = 1 THEN 8 END AS range_end, CASE WHEN chunk_index % 3 = 2 THEN 0 ELSE 1 END AS ranges FROM kb_live"""
)
def fun17_locator_ranges(t: Tables) -> DataFrame:
    """A merged span, a source's span, and spans without an end or with nothing in them."""
    kind = F.col("chunk_index") % 3
    pick = lambda test, value: F.when(test, F.lit(value))
    first = F.struct(
        F.col("chunk_id").alias("block"), pick(kind == 0, 2).alias("merged_start"), pick(kind == 0, 9).alias("merged_end"), F.when(kind == 2, 5).otherwise(7).alias("source_start"),
        pick(kind == 1, 8).alias("source_end"),
    )
    nothing = F.struct(F.col("chunk_id").alias("block"), F.lit(4).alias("merged_start"), F.lit(4).alias("merged_end"), F.lit(0).alias("source_start"), F.lit(9).alias("source_end"))
    made = A.live_chunks(t.chunks()).select("chunk_id", S.locator_ranges(F.array(first, nothing)).alias("r"))
    return made.select("chunk_id", F.get("r.start", F.lit(0)).alias("range_start"), F.get("r.end", F.lit(0)).alias("range_end"), F.size("r").alias("ranges"))


@query("SELECT doc_id, trim(nfc_normalize(text), ' ' || chr(9) || chr(10) || chr(13)) AS plain, true AS mapped FROM documents")
def fun10_normalized_texts(t: Tables) -> DataFrame:
    made = t.raw("documents").select("doc_id", "text", X.normalized_text(F.col("text")).alias("n"))
    first = F.substring("text", F.get("n.places", F.lit(0)) + 1, F.lit(1)) == F.substring("n.text", 1, 1)
    return made.select("doc_id", F.col("n.text").alias("plain"), ((F.size("n.places") == F.length("n.text") + 1) & ((F.length("n.text") == 0) | first)).alias("mapped"))


@query("SELECT doc_id, contains(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')), trim(regexp_replace(substr(text, 5, 30), '\\s+', ' ', 'g'))) AND trim(substr(text, 5, 30)) <> '' AS held FROM documents")
def fun20_quotes(t: Tables) -> DataFrame:
    quote = F.regexp_replace(F.substring("text", 5, 30), " ", "  ")
    return t.raw("documents").select("doc_id", X.holds_quote(F.col("text"), quote).alias("held"))


# --- indexing --------------------------------------------------------------------------------------------------------------


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'ACTIVE' AND document_id % 3 = 0 THEN 'SUPERSEDED' ELSE status END AS status FROM kb_chunks UNION ALL SELECT 'ACTIVE' FROM kb_chunks WHERE document_id % 3 = 0 AND chunk_level = 'CHILD') GROUP BY status")
def src24_published_collection(t: Tables) -> DataFrame:
    current = t.chunks()
    staged = current.filter("document_id % 3 = 0 AND chunk_level = 'CHILD'").withColumn("status", F.lit("STAGING"))
    return N.status_counts(indexing.publish(current, staged))


@query(
    """SELECT 0 AS snapshot, status, count(*) AS n FROM kb_chunks GROUP BY status UNION ALL
    SELECT 2, status, count(*) FROM (SELECT CASE WHEN status = 'ACTIVE' AND (document_id % 3 = 0 OR document_id % 10 = 1) THEN 'SUPERSEDED' ELSE status END AS status FROM kb_chunks
      UNION ALL SELECT 'ACTIVE' FROM kb_chunks WHERE (document_id % 3 = 0 OR document_id % 10 = 1) AND chunk_level = 'CHILD') GROUP BY status"""
)
def src24_snapshots(t: Tables) -> DataFrame:
    """Two publishes from one version, of which the second is tried again; readers of the first and the last version."""
    held = snapshots.Collection(t.spark, f"{scratch(t.spark, 'collection')}/chunks")
    current = t.chunks()
    held.create(current)
    children = current.filter("chunk_level = 'CHILD'")
    before = held.read(0)
    held.publish(children.filter("document_id % 3 = 0"), expected=0)
    try:
        held.publish(children.filter("document_id % 10 = 1 and document_id % 3 <> 0"), expected=0)
    except snapshots.Conflict:
        held.publish(children.filter("document_id % 10 = 1 and document_id % 3 <> 0"))
    counts = before.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(0).alias("snapshot"), "status", "n")
    return counts.unionByName(snapshots.snapshot_counts(held, [2]))


@query(
    f"""SELECT document_id, CASE WHEN children > 0 THEN 'v2' ELSE version END AS version, count(*) AS n FROM
    (SELECT *, count(*) FILTER (chunk_level = 'CHILD') OVER (PARTITION BY document_id) AS children FROM {_VERSIONED} WHERE status = 'ACTIVE') GROUP BY 1, 2"""
)
def chk19_rebuild_run(t: Tables) -> DataFrame:
    """A rebuild of all documents to another version that is killed on its second page and begun again."""
    held = snapshots.Collection(t.spark, f"{scratch(t.spark, 'rebuilt')}/chunks")
    held.create(_versioned(t))
    pages: list[int] = []

    def build(active: DataFrame) -> DataFrame:
        pages.append(1)
        if len(pages) == 2:
            raise InterruptedError
        return active

    share = max(1, t.raw("documents").count() // 4)  # few pages at any size
    for _ in range(2):
        try:
            snapshots.rebuild(held, "r1", "v2", build, share)
        except InterruptedError:
            continue
    return held.read().filter("status = 'ACTIVE'").groupBy("document_id", "version").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN id % 10 = 0 THEN 'moved' ELSE space_id END AS space_id, CASE WHEN id % 10 = 0 THEN 'archive' ELSE department_id END AS department_id FROM kb_documents")
def upd1_reclassify(t: Tables) -> DataFrame:
    changed = indexing.reclassify(t.documents(), F.col("id") % 10 == 0, space_id="moved", department_id="archive")
    return changed.select("id", "space_id", "department_id")


@query("SELECT id, CASE WHEN id % 9 = 0 THEN 'DELETED' ELSE status END AS status, CASE WHEN id % 9 = 0 THEN coalesce(deleted_at, DATE '2024-05-01') ELSE deleted_at END AS deleted_at FROM kb_documents")
def upd2_soft_delete(t: Tables) -> DataFrame:
    return indexing.soft_delete(t.documents(), F.col("id") % 9 == 0, "2024-05-01").select("id", "status", "deleted_at")


def _pair_targets(t: Tables) -> DataFrame:
    text = S.search_text(F.col("question"), F.col("answer"))
    return t.pairs().select(F.lit("QA").alias("target_type"), F.col("pair_id").alias("id"), F.lit(indexing.TEMPLATE).alias("template_version"), F.col("question").alias("input_text"), text.alias("search_text"))


def _mock_model(batch: list[str]) -> list[list[float]]:
    import hashlib

    return [[round(b / 255, 6) for b in hashlib.sha256(x.encode()).digest()[:8]] for x in batch]


def _mock_vectors(texts: DataFrame) -> DataFrame:
    return R.embed_batches(texts, _mock_model, 8, attempts=3)


_MOCK8 = "list_transform(range(0, 8), lambda i: round(CAST('0x' || sha256({0})[i * 2 + 1 : i * 2 + 2] AS INT) / 255.0, 6)::FLOAT)"


@query(f"SELECT item_id AS id, {_MOCK8.format('text')} AS vector FROM benchmark")
def emb2_batched_embedding(t: Tables) -> DataFrame:
    return _mock_vectors(t.raw("benchmark").select(F.col("item_id").alias("id"), "text"))


_EMBEDDED = f"SELECT pair_id AS id, {_MOCK8.format('question')} AS embedding, len(regexp_extract_all(lower(question || ' ' || answer), '[\\p{{L}}\\p{{N}}]+')) AS token_count, sha256(question) AS input_hash, 'COMPLETED' AS stage FROM kb_pairs"


def _job(t: Tables, embed) -> tuple[DataFrame, str]:
    records = t.pairs().select(F.col("pair_id").alias("id"))
    none = t.spark.createDataFrame([], "target_type string, id string, template_version string, input_hash string, model_key string, vector array<float>")
    made, stage = indexing.embed_job({"QA": (records, _pair_targets(t))}, none, embed, "m", lambda: "g1")
    return made["QA"], stage


def _embedded(rows: DataFrame, stage: str) -> DataFrame:
    return rows.select("id", "embedding", F.col("token_count").cast("long").alias("token_count"), F.get_json_object("metadata", "$.inputTextHash").alias("input_hash"), F.lit(stage).alias("stage"))


@query(_EMBEDDED)
def emb5_embedded_pairs(t: Tables) -> DataFrame:
    return _embedded(*_job(t, _mock_vectors))


@query(_EMBEDDED)
def emb5_resumed_job(t: Tables) -> DataFrame:
    """A job whose model fails for one text in five; the job after it asks only for what has no logged vector."""
    folder = f"{scratch(t.spark, 'vectors')}/log"

    def failing(batch: list[str]) -> list:
        return [None if sum(x.encode()) % 5 == 0 else v for x, v in zip(batch, _mock_model(batch), strict=True)]

    for model in (failing, _mock_model):
        rows, stage = _job(t, lambda texts, model=model: results.logged_vectors(texts, folder, "mock", model))
    return _embedded(rows, stage)


# --- question-answer runs ---------------------------------------------------------------------------------------------------


_SIZED = "(SELECT document_id, chunk_id, chunk_index, len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS tokens FROM kb_live WHERE content IS NOT NULL)"


@query(
    f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS i FROM {_SIZED}),
    f AS (SELECT document_id, i, 0 AS batch_index, 20 + tokens AS total FROM n WHERE i = 1 UNION ALL SELECT n.document_id, n.i, CASE WHEN f.total + n.tokens <= 120 THEN f.batch_index ELSE f.batch_index + 1 END,
    CASE WHEN f.total + n.tokens <= 120 THEN f.total + n.tokens ELSE 20 + n.tokens END FROM f JOIN n ON n.document_id = f.document_id AND n.i = f.i + 1)
    SELECT document_id, batch_index, count(*) AS chunks, max(f.total) AS size, CASE WHEN max(tokens) > 100 THEN 'OVERSIZE' END AS error FROM f JOIN n USING (document_id, i) GROUP BY 1, 2"""
)
def qas1_token_batches(t: Tables) -> DataFrame:
    chunks = A.live_chunks(t.chunks()).filter("content IS NOT NULL").withColumns({"tokens": S.token_count(F.col("content")), "generation": F.lit("g")})
    batches = qa.token_batches(chunks, 120, 20, splits=False)
    return batches.select("document_id", "batch_index", F.size("chunk_ids").cast("long").alias("chunks"), "size", "error")


@query(f"SELECT document_id, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(greatest(1, ceil(tokens / 30.0))) AS BIGINT) AS parts, true AS bounded FROM {_SIZED} GROUP BY 1")
def qas1_fragments(t: Tables) -> DataFrame:
    chunks = A.live_chunks(t.chunks()).filter("content IS NOT NULL").withColumns({"tokens": S.token_count(F.col("content")), "generation": F.lit("g")})
    batches = qa.token_batches(chunks, 50, 20, splits=True)
    return batches.groupBy("document_id").agg(F.sum(F.col("size") - 20).alias("tokens"), F.sum(F.size("chunk_ids")).alias("parts"), F.every((F.col("size") <= 50) & F.col("error").isNull()).alias("bounded"))


def _small_batches(t: Tables) -> DataFrame:
    live = A.live_chunks(t.chunks()).filter("content IS NOT NULL").withColumn("size", F.length("content"))
    return qa.greedy_batches(live, "size", 600)


def _picky(ids: list[str]) -> str:
    if len(ids) > 2:
        raise qa.ProviderError("TRUNCATED")
    return ",".join(ids)


@query("SELECT document_id, chunk_id, true AS small FROM kb_live WHERE content IS NOT NULL")
def qas4_halved_batches(t: Tables) -> DataFrame:
    """Every chunk in an answered part of at most two chunks, though a model truncates what is longer."""
    rows = qa.generate(_small_batches(t), _picky, depth=12).filter("error is null")
    return rows.select("document_id", F.explode(F.split("output", ",")).alias("chunk_id"), (F.size("chunk_ids") <= 2).alias("small"))


@query("SELECT document_id, true AS ready, count(*) AS chunks FROM kb_live WHERE content IS NOT NULL GROUP BY 1")
def qas6_checkpointed_run(t: Tables) -> DataFrame:
    """A run that fails for half of the documents, and one after it that does only what is left."""
    batches, folder = materialize(_small_batches(t), "batches"), f"{scratch(t.spark, 'runs')}/results"

    def flaky(ids: list[str]) -> str:
        if int(ids[0].split("-")[0]) % 2:
            raise qa.ProviderError("INFERENCE", retryable=True)
        return ",".join(ids)

    qa.checkpointed_run(batches, folder, flaky)
    rows = qa.checkpointed_run(batches, folder, lambda ids: ",".join(ids))
    ready = qa.publishable(batches, rows)
    counted = rows.join(qa.finished(rows), ["input_hash", "run"]).groupBy("document_id").agg(F.sum(F.size("chunk_ids")).alias("chunks"))
    return ready.join(counted, "document_id").select("document_id", "ready", "chunks")


@query(
    """SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY conv_id, turn) - 1 AS pair_index, question FROM (SELECT conv_id % 200 AS document_id, conv_id, turn, question FROM kb_turns WHERE role = 'user' AND next_role = 'assistant' AND conv_id % 2 = 0)
    WHERE document_id IN (SELECT DISTINCT conv_id % 200 FROM kb_turns WHERE role = 'user' AND next_role = 'assistant' AND conv_id % 2 = 0)
    UNION ALL SELECT document_id, pair_index, question FROM kb_pairs WHERE document_id NOT IN (SELECT DISTINCT conv_id % 200 FROM kb_turns WHERE role = 'user' AND next_role = 'assistant' AND conv_id % 2 = 0)"""
)
def qas7_replaced_pairs(t: Tables) -> DataFrame:
    pairs = t.pairs().withColumn("conv_id", F.split("pair_id", "-")[0].cast("long"))
    new = pairs.filter("conv_id % 2 = 0").select("document_id", F.col("conv_id").alias("chunk_index"), F.col("pair_index").alias("item_index"), "question", "answer")
    return qa.replace_pairs(t.pairs(), new).select("document_id", F.col("pair_index").cast("long").alias("pair_index"), "question")


@query(
    """WITH RECURSIVE n AS (SELECT id, user_id AS provider, event_type = 'error' AS pressed, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS i FROM kb_calls),
    f AS (SELECT provider, 0 AS i, CAST(NULL AS BIGINT) AS id, 8 AS level, 0 AS good FROM n WHERE i = 1 UNION ALL SELECT n.provider, n.i, n.id, CASE WHEN pressed THEN greatest(1, level // 2) WHEN good = 2 THEN least(8, level + 1) ELSE level END,
    CASE WHEN pressed OR good = 2 THEN 0 ELSE good + 1 END FROM f JOIN n ON n.provider = f.provider AND n.i = f.i + 1) SELECT id, level AS allowed FROM f WHERE i > 0"""
)
def qas8_concurrency(t: Tables) -> DataFrame:
    calls = t.calls().select(F.col("user_id").alias("provider"), "id", F.col("created_at").alias("at"), (F.col("event_type") == "error").alias("pressed"))
    return qa.concurrency(calls, 8)


# --- files ----------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS id, CASE WHEN doc_id % 7 = 3 OR trim(text) = '' OR text IS NULL THEN 0 ELSE 1 END AS page_count, CASE WHEN doc_id % 7 = 3 THEN 'BROKEN: UnicodeDecodeError' END AS error FROM documents WHERE regexp_matches(text, '(^|\\n)[^#\\s][^\\n]*')")
def src1_text_files(t: Tables) -> DataFrame:
    """Text files as bytes, one in seven of them not UTF-8."""
    kept = t.raw("documents").filter(F.col("text").rlike(r"(^|\n)[^#\s][^\n]*"))
    data = F.when(F.col("doc_id") % 7 == 3, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF")))).otherwise(F.encode("text", "UTF-8"))
    blocks = parse_files(kept.select(F.col("doc_id").alias("id"), F.lit("a.txt").alias("name"), data.alias("content")))
    errors = blocks.groupBy("id").agg(F.max("error").alias("error"))
    return sources.page_counts(blocks).join(errors, "id").select("id", "page_count", "error")


_LINE = "trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(f"SELECT doc_id AS id, CAST(count(*) FILTER (pos > 0) AS BIGINT) AS blocks, CAST(max(pos + 1) FILTER (pos > 0) AS INT) AS last_page, sha256(coalesce(string_agg({_LINE}, chr(10) ORDER BY pos) FILTER (pos > 0), '')) AS content_hash FROM kb_lines WHERE regexp_matches(content, '[^\\s]') GROUP BY doc_id HAVING count(*) FILTER (pos > 0) > 0")
def src9_content_lists(t: Tables) -> DataFrame:
    """A content list of each document: its first line is a heading, the others are texts, each on a page of its own."""
    lines = t.raw("documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "content")).filter(F.col("content").rlike(r"[^\s]"))
    item = F.struct("pos", F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), F.when(F.col("pos") == 0, 1).alias("text_level"), F.col("pos").alias("page_idx")).alias("i"))
    lists = lines.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    blocks = parse_files(lists.select("id", F.lit("a.list.json").alias("name"), F.to_json("items.i").alias("content")))
    return _block_digest(blocks)


def _block_digest(blocks: DataFrame) -> DataFrame:
    own = F.col("content").isNotNull()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("index", "content")))), lambda b: b["content"]), "\n")
    return blocks.groupBy("id").agg(F.count_if(own).alias("blocks"), F.max("page_no").alias("last_page"), F.sha2(joined, 256).alias("content_hash"))


@query(f"SELECT doc_id AS id, CAST(count(*) FILTER (pos > 0) AS BIGINT) AS blocks, CAST(max(pos + 1) FILTER (pos > 0) AS INT) AS last_page, sha256(coalesce(string_agg({_LINE}, chr(10) ORDER BY pos) FILTER (pos > 0), '')) AS content_hash FROM kb_lines WHERE regexp_matches(content, '[^\\s]') GROUP BY doc_id HAVING count(*) FILTER (pos > 0) > 0")
def src11_document_trees(t: Tables) -> DataFrame:
    """A document tree of each document: a title, texts by reference, and page furniture that is left out."""
    lines = t.raw("documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "content")).filter(F.col("content").rlike(r"[^\s]"))
    label = F.when(F.col("pos") == 0, "title").otherwise("text")
    node = F.struct("pos", F.struct(label.alias("label"), F.col("content").alias("text"), F.array(F.struct((F.col("pos") + 1).alias("page_no"))).alias("prov")).alias("n"))
    trees = lines.groupBy("id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    furniture = F.array(F.struct(F.lit("page_footer").alias("label"), F.lit("page of").alias("text"), F.array(F.struct(F.lit(99).alias("page_no"))).alias("prov")))
    texts = F.concat("nodes.n", furniture)
    children = F.transform(F.sequence(F.lit(0), F.size("nodes")), lambda i: F.struct(F.concat(F.lit("#/texts/"), i.cast("string")).alias("$ref")))
    tree = F.to_json(F.struct(F.struct(children.alias("children")).alias("body"), texts.alias("texts")))
    return _block_digest(parse_files(trees.select("id", F.lit("a.tree.json").alias("name"), tree.alias("content"))))


@query()
def src11_html_pages(t: Tables) -> DataFrame:
    pages = t.raw("pages").select(F.col("page_id").alias("id"), F.lit("page").alias("name"), F.lit("text/html; charset=utf-8").alias("media_type"), F.col("html").alias("content"))
    return parse_files(pages).select("id", "index", "block_type", "title_path", "content", "error")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'PRIMARY_FAILED' WHEN doc_id % 3 = 1 THEN 'PRIMARY_EMPTY' END AS reason FROM documents WHERE regexp_matches(text, '(^|\\n)[^#\\s][^\\n]*') GROUP BY 1, 2")
def src13_degraded_parses(t: Tables) -> DataFrame:
    docs = t.raw("documents").filter(F.col("text").rlike(r"(^|\n)[^#\s][^\n]*")).select(F.col("doc_id").alias("id"), "text")
    kind = F.col("id") % 3
    made = F.when(kind == 0, "{").when(kind == 1, "[]").otherwise(F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))))
    primary = parse_files(docs.select("id", F.lit("a.list.json").alias("name"), made.alias("content")))
    second = parse_files(docs.select("id", F.lit("a.md").alias("name"), F.col("text").alias("content")))
    return sources.with_fallback(primary, second).select("id", "reason").distinct()


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'UNSUPPORTED' ELSE 'UNSUPPORTED' END AS error FROM documents WHERE regexp_matches(text, '(^|\\n)[^#\\s][^\\n]*')")
def src14_parser_choice(t: Tables) -> DataFrame:
    """By suffix, by media type, of no known type, and of a type that is not allowed."""
    docs = t.raw("documents").filter(F.col("text").rlike(r"(^|\n)[^#\s][^\n]*"))
    kind = F.col("doc_id") % 4
    name = F.when(kind == 0, "a.md").when(kind == 3, "a.html").otherwise("a.bin")
    found = docs.select(F.col("doc_id").alias("id"), name.alias("name"), F.when(kind == 1, "text/markdown").alias("media_type"), F.col("text").alias("content"))
    return parse_files(found, frozenset({"md", "csv"})).select("id", "error").distinct()


@query("SELECT 'd/' || doc_id || '.txt' AS key, sha256(coalesce(text, '')) AS sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents")
def src16_objects(t: Tables) -> DataFrame:
    folder = scratch(t.spark, "objects")
    key = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    put = sources.put_objects(t.raw("documents").select(key.alias("key"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data")), folder)
    sizes = materialize(put.select("key", "size"), "written")
    got = sources.get_objects(t.spark, folder, "*.txt").select("key", F.sha2("data", 256).alias("sha256"))
    return sizes.join(got, "key", "left").select("key", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("sha256"), "size")


@query("SELECT lang || '/' || doc_id AS key, sha256(coalesce(text, '')) AS sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents WHERE lang IN ('en', 'de') AND NOT starts_with(lang || '/' || doc_id, 'de/1')")
def src16_object_source(t: Tables) -> DataFrame:
    """Texts through the data source of objects, in two appends, of which two languages are opened again."""
    objects.register(t.spark)
    folder = scratch(t.spark, "object-source")
    rows = t.raw("documents").select(F.concat_ws("/", "lang", "doc_id").alias("key"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"), "lang")
    for part in (F.col("lang") == "en", F.col("lang") != "en"):
        rows.filter(part).select("key", "data").write.format(objects.NAME).option("path", folder).mode("append").save()
    read = lambda: t.spark.read.format(objects.NAME).option("path", folder).load()
    two = read().filter("startswith(key, 'en/')").unionByName(read().filter("startswith(key, 'de/')").filter("not startswith(key, 'de/1')"))
    return two.select("key", F.sha2("data", 256).alias("sha256"), "size")


@query("SELECT item_id AS id, text AS query, item_id % 3 = 0 AS visible FROM benchmark")
def src18_json_lines(t: Tables) -> DataFrame:
    folder = f"{scratch(t.spark, 'lines')}/queries"
    t.raw("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"), (F.col("item_id") % 3 == 0).alias("visible")).write.json(folder)
    return sources.read_json_lines(t.spark, folder, "id bigint, query string, visible boolean", ("id", "query"))


@query("SELECT lang AS source_identity, doc_id % 2 + 1 AS page_no, count(*) AS blocks, count(DISTINCT text) AS texts FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def src19_manifest(t: Tables) -> DataFrame:
    folder = f"{scratch(t.spark, 'manifest')}/manifest"
    text = F.sha2("text", 256)  # what stands for a block's content
    block = F.struct(
        (F.col("doc_id") % 2 + 1).cast("int").alias("page"), F.array("lang").alias("titlePath"), F.col("doc_id").cast("string").alias("structuralId"), F.lit("TEXT").alias("blockType"), text.alias("content")
    )
    documents = t.raw("documents").filter("text IS NOT NULL").groupBy("lang").agg(F.collect_list(block).alias("blocks"))
    whole = documents.agg(F.collect_list(F.struct(F.col("lang").alias("sourceIdentity"), F.col("lang").alias("title"), "blocks")).alias("documents"))
    whole.select(F.to_json(F.struct(F.lit("1").alias("schemaVersion"), "documents")).alias("value")).coalesce(1).write.text(folder)
    blocks = sources.read_manifest(t.spark, folder, "1")
    return blocks.groupBy("source_identity", F.col("page_no").cast("long").alias("page_no")).agg(F.count("*").alias("blocks"), F.countDistinct("content").alias("texts"))


@query("SELECT unnest(['# Jobs', '', '## jobs', '', '| metric | value |', '| --- | --- |', '| failed | ' || count(*) FILTER (status = 'FAILED') || ' |', '| total | ' || count(*) || ' |']) AS line FROM kb_jobs")
def src21_report(t: Tables) -> DataFrame:
    folder = f"{scratch(t.spark, 'report')}/report"
    counted = t.jobs().agg(F.count("*").alias("total"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    metrics = counted.select(F.lit("jobs").alias("section"), F.expr("stack(2, 'total', total, 'failed', failed) AS (name, value)"))
    sources.write_report(metrics, folder, "Jobs")
    return t.spark.read.text(f"{folder}/markdown").select(F.col("value").alias("line"))


@query()
def chk_block_chunks(t: Tables) -> DataFrame:
    """Chunks of parsed files, block by block."""
    files = t.raw("documents").select(F.col("doc_id").alias("id"), F.lit("a.md").alias("name"), F.col("text").alias("content"))
    blocks = parse_files(files).filter("error is null")
    return chunking.chunk_documents(blocks, ChunkPolicy()).select("id", "chunk_level", "chunk_index", "parent_index", "content", "block_type", "token_count")
