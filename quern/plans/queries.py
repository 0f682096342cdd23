"""The registered queries of the knowledge base, each with SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.config import RetrievalConfig
from quern.functions import scalar as S
from quern.operators import access as A
from quern.operators import analytics as N
from quern.operators import retrieval as R
from quern.operators.filters import upload_error
from quern.operators.percentiles import exact_percentiles
from quern.operators.search import passage_matches
from quern.operators.vector_index import build_index, search_index
from quern.plans.entities import CHANNEL, TEXT_SCORE, Tables, with_tables
from quern.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
EMPLOYEE = A.Principal("t0", "u7", ("src1", "src2"), ("editor",))
CONFIG = RetrievalConfig()


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL."""

    def add(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            ORACLE_SQL[function.__name__] = with_tables(sql)
        return function

    return add


# --- filters and joins -------------------------------------------------------------------------------------------------


@query("SELECT id, space_id, department_id FROM kb_documents WHERE tenant_id = 't0' AND status = 'READY' AND deleted_at IS NULL")
def fil1_live_documents(t: Tables) -> DataFrame:
    return A.live_documents(t.documents(), "t0").select("id", "space_id", "department_id")


@query("SELECT document_id, subject_type, subject_id FROM kb_rules WHERE subject_type = 'ALL_AUTHENTICATED' OR (subject_type = 'DEPARTMENT' AND subject_id IN ('src1', 'src2')) OR (subject_type = 'ROLE' AND subject_id = 'editor') OR (subject_type = 'USER' AND subject_id = 'u7')")
def fil2_matching_rules(t: Tables) -> DataFrame:
    return t.rules().filter(A.rule_matches(EMPLOYEE))


@query("SELECT id FROM kb_visible WHERE space_id = 'en' AND department_id = 'src2'")
def fil3_scoped_documents(t: Tables) -> DataFrame:
    return A.visible_documents(t.documents(), t.rules(), EMPLOYEE, A.Scope("en", "src2")).select("id")


@query("SELECT pair_id, document_id, chunk_id FROM kb_pairs WHERE status = 'ACTIVE' AND (chunk_id IS NULL OR chunk_id IN (SELECT chunk_id FROM kb_live))")
def fil5_live_pairs(t: Tables) -> DataFrame:
    return A.live_pairs(t.pairs(), t.chunks()).select("pair_id", "document_id", "chunk_id")


@query("SELECT chunk_id, document_id, chunk_index FROM kb_live")
def fil6_live_chunks(t: Tables) -> DataFrame:
    return A.live_chunks(t.chunks()).select("chunk_id", "document_id", "chunk_index")


@query("SELECT id, file_name, status FROM kb_documents WHERE deleted_at IS NULL AND (title ILIKE '%SRC1%' OR file_name ILIKE '%SRC1%') AND file_type = 'CSV' AND status = 'READY' AND updated_at >= TIMESTAMP '2024-01-10' AND updated_at <= TIMESTAMP '2024-02-20'")
def fil8_document_list(t: Tables) -> DataFrame:
    listed = A.document_filter(t.documents(), "SRC1", "csv", "ready", "2024-01-10", "2024-02-20")
    return listed.select("id", "file_name", "status")


@query("SELECT count(*) AS calls FROM kb_calls WHERE path LIKE '/v1/%' AND tenant_id = 't0'")
def fil13_external_calls(t: Tables) -> DataFrame:
    return t.calls().filter(F.startswith("path", F.lit("/v1/")) & (F.col("tenant_id") == "t0")).agg(F.count("*").alias("calls"))


@query("SELECT c_custkey, c_name FROM customer WHERE (c_name ILIKE '%0001%' OR c_mktsegment ILIKE '%BUILD%') AND c_nationkey = 3")
def fil14_user_search(t: Tables) -> DataFrame:
    either = F.col("c_name").ilike("%0001%") | F.col("c_mktsegment").ilike("%BUILD%")
    return t.raw("customer").filter(either & (F.col("c_nationkey") == 3)).select("c_custkey", "c_name")


@query("""SELECT query_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' | ') AS match_query FROM
    (SELECT query_id, regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+') AS w FROM kb_queries)""")
def fil15_match_query(t: Tables) -> DataFrame:
    return t.raw("benchmark").select(F.col("item_id").alias("query_id"), S.match_query(F.col("text")).alias("match_query"))


@query("SELECT id FROM kb_documents WHERE list_has_any(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ['thing', 'the'])")
def fil16_text_match(t: Tables) -> DataFrame:
    asked = F.array(F.lit("thing"), F.lit("the"))
    return t.documents().filter(F.arrays_overlap(S.tokens(F.col("text")), asked)).select("id")


@query("SELECT a.id FROM kb_documents a JOIN (SELECT tenant_id, checksum FROM kb_documents WHERE deleted_at IS NULL GROUP BY 1, 2 HAVING count(*) > 1) b USING (tenant_id, checksum) WHERE a.deleted_at IS NULL")
def fil21_duplicate_uploads(t: Tables) -> DataFrame:
    return A.duplicate_uploads(t.documents()).select("id")


@query("SELECT id, CASE WHEN file_type NOT IN ('MARKDOWN', 'CSV') THEN 'UNSUPPORTED_TYPE' WHEN n_chars > 3000 THEN 'TOO_LARGE' END AS error FROM kb_documents")
def fil22_upload_limits(t: Tables) -> DataFrame:
    return t.documents().select("id", upload_error(F.col("file_type"), F.col("n_chars"), ("MARKDOWN", "CSV"), 3000).alias("error"))


@query("SELECT id, title FROM kb_visible")
def joi2_visible_documents(t: Tables) -> DataFrame:
    return A.visible_documents(t.documents(), t.rules(), EMPLOYEE).select("id", "title")


@query("SELECT p.pair_id, d.title FROM kb_pairs p JOIN kb_visible d ON d.id = p.document_id WHERE p.status = 'ACTIVE'")
def joi1_visible_pairs(t: Tables) -> DataFrame:
    visible = A.visible_documents(t.documents(), t.rules(), EMPLOYEE).select("id", "title")
    return t.pairs().filter("status = 'ACTIVE'").join(visible, F.col("document_id") == F.col("id")).select("pair_id", "title")


@query("SELECT p.pair_id, c.chunk_id, c.parent_chunk_id FROM kb_pairs p JOIN kb_live c ON c.chunk_id = p.chunk_id AND c.document_id = p.document_id")
def joi5_provenance(t: Tables) -> DataFrame:
    live = A.live_chunks(t.chunks()).select("chunk_id", "document_id", "parent_chunk_id")
    return t.pairs().select("pair_id", "chunk_id", "document_id").join(live, ["chunk_id", "document_id"]).select("pair_id", "chunk_id", "parent_chunk_id")


@query("SELECT h.chunk_id, n.chunk_id AS neighbor_id FROM kb_live h JOIN kb_live n ON n.document_id = h.document_id AND n.parent_chunk_id = h.parent_chunk_id AND n.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 AND n.chunk_index <> h.chunk_index")
def joi6_neighbors(t: Tables) -> DataFrame:
    live = A.live_chunks(t.chunks())
    hits = live.select("chunk_id", "document_id", "parent_chunk_id", "chunk_index")
    return R.neighbors(hits, live).select("chunk_id", "neighbor_id")


@query("SELECT chunk_id AS member, arg_min(chunk_id, chunk_index) OVER w AS first, count(*) OVER w AS members FROM kb_live WHERE content <> '' WINDOW w AS (PARTITION BY document_id, content)")
def joi9_equal_content(t: Tables) -> DataFrame:
    live = A.live_chunks(t.chunks()).filter("content <> ''").select("document_id", "chunk_index", "chunk_id", F.sha2("content", 256).alias("h"))
    groups = live.groupBy("document_id", "h").agg(F.min_by("chunk_id", "chunk_index").alias("first"), F.count("*").alias("members"))
    return live.join(groups, ["document_id", "h"]).select(F.col("chunk_id").alias("member"), "first", "members")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey ORDER BY c_custkey LIMIT 50 OFFSET 20")
def joi10_user_department(t: Tables) -> DataFrame:
    joined = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return N.page(joined.select("c_custkey", "n_name"), ["c_custkey"], 20, 50)


@query("SELECT n_name, coalesce(k, 0) AS users, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS permissions FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) u ON c_nationkey = n_nationkey")
def joi12_role_counts(t: Tables) -> DataFrame:
    nation = t.raw("nation")
    users = t.raw("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("users"))
    permissions = t.raw("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("permissions"))
    both = N.with_zero_stats(nation, users, "n_nationkey").select("n_nationkey", "n_name", "users")
    return N.with_zero_stats(both, permissions, "n_nationkey").select("n_name", "users", "permissions")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def joi15_unused(t: Tables) -> DataFrame:
    used = t.raw("orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.raw("customer").select("c_custkey").join(used, "c_custkey", "left_anti")


@query("SELECT s.id AS space_id, coalesce(total, 0) AS total, coalesce(ready, 0) AS ready FROM (SELECT unnest(['en', 'de', 'fr', 'es', 'xx']) AS id) s LEFT JOIN (SELECT space_id, count(*) AS total, count(*) FILTER (status = 'READY') AS ready FROM kb_documents WHERE deleted_at IS NULL GROUP BY 1) d ON d.space_id = s.id")
def joi18_space_stats(t: Tables) -> DataFrame:
    spaces = t.spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "xx")], "space_id string")
    stats = N.document_stats(t.documents(), "space_id").select("space_id", "total", "ready")
    return N.with_zero_stats(spaces, stats, "space_id")


@query("""SELECT o_orderkey AS run_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def joi19_cited_runs(t: Tables) -> DataFrame:
    cited = t.raw("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("run_id"))
    return t.raw("orders").select(F.col("o_orderkey").alias("run_id")).join(cited, "run_id", "left_semi")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def joi21_passage_matches(t: Tables) -> DataFrame:
    passages = t.raw("benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return passage_matches(t.raw("documents").select(F.col("doc_id").alias("id"), "text"), passages).select(F.col("passage_id").alias("item_id"), F.col("id").alias("doc_id"))


@query("""WITH RECURSIVE up AS (SELECT r_regionkey + 1000 AS id, CAST(NULL AS BIGINT) AS parent, r_name AS path, 1 AS depth FROM region
    UNION ALL SELECT n.id, n.parent, up.path || ' / ' || n.name, up.depth + 1 FROM
    (SELECT n_nationkey AS id, CAST(n_regionkey + 1000 AS BIGINT) AS parent, n_name AS name FROM nation) n JOIN up ON n.parent = up.id)
    SELECT CAST(id AS BIGINT) AS id, path, CAST(depth AS BIGINT) AS depth FROM up""")
def joi24_tree_paths(t: Tables) -> DataFrame:
    t.raw("region").selectExpr("CAST(r_regionkey + 1000 AS BIGINT) AS id", "CAST(NULL AS BIGINT) AS parent", "r_name AS name").unionByName(
        t.raw("nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "CAST(n_regionkey + 1000 AS BIGINT) AS parent", "n_name AS name")
    ).createOrReplaceTempView("quern_tree")
    return t.spark.sql(
        """WITH RECURSIVE up(id, path, depth) AS (SELECT id, name, 1L FROM quern_tree WHERE parent IS NULL
        UNION ALL SELECT c.id, concat(up.path, ' / ', c.name), up.depth + 1 FROM quern_tree c JOIN up ON c.parent = up.id)
        SELECT id, path, depth FROM up"""
    )


@query("SELECT p.pair_id, len(regexp_extract_all(lower(d.title || ' ' || coalesce(c.content, '') || ' ' || p.question || ' ' || p.answer), '[\\p{L}\\p{N}]+')) AS n FROM kb_pairs p JOIN kb_documents d ON d.id = p.document_id LEFT JOIN kb_chunks c ON c.chunk_id = p.chunk_id")
def joi25_search_text_backfill(t: Tables) -> DataFrame:
    named = t.pairs().join(t.documents().select(F.col("id").alias("document_id"), "title"), "document_id")
    joined = named.join(t.chunks().select("chunk_id", "content"), "chunk_id", "left")
    text = S.search_text(F.col("title"), F.coalesce("content", F.lit("")), F.col("question"), F.col("answer"))
    return joined.select("pair_id", F.size(F.split(text, " ")).cast("long").alias("n"))


# --- aggregates --------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS documents FROM kb_documents WHERE tenant_id = 't0' AND deleted_at IS NULL")
def agg1_document_count(t: Tables) -> DataFrame:
    return t.documents().filter("tenant_id = 't0' AND deleted_at IS NULL").agg(F.count("*").alias("documents"))


@query("SELECT status, count(*) AS n FROM kb_jobs GROUP BY status")
def agg2_status_counts(t: Tables) -> DataFrame:
    return N.status_counts(t.jobs())


@query("""SELECT stage, count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failure, count(*) AS total,
    round(count(*) FILTER (status = 'SUCCESS') * 100.0 / count(*), 2) AS success_rate FROM kb_jobs GROUP BY stage""")
def agg3_stage_outcomes(t: Tables) -> DataFrame:
    return N.stage_outcomes(t.jobs())


@query("""SELECT space_id, category_id, count(*) AS total, count(*) FILTER (status = 'PARSING') AS processing, count(*) FILTER (status = 'READY') AS ready,
    count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (category_id IS NULL) AS unclassified FROM kb_documents WHERE deleted_at IS NULL GROUP BY ALL""")
def agg5_category_stats(t: Tables) -> DataFrame:
    return N.document_stats(t.documents(), "space_id", "category_id")


@query("SELECT count(*) AS documents, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks FROM kb_visible")
def agg6_visible_summary(t: Tables) -> DataFrame:
    return A.visible_documents(t.documents(), t.rules(), EMPLOYEE).agg(F.count("*").alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


@query("SELECT n_regionkey, count(*) AS nations FROM nation GROUP BY n_regionkey")
def agg7_guard_counts(t: Tables) -> DataFrame:
    return t.raw("nation").groupBy("n_regionkey").agg(F.count("*").alias("nations"))


@query("SELECT c_nationkey, count(*) AS users FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey")
def agg8_users_per_department(t: Tables) -> DataFrame:
    return t.raw("customer").filter("c_nationkey IS NOT NULL").groupBy("c_nationkey").agg(F.count("*").alias("users"))


@query("""SELECT count(*) AS query_count, round(count(c) * 100.0 / count(*), 2) AS citation_coverage,
    round(count(*) FILTER (status IN ('REFUSED', 'NO_ANSWER')) * 100.0 / count(*), 2) AS refusal_rate,
    round(count(*) FILTER (status IN ('COMPLETED', 'SUCCESS')) * 100.0 / count(*), 2) AS hit_rate,
    CAST(floor(avg(nullif(latency_ms, 0))) AS BIGINT) AS first_token_latency_ms
    FROM kb_calls LEFT JOIN (SELECT DISTINCT l_orderkey AS id, 1 AS c FROM lineitem) USING (id)""")
def agg9_query_kpis(t: Tables) -> DataFrame:
    runs = t.calls().withColumn("has_answer", F.lit(None).cast("boolean")).withColumn("first_token_ms", F.lit(None).cast("long"))
    return N.query_kpis(runs, t.raw("lineitem").select(F.col("l_orderkey").alias("run_id")))


@query("SELECT round(count(*) FILTER (status = 'SUCCESS') * 100.0 / count(*), 2) AS success_rate, round(count(*) FILTER (status = 'FAILED') * 100.0 / count(*), 2) AS failure_rate FROM kb_jobs")
def agg10_task_rates(t: Tables) -> DataFrame:
    total = F.count("*")
    good, bad = F.count_if(F.col("status") == "SUCCESS"), F.count_if(F.col("status") == "FAILED")
    return t.jobs().agg(S.percent(good, total).alias("success_rate"), S.percent(bad, total).alias("failure_rate"))


_PERCENTILES = "SELECT event_type, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.5), 6) AS p50 FROM kb_calls GROUP BY event_type"


@query(_PERCENTILES)
def agg12_exact_percentiles(t: Tables) -> DataFrame:
    """The same by refined histograms: no task holds a group."""
    found = exact_percentiles(t.calls(), ["event_type"], "latency_ms", {"p95": 0.95, "p50": 0.5})
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in ("p95", "p50")))


@query(_PERCENTILES)
def agg12_percentiles(t: Tables) -> DataFrame:
    p = lambda share, name: F.round(S.linear_percentile(F.col("latency_ms"), share), 6).alias(name)
    return t.calls().groupBy("event_type").agg(p(0.95, "p95"), p(0.5, "p50"))


@query("SELECT event_type, l[CAST(round_even((len(l) - 1) * 0.95, 0) AS INT) + 1] AS p95 FROM (SELECT event_type, list(latency_ms ORDER BY latency_ms) AS l FROM kb_calls GROUP BY event_type)")
def agg13_nearest_rank(t: Tables) -> DataFrame:
    return N.nearest_rank(t.calls(), "event_type", "latency_ms", 0.95).withColumnRenamed("latency_ms", "p95")


_RANKED = """kb_ranked AS (SELECT query_id, doc_id AS document_id, text AS content, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
    FROM (SELECT query_id, doc_id, d.text, round(len(list_intersect(q.cs, d.cs)) / len(q.cs), 6) + CASE WHEN contains(d.text, q.query) THEN 1 ELSE 0 END AS score
    FROM (SELECT item_id AS query_id, text AS query, list_distinct(string_split(regexp_replace(lower(text), '\\s', '', 'g'), '')) AS cs FROM benchmark) q,
         (SELECT doc_id, text, list_distinct(string_split(regexp_replace(lower(text), '\\s', '', 'g'), '')) AS cs FROM documents) d))"""


def _ranked(t: Tables, matches: DataFrame) -> DataFrame:
    """Ten documents for each question by share of characters; those that hold the question's text come first.

    A text that holds another has all its characters, so its share is 1. Only the rows that are left fetch their texts.
    """
    docs = t.raw("documents").select(F.col("doc_id").alias("document_id"), "text")
    items = docs.select("document_id", F.col("document_id").alias("item_id"), F.col("document_id").alias("item_index"), F.col("text").alias("search_text"))
    found = R.text_channel(items, _text_queries(t), 10).select("query_id", "document_id", "score")
    held = matches.select("query_id", "document_id", F.lit(2.0).alias("score"))
    best = found.unionByName(held).groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")
    top = best.withColumn("rank", F.row_number().over(order)).filter("rank <= 10")
    return top.join(docs.withColumnRenamed("text", "content"), "document_id").select("query_id", "document_id", "content", "rank")


def _expected(t: Tables) -> DataFrame:
    matches = joi21_passage_matches(t).join(t.raw("benchmark"), "item_id")
    return matches.selectExpr("item_id AS query_id", "doc_id AS document_id", "text AS anchor", "item_id % 10 <> 0 AS visible")


@query(f"""WITH {_RANKED}, e AS (SELECT item_id AS query_id, doc_id AS document_id, b.text AS anchor, item_id % 10 <> 0 AS visible FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    r AS (SELECT * FROM kb_ranked WHERE rank <= 10),
    f AS (SELECT r.query_id, min(rank) AS first FROM r JOIN e ON r.query_id = e.query_id AND r.document_id = e.document_id WHERE contains(content, anchor) GROUP BY 1),
    h AS (SELECT query_id, count(*) AS held, count(*) - count(DISTINCT document_id || ':' || content) AS repeats FROM r GROUP BY 1),
    k AS (SELECT DISTINCT r.query_id, 1 AS leak FROM r JOIN e ON r.query_id = e.query_id AND r.document_id = e.document_id),
    s AS (SELECT query_id, bool_and(visible) AS visible FROM e GROUP BY 1),
    a AS (SELECT * FROM s LEFT JOIN f USING (query_id) LEFT JOIN h USING (query_id) LEFT JOIN k USING (query_id))
    SELECT round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END) FILTER (visible), 6) AS recall_at_5, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END) FILTER (visible), 6) AS recall_at_10,
    round(avg(coalesce(1.0 / first, 0.0)) FILTER (visible), 6) AS mrr_at_10, round(avg(coalesce(1.0 / log2(first + 1), 0.0)) FILTER (visible), 6) AS ndcg_at_10,
    round(avg(CASE WHEN held IS NULL THEN 1.0 ELSE 0.0 END) FILTER (visible), 6) AS empty_rate, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0.0 END) FILTER (visible), 6) AS citation_accuracy,
    round(coalesce(sum(repeats) / sum(held), 0.0), 6) AS duplicate_rate, round(coalesce(avg(coalesce(leak, 0)) FILTER (NOT visible), 0.0), 6) AS permission_leak_rate,
    count(*) FILTER (visible) AS evaluated FROM a""")
def agg14_retrieval_quality(t: Tables) -> DataFrame:
    expected = materialize(_expected(t), "expected")
    return N.retrieval_quality(materialize(_ranked(t, expected), "ranked"), expected)


@query("""SELECT count(*) AS chunks, count(*) FILTER (n < 20) AS tiny, count(*) FILTER (n > 60) AS oversized_prose, CAST(min(n) AS BIGINT) AS min_tokens, CAST(max(n) AS BIGINT) AS max_tokens,
    round(avg(n), 6) AS mean_tokens, round(quantile_cont(n, 0.5), 6) AS p50_tokens, round(quantile_cont(n, 0.95), 6) AS p95_tokens,
    round(avg(CASE WHEN chunk_id IN (SELECT chunk_id FROM kb_pairs WHERE chunk_id IS NOT NULL) THEN 1.0 ELSE 0.0 END), 6) AS coverage
    FROM (SELECT chunk_id, len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS n FROM kb_live)""")
def agg16_chunk_health(t: Tables) -> DataFrame:
    covered = t.pairs().filter("chunk_id IS NOT NULL").select("chunk_id", F.lit(True).alias("covered")).distinct()
    chunks = A.live_chunks(t.chunks()).join(covered, "chunk_id", "left")
    counted = chunks.select(S.token_count(F.col("content")).alias("token_count"), F.lit("TEXT").alias("block_type"), F.coalesce("covered", F.lit(False)).alias("covered"))
    return N.chunk_health(counted, 20, 60)


@query("""SELECT *, ratio <= 2.0 AS passed FROM (SELECT *, round(candidate_p95 / baseline_p95, 6) AS ratio FROM
    (SELECT round(quantile_cont(latency_ms, 0.95) FILTER (event_type = 'view'), 6) AS baseline_p95, round(quantile_cont(latency_ms, 0.95) FILTER (event_type = 'click'), 6) AS candidate_p95 FROM kb_calls))""")
def agg19_latency_gate(t: Tables) -> DataFrame:
    calls = t.calls()
    return N.latency_gates(calls.filter("event_type = 'view'"), calls.filter("event_type = 'click'"), 2.0)


@query("SELECT count(*) * (1536 * 4 + 64) AS bytes FROM kb_live")
def agg20_index_size(t: Tables) -> DataFrame:
    return N.index_size(A.live_chunks(t.chunks()))


@query("""SELECT event_type, le, n FROM (SELECT event_type, unnest(['50', '100', '500', '+Inf']) AS le, unnest([count(*) FILTER (latency_ms <= 50), count(*) FILTER (latency_ms <= 100),
    count(*) FILTER (latency_ms <= 500), count(latency_ms)]) AS n FROM kb_calls GROUP BY event_type)""")
def agg22_latency_histogram(t: Tables) -> DataFrame:
    return N.histogram(t.calls(), "latency_ms", [50, 100, 500], "event_type")


@query("SELECT path, status_code, count(*) AS n, max_by(latency_ms, id) AS last_latency FROM kb_calls GROUP BY ALL")
def agg23_counters_and_gauges(t: Tables) -> DataFrame:
    return t.calls().groupBy("path", "status_code").agg(F.count("*").alias("n"), F.max_by("latency_ms", "id").alias("last_latency"))


@query("SELECT tenant_id, sha256(tenant_id || ':' || question) AS question_hash, count(*) AS n, max(turn) AS last_asked FROM (SELECT 't' || (conv_id % 2) AS tenant_id, text AS question, turn FROM conversations WHERE role = 'user') GROUP BY 1, 2")
def agg24_missed_questions(t: Tables) -> DataFrame:
    asked = t.raw("conversations").filter("role = 'user'").selectExpr("concat('t', conv_id % 2) AS tenant_id", "text AS question", "turn AS asked_at")
    return N.missed_questions(asked)


@query("SELECT document_id, count(*) AS chunks FROM kb_live GROUP BY document_id")
def agg27_chunks_per_document(t: Tables) -> DataFrame:
    return A.live_chunks(t.chunks()).groupBy("document_id").agg(F.count("*").alias("chunks"))


@query("SELECT space_id, list_sort(list(DISTINCT trim(category_id)) FILTER (trim(category_id) <> '')) AS categories FROM kb_documents GROUP BY space_id")
def agg29_distinct_sorted(t: Tables) -> DataFrame:
    name = F.trim("category_id")
    return t.documents().groupBy("space_id").agg(F.array_sort(F.collect_set(F.when(name != "", name))).alias("categories"))


@query("SELECT DISTINCT strftime(created_at, '%Y-%m-%d') AS day FROM kb_calls")
def agg30_days(t: Tables) -> DataFrame:
    return t.calls().select(F.date_format("created_at", "yyyy-MM-dd").alias("day")).distinct()


# --- windows, sorts, sets ----------------------------------------------------------------------------------------------


@query("SELECT document_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS r FROM kb_jobs) WHERE r = 1")
def win5_latest_job(t: Tables) -> DataFrame:
    return N.latest_per(t.jobs(), "document_id", "created_at", "id").select("document_id", "id", "status")


_VECTOR_TOP_K = """SELECT query_id, document_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, item_index, item_id) AS rank FROM
    (SELECT query_id, document_id, item_id, item_index, round(list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM kb_asked, kb_vectors)) WHERE rank <= 20"""


@query(_VECTOR_TOP_K)
def srt1_vector_top_k(t: Tables) -> DataFrame:
    return R.vector_channel(_items(t), _asked(t), 20).select("query_id", "document_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@query(_VECTOR_TOP_K)
def srt1_indexed(t: Tables) -> DataFrame:
    """The same rows through the inverted-file index, which is built first."""
    found = search_index(build_index(_items(t)), _asked(t), 20)
    return found.select("query_id", "document_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


def _items(t: Tables) -> DataFrame:
    return t.raw("embeddings").selectExpr("CAST(label AS BIGINT) AS document_id", "vec_id AS item_id", "vec_id AS item_index", "embedding")


def _asked(t: Tables) -> DataFrame:
    return t.raw("embeddings").filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")


def _text_queries(t: Tables) -> DataFrame:
    return t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"SELECT query_id, document_id, item_id, score, rank FROM ({CHANNEL.format(name='x', score=TEXT_SCORE, items='kb_qa_items', id='pair_id', index='pair_index', k=20)})")
def srt4_text_top_k(t: Tables) -> DataFrame:
    found = R.text_channel(t.scoped_pairs(EMPLOYEE), _text_queries(t), 20)
    return found.select("query_id", "document_id", "item_id", "score", F.col("rank").cast("long").alias("rank"))


@query("SELECT id, title FROM kb_documents ORDER BY updated_at DESC, id DESC LIMIT 20 OFFSET 40")
def srt10_page(t: Tables) -> DataFrame:
    return N.page(t.documents().select("id", "title", "updated_at"), [F.desc("updated_at"), F.desc("id")], 40, 20).select("id", "title")


@query("SELECT id, title FROM kb_documents WHERE id > 500 ORDER BY id LIMIT 25")
def srt11_key_page(t: Tables) -> DataFrame:
    return N.key_page(t.documents().select("id", "title"), "id", 500, 25)


@query("SELECT id, created_at FROM kb_jobs ORDER BY created_at DESC, id DESC LIMIT 8")
def srt12_recent(t: Tables) -> DataFrame:
    return t.jobs().orderBy(F.desc("created_at"), F.desc("id")).limit(8).select("id", "created_at")


@query("SELECT v AS path, row_number() OVER (ORDER BY list_transform(string_split(v, '.'), lambda x: CAST(x AS INT))) AS place FROM (SELECT DISTINCT (n_regionkey || '.' || n_nationkey) AS v FROM nation)")
def srt14_path_order(t: Tables) -> DataFrame:
    paths = t.raw("nation").select(F.concat_ws(".", "n_regionkey", "n_nationkey").alias("path")).distinct()
    key = F.transform(F.split("path", "[.]"), lambda x: x.cast("int"))
    return paths.withColumn("place", F.row_number().over(Window.orderBy(key)).cast("long"))  # a small dimension


@query("""SELECT kind, id, created_at FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, o, id DESC) AS r FROM
    (SELECT * FROM (SELECT 'IMPORT_JOB_FAILED' AS kind, id, CAST(created_at AS TIMESTAMP) AS created_at, 0 AS o FROM kb_jobs WHERE status = 'FAILED' ORDER BY created_at DESC, id DESC LIMIT 8)
     UNION ALL SELECT * FROM (SELECT 'MODEL_CALL_FAILED', id, created_at, 1 FROM kb_calls WHERE status = 'FAILED' ORDER BY created_at DESC, id DESC LIMIT 8)
     UNION ALL SELECT * FROM (SELECT 'AUDIT', id, created_at, 2 FROM kb_calls ORDER BY created_at DESC, id DESC LIMIT 8))) WHERE r <= 8""")
def set1_risk_events(t: Tables) -> DataFrame:
    pick = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))
    calls = t.calls()
    sources = [pick(t.jobs().filter("status = 'FAILED'"), "IMPORT_JOB_FAILED"), pick(calls.filter("status = 'FAILED'"), "MODEL_CALL_FAILED"), pick(calls, "AUDIT")]
    return N.merged_top(sources, "created_at", "id", 8).drop("source_order")


@query("""SELECT source, 'seen' AS part FROM (SELECT source FROM documents INTERSECT SELECT department_id FROM kb_visible)
    UNION ALL SELECT source, 'unseen' FROM (SELECT source FROM documents EXCEPT SELECT department_id FROM kb_visible)""")
def set4_intersect_and_difference(t: Tables) -> DataFrame:
    sources = t.raw("documents").select("source").distinct()
    seen = A.visible_documents(t.documents(), t.rules(), EMPLOYEE).select(F.col("department_id").alias("source"))
    both = sources.intersect(seen).withColumn("part", F.lit("seen"))
    return both.unionByName(sources.subtract(seen).withColumn("part", F.lit("unseen")))


# --- scalar functions --------------------------------------------------------------------------------------------------


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fun1_cosine(t: Tables) -> DataFrame:
    e = t.raw("embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    other = t.raw("embeddings").select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.join(other, "a").select("a", "b", F.round(S.cosine(F.col("x"), F.col("y")), 6).alias("score"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n FROM documents")
def fun12_token_count(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", S.token_count(F.col("text")).cast("long").alias("n"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def fun14_content_hash(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query(f"SELECT doc_id, trim(regexp_replace(text, '{S.WHITE}+', ' ', 'g')) AS flat FROM documents")
def fun18_collapse(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", S.collapsed(F.col("text")).alias("flat"))


@query("SELECT event_id, event_id % 12 AS attempt, least(600.0, 5.0 * pow(2.0, event_id % 12)) AS delay FROM events WHERE event_type = 'error'")
def fun28_retry_delay(t: Tables) -> DataFrame:
    attempt = F.col("event_id") % 12
    return t.raw("events").filter("event_type = 'error'").select("event_id", attempt.alias("attempt"), S.retry_delay(attempt).alias("delay"))


@query("SELECT id, CASE regexp_extract(file_name, '\\.([^./]+)$', 1) WHEN 'md' THEN 'MARKDOWN' WHEN 'csv' THEN 'CSV' WHEN 'pdf' THEN 'PDF' END AS kind FROM kb_documents")
def fun26_file_type(t: Tables) -> DataFrame:
    return t.documents().select("id", S.file_type(F.col("file_name")).alias("kind"))


@query("SELECT id, array_to_string(list_filter([space_id, department_id, coalesce(category_id, '')], lambda x: x <> ''), ' / ') AS path FROM kb_documents")
def fun29_title_path(t: Tables) -> DataFrame:
    return t.documents().select("id", S.title_path(F.col("space_id"), F.col("department_id"), F.coalesce("category_id", F.lit(""))).alias("path"))


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 + (length(lower(text)) - length(replace(lower(text), 'ing', ''))) // 3 AS BIGINT) AS hits FROM documents")
def fun31_substring_score(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", S.substring_score(F.col("text"), ["the", "ing"]).alias("hits"))


@query("SELECT item_id, list_transform(range(0, 8), lambda i: round(CAST('0x' || sha256(text)[i * 2 + 1 : i * 2 + 2] AS INT) / 255.0, 6)) AS vector FROM benchmark")
def fun34_mock_embedding(t: Tables) -> DataFrame:
    return t.raw("benchmark").select("item_id", S.mock_embedding(F.col("text"), 8).alias("vector"))


@query("SELECT day, count(*) AS n FROM (SELECT strftime(created_at, '%Y-%m-%d') AS day FROM kb_calls WHERE created_at < TIMESTAMP '2024-01-15') GROUP BY day")
def src20_archive_days(t: Tables) -> DataFrame:
    return N.archive_days(t.calls(), "created_at", "2024-01-15").groupBy(F.col("dt").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT path || '{' || 'code=\"' || status_code || '\"} ' || count(*) AS line FROM kb_calls GROUP BY path, status_code")
def src23_exposition(t: Tables) -> DataFrame:
    counted = t.calls().groupBy("path", "status_code").agg(F.count("*").alias("value"))
    return N.exposition(counted.select(F.col("path").alias("name"), F.create_map(F.lit("code"), F.col("status_code").cast("string")).alias("labels"), "value"))


@query(
    """WITH b AS (SELECT event_type, unnest([10, 100, 500]) AS le FROM (SELECT DISTINCT event_type FROM kb_calls))
    SELECT 'latency_bucket{event="a\\\\b\\"' || b.event_type || '\\n",le="' || CAST(le AS DOUBLE) || '"} ' || (SELECT count(*) FROM kb_calls c WHERE c.event_type = b.event_type AND latency_ms <= le) AS line FROM b
    UNION ALL SELECT 'latency_bucket{event="a\\\\b\\"' || event_type || '\\n",le="+Inf"} ' || count(*) FROM kb_calls GROUP BY event_type
    UNION ALL SELECT 'latency_sum{event="a\\\\b\\"' || event_type || '\\n"} ' || sum(latency_ms) FROM kb_calls GROUP BY event_type
    UNION ALL SELECT 'latency_count{event="a\\\\b\\"' || event_type || '\\n"} ' || count(*) FROM kb_calls GROUP BY event_type"""
)
def src23_histogram(t: Tables) -> DataFrame:
    """Histogram lines whose label values need escapes."""
    event = F.concat(F.lit('a\\b"'), "event_type", F.lit("\n"))
    return N.histogram_exposition(t.calls().withColumn("event", event), "latency", "latency_ms", [10.0, 100.0, 500.0], "event")


@query("SELECT id, title, department_id FROM kb_documents WHERE id NOT IN (SELECT document_id FROM kb_rules)")
def src26_unreferenced(t: Tables) -> DataFrame:
    return t.documents().join(t.rules().select(F.col("document_id").alias("id")), "id", "left_anti").select("id", "title", "department_id")


# --- retrieval ---------------------------------------------------------------------------------------------------------

@query("SELECT conv_id, max_by(text, turn) AS question FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def ret13_last_question(t: Tables) -> DataFrame:
    return t.raw("conversations").filter("role = 'user' AND trim(text) <> ''").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"))
