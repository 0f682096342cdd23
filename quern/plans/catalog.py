"""More registered queries: projections, lookups, statistics, ordered operators and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators import access as A
from quern.operators import analytics as N
from quern.operators import filters, indexing
from quern.operators.spans import overlapping_spans
from quern.plans.entities import Tables
from quern.plans.queries import EMPLOYEE, query


@query("""SELECT l_orderkey AS run_id, list_sort(list(DISTINCT l_partkey)) AS documents FROM lineitem WHERE l_partkey IN (SELECT id FROM kb_visible) GROUP BY l_orderkey""")
def fil24_explained_items(t: Tables) -> DataFrame:
    runs = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.to_json(F.collect_set("l_partkey")).alias("snapshot"))
    items = runs.select("run_id", F.explode(F.from_json("snapshot", "array<bigint>")).alias("id"))
    seen = A.visible_documents(t.documents(), t.rules(), EMPLOYEE).select("id")
    return items.join(seen, "id", "left_semi").groupBy("run_id").agg(F.array_sort(F.collect_list("id")).alias("documents"))


@query("SELECT id, title || ' (' || file_type || ')' AS label, coalesce(category_id, 'none') AS category, strftime(updated_at, '%Y-%m-%d') AS updated FROM kb_documents")
def prj1_document_rows(t: Tables) -> DataFrame:
    label = F.concat("title", F.lit(" ("), "file_type", F.lit(")"))
    return t.documents().select("id", label.alias("label"), F.coalesce("category_id", F.lit("none")).alias("category"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("SELECT id, 'Document: ' || title || chr(10) || 'Section: ' || space_id || CASE WHEN category_id IS NOT NULL THEN chr(10) || 'Type: ' || category_id ELSE '' END AS input FROM kb_documents")
def prj6_embedding_text(t: Tables) -> DataFrame:
    text = indexing.embedding_text(F.col("title"), F.col("space_id"), F.col("category_id"), F.lit(None).cast("string"))
    return t.documents().select("id", text.alias("input"))


@query("SELECT c.chunk_id, p.chunk_id AS parent FROM kb_live c JOIN kb_visible d ON d.id = c.document_id JOIN kb_chunks p ON p.chunk_id = c.parent_chunk_id AND p.document_id = c.document_id AND p.chunk_level = 'PARENT'")
def joi7_scoped_parents(t: Tables) -> DataFrame:
    seen = A.visible_documents(t.documents(), t.rules(), EMPLOYEE).select(F.col("id").alias("document_id"))
    chunks = t.chunks()
    parents = chunks.filter("chunk_level = 'PARENT'").select("document_id", F.col("chunk_id").alias("parent"))
    scoped = A.live_chunks(chunks).join(seen, "document_id").select("document_id", "chunk_id", F.col("parent_chunk_id").alias("parent"))
    return scoped.join(parents, ["document_id", "parent"]).select("chunk_id", "parent")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey % 50 AS lo, l_suppkey % 50 + l_quantity AS hi FROM lineitem WHERE l_quantity > 0)
    SELECT a.l_linenumber AS a, b.l_linenumber AS b, a.l_orderkey AS query_id FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber
    WHERE greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / CAST(least(a.hi - a.lo, b.hi - b.lo) AS DOUBLE) >= 0.8""")
def joi8_span_overlaps(t: Tables) -> DataFrame:
    low = F.col("l_suppkey") % 50
    spans = t.raw("lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_orderkey", "l_linenumber").alias("id"), low.alias("start"), (low + F.col("l_quantity")).cast("long").alias("end"))
    pairs = overlapping_spans(spans, spans, 0.8).filter("left_id.l_linenumber < right_id.l_linenumber")
    return pairs.select(F.col("left_id.l_linenumber").alias("a"), F.col("right_id.l_linenumber").alias("b"), F.col("left_id.l_orderkey").alias("query_id"))


_LINES = "SELECT doc_id, pos, sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(content) - 1 AS a, sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS b FROM kb_lines"


@query(
    f"""WITH l AS ({_LINES}), w AS (SELECT doc_id, i AS part, i * 100 AS a, i * 100 + 150 AS b FROM (SELECT doc_id, unnest(range(CAST(ceil(length(text) / 100.0) AS BIGINT))) AS i FROM documents))
    SELECT l.doc_id, pos AS line, part AS window_no, round(CAST(least(l.b, w.b) - greatest(l.a, w.a) AS DOUBLE) / least(l.b - l.a, w.b - w.a), 6) AS overlap FROM l JOIN w ON l.doc_id = w.doc_id AND l.a < w.b AND w.a < l.b
    WHERE l.b > l.a AND CAST(least(l.b, w.b) - greatest(l.a, w.a) AS DOUBLE) / least(l.b - l.a, w.b - w.a) >= 0.5"""
)
def joi8_line_windows(t: Tables) -> DataFrame:
    """Lines and windows of 150 characters of each text that overlap by half of the shorter one."""
    docs = t.raw("documents").filter("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    end = F.sum(F.length("content") + 1).over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    own = lines.select(F.col("doc_id").alias("key"), F.struct("doc_id", "pos").alias("id"), (end - F.length("content")).alias("start"), end.alias("end"))
    part = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 100) - 1))
    windows = docs.filter("length(text) > 0").select("doc_id", part.alias("part")).select(F.col("doc_id").alias("key"), F.struct("doc_id", "part").alias("id"), (F.col("part") * 100).alias("start"), (F.col("part") * 100 + 150).alias("end"))
    pairs = overlapping_spans(own, windows, 0.5)
    return pairs.select("left_id.doc_id", F.col("left_id.pos").alias("line"), F.col("right_id.part").alias("window_no"), F.round("overlap", 6).alias("overlap"))


@query("SELECT c_custkey, list_sort(list(n_name)) AS roles FROM customer JOIN nation ON n_regionkey = c_nationkey % 5 GROUP BY c_custkey")
def joi11_user_roles(t: Tables) -> DataFrame:
    users = t.raw("customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("n_regionkey"))
    joined = users.join(t.raw("nation").select("n_regionkey", "n_name"), "n_regionkey")
    return joined.groupBy("c_custkey").agg(F.array_sort(F.collect_list("n_name")).alias("roles"))


@query("SELECT n_name AS role, s_name AS permission FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def joi14_role_permissions(t: Tables) -> DataFrame:
    joined = t.raw("nation").join(t.raw("supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("n_name").alias("role"), F.col("s_name").alias("permission"))


@query("SELECT p_partkey AS config_id, s_name AS provider FROM part JOIN supplier ON s_suppkey = p_partkey % 10 + 1 WHERE p_size > 10 AND s_acctbal > 0 ORDER BY p_partkey LIMIT 1")
def joi16_default_model(t: Tables) -> DataFrame:
    configs = t.raw("part").filter("p_size > 10").select("p_partkey", (F.col("p_partkey") % 10 + 1).alias("s_suppkey"))
    joined = configs.join(t.raw("supplier").filter("s_acctbal > 0"), "s_suppkey")
    return joined.orderBy("p_partkey").limit(1).select(F.col("p_partkey").alias("config_id"), F.col("s_name").alias("provider"))


@query("SELECT id, coalesce(n_name, 'unknown') AS name FROM kb_calls LEFT JOIN nation ON n_nationkey = user_id")
def joi17_name_lookup(t: Tables) -> DataFrame:
    names = t.raw("nation").select(F.col("n_nationkey").cast("long").alias("user_id"), "n_name")
    return t.calls().join(names, "user_id", "left").select("id", F.coalesce("n_name", F.lit("unknown")).alias("name"))


@query("SELECT p.pair_id, c.chunk_index, CASE WHEN c.content IS NULL THEN 'PAIR' ELSE 'CHUNK' END AS target FROM kb_pairs p LEFT JOIN kb_live c ON c.chunk_id = p.chunk_id")
def joi22_embedding_targets(t: Tables) -> DataFrame:
    live = A.live_chunks(t.chunks()).select("chunk_id", "chunk_index", F.lit("CHUNK").alias("target"))
    return t.pairs().join(live, "chunk_id", "left").select("pair_id", "chunk_index", F.coalesce("target", F.lit("PAIR")).alias("target"))


@query("SELECT p.pair_id, coalesce(c.chunk_index, -1) AS span_start, coalesce(c.content, '') AS content FROM kb_pairs p LEFT JOIN kb_live c ON c.chunk_id = p.chunk_id AND c.document_id = p.document_id")
def joi26_pair_spans(t: Tables) -> DataFrame:
    live = A.live_chunks(t.chunks()).select("chunk_id", "document_id", "chunk_index", "content")
    joined = t.pairs().join(live, ["chunk_id", "document_id"], "left")
    return joined.select("pair_id", F.coalesce("chunk_index", F.lit(-1)).alias("span_start"), F.coalesce("content", F.lit("")).alias("content"))


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'PARSING') AS processing, count(*) FILTER (status = 'READY') AS ready,
    count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (category_id IS NULL) AS unclassified FROM kb_documents WHERE deleted_at IS NULL""")
def agg4_document_stats(t: Tables) -> DataFrame:
    return N.document_stats(t.documents())


@query("""SELECT stage, count(*) AS observations, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95 FROM
    (SELECT l_returnflag AS stage, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')
    WHERE d >= 0 GROUP BY stage""")
def agg17_stage_latency(t: Tables) -> DataFrame:
    done = t.raw("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = F.datediff("l_shipdate", "o_orderdate").alias("d")
    rows = t.raw("lineitem").join(done, "l_orderkey").select(F.col("l_returnflag").alias("stage"), days).filter("d >= 0")
    p = lambda share: F.round(S.linear_percentile(F.col("d"), share), 6)
    return rows.groupBy("stage").agg(F.count("*").alias("observations"), p(0.5).alias("p50"), p(0.95).alias("p95"))


@query("SELECT document_id AS run_id, count(*) FILTER (status = 'SUCCESS') AS successful FROM kb_jobs GROUP BY document_id")
def agg26_successful_batches(t: Tables) -> DataFrame:
    return t.jobs().groupBy(F.col("document_id").alias("run_id")).agg(F.count_if(F.col("status") == "SUCCESS").alias("successful"))


@query("""SELECT chunk_id, list_sort(list(chunk_index) OVER (PARTITION BY document_id, parent_chunk_id ORDER BY chunk_index RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS around FROM kb_live WHERE parent_chunk_id IS NOT NULL""")
def win4_neighbor_frames(t: Tables) -> DataFrame:
    frame = Window.partitionBy("document_id", "parent_chunk_id").orderBy("chunk_index").rangeBetween(-1, 1)
    live = A.live_chunks(t.chunks()).filter("parent_chunk_id IS NOT NULL")
    return live.select("chunk_id", F.array_sort(F.collect_list("chunk_index").over(frame)).alias("around"))


@query("SELECT chunk_id, lag(content) OVER w AS before, lead(content) OVER w AS after FROM kb_live WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index)")
def win8_adjacent_context(t: Tables) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    return A.live_chunks(t.chunks()).select("chunk_id", F.lag("content").over(order).alias("before"), F.lead("content").over(order).alias("after"))


@query("SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY created_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS hits FROM kb_calls")
def win11_sliding_counts(t: Tables) -> DataFrame:
    seconds = F.unix_micros(F.col("created_at").cast("timestamp"))
    frame = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, 0)
    return t.calls().withColumn("us", seconds).select("id", F.count("*").over(frame).alias("hits"))


@query("SELECT n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey) AS place FROM nation")
def srt13_ordered_dimension(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name", "n_nationkey"))
    return t.raw("nation").select("n_nationkey", "n_name", place.cast("long").alias("place"))


@query("SELECT o_custkey AS run_id, list_slice(list_sort(list(o_orderkey)), 1, 10) AS snapshot FROM orders GROUP BY o_custkey")
def srt15_snapshot_cap(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    first = t.raw("orders").select(F.col("o_custkey").alias("run_id"), "o_orderkey", place.alias("place")).filter("place <= 10")
    return first.groupBy("run_id").agg(F.array_sort(F.collect_list("o_orderkey")).alias("snapshot"))


@query("SELECT channel, count(*) AS n FROM (SELECT 'pair' AS channel FROM kb_pairs UNION ALL SELECT 'chunk' FROM kb_live) GROUP BY channel")
def set2_channel_union(t: Tables) -> DataFrame:
    both = t.pairs().select(F.lit("pair").alias("channel")).unionByName(A.live_chunks(t.chunks()).select(F.lit("chunk").alias("channel")))
    return both.groupBy("channel").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT source, lang FROM documents")
def set3_distinct(t: Tables) -> DataFrame:
    return t.raw("documents").select("source", "lang").distinct()


@query("""SELECT document_id, list(content ORDER BY first) AS texts FROM (SELECT document_id, content, min(chunk_index) AS first FROM kb_live GROUP BY 1, 2) GROUP BY document_id""")
def set5_ordered_distinct(t: Tables) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    grouped = A.live_chunks(t.chunks()).groupBy("document_id").agg(ordered.alias("rows"))
    return grouped.select("document_id", F.array_distinct("rows.content").alias("texts"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 9 + 1 END, 1) AS first_page, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 9 + 2 END, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 9 + 1 END, 1) AS last_page FROM documents")
def fun22_page_range(t: Tables) -> DataFrame:
    start = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 9 + 1)
    end = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 9 + 2)
    pages = S.page_range(start, end, F.lit(None).cast("long"))
    return t.raw("documents").select("doc_id", pages.alias("p")).select("doc_id", F.col("p.start").cast("long").alias("first_page"), F.col("p.end").cast("long").alias("last_page"))


@query("SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS iso FROM kb_calls WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def fun27_since_days(t: Tables) -> DataFrame:
    since = F.lit("2024-01-31").cast("timestamp_ntz") - F.expr("INTERVAL 7 DAYS")
    return t.calls().filter(F.col("created_at") >= since).select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("SELECT pair_id, '[' || pair_index || '] Q: ' || question || chr(10) || 'A: ' || answer AS section FROM kb_pairs")
def fun30_evidence_sections(t: Tables) -> DataFrame:
    return t.pairs().select("pair_id", S.evidence_section(F.col("pair_index"), F.col("question"), F.col("answer")).alias("section"))


@query(f"SELECT doc_id, length(regexp_replace(lower(text), '{S.WHITE}+', '', 'g')) AS n FROM documents")
def fun3_normalized_length(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.length(S.normalized(F.col("text"))).cast("long").alias("n"))


@query("SELECT id, CASE WHEN id % 7 = 3 THEN id = (SELECT max(id) FROM kb_documents WHERE id % 7 = 3) ELSE false END AS is_default FROM kb_documents")
def upd3_default_flag(t: Tables) -> DataFrame:
    docs = t.documents().select("id")
    newest = docs.filter("id % 7 = 3").agg(F.max("id").alias("id"))
    return indexing.default_switch(docs, F.col("id") % 7 == 3, newest)


@query("SELECT chunk_id, n > 40 AS too_long FROM (SELECT chunk_id, len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS n FROM kb_live)")
def emb3_input_limit(t: Tables) -> DataFrame:
    return A.live_chunks(t.chunks()).select("chunk_id", filters.over_input_limit(F.col("content"), S.token_count, 40).alias("too_long"))


@query("SELECT doc_id AS document_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS blocks FROM documents")
def src25_block_per_chunk(t: Tables) -> DataFrame:
    return t.raw("documents").select(F.col("doc_id").alias("document_id"), F.size(F.split("text", "\n")).cast("long").alias("blocks"))
