"""The knowledge base's tables derived from the shared tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.scalar import WHITE, mock_embedding
from quern.operators.access import Principal, live_chunks, live_pairs, visible_documents
from quern.session import configure, ship


class Tables:
    """Loads and derives tables of one folder. Nothing is read before an action; unused columns are pruned."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship(configure(spark))

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self) -> DataFrame:
        joined = self.raw("documents").join(self.raw("labels"), "doc_id", "left")
        return joined.selectExpr(
            "doc_id AS id",
            "concat('t', doc_id % 2) AS tenant_id",
            "concat('Document ', doc_id) AS title",
            "concat(source, '/', doc_id, CASE WHEN doc_id % 3 = 0 THEN '.md' WHEN doc_id % 3 = 1 THEN '.csv' ELSE '.pdf' END) AS file_name",
            "CASE WHEN doc_id % 3 = 0 THEN 'MARKDOWN' WHEN doc_id % 3 = 1 THEN 'CSV' ELSE 'PDF' END AS file_type",
            "sha2(text, 256) AS checksum",
            "CASE WHEN quality = 1 THEN 'READY' WHEN quality = 0 THEN 'FAILED' WHEN doc_id % 5 < 3 THEN 'READY' ELSE 'PARSING' END AS status",
            "lang AS space_id",
            "source AS department_id",
            "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat(source, '-', lang) END AS category_id",
            "CASE WHEN doc_id % 41 = 0 THEN DATE'2024-03-01' END AS deleted_at",
            "CAST(date_add(DATE'2024-01-01', CAST(doc_id % 60 AS INT)) AS TIMESTAMP_NTZ) AS updated_at",
            "CAST(n_chars AS BIGINT) AS n_chars",
            "CAST(size(split(text, '\\n')) AS BIGINT) AS chunk_count",
            "text",
            "toxic",
        )

    def rules(self) -> DataFrame:
        """Access rules; a document's rules come from one scan of the documents."""
        rule = lambda where, kind, subject: F.when(F.expr(where), F.struct(F.lit(kind).alias("subject_type"), F.expr(subject).alias("subject_id")))
        rules = F.array(
            rule("id % 2 = 0 AND coalesce(toxic, 0) = 0", "ALL_AUTHENTICATED", "'*'"), rule("id % 3 = 1", "DEPARTMENT", "department_id"),
            rule("toxic = 1", "ROLE", "'auditor'"), rule("id % 11 = 0", "USER", "'u7'"),
        )
        each = self.documents().select(F.col("id").alias("document_id"), F.explode(rules).alias("r"))
        return each.filter("r is not null").select("document_id", "r.subject_type", "r.subject_id")

    def chunks(self) -> DataFrame:
        lines = self.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
        children = lines.selectExpr(
            "concat(doc_id, '-c', pos) AS chunk_id",
            "doc_id AS document_id",
            "CASE WHEN pos % 10 = 9 THEN NULL ELSE concat(doc_id, '-p', pos DIV 4) END AS parent_chunk_id",
            "pos AS chunk_index",
            "'CHILD' AS chunk_level",
            "CASE WHEN (doc_id + pos) % 13 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status",
            "content",
        )
        split = self.raw("documents").select("doc_id", F.split("text", "\n").alias("lines"))
        parts = split.select("doc_id", "lines", F.explode(F.expr("sequence(0, (size(lines) - 1) DIV 4)")).alias("part"))
        parents = parts.filter("lines is not null").selectExpr(
            "concat(doc_id, '-p', part) AS chunk_id",
            "doc_id AS document_id",
            "CAST(NULL AS STRING) AS parent_chunk_id",
            "CAST(part AS INT) AS chunk_index",
            "'PARENT' AS chunk_level",
            "CASE WHEN doc_id % 17 = 0 THEN 'STAGING' ELSE 'ACTIVE' END AS status",
            "array_join(slice(lines, CAST(part AS INT) * 4 + 1, 4), '\n') AS content",
        )
        return children.unionByName(parents)

    def pairs(self) -> DataFrame:
        order = Window.partitionBy("conv_id").orderBy("turn")
        turns = self.raw("conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(order).alias("next_role"), F.lead("text").over(order).alias("answer"))
        return turns.filter("role = 'user' AND next_role = 'assistant'").selectExpr(
            "concat(conv_id, '-', turn) AS pair_id",
            "conv_id % 200 AS document_id",
            "turn AS pair_index",
            "CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat(conv_id % 200, '-c0') END AS chunk_id",
            "CASE WHEN conv_id % 19 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status",
            "question",
            "answer",
        )

    def seen(self, principal: Principal) -> DataFrame:
        """document_id and title of the documents that the principal may see."""
        return visible_documents(self.documents(), self.rules(), principal).select(F.col("id").alias("document_id"), "title")

    def scoped_pairs(self, principal: Principal, seen: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
        """Live pairs of documents that the principal may see, as items of retrieval. seen and chunks (live ones of these
        documents) are taken where they are made already."""
        seen = self.seen(principal) if seen is None else seen
        pairs = self.pairs()
        if chunks is None:
            live = live_pairs(pairs, self.chunks())
        else:
            active = pairs.filter("status = 'ACTIVE'")
            live = active.join(chunks.select("chunk_id"), "chunk_id", "left_semi").unionByName(active.filter("chunk_id is null"), allowMissingColumns=True)
        return live.join(seen, "document_id", "left_semi").select(
            "document_id", F.col("pair_id").alias("item_id"), F.col("pair_index").alias("item_index"), "chunk_id", "question", "answer",
            F.concat_ws(" ", "question", "answer").alias("search_text"), mock_embedding(F.col("question"), 32).alias("embedding"),
        )

    def scoped_chunks(self, principal: Principal, seen: DataFrame | None = None) -> DataFrame:
        """Live child chunks of documents that the principal may see, as items of retrieval."""
        live = live_chunks(self.chunks()).join(self.seen(principal) if seen is None else seen, "document_id")
        text = F.col("content").alias("search_text")
        return live.select("document_id", "chunk_id", "chunk_index", "parent_chunk_id", F.array("title").alias("title_path"), "content", text, mock_embedding(F.col("content"), 32).alias("embedding"))

    def scoped_parents(self, principal: Principal, seen: DataFrame | None = None) -> DataFrame:
        """Active parents of documents that the principal may see."""
        seen = self.seen(principal) if seen is None else seen
        return self.chunks().filter("chunk_level = 'PARENT' and status = 'ACTIVE'").join(seen, "document_id", "left_semi")

    def questions(self) -> DataFrame:
        """The question table with its vectors."""
        asked = self.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
        return asked.withColumn("vector", mock_embedding(F.col("query"), 32))

    def calls(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS id",
            "ts AS created_at",
            "concat('t', user_id % 2) AS tenant_id",
            "user_id",
            "CASE WHEN event_type IN ('click', 'view') THEN concat('/v1/', event_type) ELSE concat('/api/', event_type) END AS path",
            "CASE WHEN event_type = 'error' THEN 500 WHEN value > 90 THEN 429 ELSE 200 END AS status_code",
            "CAST(floor(value * 10) AS BIGINT) AS latency_ms",
            "CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'purchase' THEN 'SUCCESS' WHEN value < 5 THEN 'NO_ANSWER' ELSE 'COMPLETED' END AS status",
            "event_type",
            "props",
        )

    def jobs(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id",
            "o_custkey AS document_id",
            "CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS status",
            "o_orderpriority AS stage",
            "o_orderdate AS created_at",
        )


def _chars(text: str) -> str:
    return f"list_distinct(string_split(regexp_replace(lower({text}), '{WHITE}', '', 'g'), ''))"


def _mock(text: str) -> str:
    return f"list_transform(range(0, 32), lambda i: round(CAST('0x' || sha256({text})[i * 2 + 1 : i * 2 + 2] AS INT) / 255.0, 6)::DOUBLE)"


VECTOR_SCORE = "round(coalesce(list_cosine_similarity(q.e, t.e), 0), 6)"
TEXT_SCORE = "round(len(list_intersect(q.cs, t.cs)) / len(q.cs), 6)"
#: One channel's best rows of each question. A text channel leaves out rows with nothing in common, a vector channel has none here.
CHANNEL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, item_index, item_id) AS rank FROM
        (SELECT '{name}' AS channel, q.query_id, t.document_id, t.{id} AS item_id, t.{index} AS item_index, {score} AS score FROM kb_q q, {items} t) WHERE score > 0) WHERE rank <= {k}"""

_FLAT = "trim(regexp_replace({}, '" + WHITE.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'))"
_WINDOW = f"""SELECT *, substr(p, 1, spot - 1) AS l, substr(p, spot + length(o)) AS r FROM
    (SELECT f.query_id, f.chunk_id, f.final_rank, f.fused_score, f.parent_chunk_id, {_FLAT.format("h.content")} AS p, {_FLAT.format("f.content")} AS o, instr({_FLAT.format("h.content")}, {_FLAT.format("f.content")}) AS spot
     FROM kb_final f JOIN kb_chunks h ON h.chunk_id = f.parent_chunk_id AND h.document_id = f.document_id AND h.chunk_level = 'PARENT' AND h.status = 'ACTIVE') WHERE spot > 0 AND o <> ''"""
_UNITS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+[^\\p{{L}}\\p{{N}}]*')"
_LEAD = "regexp_extract({}, '^[^\\p{{L}}\\p{{N}}]*')"

#: The same tables for the SQL side, in dependency order.
CTES = {
    "kb_documents": """SELECT doc_id AS id, 't' || (doc_id % 2) AS tenant_id, 'Document ' || doc_id AS title,
        source || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' WHEN doc_id % 3 = 1 THEN '.csv' ELSE '.pdf' END AS file_name,
        CASE WHEN doc_id % 3 = 0 THEN 'MARKDOWN' WHEN doc_id % 3 = 1 THEN 'CSV' ELSE 'PDF' END AS file_type,
        sha256(text) AS checksum,
        CASE WHEN quality = 1 THEN 'READY' WHEN quality = 0 THEN 'FAILED' WHEN doc_id % 5 < 3 THEN 'READY' ELSE 'PARSING' END AS status,
        lang AS space_id, source AS department_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source || '-' || lang END AS category_id,
        CASE WHEN doc_id % 41 = 0 THEN DATE '2024-03-01' END AS deleted_at,
        CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS TIMESTAMP) AS updated_at, n_chars,
        CAST(len(string_split(text, chr(10))) AS BIGINT) AS chunk_count, text, toxic
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "kb_rules": """SELECT id AS document_id, 'ALL_AUTHENTICATED' AS subject_type, '*' AS subject_id FROM kb_documents WHERE id % 2 = 0 AND coalesce(toxic, 0) = 0
        UNION ALL SELECT id, 'DEPARTMENT', department_id FROM kb_documents WHERE id % 3 = 1
        UNION ALL SELECT id, 'ROLE', 'auditor' FROM kb_documents WHERE toxic = 1
        UNION ALL SELECT id, 'USER', 'u7' FROM kb_documents WHERE id % 11 = 0""",
    "kb_lines": """SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS content FROM documents""",
    "kb_chunks": """SELECT doc_id || '-c' || pos AS chunk_id, doc_id AS document_id,
        CASE WHEN pos % 10 = 9 THEN NULL ELSE doc_id || '-p' || (pos // 4) END AS parent_chunk_id, CAST(pos AS INT) AS chunk_index,
        'CHILD' AS chunk_level, CASE WHEN (doc_id + pos) % 13 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status, content FROM kb_lines
        UNION ALL SELECT doc_id || '-p' || (pos // 4), doc_id, CAST(NULL AS VARCHAR), CAST(pos // 4 AS INT), 'PARENT',
        CASE WHEN doc_id % 17 = 0 THEN 'STAGING' ELSE 'ACTIVE' END, content FROM kb_parts""",
    "kb_parts": """SELECT doc_id, pos // 4 * 4 AS pos, string_agg(content, chr(10) ORDER BY pos) AS content FROM kb_lines GROUP BY doc_id, pos // 4 * 4""",
    "kb_live": """SELECT * FROM kb_chunks c WHERE chunk_level = 'CHILD' AND status = 'ACTIVE' AND (parent_chunk_id IS NULL OR EXISTS
        (SELECT 1 FROM kb_chunks p WHERE p.chunk_id = c.parent_chunk_id AND p.document_id = c.document_id AND p.chunk_level = 'PARENT' AND p.status = 'ACTIVE'))""",
    "kb_turns": """SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "kb_pairs": """SELECT conv_id || '-' || turn AS pair_id, conv_id % 200 AS document_id, turn AS pair_index,
        CASE WHEN conv_id % 3 = 0 THEN NULL ELSE (conv_id % 200) || '-c0' END AS chunk_id,
        CASE WHEN conv_id % 19 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status, question, answer
        FROM kb_turns WHERE role = 'user' AND next_role = 'assistant'""",
    "kb_calls": """SELECT event_id AS id, ts AS created_at, 't' || (user_id % 2) AS tenant_id, user_id,
        CASE WHEN event_type IN ('click', 'view') THEN '/v1/' || event_type ELSE '/api/' || event_type END AS path,
        CASE WHEN event_type = 'error' THEN 500 WHEN value > 90 THEN 429 ELSE 200 END AS status_code,
        CAST(floor(value * 10) AS BIGINT) AS latency_ms,
        CASE WHEN event_type = 'error' THEN 'FAILED' WHEN event_type = 'purchase' THEN 'SUCCESS' WHEN value < 5 THEN 'NO_ANSWER' ELSE 'COMPLETED' END AS status,
        event_type, props FROM events""",
    "kb_jobs": """SELECT o_orderkey AS id, o_custkey AS document_id,
        CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS status, o_orderpriority AS stage, o_orderdate AS created_at FROM orders""",
    "kb_visible": """SELECT * FROM kb_documents d WHERE tenant_id = 't0' AND status = 'READY' AND deleted_at IS NULL AND EXISTS
        (SELECT 1 FROM kb_rules r WHERE r.document_id = d.id AND (subject_type = 'ALL_AUTHENTICATED' OR (subject_type = 'DEPARTMENT' AND subject_id IN ('src1', 'src2'))
         OR (subject_type = 'ROLE' AND subject_id IN ('editor')) OR (subject_type = 'USER' AND subject_id = 'u7')))""",
    "kb_queries": """SELECT item_id AS query_id, text AS query FROM benchmark""",
    "kb_q": f"""SELECT item_id AS query_id, text AS query, {_chars("text")} AS cs, regexp_replace(lower(text), '{WHITE}+', '', 'g') AS flat, {_mock("text")} AS e FROM benchmark""",
    "kb_qa_items": f"""SELECT p.*, {_chars("question || ' ' || answer")} AS cs, {_mock("question")} AS e FROM kb_pairs p WHERE status = 'ACTIVE'
        AND document_id IN (SELECT id FROM kb_visible) AND (chunk_id IS NULL OR chunk_id IN (SELECT chunk_id FROM kb_live))""",
    "kb_text_items": f"""SELECT c.*, d.title, {_chars("content")} AS cs, {_mock("content")} AS e FROM kb_live c JOIN kb_visible d ON d.id = c.document_id""",
    "kb_fused_pairs": f"""SELECT query_id, item_id, min(document_id) AS document_id, min(item_index) AS item_index, max(rank) FILTER (channel = 'v') AS vr, max(rank) FILTER (channel = 'x') AS xr,
        coalesce(max(score) FILTER (channel = 'v'), 0) AS vs, coalesce(max(score) FILTER (channel = 'x'), 0) AS xs, round(sum(1.0 / (60 + rank)), 9) AS fused_score,
        min(CASE channel WHEN 'v' THEN rank ELSE 1000 + rank END) AS first_seen FROM ({CHANNEL.format(name="v", score=VECTOR_SCORE, items="kb_qa_items", id="pair_id", index="pair_index", k=20)}
        UNION ALL {CHANNEL.format(name="x", score=TEXT_SCORE, items="kb_qa_items", id="pair_id", index="pair_index", k=20)}) GROUP BY 1, 2""",
    "kb_final_pairs": f"""SELECT query_id, item_id, vr, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_score DESC, xs DESC, first_seen, document_id, item_index, item_id) AS final_rank FROM
    (SELECT f.*, round(fused_score * 8 + vs * 0.35 + xs * 0.45 + CASE WHEN q.flat <> '' AND contains(p.flat, q.flat) THEN 1.2 ELSE 0 END
        + CASE WHEN len(q.cs) > 0 THEN len(list_intersect(q.cs, p.cs)) / len(q.cs) ELSE 0 END * 0.5 + 0.15 / (1 + greatest(item_index, 0)), 6) AS rerank_score
     FROM kb_fused_pairs f JOIN kb_q q USING (query_id) JOIN (SELECT pair_id AS item_id, regexp_replace(lower(question), '{WHITE}+', '', 'g') AS flat,
        list_distinct(string_split(regexp_replace(lower(question), '{WHITE}', '', 'g'), '')) AS cs FROM kb_pairs) p USING (item_id))""",
    "kb_hits": " UNION ALL ".join(
        CHANNEL.format(name=name, score=score, items=items, id=id_, index=index, k=10)
        for name, score, items, id_, index in (
            ("qv", VECTOR_SCORE, "kb_qa_items", "pair_id", "pair_index"), ("qx", TEXT_SCORE, "kb_qa_items", "pair_id", "pair_index"),
            ("tv", VECTOR_SCORE, "kb_text_items", "chunk_id", "chunk_index"), ("tx", TEXT_SCORE, "kb_text_items", "chunk_id", "chunk_index"),
        )
    ),
    "kb_evidence": """SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS fused_score, max_by(score, rank) FILTER (channel = 'qv') AS qv, max_by(score, rank) FILTER (channel = 'qx') AS qx,
        min_by(pair_index, (CASE channel WHEN 'qv' THEN 0 ELSE 1000 END) + rank) FILTER (pair_index IS NOT NULL) AS pair_index,
        min_by(pair_id, (CASE channel WHEN 'qv' THEN 0 ELSE 1000 END) + rank) FILTER (pair_id IS NOT NULL) AS pair_id, min(last) AS source_rank FROM
        (SELECT *, max(rank) OVER (PARTITION BY query_id, chunk_id, channel) AS last FROM (SELECT h.query_id, h.channel, h.rank, h.score, p.chunk_id, p.pair_index, p.pair_id FROM kb_hits h JOIN kb_qa_items p ON p.pair_id = h.item_id WHERE channel IN ('qv', 'qx') AND p.chunk_id IS NOT NULL
         UNION ALL SELECT query_id, channel, rank, score, item_id, NULL, NULL FROM kb_hits WHERE channel IN ('tv', 'tx'))) WHERE chunk_id IN (SELECT chunk_id FROM kb_text_items) GROUP BY 1, 2""",
    "kb_kept": """SELECT query_id, arg_min(chunk_id, o) AS chunk_id, min_by(fused_score, o) AS fused_score, min_by(pair_index, o) AS pair_index, max_by(qv, o) FILTER (qv IS NOT NULL) AS qv,
        max_by(qx, o) FILTER (qx IS NOT NULL) AS qx, count(*) AS merged FROM (SELECT e.*, c.content, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, c.document_id, e.chunk_id) AS o
        FROM kb_evidence e JOIN kb_text_items c USING (chunk_id)) GROUP BY query_id, content""",
    "kb_final": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fused_score DESC, coalesce(qx, 0) DESC, document_id, chunk_id) AS final_rank FROM
        (SELECT k.*, c.document_id, c.parent_chunk_id, c.chunk_index, c.content, round(fused_score * 8 + coalesce(qv, 0) * 0.35 + coalesce(qx, 0) * 0.45
            + CASE WHEN q.flat <> '' AND contains(s.flat, q.flat) THEN 1.2 ELSE 0 END + CASE WHEN len(q.cs) > 0 THEN len(list_intersect(q.cs, s.cs)) / len(q.cs) ELSE 0 END * 0.5
            + 0.15 / (1 + greatest(coalesce(k.pair_index, c.chunk_index), 0)), 6) AS rerank_score
         FROM kb_kept k JOIN kb_text_items c USING (chunk_id) JOIN kb_q q USING (query_id) JOIN
         (SELECT chunk_id, regexp_replace(lower(title || content), '{WHITE}+', '', 'g') AS flat, list_distinct(string_split(regexp_replace(lower(title || content), '{WHITE}', '', 'g'), '')) AS cs FROM kb_text_items) s USING (chunk_id))) WHERE final_rank <= 5""",
    "kb_context": f"""WITH RECURSIVE w AS ({_WINDOW}), u AS (SELECT *, {_UNITS.format("l")} AS lu, {_UNITS.format("r")} AS ru FROM w),
    parts AS (SELECT query_id, chunk_id, final_rank, fused_score, 0 AS step, 'PARENT' AS kind, parent_chunk_id AS context_id, {_FLAT.format('''(CASE WHEN len(lu) = 0 THEN l
        ELSE (CASE WHEN (len(lu) - 1) // 600 = 0 THEN ''' + _LEAD.format("l") + ''' ELSE '' END) || array_to_string(list_slice(lu, (len(lu) - 1) // 600 * 600 + 1, len(lu)), '') END)
        || ' ' || ''' + _LEAD.format("r") + ''' || array_to_string(list_slice(ru, 1, 600), '')''')} AS content FROM u
      UNION ALL SELECT f.query_id, f.chunk_id, f.final_rank, f.fused_score, n.chunk_index - f.chunk_index + 2, 'NEIGHBOR', n.chunk_id, {_FLAT.format("n.content")} FROM kb_final f JOIN kb_text_items n
        ON n.document_id = f.document_id AND n.parent_chunk_id = f.parent_chunk_id AND n.chunk_index BETWEEN f.chunk_index - 1 AND f.chunk_index + 1 AND n.chunk_index <> f.chunk_index),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, final_rank, step, context_id) AS i FROM parts),
    fold AS (SELECT query_id, 0 AS i, list_filter(list({_FLAT.format("content")}), lambda x: x <> '') AS seen, false AS taken FROM kb_final GROUP BY query_id
      UNION ALL SELECT g.query_id, g.i + 1, CASE WHEN regexp_matches(o.content, '[\\p{{L}}\\p{{N}}]') AND len(list_filter(g.seen, lambda x: contains(x, o.content) OR contains(o.content, x))) = 0 THEN list_append(g.seen, o.content) ELSE g.seen END,
        regexp_matches(o.content, '[\\p{{L}}\\p{{N}}]') AND len(list_filter(g.seen, lambda x: contains(x, o.content) OR contains(o.content, x))) = 0 FROM fold g JOIN o ON o.query_id = g.query_id AND o.i = g.i + 1)
    SELECT o.query_id, o.chunk_id, o.final_rank, o.kind, o.context_id, o.content FROM o JOIN fold USING (query_id, i) WHERE taken""",
    "kb_vectors": """SELECT CAST(label AS BIGINT) AS document_id, vec_id AS item_id, vec_id AS item_index, embedding FROM embeddings""",
    "kb_asked": """SELECT vec_id AS query_id, embedding AS vector FROM embeddings WHERE vec_id % 50 = 0""",
}


def with_tables(sql: str) -> str:
    """sql behind the definitions that it needs."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name, body in CTES.items():
            if name in text and name not in needed:
                add(body)
                if name not in needed:
                    needed.append(name)

    add(sql)
    if not needed:
        return sql
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{head}, {body.removeprefix(start)}"
    return f"WITH {head} {body}"
