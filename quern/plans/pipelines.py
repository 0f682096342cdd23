"""Registered queries of parsing, chunking, question-answer generation, evidence handling and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import ChunkPolicy
from quern.functions import scalar as S
from quern.functions.text import redacted_json
from quern.operators import access as A
from quern.operators import chunking, qa
from quern.plans.entities import Tables
from quern.plans.queries import query
from quern.sources.blocks import parse_files
from quern.storage import scratch
from quern.streaming import logs, stateful, upserts


def _files(t: Tables) -> DataFrame:
    return t.raw("documents").select(F.col("doc_id").alias("id"), F.concat("doc_id", F.lit(".md")).alias("name"), F.col("text").alias("content"))


_PLAIN = "regexp_replace(content, '[^\\x21-\\x7e]', '', 'g')"


@query(f"SELECT doc_id AS id, sha256(string_agg({_PLAIN}, '' ORDER BY pos)) AS text_hash FROM kb_lines WHERE regexp_matches(content, '[^\\s]') AND NOT regexp_matches(content, '^\\s*#') GROUP BY doc_id")
def src2_markdown_blocks(t: Tables) -> DataFrame:
    """The printable characters of each document's blocks: those of its lines that are no headings."""
    blocks = parse_files(_files(t)).filter("content is not null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "content"))), lambda b: b["content"]), "")
    return blocks.groupBy("id").agg(F.sha2(F.regexp_replace(joined, r"[^\x21-\x7e]", ""), 256).alias("text_hash"))


@query()
def src3_block_types(t: Tables) -> DataFrame:
    return parse_files(_files(t)).select("id", "index", "block_type", "line_start", "line_end", "content", "error")


@query("SELECT c_custkey // 200 AS id, count(*) AS rows, CAST(2 AS BIGINT) AS first, count(*) + 1 AS last, sha256(string_agg('| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |', chr(10) ORDER BY c_custkey)) AS rows_hash, true AS bounded FROM customer GROUP BY 1")
def src7_csv_blocks(t: Tables) -> DataFrame:
    """CSV files of 200 customers, packed into tables of at most 4000 characters that each repeat the header."""
    line = F.struct("c_custkey", F.concat_ws(",", "c_custkey", "c_name", "c_mktsegment").alias("line"))
    packed = t.raw("customer").groupBy(F.floor(F.col("c_custkey") / 200).alias("id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.concat(F.lit("id,name,segment\n"), F.array_join("lines.line", "\n"))
    blocks = parse_files(packed.select("id", F.lit("customers.csv").alias("name"), text.alias("content")))
    rows = F.slice(F.split("content", "\n"), 3, 1 << 20)
    own = blocks.select("id", "index", "line_start", "line_end", F.length("content").alias("size"), rows.alias("rows"))
    lines = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("index", "rows"))), lambda b: b["rows"]))
    grouped = own.groupBy("id").agg(lines.alias("lines"), F.min("line_start").cast("long").alias("first"), F.max("line_end").cast("long").alias("last"), F.every(F.col("size") <= 4000).alias("bounded"))
    return grouped.select("id", F.size("lines").cast("long").alias("rows"), "first", "last", F.sha2(F.array_join("lines", "\n"), 256).alias("rows_hash"), "bounded")


@query("SELECT doc_id AS id, true AS bounded, sha256(regexp_replace(text, '[\\s]+', '', 'g')) AS text_hash FROM documents WHERE regexp_matches(text, '\\S')")
def chk1_chunks_hold_the_text(t: Tables) -> DataFrame:
    policy = ChunkPolicy()
    chunks = chunking.chunk_documents(_as_blocks(t), policy)
    own = F.expr("substring(content, prefix_chars + 1)")
    children = chunks.filter("chunk_level = 'CHILD'").groupBy("id").agg(
        F.every(F.col("token_count") <= policy.max_tokens).alias("bounded"), F.array_sort(F.collect_list(F.struct("chunk_index", own.alias("text")))).alias("parts")
    )
    return children.select("id", "bounded", F.sha2(F.regexp_replace(F.array_join("parts.text", ""), r"\s+", ""), 256).alias("text_hash"))


def _as_blocks(t: Tables) -> DataFrame:
    return t.raw("documents").select(
        F.col("doc_id").alias("id"), F.lit(0).alias("index"), F.col("text").alias("content"), F.lit("TEXT").alias("block_type"), F.lit(1).alias("page_no"), F.array(F.col("lang")).alias("title_path")
    )


@query()
def chk1_chunks(t: Tables) -> DataFrame:
    return chunking.chunk_documents(_as_blocks(t)).drop("block_indexes")


@query(
    """WITH RECURSIVE n AS (SELECT document_id, chunk_id, CAST(length(content) AS BIGINT) AS size, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS i FROM kb_live),
    f AS (SELECT document_id, i, 0 AS batch_index, size AS total, chunk_id FROM n WHERE i = 1
    UNION ALL SELECT n.document_id, n.i, CASE WHEN f.total + n.size <= 600 THEN f.batch_index ELSE f.batch_index + 1 END,
    CASE WHEN f.total + n.size <= 600 THEN f.total + n.size ELSE n.size END, n.chunk_id FROM f JOIN n ON n.document_id = f.document_id AND n.i = f.i + 1)
    SELECT document_id, CAST(batch_index AS BIGINT) AS batch_index, count(*) AS chunks, max(total) AS size FROM f GROUP BY document_id, batch_index"""
)
def qas2_character_batches(t: Tables) -> DataFrame:
    live = A.live_chunks(t.chunks()).withColumn("size", F.length("content"))
    batches = qa.greedy_batches(live, "size", 600)
    return batches.select("document_id", F.col("batch_index").cast("long").alias("batch_index"), F.size("chunk_ids").cast("long").alias("chunks"), "size")


@query("SELECT document_id, '0.' || side AS path, CASE WHEN side = 0 THEN n // 2 ELSE n - n // 2 END AS chunks FROM (SELECT document_id, count(*) AS n FROM kb_live GROUP BY 1 HAVING count(*) > 1), (VALUES (0), (1)) v(side)")
def qas3_bisection(t: Tables) -> DataFrame:
    whole = qa.greedy_batches(A.live_chunks(t.chunks()).withColumn("size", F.length("content")), "size", 1 << 40)
    halves = qa.bisect(whole.select("document_id", F.lit("0").alias("path"), F.lit(0).alias("depth"), "chunk_ids", "size"))
    return halves.select("document_id", "path", F.size("chunk_ids").cast("long").alias("chunks"))


@query(
    f"""SELECT doc_id AS document_id, CASE WHEN doc_id % 9 = 0 THEN 'INVALID_JSON' WHEN doc_id % 9 = 1 THEN 'QUOTE_NOT_FOUND' WHEN doc_id % 9 = 7 THEN NULL
    WHEN NOT regexp_matches(coalesce(substr(text, 1, 40), ''), '{S.NOT_WHITE}') THEN 'MISSING_FIELD' WHEN doc_id % 9 IN (2, 5, 6) THEN 'PAGE_RANGE' WHEN doc_id % 9 = 3 THEN 'COVERAGE' END AS error FROM documents"""
)
def qas5_answer_validation(t: Tables) -> DataFrame:
    """Answers of nine kinds: no JSON, another quote, a page beyond the chunk, a chunk too much, a right one, no page, a page
    that is no number, a chunk that is skipped with a reason, and a right one whose quote has other white space."""
    kind = F.col("doc_id") % 9
    docs = t.raw("documents").withColumn("quote", F.coalesce(F.substring("text", 1, 40), F.lit("")))
    quote = F.when(kind == 1, "no such passage \u0001").when(kind == 8, F.replace("quote", F.lit(" "), F.lit("\n\t "))).otherwise(F.col("quote"))
    page = F.when(kind == 2, "9").when(kind == 6, '"x"').when(kind != 5, "1")
    item = F.concat(F.lit('{"question": "q?", "answer": "a", "quote": '), F.get(F.split(F.to_json(F.struct(quote.alias("q"))), '^\\{"q":|\\}$'), F.lit(1)), F.coalesce(F.concat(F.lit(', "pageNo": '), page), F.lit("")), F.lit(', "chunkIndex": 0}'))
    covered = F.when(kind == 3, "[0, 7]").otherwise("[0]")
    body = F.concat(F.lit('{"items": ['), item, F.lit('], "coveredChunkIndexes": '), covered, F.lit("}"))
    body = F.when(kind == 7, '{"items": [], "coveredChunkIndexes": [], "skippedChunks": [{"chunkIndex": 0, "reason": "no content"}]}').otherwise(body)
    output = F.when(kind == 0, "no json at all").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    answers = docs.select(F.col("doc_id").alias("batch_id"), F.col("doc_id").alias("document_id"), F.array(F.lit(0)).alias("expected"), output.alias("output"))
    chunks = docs.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    return qa.validate_answers(answers, chunks).select("document_id", "error")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '***REDACTED***' WHEN 1 THEN 'GET /x?api_key=***REDACTED***&id=' || event_id WHEN 2 THEN 'key ***REDACTED*** of ' || user_id ELSE 'plain text ' || event_id END AS line,
    '***REDACTED***' AS password, 'lk_live_12345678' AS key_prefix FROM events""")
def fun23_redaction(t: Tables) -> DataFrame:
    kind, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    text = F.when(kind == 0, F.concat(F.lit("Authorization: Bearer abc"), n)).when(kind == 1, F.concat(F.lit("GET /x?api_key=k"), n, F.lit("&id="), n))
    text = text.when(kind == 2, F.concat(F.lit("key sk-0123456789abcdef"), n, F.lit(" of "), "user_id")).otherwise(F.concat(F.lit("plain text "), n))
    payload = F.create_map(F.lit("message"), text, F.lit("Password"), n, F.lit("key-prefix"), F.lit("lk_live_12345678"))
    masked = t.raw("events").select("event_id", S.redacted_payload(payload).alias("p"))
    return masked.select("event_id", *(F.col("p").getItem(k).alias(name) for k, name in (("message", "line"), ("Password", "password"), ("key-prefix", "key_prefix"))))


@query(
    """SELECT event_id, '{"a":{"Password":"***REDACTED***","list":["GET /x?api_key=***REDACTED***&id=' || event_id || '",{"key-prefix":"lk_live_12345678","n":' || event_id || ',"token":["***REDACTED***"]}],"secrets":"***REDACTED***"},"note":"plain ' || event_id || '"}' AS payload FROM events"""
)
def fun23_nested_payloads(t: Tables) -> DataFrame:
    """Secrets at every depth of payloads, of which a name masks objects and numbers too."""
    n = F.col("event_id").cast("string")
    shape = '{"a": {"Password": @, "list": ["GET /x?api_key=k@&id=@", {"key-prefix": "lk_live_12345678", "n": @, "token": ["sk-0123456789abcdef@"]}], "secrets": {"x": [1, @]}}, "note": "plain @"}'
    return t.raw("events").select("event_id", redacted_json(F.replace(F.lit(shape), F.lit("@"), n)).alias("payload"))


def _stream(t: Tables, name: str) -> DataFrame:
    """A stream of a table's files. A pattern, as a stream's path may not be a file, and a table is one or a folder of many."""
    return t.spark.readStream.schema(t.raw(name).schema).parquet(f"{t.folder}/{name}.parque[t]")


def _drained(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    """The result of a stream after all that is there now, by way of Parquet in the shared folder.

    An appending stream writes files; one with a complete or updated result writes each batch to a folder of its own, of
    which the last holds the result.
    """
    base = scratch(t.spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{base}/rows").awaitTermination()
        return t.spark.read.schema(stream.schema).parquet(f"{base}/rows")
    batches: list[int] = []

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/batch-{number}")
        batches.append(number)

    writer.foreachBatch(keep).start().awaitTermination()
    if not batches:
        return t.spark.createDataFrame([], stream.schema)
    return t.spark.read.schema(stream.schema).parquet(f"{base}/batch-{max(batches)}")


def _stream_calls(t: Tables) -> DataFrame:
    return _stream(t, "events").selectExpr(
        "event_id AS id", "CAST(ts AS TIMESTAMP) AS created_at", "user_id",
        "CASE WHEN event_type IN ('click', 'view') THEN concat('/v1/', event_type) ELSE concat('/api/', event_type) END AS path",
        "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code", "CAST(floor(value * 10) AS BIGINT) AS latency_ms",
    )


@query(
    """SELECT strftime(time_bucket(INTERVAL 1 HOUR, created_at), '%Y-%m-%d %H') AS hour, path, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, round(avg(latency_ms), 3) AS mean_latency
    FROM kb_calls GROUP BY ALL"""
)
def str5_request_windows(t: Tables) -> DataFrame:
    done = _drained(t, logs.request_windows(_stream_calls(t)), "complete")
    return done.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "path", "calls", "failures", "mean_latency")


@query("SELECT tenant_id, sha256(tenant_id || ':' || question) AS question_hash, count(*) AS n FROM (SELECT 't' || (conv_id % 2) AS tenant_id, text AS question FROM conversations WHERE role = 'user') GROUP BY 1, 2")
def str7_missed_counts(t: Tables) -> DataFrame:
    asked = _stream(t, "conversations").filter("role = 'user'").selectExpr("concat('t', conv_id % 2) AS tenant_id", "text AS question", "turn AS asked_at")
    return _drained(t, logs.missed_counts(asked), "complete").select("tenant_id", "question_hash", "n")


@query(
    """WITH RECURSIVE n AS (SELECT event_id AS id, user_id AS key, epoch_us(ts) / 1000000.0 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT key, 0 AS i, CAST(NULL AS BIGINT) AS id, CAST([] AS DOUBLE[]) AS held, false AS allowed FROM n WHERE i = 1 UNION ALL SELECT n.key, n.i, n.id,
    CASE WHEN len(list_filter(held, lambda x: x > s - 36000.0)) < 3 THEN list_append(list_filter(held, lambda x: x > s - 36000.0), CAST(s AS DOUBLE)) ELSE list_filter(held, lambda x: x > s - 36000.0) END,
    len(list_filter(held, lambda x: x > s - 36000.0)) < 3 FROM f JOIN n ON n.key = f.key AND n.i = f.i + 1) SELECT key, id, allowed FROM f WHERE i > 0"""
)
def str6_rate_limit(t: Tables) -> DataFrame:
    """Calls of a file stream, and a file that tells the time two windows after the last call, so that all are decided."""
    base = scratch(t.spark, "calls")
    events = t.raw("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    later = F.timestamp_micros(F.max(F.unix_micros("at")) + 72_000_000_000).alias("at")
    events.agg(later).select(F.lit(0).cast("long").alias("key"), F.lit(None).cast("long").alias("id"), "at").write.parquet(f"{base}/time")
    clock = t.spark.readStream.schema("key long, id long, at timestamp").parquet(f"{base}/time")
    calls = _stream(t, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return _drained(t, stateful.rate_limited(calls.unionByName(clock), 3, 36_000.0), "append")


@query("SELECT tenant_id, question_hash, n, last_role, first_turn FROM (SELECT tenant_id, sha256(tenant_id || ':' || trim(question)) AS question_hash, count(*) AS n, arg_max(role, turn * 10 + length(role)) AS last_role, CAST(max(turn) FILTER (turn < 3) AS VARCHAR) AS first_turn FROM (SELECT 't' || (conv_id % 2) AS tenant_id, text AS question, role, turn FROM conversations) GROUP BY 1, 2)")
def str7_upserted_questions(t: Tables) -> DataFrame:
    """Questions of a stream that are merged into a table in two batches; the second one is merged twice."""
    base = scratch(t.spark, "missed")
    none = F.create_map().cast("map<string,string>")
    early = F.when(F.col("turn") < 3, F.create_map(F.lit("early"), F.col("turn").cast("string"))).otherwise(none)
    asked = t.raw("conversations").select(
        F.concat(F.lit("t"), F.col("conv_id") % 2).alias("tenant_id"), F.col("text").alias("question"), (F.col("turn") * 10 + F.length("role")).alias("asked_at"), F.map_concat(F.create_map(F.lit("role"), "role"), early).alias("metadata"),
        (F.col("turn") >= 2).alias("late"),
    )
    table = upserts.UpsertTable(t.spark, f"{base}/table")
    for late in (False, True):
        asked.filter(F.col("late") == late).drop("late").write.mode("append").parquet(f"{base}/in")
        table.follow(t.spark.readStream.schema(asked.drop("late").schema).parquet(f"{base}/in"), f"{base}/checkpoint")
    table.merge(asked.filter("late").drop("late"), 1)
    return table.read().select("tenant_id", "question_hash", "n", F.col("metadata").getItem("role").alias("last_role"), F.col("metadata").getItem("early").alias("first_turn"))


_EVENTS = """SELECT run_id, seq, event, data FROM (SELECT pair_id AS run_id, 0 AS seq, 'run_started' AS event, pair_id AS data FROM kb_pairs WHERE length(answer) > 0
    UNION ALL SELECT pair_id, 1, 'no_answer', pair_id FROM kb_pairs WHERE length(answer) > 0 AND status <> 'ACTIVE'
    UNION ALL SELECT pair_id, i + 1, 'delta', substr(answer, i * 8 + 1, 8) FROM (SELECT *, unnest(range(0, CAST(ceil(length(answer) / 8.0) AS BIGINT))) AS i FROM kb_pairs WHERE length(answer) > 0 AND status = 'ACTIVE')
    UNION ALL SELECT pair_id, CAST(ceil(length(answer) / 8.0) AS BIGINT) + 1, 'citation', question FROM kb_pairs WHERE length(answer) > 0 AND status = 'ACTIVE'
    UNION ALL SELECT pair_id, CAST(ceil(length(answer) / 8.0) AS BIGINT) + 2, 'done', pair_id FROM kb_pairs WHERE length(answer) > 0 AND status = 'ACTIVE')"""


def _answer_events(t: Tables) -> DataFrame:
    status = F.when(F.col("status") == "ACTIVE", "COMPLETED").otherwise("NO_ANSWER")
    return logs.answer_events(t.pairs().filter("length(answer) > 0").select(F.col("pair_id").alias("run_id"), status.alias("status"), "answer", F.array("question").alias("citations")))


@query(f"SELECT run_id, CAST(seq AS BIGINT) AS seq, event, data FROM ({_EVENTS})")
def str1_answer_events(t: Tables) -> DataFrame:
    return _answer_events(t).withColumn("seq", F.col("seq").cast("long"))


@query(f"SELECT sha256('event: ' || event || chr(10) || 'data: ' || replace(data, chr(10), chr(10) || 'data: ')) AS frame_hash, count(*) AS n FROM ({_EVENTS}) GROUP BY 1")
def src22_event_frames(t: Tables) -> DataFrame:
    """The frames that a stream of answer events leaves in the shared folder."""
    base = scratch(t.spark, "frames")
    _answer_events(t).write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema("run_id string, seq int, event string, data string").parquet(f"{base}/in")
    logs.write_frames(stream, f"{base}/out", f"{base}/checkpoint")
    frames = t.spark.read.option("lineSep", "\n\n").option("recursiveFileLookup", "true").text(f"{base}/out").filter("value <> ''")
    return frames.groupBy(F.sha2("value", 256).alias("frame_hash")).agg(F.count("*").alias("n"))


@query("SELECT id, greatest(0, coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY us, id)) // 3600000000, 0)) AS heartbeats FROM (SELECT id, user_id, epoch_us(created_at) AS us FROM kb_calls)")
def str2_heartbeats(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("created_at").cast("timestamp"))
    events = t.calls().select(F.col("user_id").alias("run_id"), F.struct(us, "id").alias("seq"), (us / 1e6).alias("at"), "id")
    return logs.heartbeats(events, 3600.0).select(F.col("seq.id").alias("id"), "heartbeats")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'LOST' WHEN o_orderkey % 5 = 0 THEN 'RETRIED' ELSE 'DONE' END AS state FROM orders WHERE o_orderkey % 7 <> 0")
def str3_chained_queues(t: Tables) -> DataFrame:
    """Orders through two queues. One in five fails at its first attempt in the second, one in seven always."""
    base = scratch(t.spark, "queues")
    t.raw("orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("attempt")).write.parquet(f"{base}/one/batch-0")
    read = lambda folder: t.spark.readStream.schema("id long, attempt int").option("recursiveFileLookup", "true").parquet(folder)
    fine = lambda rows: rows.withColumn("error", F.lit(None).cast("string"))
    wrong = (F.col("id") % 7 == 0) | ((F.col("id") % 5 == 0) & (F.col("attempt") == 0))
    fails = lambda rows: rows.withColumn("error", F.when(wrong, "FAULT"))
    logs.work_queue(read(f"{base}/one"), fine, f"{base}/two", f"{base}/one-again", f"{base}/c1")
    inbox = f"{base}/two"
    for turn in range(3):  # a queue and the retries that it leaves
        logs.work_queue(read(inbox), fails, f"{base}/done/{turn}", f"{base}/again/{turn}", f"{base}/c2-{turn}")
        inbox = f"{base}/again/{turn}"
    done = t.spark.read.option("recursiveFileLookup", "true").parquet(f"{base}/done")
    return done.select("id", F.when(F.col("attempt") > 0, "RETRIED").otherwise("DONE").alias("state"))


@query("SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM kb_calls WHERE created_at < TIMESTAMP '2024-01-15' GROUP BY 1")
def str4_scheduled_archive(t: Tables) -> DataFrame:
    """Two runs of the archive over one table: the second one finds nothing new."""
    base = scratch(t.spark, "archive")
    for _ in range(2):
        logs.archive_stream(_stream_calls(t), f"{base}/days", "2024-01-15", f"{base}/checkpoint")
    return t.spark.read.schema("id long, dt string").json(f"{base}/days").groupBy(F.col("dt").alias("day")).agg(F.count("*").alias("n"))
