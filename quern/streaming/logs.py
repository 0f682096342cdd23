"""Streams: request logs by window, exact sliding rate limits, counters of missed questions, and event frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def request_windows(calls: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls, failures and mean latency by window and path. Rows later than `late` are left out once a window closes."""
    failed = F.count_if(F.col("status_code") >= 500)
    grouped = calls.withWatermark("created_at", late).groupBy(F.window("created_at", width), "path")
    counted = grouped.agg(F.count("*").alias("calls"), failed.alias("failures"), F.avg("latency_ms").alias("mean_latency"))
    return counted.select(F.col("window.start").alias("start"), "path", "calls", "failures", F.round("mean_latency", 3).alias("mean_latency"))


def session_lengths(calls: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: runs of calls with no gap over `gap`."""
    grouped = calls.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap).alias("s"), "user_id")
    return grouped.agg(F.count("*").alias("calls")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "calls")


def missed_counts(questions: DataFrame) -> DataFrame:
    """Running count of each unanswered question, for the update mode. Without a tenant or a question there is no hash."""
    key = F.sha2(F.concat("tenant_id", F.lit(":"), "question"), 256)
    return questions.groupBy("tenant_id", key.alias("question_hash")).agg(F.count("*").alias("n"), F.max("asked_at").alias("last_asked"))


def rate_limited(calls: DataFrame, limit: int, seconds: float = 60.0) -> DataFrame:
    """Each call (key, id, at in seconds) with allowed: fewer than `limit` allowed calls of its key in the seconds before.

    Rejected calls don't count, so a decision depends on earlier ones: the state of a key is its at most `limit` allowed
    times, and stays. Within a batch, calls of a key are taken in order of time and id; maxFilesPerTrigger bounds a batch.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        allowed = []
        for at in rows["at"]:
            held = [t for t in held if t > at - seconds]
            allowed.append(len(held) < limit)
            if allowed[-1]:
                held.append(float(at))
        state.update((held,))
        yield pd.DataFrame({"key": key[0], "id": rows["id"], "allowed": allowed})

    kinds = dict(calls.dtypes)
    out = f"key {kinds['key']}, id {kinds['id']}, allowed boolean"
    return calls.groupBy("key").applyInPandasWithState(decide, out, "held array<double>", "append", GroupStateTimeout.NoTimeout)


def answer_events(runs: DataFrame, size: int = 8) -> DataFrame:
    """The event rows of each answer (run_id, status, answer, citations: array of strings) in order of seq: run_started,
    a delta for each `size` characters, the citations, then done; without an answer, no_answer alone."""
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("answer") - 1), F.lit(size))
    event = lambda name, data: F.struct(F.lit(name).alias("event"), data.cast("string").alias("data"))
    deltas = F.transform(cuts, lambda i: F.struct(F.lit("delta").alias("event"), F.substring("answer", i + 1, F.lit(size)).alias("data")))
    cited = F.transform("citations", lambda c: F.struct(F.lit("citation").alias("event"), c.alias("data")))
    start, done = F.array(event("run_started", F.col("run_id"))), F.array(event("done", F.col("run_id")))
    whole = F.when(F.col("status") == "NO_ANSWER", F.concat(start, F.array(event("no_answer", F.col("run_id"))))).otherwise(F.concat(start, deltas, cited, done))
    return runs.select("run_id", F.posexplode(whole).alias("seq", "e")).select("run_id", "seq", "e.event", "e.data")


def frames(events: DataFrame, *others: str) -> DataFrame:
    """Server-sent frames of event rows, with other columns."""
    body = F.regexp_replace(F.coalesce("data", F.lit("")), "\n", "\ndata: ")
    return events.select("run_id", "seq", *others, F.concat(F.lit("event: "), "event", F.lit("\ndata: "), body, F.lit("\n\n")).alias("frame"))


def heartbeats(events: DataFrame, interval: float) -> DataFrame:
    """How many heartbeat comments each event (run_id, seq, at in seconds) is preceded by: one per whole idle interval."""
    from pyspark.sql import Window

    gap = F.col("at") - F.lag("at").over(Window.partitionBy("run_id").orderBy("seq"))
    return events.select("run_id", "seq", F.coalesce(F.floor(gap / interval), F.lit(0)).cast("long").alias("heartbeats"))


def work_queue(tasks: DataFrame, work: Callable[[DataFrame], DataFrame], outbox: str, retries: str, checkpoint: str, attempts: int = 3) -> None:
    """One stage of a chain of queues: all waiting tasks (id, attempt and a payload) through work, which adds error.

    Done tasks are appended to outbox, which is the next stage's inbox. Failed ones are appended to retries with one more
    attempt, up to `attempts`; a folder of retries is an inbox too. Offsets are kept in checkpoint after a batch's files
    are written, so a task is taken up again if its batch was lost, and its batch's folder is then replaced.
    """

    def run(rows: DataFrame, number: int) -> None:
        done = work(rows).cache()
        plain = rows.columns
        done.filter("error is null").select(*plain).write.mode("overwrite").parquet(f"{outbox}/batch-{number}")
        again = done.filter(f"error is not null and attempt + 1 < {attempts}").withColumn("attempt", F.col("attempt") + 1)
        again.select(*plain).write.mode("overwrite").parquet(f"{retries}/batch-{number}")
        done.unpersist()

    tasks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def archive_stream(calls: DataFrame, folder: str, cutoff: str, checkpoint: str) -> None:
    """A scheduled run of the archive: what came since the last run and is older than the cutoff, as gzip JSON lines, a
    folder a day. A run without new rows writes none."""
    old = calls.filter(F.col("created_at") < F.lit(cutoff).cast("timestamp")).withColumn("dt", F.date_format("created_at", "yyyy-MM-dd"))
    writer = old.writeStream.partitionBy("dt").format("json").option("compression", "gzip").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(folder).awaitTermination()


def write_frames(events: DataFrame, folder: str, checkpoint: str) -> None:
    """Frames of a stream of events as text files, in order within each run and batch."""

    def run(rows: DataFrame, number: int) -> None:
        ordered = frames(rows).repartition("run_id").sortWithinPartitions("run_id", "seq")
        bodies = F.regexp_replace("frame", "\n\n$", "").alias("value")  # the line end that Spark writes closes the frame
        ordered.select(bodies).write.mode("overwrite").option("lineSep", "\n\n").text(f"{folder}/batch-{number}")

    events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
