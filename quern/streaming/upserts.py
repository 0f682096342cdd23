"""Streaming upserts into a bucketed table: each batch merges what it changes, and a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table: a batch rewrites those that it changes.
BUCKETS = 64
MISSED_DDL = "tenant_id string, question_hash string, question string, n long, metadata map<string,string>"


def question_hash(tenant: Column, question: Column) -> Column:
    return F.sha2(F.concat_ws(":", tenant, F.trim(question)), 256)


def missed_in_batch(rows: DataFrame) -> DataFrame:
    """Counts of the unanswered questions (tenant_id, question, asked_at, metadata: map of strings) of one batch, in the form
    of the table. Of each metadata name the latest value stays, the greater one of the same time. Both are aggregated
    before they are dealt, however often a question is asked."""
    named = rows.select("tenant_id", question_hash(F.col("tenant_id"), F.col("question")).alias("question_hash"), F.trim("question").alias("question"), "asked_at", "metadata")
    keys = ("tenant_id", "question_hash")
    counts = named.groupBy(*keys).agg(F.min("question").alias("question"), F.count("*").alias("n"))
    entries = named.select(*keys, "asked_at", F.explode("metadata").alias("k", "v"))
    latest = entries.groupBy(*keys, "k").agg(F.max_by("v", F.struct("asked_at", "v")).alias("v"))
    maps = latest.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))
    none = F.create_map().cast("map<string,string>")
    return counts.join(maps, list(keys), "left").select(*keys, "question", "n", F.coalesce("metadata", none).alias("metadata"))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the table after new ones: counts are added, new metadata goes over old."""
    keys = ["tenant_id", "question_hash"]
    both = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in ("question", "n", "metadata"))).join(new, keys, "full")
    none = F.create_map().cast("map<string,string>")
    over = F.coalesce("metadata", none)
    under = F.map_filter(F.coalesce("_metadata", none), lambda k, v: ~F.map_contains_key(over, k))
    total = F.coalesce("_n", F.lit(0)) + F.coalesce("n", F.lit(0))
    return both.select(*keys, F.coalesce("_question", "question").alias("question"), total.alias("n"), F.map_concat(under, over).alias("metadata"))


class UpsertTable:
    """A table in buckets of a hash of question_hash. The folder of a batch has new versions of the buckets that it changed,
    and a mark once it is whole; a reader takes of each bucket the latest version of a whole batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _listed(self, *parts: str) -> list[str]:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def versions(self, below: int | None = None) -> dict[int, int]:
        """The batch that has the latest version of each bucket, of batches below a number."""
        batches = sorted(int(n.removeprefix("batch=")) for n in self._listed() if n.startswith("batch="))
        found: dict[int, int] = {}
        for batch in batches:
            names = self._listed(f"batch={batch}") if below is None or batch < below else []
            if "_SUCCESS" in names:
                found |= {int(n.removeprefix("bucket=")): batch for n in names if n.startswith("bucket=")}
        return found

    def read(self, below: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The table's rows, with their bucket, as of the last whole batch or of those below a number."""
        paths = [f"{self.folder}/batch={v}/bucket={b}" for b, v in self.versions(below).items() if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], MISSED_DDL)
        return self.spark.read.schema(MISSED_DDL).parquet(*paths)

    def merge(self, rows: DataFrame, number: int) -> None:
        """Merges a batch of unanswered questions. It starts from the batches before it, and its folder is replaced: so the
        same batch again, after a failure, leaves the same table."""
        new = missed_in_batch(rows).withColumn("bucket", F.pmod(F.xxhash64("question_hash"), F.lit(BUCKETS)).cast("int")).cache()
        try:
            changed = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # BUCKETS at most
            whole = merged(self.read(number, changed), new.drop("bucket"))
            dealt = whole.withColumn("bucket", F.pmod(F.xxhash64("question_hash"), F.lit(BUCKETS)).cast("int"))
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={number}")
        finally:
            new.unpersist()

    def follow(self, questions: DataFrame, checkpoint: str) -> None:
        """Merges all batches of a stream of unanswered questions that are there now."""
        writer = questions.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(self.merge)
        writer.trigger(availableNow=True).start().awaitTermination()
