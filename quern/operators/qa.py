"""Question-answer generation around a model: batches under a budget, bisection, and validation of what comes back."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import collapsed, json_slice
from quern.functions.text import holds_quote
from quern.operators.results import call_log, logged_calls
from quern.storage import materialize

ANSWER_DDL = (
    "items array<struct<question: string, answer: string, quote: string, pageNo: variant, chunkIndex: int>>, "
    "coveredChunkIndexes array<int>, skippedChunks array<struct<chunkIndex: int, reason: string>>"
)


def batch_numbers(chunks: DataFrame, measure: str, budget: int, fixed: int = 0) -> DataFrame:
    """chunks with batch_index: in order of chunk_index, a new batch where `fixed` and the batch's measures would exceed the
    budget. A chunk over the budget is a batch by itself.

    Whether a batch is full depends on where it began, so each document's chunks are read in order, a task at a time, and
    a batch's sum is all that is carried from one to the next.
    """
    types = dict(chunks.dtypes)
    slim = chunks.select("document_id", "chunk_index", F.col(measure).cast("long").alias("_size"))
    dealt = slim.repartition("document_id").sortWithinPartitions("document_id", "chunk_index")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, number, total = object(), 0, 0
        for frame in frames:
            numbers = []
            for owner, size in zip(frame["document_id"], frame["_size"]):
                if owner != document:
                    document, number, total = owner, 0, fixed + size
                elif total + size <= budget:
                    total += size
                else:
                    number, total = number + 1, fixed + size
                numbers.append(number)
            yield pd.DataFrame({"document_id": frame["document_id"], "chunk_index": frame["chunk_index"], "batch_index": numbers})

    ddl = f"document_id {types['document_id']}, chunk_index {types['chunk_index']}, batch_index int"
    return chunks.join(dealt.mapInPandas(run, ddl), ["document_id", "chunk_index"])


def greedy_batches(chunks: DataFrame, measure: str, budget: int, fixed: int = 0) -> DataFrame:
    """document_id, batch_index, chunk_ids and size: chunks in order, a new batch where the budget would be exceeded."""
    entry = F.struct("chunk_index", "chunk_id")
    grouped = batch_numbers(chunks, measure, budget, fixed).groupBy("document_id", "batch_index")
    found = grouped.agg(F.array_sort(F.collect_list(entry)).alias("rows"), F.sum(measure).cast("long").alias("size"))
    return found.select("document_id", "batch_index", F.col("rows.chunk_id").alias("chunk_ids"), "size")


def token_batches(chunks: DataFrame, budget: int, fixed: int, splits: bool) -> DataFrame:
    """Batches by prompt tokens: `fixed` for the contract and tokens for each chunk. document_id, batch_index, chunk_ids,
    size and error.

    A chunk that doesn't fit by itself is an error of adaptive collections (OVERSIZE) and is cut into fragments in others
    (splits), each a part of the longest beginnings that fit; a document of several generations is an error
    (GENERATIONS). chunks has document_id, chunk_id, chunk_index, content, tokens and generation.
    """
    room = budget - fixed
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / room)).cast("int") if splits else F.lit(1)
    cut = chunks.withColumn("_part", F.explode(F.sequence(F.lit(0), pieces - 1)))
    name = F.when(pieces > 1, F.concat("chunk_id", F.lit("#"), F.col("_part").cast("string"))).otherwise(F.col("chunk_id"))
    last = F.col("tokens") - F.col("_part") * room
    size = F.when(pieces > 1, F.least(F.lit(room).cast("long"), last.cast("long"))).otherwise(F.col("tokens").cast("long"))
    alone = F.when(pieces > 1, F.lit(room).cast("long")).otherwise(size)  # a fragment shares its batch with nothing
    rows = cut.select("document_id", name.alias("chunk_id"), (F.col("chunk_index") * 100_000 + F.col("_part")).alias("chunk_index"), size.alias("tokens"), alone.alias("_alone"), "generation")
    entry = F.struct("chunk_index", "chunk_id")
    grouped = batch_numbers(rows, "_alone", budget, fixed).groupBy("document_id", "batch_index").agg(
        F.array_sort(F.collect_list(entry)).alias("rows"), (F.sum("tokens") + fixed).alias("size"), F.max("tokens").alias("_most")
    )
    many = chunks.groupBy("document_id").agg((F.countDistinct("generation") > 1).alias("_mixed"))
    error = F.when(F.col("_mixed"), "GENERATIONS").when(F.col("_most") > room, "OVERSIZE")
    return grouped.join(many, "document_id").select("document_id", "batch_index", F.col("rows.chunk_id").alias("chunk_ids"), "size", error.alias("error"))


class ProviderError(Exception):
    """A model call that failed: TIMEOUT and TRUNCATED ask for less at once, others for another try if retryable."""

    def __init__(self, code: str, retryable: bool = False):
        super().__init__(code)
        self.code, self.retryable = code, retryable


def answered(model: Callable[[list[str]], str], number: int, ids: list[str], attempts: int = 3, depth: int = 4) -> list[tuple]:
    """(path, chunk_ids, output, error) of one batch's parts: see generate."""
    rows, todo = [], [(str(number), list(ids))]
    while todo:
        path, part = todo.pop()
        output = error = None
        for _ in range(attempts):
            try:
                output, error = model(part), None
                break
            except ProviderError as failure:
                error = failure.code
                if not failure.retryable or failure.code in ("TIMEOUT", "TRUNCATED"):
                    break
        if error in ("TIMEOUT", "TRUNCATED") and len(part) > 1 and path.count(".") < depth:
            half = len(part) // 2
            todo += [(f"{path}.1", part[half:]), (f"{path}.0", part[:half])]
        else:
            rows.append((path, part, output, error))
    return rows


def generate(batches: DataFrame, model: Callable[[list[str]], str], attempts: int = 3, depth: int = 4) -> DataFrame:
    """Each batch (document_id, batch_index, chunk_ids) through a model: document_id, batch_index, path, chunk_ids, output
    and error.

    A timeout or a truncated output halves a batch of two chunks or more, at most `depth` times; each half is a row with
    a longer path (.0, .1). Other retryable errors are tried again, `attempts` times in all. What still fails keeps its
    error's code, so that a later run may take it up.
    """
    types = dict(batches.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asked = zip(frame["document_id"], frame["batch_index"], frame["chunk_ids"])
            rows = [(document, number, *part) for document, number, ids in asked for part in answered(model, number, ids, attempts, depth)]
            yield pd.DataFrame(rows, columns=["document_id", "batch_index", "path", "chunk_ids", "output", "error"])

    ddl = f"document_id {types['document_id']}, batch_index int, path string, chunk_ids array<string>, output string, error string"
    return batches.select("document_id", "batch_index", "chunk_ids").mapInPandas(run, ddl)


def finished(rows: DataFrame) -> DataFrame:
    """input_hash and run of the batches that a run has answered in all their parts."""
    return rows.groupBy("input_hash", "run").agg(F.max("error").alias("_error")).filter("_error is null").drop("_error")


def with_input_hash(batches: DataFrame) -> DataFrame:
    """batches with a hash of what they ask: a run that is begun again finds what was done."""
    return batches.withColumn("input_hash", F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.array_join("chunk_ids", ",")), 256))


_PARTS = "array<struct<path: string, chunk_ids: array<string>, output: string, error: string>>"


def checkpointed_run(batches: DataFrame, folder: str, model: Callable[[list[str]], str], batch: int = 1) -> DataFrame:
    """Runs the batches that the log in folder has no answer for. Returns the logged rows of all runs, as generate gives
    them, with input_hash and run; a run without pending batches adds none.

    A worker logs the answers of every `batch` batches before it asks for more (results.logged_calls), so a job that fails
    half way keeps them, and so does a task. A batch counts as done when a run has all its parts without an error, so one
    that failed in part is asked again as a whole.
    """
    hashed = with_input_hash(batches)
    payload = F.to_json(F.struct("batch_index", "chunk_ids"))

    def call(payloads: list[str]) -> list[list[dict]]:
        out = []
        for one in map(json.loads, payloads):
            parts = answered(model, one["batch_index"], one["chunk_ids"])
            out.append([dict(zip(("path", "chunk_ids", "output", "error"), p, strict=True)) for p in parts])
        return out

    logged_calls(hashed.select(F.col("input_hash").alias("key"), payload.alias("payload")), folder, call, batch, lambda parts: all(p["error"] is None for p in parts))
    log = call_log(batches.sparkSession, folder).withColumnRenamed("key", "input_hash")
    rows = hashed.join(log, "input_hash").select("document_id", "batch_index", "input_hash", "run", F.explode(F.from_json("result", _PARTS)).alias("p"))
    found = rows.select("document_id", "batch_index", "p.path", "p.chunk_ids", "p.output", "p.error", "input_hash", "run")
    return materialize(found, "answers")  # so that the log is read once, whatever is asked of its rows


def publishable(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """document_id and ready: whether every batch of the document was finished by some run."""
    done = finished(rows).select("input_hash", F.lit(True).alias("_done")).distinct()
    joined = with_input_hash(batches).join(done, "input_hash", "left")
    return joined.groupBy("document_id").agg(F.every(F.coalesce("_done", F.lit(False))).alias("ready"))


def concurrency(calls: DataFrame, most: int, rise: int = 3) -> DataFrame:
    """id and allowed: how many calls a provider may have at once after each call, from `most` on.

    A call that failed under pressure halves it, `rise` calls in a row without raise it by one. calls has provider, id, at
    and pressed. Each provider's calls are read in order, and only the level and the run are carried on.
    """
    types = dict(calls.dtypes)
    dealt = calls.select("provider", "id", "at", "pressed").repartition("provider").sortWithinPartitions("provider", "at", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider, level, good = object(), most, 0
        for frame in frames:
            levels = []
            for owner, pressed in zip(frame["provider"], frame["pressed"]):
                if owner != provider:
                    provider, level, good = owner, most, 0
                if pressed:
                    level, good = max(1, level // 2), 0
                else:
                    good += 1
                    if good == rise:
                        level, good = min(most, level + 1), 0
                levels.append(level)
            yield pd.DataFrame({"id": frame["id"], "allowed": levels})

    return dealt.mapInPandas(run, f"id {types['id']}, allowed int")


def mock_answers(prompt: str) -> str:
    """The canned output of a provider for tests: one pair that quotes the prompt's first line."""
    quote = prompt.splitlines()[0][:80] if prompt else ""
    item = {"question": "What is stated?", "answer": quote, "quote": quote, "pageNo": 1, "chunkIndex": 0}
    return json.dumps({"items": [item], "coveredChunkIndexes": [0], "skippedChunks": []})


def bisect(batches: DataFrame) -> DataFrame:
    """Both halves of each batch of two chunks or more: path with .0 or .1, depth one more, size by share of chunks."""
    half = F.floor(F.size("chunk_ids") / 2).cast("int")
    left = F.struct(F.lit(0).alias("side"), F.slice("chunk_ids", F.lit(1), half).alias("ids"))
    right = F.struct(F.lit(1).alias("side"), F.slice("chunk_ids", half + 1, F.size("chunk_ids") - half).alias("ids"))
    parts = batches.filter(F.size("chunk_ids") > 1).select("*", F.explode(F.array(left, right)).alias("p"))
    share = F.greatest(F.lit(1), F.round(F.col("size") * F.size("p.ids") / F.size("chunk_ids"))).cast("long")
    return parts.select(
        "document_id", F.concat_ws(".", "path", "p.side").alias("path"), (F.col("depth") + 1).alias("depth"), F.col("p.ids").alias("chunk_ids"), share.alias("size")
    )


def validate_answers(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """The items of each model answer (batch_id, document_id, expected: array of chunk indexes, output) with an error.

    Errors, first that holds: INVALID_JSON, MISSING_FIELD, UNKNOWN_CHUNK, PAGE_RANGE (also where pageNo is missing or no
    whole number), QUOTE_NOT_FOUND (composition and white space aside), COVERAGE (covered and skipped indexes must part
    the expected ones, and items must be of covered ones). An answer without items is one row without an item; it is
    valid if it skips all chunks. chunks has document_id, chunk_index, content, page_start and page_end.
    """
    parsed = answers.withColumn("a", F.from_json(json_slice(F.col("output")), ANSWER_DDL))
    covered, skipped = F.coalesce("a.coveredChunkIndexes", F.array().cast("array<int>")), F.coalesce(F.col("a.skippedChunks.chunkIndex"), F.array().cast("array<int>"))
    both = F.concat(covered, skipped)
    parted = (F.array_sort(both) == F.array_sort("expected")) & (F.size(F.array_distinct(both)) == F.size(both))
    used = F.array_distinct(F.coalesce(F.col("a.items.chunkIndex"), F.array().cast("array<int>")))
    parted = parted & (F.size(F.array_except(used, covered)) == 0)
    rows = parsed.select("batch_id", "document_id", "expected", F.coalesce(parted, F.lit(False)).alias("parted"), F.col("a.items").isNull().alias("broken"), F.posexplode_outer("a.items").alias("item_index", "item"))
    source = chunks.select("document_id", F.col("chunk_index").alias("_i"), "content", "page_start", "page_end")
    joined = rows.join(source, (rows["document_id"] == source["document_id"]) & (F.col("item.chunkIndex") == F.col("_i")), "left").drop(source["document_id"])
    blank = lambda name: collapsed(F.col(f"item.{name}")) == ""
    whole = F.schema_of_variant("item.pageNo") == "BIGINT"
    first, page = F.coalesce("page_start", F.lit(1)), F.when(whole, F.try_variant_get("item.pageNo", "$", "bigint"))
    in_range = F.coalesce((page >= 1) & page.between(first, F.coalesce("page_end", first)), F.lit(False))
    of_item = (
        F.when(blank("question") | blank("answer") | blank("quote"), "MISSING_FIELD")
        .when(~F.coalesce(F.array_contains("expected", F.col("item.chunkIndex")), F.lit(False)) | F.col("_i").isNull(), "UNKNOWN_CHUNK")
        .when(~in_range, "PAGE_RANGE")
        .when(~holds_quote(F.col("content"), F.col("item.quote")), "QUOTE_NOT_FOUND")
    )
    error = F.when(F.col("broken"), "INVALID_JSON").when(F.col("item").isNotNull() & of_item.isNotNull(), of_item).when(~F.col("parted"), "COVERAGE")
    fields = ("question", "answer", "quote")
    return joined.select("batch_id", "document_id", "item_index", *(F.col(f"item.{f}") for f in fields), page.cast("int").alias("pageNo"), "item.chunkIndex", error.alias("error"))


def attributed_quotes(quotes: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """The one chunk of each quote (key, document_id, page, quote): the only one of its document whose pages hold the page
    and whose text holds the quote, white space aside. Else error: NOT_FOUND or AMBIGUOUS. chunks has document_id,
    chunk_id, content, page_start and page_end."""
    flat = collapsed(F.col("quote"))
    held = quotes.filter(flat != "").join(chunks, "document_id").filter(F.col("page").between(F.col("page_start"), F.col("page_end")) & F.contains(collapsed(F.col("content")), flat))
    found = held.groupBy(key).agg(F.count("*").alias("_n"), F.max("chunk_id").alias("_chunk"))
    joined = quotes.join(found, key, "left")
    return joined.select(
        *quotes.columns, F.when(F.col("_n") == 1, F.col("_chunk")).alias("chunk_id"), F.when(F.col("_n") > 1, "AMBIGUOUS").when(F.col("_n").isNull(), "NOT_FOUND").alias("error")
    )


def replace_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs after documents of `new` have theirs replaced, numbered again in each document."""
    stay = old.join(new.select("document_id").distinct(), "document_id", "left_anti")
    order = Window.partitionBy("document_id").orderBy("chunk_index", "item_index")
    numbered = new.withColumn("pair_index", F.row_number().over(order) - 1)
    return stay.select("document_id", "pair_index", "question", "answer").unionByName(numbered.select("document_id", "pair_index", "question", "answer"))
