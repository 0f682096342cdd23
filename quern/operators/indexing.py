"""From chunks and pairs to a published, embedded collection: search texts, versions, embeddings and their job, updates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import search_text, title_path
from quern.operators.filters import stale_targets
from quern.storage import materialize

#: The version of the text that is embedded; a change makes all vectors stale.
TEMPLATE = "v1"


def evidence_of(chunks: DataFrame) -> DataFrame:
    """Chunks as evidence: pages from page_no where they are missing, the locators or else the single locator, and a hash
    worked out again where it is missing or that of an empty text."""
    empty = F.sha2(F.lit(""), 256)
    good = F.coalesce("content_hash", F.lit(""))
    return chunks.select(
        "chunk_id", "document_id", "parent_chunk_id", "content",
        F.coalesce("page_start", "page_no").alias("page_start"), F.coalesce("page_end", "page_no").alias("page_end"),
        F.coalesce("source_locators", F.when(F.col("source_locator").isNotNull(), F.array("source_locator"))).alias("source_locators"),
        F.when((good == "") | (good == empty), F.sha2("content", 256)).otherwise(good).alias("content_hash"),
    )


def chunk_search_text(title: Column, path: Column, content: Column) -> Column:
    """Search tokens of a chunk: title, title path, content."""
    return search_text(title, F.array_join(path, " "), content)


def pair_search_text(title: Column, path: Column, question: Column, answer: Column, quote: Column) -> Column:
    """Search tokens of a pair: title, its chunk's title path, question, answer and quote."""
    return search_text(title, F.array_join(F.coalesce(path, F.array().cast("array<string>")), " "), question, answer, F.coalesce(quote, F.lit("")))


def embedding_text(document: Column, section: Column, kind: Column, body: Column) -> Column:
    """Labelled lines for the embedding model; empty ones are left out."""
    line = lambda label, value: F.when(F.trim(value) != "", F.concat(F.lit(f"{label}: "), value))
    return F.concat_ws("\n", line("Document", document), line("Section", section), line("Type", kind), F.nullif(body, F.lit("")))


PROMPT = (
    "Write question-answer pairs from the numbered parts below. Answer as JSON with items, coveredChunkIndexes and "
    "skippedChunks; quote each answer's source word for word."
)


def qa_prompts(chunks: DataFrame, *keys: str) -> DataFrame:
    """The prompt of each group of chunks (title, chunk_index, title_path, page_start, page_end, content): the contract,
    the document's title, then for each chunk a header line and its content."""
    pages = F.concat(F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"))
    head = F.concat(F.lit("["), F.col("chunk_index").cast("string"), F.lit("] pages "), pages, F.lit(" | "), F.array_join("title_path", " / "))
    part = F.struct("chunk_index", F.concat(head, F.lit("\n"), "content").alias("text"))
    grouped = chunks.groupBy(*keys).agg(F.min("title").alias("title"), F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select(*keys, F.concat_ws("\n\n", F.lit(PROMPT), F.concat(F.lit("Document: "), "title"), F.array_join("parts.text", "\n\n")).alias("prompt"))


def publish(current: DataFrame, staged: DataFrame) -> DataFrame:
    """The collection after staged rows are published: of documents with staged rows, what was ACTIVE is SUPERSEDED, and
    staged rows are ACTIVE. One plan gives the whole new snapshot, so readers see all of it or none."""
    changed = staged.select("document_id").distinct().withColumn("_new", F.lit(True))
    status = F.when(F.col("_new") & (F.col("status") == "ACTIVE"), "SUPERSEDED").otherwise(F.col("status"))
    old = current.join(changed, "document_id", "left").withColumn("status", status).select(*current.columns)
    return old.unionByName(staged.withColumn("status", F.lit("ACTIVE")).select(*current.columns))


def rebuild_targets(chunks: DataFrame, version: str, after, limit: int) -> DataFrame:
    """The next documents to rebuild to a version, in order of id: those with active children of which none has it."""
    children = chunks.filter("chunk_level = 'CHILD' and status = 'ACTIVE'").groupBy("document_id")
    todo = children.agg(F.count_if(F.col("version") == version).alias("_done")).filter("_done = 0")
    return todo.filter(F.col("document_id") > F.lit(after)).orderBy("document_id").limit(limit).select("document_id")


def rebuild_verified(before: DataFrame, after: DataFrame) -> DataFrame:
    """document_id and verified: whether the rebuilt children of a document hold the same text, white space aside."""
    flat = lambda df: df.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda c: c["content"]), "").alias("t"))
    plain = lambda name: F.regexp_replace(name, r"\s+", "")
    joined = flat(before).withColumnRenamed("t", "a").join(flat(after).withColumnRenamed("t", "b"), "document_id", "left")
    return joined.select("document_id", F.coalesce(plain("a") == plain("b"), F.lit(False)).alias("verified"))


def persist_embeddings(records: DataFrame, targets: DataFrame, vectors: DataFrame, model_key: str) -> DataFrame:
    """records (id, ...) with the vectors of their targets: embedding, search_text, token_count and what was embedded.

    targets has target_type, id, template_version, input_text and search_text, vectors has id and vector. Others stay.
    """
    made = targets.join(vectors, "id").select(
        "id", F.col("vector").alias("_vector"), F.col("search_text").alias("_text"),
        F.to_json(F.struct(F.col("target_type").alias("targetType"), F.col("template_version").alias("embeddingTemplateVersion"), F.sha2("input_text", 256).alias("inputTextHash"), F.lit(model_key).alias("modelKey"))).alias("_meta"),
    )
    words = F.size(F.filter(F.split("_text", r"\s+"), lambda w: w != ""))
    out = records.join(made, "id", "left")
    new = {"embedding": "_vector", "search_text": "_text", "metadata": "_meta"}
    old = {c: F.col(c) if c in records.columns else F.lit(None) for c in (*new, "token_count")}
    kept = {c: F.coalesce(F.col(source), old[c]) for c, source in new.items()}
    kept["token_count"] = F.coalesce(F.when(F.col("_text").isNotNull(), words), old["token_count"])
    return out.withColumns(kept).drop("_vector", "_text", "_meta")


def embed_job(
    groups: dict[str, tuple[DataFrame, DataFrame]], stored: DataFrame, embed: Callable[[DataFrame], DataFrame], model_key: str, generation: Callable[[], str]
) -> tuple[dict[str, DataFrame], str]:
    """Embeds the stale targets of each group (records, targets) and gives the groups' new records and the stage reached.

    All or nothing: vectors are asked for once and written, then counted; where a vector is missing, or the chunks'
    generation is another one by then or after the records are written, nothing changes and the stage is FAILED. Vectors
    that were written are not lost if embed logs them (results.logged_vectors).
    """
    begun = generation()
    unchanged = {name: records for name, (records, _) in groups.items()}
    made = {}
    for name, (_, targets) in groups.items():
        stale = stale_targets(targets, stored, model_key)
        made[name] = stale, materialize(embed(stale.select("id", F.col("input_text").alias("text"))), "vectors")
    lost = any(not stale.join(vectors.filter("vector is not null"), "id", "left_anti").isEmpty() for stale, vectors in made.values())
    if lost or generation() != begun:
        return unchanged, "FAILED"
    written = {name: materialize(persist_embeddings(groups[name][0], stale, vectors, model_key), "records") for name, (stale, vectors) in made.items()}
    return (written, "COMPLETED") if generation() == begun else (unchanged, "FAILED")


def reclassify(documents: DataFrame, where: Column, **values: str | None) -> DataFrame:
    """documents with new space_id, department_id or category_id where the condition holds."""
    if unknown := set(values) - {"space_id", "department_id", "category_id"}:
        raise ValueError(f"no classification: {sorted(unknown)}")
    hit = F.coalesce(where, F.lit(False))
    return documents.withColumns({name: F.when(hit, F.lit(value)).otherwise(F.col(name)) for name, value in values.items()})


def soft_delete(documents: DataFrame, where: Column, at: str) -> DataFrame:
    """documents of which those that match are DELETED as of a date; what was deleted before keeps its date."""
    hit = F.coalesce(where, F.lit(False))
    date = F.when(hit & F.col("deleted_at").isNull(), F.to_date(F.lit(at))).otherwise(F.col("deleted_at"))
    return documents.withColumns({"status": F.when(hit, "DELETED").otherwise(F.col("status")), "deleted_at": date})


def default_switch(records: DataFrame, where: Column, chosen: DataFrame, flag: str = "is_default") -> DataFrame:
    """records of which those that match are the default if their id is in chosen, and not otherwise; the flags of others
    stay. So a group has the chosen default alone after one write."""
    picked = chosen.select("id").distinct().withColumn("_picked", F.lit(True))
    hit = F.coalesce(where, F.lit(False))
    old = F.col(flag) if flag in records.columns else F.lit(False)
    joined = records.join(picked, "id", "left").withColumn(flag, F.when(hit, F.coalesce("_picked", F.lit(False))).otherwise(old))
    return joined.select(*records.columns, *([] if flag in records.columns else [flag]))


def citations(final: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations of each query's evidence in order: query_id, rank, document_id, item_id, title and path of the
    classification, blank parts left out."""
    path = title_path(*(F.coalesce(c, F.lit("")) for c in ("space_id", "department_id", "category_id")))
    named = documents.select(F.col("id").alias("document_id"), "title", path.alias("path"))
    return final.join(named, "document_id").select("query_id", F.col("final_rank").alias("rank"), "document_id", "item_id", "title", "path")


def context_parts(evidence: DataFrame, supplemental: DataFrame, tokens: Callable[[Column], Column], budget: int) -> DataFrame:
    """Evidence, then supplemental parts, of each query while their tokens fit the budget; the first that doesn't ends it.

    Both have query_id, final_rank and content; a query has few rows of either.
    """
    parts = evidence.select("query_id", F.lit(0).alias("part"), "final_rank", F.lit(0).alias("turn"), "content")
    turn = F.row_number().over(Window.partitionBy("query_id", "final_rank").orderBy("content"))
    more = supplemental.select("query_id", F.lit(1).alias("part"), "final_rank", turn.alias("turn"), "content")
    order = Window.partitionBy("query_id").orderBy("part", "final_rank", "turn").rowsBetween(Window.unboundedPreceding, 0)
    running = parts.unionByName(more).withColumn("used", F.sum(tokens(F.col("content"))).over(order))
    return running.filter(F.col("used") <= budget)
