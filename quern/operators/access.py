"""Who may see what: base filters, access rules, and the validity of chunks and question-answer pairs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    """The caller of a query."""

    tenant_id: str
    user_id: str = ""
    department_ids: tuple[str, ...] = ()
    role_ids: tuple[str, ...] = ()
    is_admin: bool = False


@dataclass(frozen=True)
class Scope:
    """An optional part of the classification. A department needs its space, and a category both."""

    space: str | None = None
    department: str | None = None
    category: str | None = None
    document_ids: frozenset | None = field(default=None)

    def __post_init__(self) -> None:
        if self.department and not self.space:
            raise ValueError("a department needs a knowledge space")
        if self.category and not (self.space and self.department):
            raise ValueError("a category needs a knowledge space and a department")


def live_documents(documents: DataFrame, tenant_id: str, scope: Scope | None = None) -> DataFrame:
    """READY documents of a tenant that are not deleted, within the scope. An empty set of ids matches nothing."""
    out = documents.filter((F.col("tenant_id") == tenant_id) & (F.col("status") == "READY") & F.col("deleted_at").isNull())
    for column, value in (() if scope is None else (("space_id", scope.space), ("department_id", scope.department), ("category_id", scope.category))):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if scope is not None and scope.document_ids is not None:
        out = out.filter(F.col("id").isin(*scope.document_ids) if scope.document_ids else F.lit(False))
    return out


def rule_matches(principal: Principal) -> Column:
    """True on access rules that admit the principal."""
    kind, subject = F.col("subject_type"), F.col("subject_id")
    return (
        (kind == "ALL_AUTHENTICATED")
        | ((kind == "DEPARTMENT") & subject.isin(*principal.department_ids))
        | ((kind == "ROLE") & subject.isin(*principal.role_ids))
        | ((kind == "USER") & (subject == principal.user_id))
    )


def visible_documents(documents: DataFrame, rules: DataFrame, principal: Principal, scope: Scope | None = None) -> DataFrame:
    """Live documents that some rule opens to the principal. A semi join: several matching rules give one row."""
    live = live_documents(documents, principal.tenant_id, scope)
    if principal.is_admin:
        return live
    admitted = rules.filter(rule_matches(principal)).select(F.col("document_id").alias("id"))
    return live.join(admitted, "id", "left_semi")


def live_chunks(chunks: DataFrame) -> DataFrame:
    """ACTIVE child chunks whose parent, if they name one, is an ACTIVE parent of the same document."""
    parents = chunks.filter("chunk_level = 'PARENT' and status = 'ACTIVE'").select(
        F.col("chunk_id").alias("parent_chunk_id"), F.col("document_id").alias("parent_document")
    )
    children = chunks.filter("chunk_level = 'CHILD' and status = 'ACTIVE'")
    same = (children["parent_chunk_id"] == parents["parent_chunk_id"]) & (children["document_id"] == parents["parent_document"])
    held = children.join(parents, same, "left_semi")
    return held.unionByName(children.filter("parent_chunk_id is null"))


def live_pairs(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """ACTIVE question-answer pairs without a chunk, or with a live one."""
    active = pairs.filter("status = 'ACTIVE'")
    valid = live_chunks(chunks).select("chunk_id")
    return active.join(valid, "chunk_id", "left_semi").unionByName(active.filter("chunk_id is null"), allowMissingColumns=True)


def document_filter(
    documents: DataFrame,
    keyword: str | None = None,
    file_type: str | None = None,
    status: str | None = None,
    updated_from: str | None = None,
    updated_to: str | None = None,
    unclassified: bool = False,
) -> DataFrame:
    """Documents by any of the list's criteria."""
    out = documents.filter(F.col("deleted_at").isNull())
    if keyword:
        out = out.filter(F.col("title").ilike(f"%{keyword}%") | F.col("file_name").ilike(f"%{keyword}%"))
    if file_type:
        out = out.filter(F.col("file_type") == file_type.upper())
    if status:
        out = out.filter(F.col("status") == status.upper())
    if updated_from:
        out = out.filter(F.col("updated_at") >= F.to_timestamp_ntz(F.lit(updated_from)))
    if updated_to:
        out = out.filter(F.col("updated_at") <= F.to_timestamp_ntz(F.lit(updated_to)))
    return out.filter(F.col("category_id").isNull()) if unclassified else out


def duplicate_uploads(documents: DataFrame) -> DataFrame:
    """Live documents whose checksum another live document of the tenant has. Counted, not paired."""
    live = documents.filter(F.col("deleted_at").isNull())
    often = live.groupBy("tenant_id", "checksum").count().filter("count > 1").select("tenant_id", "checksum")
    return live.join(often, ["tenant_id", "checksum"], "left_semi")


def expanded_roles(users: DataFrame, grants: DataFrame, group: str) -> DataFrame:
    """user_id with the roles and permissions of the user's group, each once and in order; null where there are none. users
    has user_id and group, grants has group, role and permission (null for a role without one).

    A group's lists are made and sorted once, before users multiply them: groups are few, so their rows are broadcast. Each
    user's row may be as long as all permissions, so the users, short until then, are dealt to all tasks first.
    """
    sorted_set = lambda name: F.when(F.count(name) > 0, F.array_sort(F.collect_set(name))).alias(f"{name}s")
    lists = grants.groupBy(group).agg(sorted_set("role"), sorted_set("permission"))
    parts = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return users.repartition(parts, "user_id").join(F.broadcast(lists), group).select("user_id", "roles", "permissions")
