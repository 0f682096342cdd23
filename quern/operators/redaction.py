"""What may be kept of payloads, retrieval snapshots and parameters: allow-lists in place of the given JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields of an item, of filters and of a snapshot that may be kept. They hold no question, text, title
#: or vector.
ITEM_DDL = (
    "qaPairId string, documentId string, chunkId string, parentChunkId string, evidenceId string, evidenceType string, pageNo int, "
    "pageStart int, pageEnd int, rank int, score double, vectorScore double, textScore double, rrfScore double, rerankScore double, "
    "fusedScore double, channelScores map<string, double>, channelRanks map<string, int>"
)
FILTER_DDL = "scopeDocumentIds array<string>, scopeSpaceId string, scopeClassificationDepartmentId string, scopeCategoryId string"
RRF_DDL = "k double, weights map<string, double>"
SNAPSHOT_DDL = (
    "channels array<string>, chunkerConfigHashes array<string>, featureFlags map<string, boolean>, retrievalConfigHash string, "
    f"rrfParameters struct<{RRF_DDL}>, chunkRetrievalDegraded boolean, rerankerDegraded boolean, filters struct<{FILTER_DDL}>, "
    f"latencyMs double, requestId string, stages map<string, array<struct<{ITEM_DDL}>>>"
)
#: Configuration hashes kept of a snapshot.
HASHES = 64


def sanitized_snapshot(snapshot: Column, cap: int) -> Column:
    """A snapshot (JSON) with nothing but the fields of SNAPSHOT_DDL, and the first `cap` items of each stage.

    Reading with a schema is the allow-list: what it doesn't name is gone. What is no object gives {}. Hashes are
    trimmed, sorted and distinct; fields that are null are left out.
    """
    read = F.from_json(snapshot, SNAPSHOT_DDL)
    hashes = F.filter(F.transform(read["chunkerConfigHashes"], lambda h: F.trim(h)), lambda h: h != "")
    kept = read.withField("chunkerConfigHashes", F.slice(F.array_sort(F.array_distinct(hashes)), 1, HASHES))
    kept = kept.withField("stages", F.transform_values(read["stages"], lambda _, items: F.slice(items, 1, cap)))
    return F.coalesce(F.to_json(kept), F.lit("{}"))


def sanitized_item(item: Column) -> Column:
    """One item (JSON), as of a citation, with nothing but the fields of ITEM_DDL."""
    return F.coalesce(F.to_json(F.from_json(item, ITEM_DDL)), F.lit("{}"))


def sanitized_filters(filters: Column) -> Column:
    """Filters (JSON) with nothing but the fields of FILTER_DDL."""
    return F.coalesce(F.to_json(F.from_json(filters, FILTER_DDL)), F.lit("{}"))


def sanitized_parameters(parameters: Column) -> Column:
    """Fusion parameters (JSON): k and the weights that are numbers."""
    read = F.from_json(parameters, RRF_DDL)
    return F.coalesce(F.to_json(read.withField("weights", F.map_filter(read["weights"], lambda _, w: w.isNotNull()))), F.lit("{}"))
