"""Connected components of a distributed graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize, release


def _signature(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("high", "low").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(mixed)).first())


def _step(edges: DataFrame) -> DataFrame:
    """One large star and one small star: nodes come to hang on smaller ones, components stay as they are."""
    both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).union(edges.select("low", "high"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
    least = large.groupBy("high").agg(F.min("low").alias("m"))
    kept = large.join(least, "high").filter("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return kept.union(least.select("high", F.col("m").alias("low"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node in links (columns a and b, any comparable type).

    Only nodes with a link to another are returned. Every round is written to shared storage, so a lost executor costs
    one round, and the one before is removed. Rounds grow with the logarithm of a component's diameter; minima are pre-aggregated, so a node with very
    many links does not gather them.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    edges = materialize(edges, "links")
    seen = _signature(edges)
    while seen[0]:
        before, edges = edges, materialize(_step(edges), "links")
        release(before)
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(roots)
