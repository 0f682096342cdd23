"""Joins of spans that overlap, by bins of their length's class: no key's spans are compared all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.retrieval import span_overlap


def _class(length: Column) -> Column:
    """The power of two at or below a length."""
    return F.floor(F.log2(length.cast("double")) + 1e-12).cast("int")


def _bins(start: Column, end: Column, width: Column) -> Column:
    """The bins of a width that a span touches."""
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def overlapping_spans(left: DataFrame, right: DataFrame, share: float = 0.0) -> DataFrame:
    """left_id, right_id and overlap of all pairs of spans (key, id, start, end; ends are exclusive) of one key that overlap
    by `share` of the shorter one or more, and by something.

    The longer span of a pair stands in the bins of its own class, as wide as the power of two at or below its length,
    of which it touches two or three. The shorter one looks into the bins of every class from its own up. So a span has
    rows in proportion to the number of classes, and only spans of one place meet. A pair is taken where both begin, so
    it is made once. Empty spans and null keys or ends overlap nothing.
    """
    known = "key is not null and id is not null and end > start"
    slim = lambda df: df.filter(known).select("key", "id", "start", "end", _class(F.col("end") - F.col("start")).alias("c"))
    sides = slim(left), slim(right)
    tops = [df.agg(F.max("c")).first()[0] for df in sides]
    width = F.pow(F.lit(2.0), F.col("c")).cast("long")

    def owners(df: DataFrame) -> DataFrame:
        return df.select("key", F.struct("id", "start", "end").alias("o"), "c", F.explode(_bins(F.col("start"), F.col("end"), width)).alias("bin"))

    def seekers(df: DataFrame, top: int | None, own: bool) -> DataFrame:
        begin = F.col("c") if own else F.col("c") + 1  # of one class, the left span seeks the right one
        classes = F.explode(F.filter(F.sequence(F.col("c"), F.greatest(F.col("c"), F.lit(top or 0))), lambda x: (x >= begin) & (x <= (top if top is not None else -1))))
        rows = df.select("key", F.struct("id", "start", "end").alias("s"), classes.alias("c"))
        return rows.select("key", "s", "c", F.explode(_bins(F.col("s.start"), F.col("s.end"), width)).alias("bin"))

    def pairs(seeking: DataFrame, owning: DataFrame, left_name: str, right_name: str) -> DataFrame:
        met = seeking.join(owning, ["key", "c", "bin"])
        first = F.floor(F.greatest("s.start", "o.start") / width) == F.col("bin")
        return met.filter(first).select(F.col(f"{left_name}.id").alias("left_id"), F.col(f"{right_name}.id").alias("right_id"), span_overlap(*(F.col(c) for c in ("s.start", "s.end", "o.start", "o.end"))).alias("overlap"))

    a = pairs(seekers(sides[0], tops[1], True), owners(sides[1]), "s", "o")
    b = pairs(seekers(sides[1], tops[0], False), owners(sides[0]), "o", "s")
    return a.unionByName(b).filter((F.col("overlap") > 0) & (F.col("overlap") >= share))
