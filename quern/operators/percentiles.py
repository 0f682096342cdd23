"""Exact percentiles of groups of any size by histograms that are refined, so that no task holds a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import materialize

#: Bins of one pass.
BINS = 1024


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and a column for each of shares: the percentile of value with linear interpolation at (n - 1) * share.

    Equal values are counted first, dealt by key and value. Each rank that is asked for begins with its group's least and
    greatest value; a pass counts the values between in BINS bins and goes on with the bin that holds the rank, until
    that is one value. A pass sends the bins' counts, pre-aggregated, however large a group is. Null values don't count;
    a group without others gives nulls; keys may be null.
    """
    wanted = [F.struct(F.lit(name).alias("name"), F.lit(float(share)).alias("share")) for name, share in shares.items()]
    counted = materialize(rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")), "counted")
    groups = counted.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    place = (F.col("_all") - 1) * F.col("_w.share")
    each = groups.select("*", F.explode(F.array(*wanted)).alias("_w")).select(*keys, F.col("_w.name").alias("_name"), place.alias("_place"), "_lo", "_hi", "_all")
    ranks = each.select("*", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))).alias("_rank"))
    state = materialize(ranks.select(*keys, "_name", "_place", "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below")), "ranks")
    found = []
    while True:
        found.append(state.filter("_lo = _hi"))
        state = state.filter("_lo < _hi")
        if state.isEmpty():
            break
        state = materialize(_refined(state, counted, keys), "ranks")
    whole = reduce(DataFrame.unionByName, found)
    low, high = F.min("_lo"), F.max("_lo")
    fraction = F.max(F.col("_place") - F.floor("_place"))
    values = whole.groupBy(*keys, "_name").agg((low + (high - low) * fraction).alias("_p"))
    wide = values.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == name, F.col("_p"))).alias(name) for name in shares))
    same = reduce(lambda a, b: a & b, (F.col(f"_k.{k}").eqNullSafe(F.col(k)) for k in keys), F.lit(True))
    every = rows.select(F.struct(*keys).alias("_k")).distinct() if keys else None
    return wide if every is None else every.join(wide, same, "left").select(*(F.col(f"_k.{k}").alias(k) for k in keys), *shares)


def _refined(state: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Each rank's bounds and the number of values below them, one pass on."""
    own = state.select(*(F.col(k).alias(f"_s_{k}") for k in keys), *(c for c in state.columns if c not in keys))
    same = reduce(lambda a, b: a & b, (F.col(f"_s_{k}").eqNullSafe(F.col(k)) for k in keys), F.lit(True))
    met = counted.join(own, same & F.col("_v").between(F.col("_lo"), F.col("_hi")))
    at = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS), F.lit(BINS - 1)).cast("int")
    names = [*(f"_s_{k}" for k in keys), "_name", "_place", "_rank", "_below"]
    bins = met.groupBy(*names, at.alias("_bin")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    one = Window.partitionBy(*names).orderBy("_bin")
    upto = F.sum("_n").over(one.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_below")
    holding = bins.withColumn("_upto", upto).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
    return holding.select(*(F.col(f"_s_{k}").alias(k) for k in keys), "_name", "_place", "_rank", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_below"))
