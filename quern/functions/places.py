"""From places in normalized texts back to places in the original ones, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.scalar import NOT_WHITE, WHITE, let, token_prefix, token_suffix


def segment_map(places: Column) -> Column:
    """The places of a normalized text's characters in the original one (text.normalized_text), as segments in order: at,
    where a segment begins in the normalized text, and from, where it does in the original. Within a segment both go on
    by one, so a text that normalization leaves alone is one segment."""
    begins = F.transform(places, lambda p, i: F.when((i == 0) | (F.get(places, i - 1) != p - 1), F.struct(i.alias("at"), p.alias("from"))))
    return F.filter(begins, lambda s: s.isNotNull())


def original_place(segments: Column, at: Column) -> Column:
    """The place in the original text of a place in the normalized one: binary search in its segments."""

    def step(state: Column, _: Column) -> Column:
        middle = F.ceil((state["low"] + state["high"]) / 2).cast("int")
        right = F.get(segments, middle)["at"] <= at
        return F.struct(F.when(right, middle).otherwise(state["low"]).alias("low"), F.when(right, state["high"]).otherwise(F.greatest(middle - 1, state["low"])).alias("high"))

    start = F.struct(F.lit(0).alias("low"), (F.size(segments) - 1).alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(segments) + F.lit(1.0))).cast("int"))
    return F.aggregate(steps, start, step, lambda s: F.get(segments, s["low"])["from"] + at - F.get(segments, s["low"])["at"])


def original_span(segments: Column, start: Column, end: Column) -> Column:
    """start and end (exclusive) in the original text of a span of the normalized one. The end is where the next character
    begins, so that composed characters and line ends are in it whole."""
    return F.struct(original_place(segments, start).alias("start"), original_place(segments, end).alias("end"))


#: A word and the white space behind it; white space at the beginning.
_UNIT, _LEAD = f"{NOT_WHITE}+{WHITE}*", f"^{WHITE}*"


def place_before_collapse(text: Column, at: Column) -> Column:
    """The place in a text of a place in its collapsed form (scalar.collapsed). A space there is the first white space of
    its run. One pass over the words, with two sums and no list."""
    start = F.struct(F.lit(0).alias("to"), F.length(F.regexp_extract(text, _LEAD, 0)).alias("from"), F.lit(None).cast("int").alias("found"))

    def step(state: Column, unit: Column) -> Column:
        size = F.length(F.regexp_replace(unit, f"{WHITE}+$", "")) + 1
        here = state["found"].isNull() & (at < state["to"] + size)
        return F.struct((state["to"] + size).alias("to"), (state["from"] + F.length(unit)).alias("from"), F.when(here, state["from"] + at - state["to"]).otherwise(state["found"]).alias("found"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(f"({_UNIT})"), 1), start, step, lambda s: s["found"])


def collapsed_span(text: Column, start: Column, end: Column) -> Column:
    """start and end (exclusive) in a text of a span of its collapsed form, without white space at its ends; null where
    nothing else is in it."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", " "))

    def of(part: Column) -> Column:
        first = start + F.length(part) - F.length(F.ltrim(part))
        last = end - (F.length(part) - F.length(F.rtrim(part)))
        span = F.struct(place_before_collapse(text, first).cast("int").alias("start"), (place_before_collapse(text, last - 1) + 1).cast("int").alias("end"))
        return F.when(last > first, span)

    return let(F.substring(flat, start + 1, end - start), of)


def quote_span(text: Column, quote: Column) -> Column:
    """start and end of a quote in a text, white space aside; null where it isn't found or is empty."""
    flat = lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), WHITE + "+", " "))

    def found(own: Column) -> Column:
        at = F.instr(flat(text), own) - 1
        return F.when((own != "") & (at >= 0), collapsed_span(text, at, at + F.length(own)))

    return let(flat(quote), found)


def window_span(parent: Column, child: Column, budget: int) -> Column:
    """start and end in the parent of what scalar.context_window shows of it, with the child's own text between both sides;
    null where the child isn't found."""
    flat = lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), WHITE + "+", " "))

    def around(whole: Column, own: Column) -> Column:
        at = F.when(own == "", 0).otherwise(F.instr(whole, own))
        left, right = F.substring(whole, F.lit(1), at - 1), F.substring(whole, at + F.length(own), F.length(whole))
        start = F.length(left) - F.length(token_suffix(left, budget // 2))
        end = at - 1 + F.length(own) + F.length(token_prefix(right, budget - budget // 2))
        return F.when(at > 0, collapsed_span(parent, start, end))

    return let(flat(parent), lambda whole: let(flat(child), lambda own: around(whole, own)))
