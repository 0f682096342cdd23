"""License scans in DataFrame functions: phrases, and an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import keep, materialize, temporary
from quern.llm.quality import let

#: The phrases whose places are counted, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Least share of a template's distinct words that a block must hold. Below ten words that is all of them.
CONTAINMENT = 0.9
#: Words of all templates at most, as their table is sent to every task.
MAX_WORDS = 20_000
#: Labels and sentences of well-known licenses, one template each.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc-sa-4.0", "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
)

_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Between blocks: the end of a sentence, or an empty line.
_END = r"[.!?;:]+[ \t\n\x0B\f\r]+|\n[ \t\x0B\f\r]*\n"


def lowered(text: Column) -> Column:
    """The text in lower case. Of the letters beyond ASCII only the Kelvin sign would become one of ASCII: it is replaced."""
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))


def spaced(lower: Column) -> Column:
    """The words of a lower-case text with one space between them."""
    return F.btrim(F.regexp_replace(lower, _OTHER, " "))


def words_of(line: Column) -> Column:
    """The words of a spaced text."""
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def blocks_of(lower: Column) -> Column:
    """The blocks of a lower-case text: its sentences."""
    return F.split(lower, _END)


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    """template, label and distinct words of each template."""
    each = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text")) for i, (label, text) in enumerate(templates)]
    rows = spark.range(1).select(F.explode(F.array(*each)).alias("t")).select("t.*")
    return rows.select("template", "label", F.array_distinct(words_of(spaced(lowered(F.col("text"))))).alias("words"))


def _least(size: Column, containment: float) -> Column:
    """Words that a block must share with a template of this size."""
    return F.greatest(F.ceil(size * containment - 1e-9), F.lit(1)).cast("int")


def global_order(words: DataFrame, templates: DataFrame) -> list[str]:
    """The templates' words by how often they are in words (a column `word` over the whole corpus), the rarest first."""
    known = templates.select(F.explode("words").alias("word")).distinct()
    vocabulary = [r["word"] for r in known.limit(MAX_WORDS + 1).collect()]
    if len(vocabulary) > MAX_WORDS:
        raise ValueError(f"templates have over {MAX_WORDS} different words")
    counts = words.filter(F.col("word").isin(*vocabulary)).groupBy("word").agg(F.count("*").alias("n")) if vocabulary else words.limit(0).withColumn("n", F.lit(0))
    found = {r["word"]: r["n"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def ordered(words: Column, order: list[str]) -> Column:
    """Those of the words that some template has, in the global order. Others can't be shared."""
    return F.array_intersect(F.lit(order).cast("array<string>"), words)


def template_matches(blocks: DataFrame, templates: DataFrame, order: list[str], containment: float = CONTAINMENT) -> DataFrame:
    """block, template, label, shared (words) and containment of all pairs in which a block (block, tokens in the global order) holds this
    share of a template's words or more.

    Prefix filter: of a template's words, all but the least number to share less one are its prefix, and a block that
    shares enough holds one of them; so blocks and prefixes are joined on words. Length filter: a block has that many
    template words at least. Positional filter: what follows the shared word in the shorter rest must suffice. The test
    holds for a pair's first common word, so no pair is lost; pairs that pass are counted exactly.
    """
    sides = templates.select("template", "label", ordered(F.col("words"), order).alias("own")).filter(F.size("own") > 0)
    sides = sides.withColumn("least", _least(F.size("own"), containment))
    prefix = F.slice("own", F.lit(1), F.size("own") - F.col("least") + 1)
    keys = sides.select("template", "label", "own", "least", F.posexplode(prefix).alias("i", "word"))
    each = blocks.select("block", "tokens", F.posexplode("tokens").alias("j", "word"))
    rest = F.least(F.size("own") - F.col("i"), F.size("tokens") - F.col("j"))
    met = each.join(F.broadcast(keys), "word")  # at most MAX_WORDS rows: global_order has checked it
    passed = met.filter((F.size("tokens") >= F.col("least")) & (rest >= F.col("least")))
    shared = F.size(F.array_intersect("tokens", "own"))
    held = passed.select("block", "template", "label", shared.alias("shared"), "least", F.size("own").alias("size")).filter("shared >= least")
    return held.groupBy("block", "template", "label").agg(F.max("shared").alias("shared"), (F.max("shared") / F.max("size")).alias("containment"))


def _first_prefix(templates: DataFrame, order: list[str], containment: float) -> tuple[list[str], int]:
    """The words of all prefixes, and the least number of words that any template asks for."""
    own = ordered(F.col("words"), order)
    rows = templates.select(own.alias("own")).filter(F.size("own") > 0).withColumn("least", _least(F.size("own"), containment))
    rows = rows.select("least", F.slice("own", F.lit(1), F.size("own") - F.col("least") + 1).alias("prefix")).collect()
    return sorted({w for r in rows for w in r["prefix"]}), min((r["least"] for r in rows), default=1)


def license_blocks(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, place (of the block in the text, from 0), text (of the block, lower case), template, label and containment:
    every pair of a block and a template that meets the containment."""
    templates = template_table(docs.sparkSession) if templates is None else templates
    texts = docs.select("doc_id", lowered(F.coalesce("text", F.lit(""))).alias("lower"))
    order = global_order(texts.select(F.explode(words_of(spaced(F.col("lower")))).alias("word")), templates)
    prefix, least = _first_prefix(templates, order, containment)
    each = texts.select("doc_id", F.posexplode(blocks_of(F.col("lower"))).alias("place", "text"))
    each = each.withColumn("tokens", ordered(words_of(spaced(F.col("text"))), order)).filter(F.size("tokens") >= least)
    each = each.filter(F.arrays_overlap("tokens", F.lit(prefix).cast("array<string>")))
    rows = each.select(F.struct("doc_id", "place", "text", F.monotonically_increasing_id().alias("row")).alias("block"), "tokens")
    matches = template_matches(rows, templates, order, containment)
    return matches.select("block.doc_id", "block.place", "block.text", "template", "label", "containment")


def _places(phrase: str, n_words: Column):
    """n, first and last: the places of a phrase in words with two spaces between them and one at the ends."""
    apart, size = " " + phrase.replace(" ", "  ") + " ", phrase.count(" ") + 1

    def count(part: Column) -> Column:
        return (F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2

    def places(wide: Column) -> Column:
        n = (F.length(wide) - F.length(F.replace(wide, F.lit(apart), F.lit("")))) / len(apart)
        last = n_words - count(F.substring_index(wide, apart, -1)) - size
        return F.struct(n.cast("long").alias("n"), count(F.substring_index(wide, apart, 1)).cast("long").alias("first"), last.cast("long").alias("last"))

    return places


def _phrases(line: Column, n_words: Column) -> list[Column]:
    """The places of each phrase in words with one space between them; null where there is none."""
    bordered = F.concat(F.lit(" "), line, F.lit(" "))
    wide = F.concat(F.lit(" "), F.replace(line, F.lit(" "), F.lit("  ")), F.lit(" "))
    return [F.when(F.contains(bordered, F.lit(f" {phrase} ")), let(wide, _places(phrase, n_words))) for phrase, _ in PHRASES]


def license_scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of docs.

    n_base counts the places of the PHRASES, first_word and last_word are their least and greatest start. labels adds
    those of templates (template, label, words) that a block of the text meets by the containment, of each block the
    templates that share the most words with it; score is the highest containment of these, 0.0 without one. Null and empty texts have no words and empty labels. Repeated rows and null doc_ids
    are rows like others; an empty table gives none; other columns are not read.

    Two passes over the texts, in functions alone: the words' frequencies over the corpus, pre-aggregated before their
    exchange, and the measures with the blocks that hold a prefix word, few, of which only template words are kept. Equal
    lists of blocks are joined once. The texts are not shuffled.
    """
    spark = docs.sparkSession
    templates = template_table(spark) if templates is None else templates
    lower = lowered(F.coalesce("text", F.lit("")))
    order = global_order(docs.select(F.explode(words_of(spaced(lower))).alias("word")), templates)
    prefix, least = _first_prefix(templates, order, containment)
    prefix_words = F.lit(prefix).cast("array<string>")
    with temporary():
        rows = docs.select("doc_id", lower.alias("lower")).withColumn("line", spaced(F.col("lower"))).withColumn("words", words_of(F.col("line")))
        kept = F.transform(blocks_of(F.col("lower")), lambda b: ordered(words_of(spaced(b)), order))
        kept = F.array_distinct(F.filter(kept, lambda b: (F.size(b) >= least) & F.arrays_overlap(b, prefix_words)))
        blocks = F.when(F.arrays_overlap("words", prefix_words), kept)
        n_words = F.size("words").cast("long")
        rows = rows.select("doc_id", n_words.alias("n_words"), F.array(*_phrases(F.col("line"), n_words)).alias("found"), blocks.alias("blocks"))
        rows = materialize(rows.withColumn("blocks", F.when(F.size("blocks") > 0, F.col("blocks"))), "measures")
        lists = rows.filter("blocks IS NOT NULL").select("blocks").distinct()
        each = lists.select("blocks", F.explode("blocks").alias("tokens"))
        matches = materialize(template_matches(each.select(F.col("tokens").alias("block"), "tokens").distinct(), templates, order, containment), "matches")
        most = F.max("shared").over(Window.partitionBy("block"))
        best = matches.withColumn("most", most).filter("shared = most").groupBy("block").agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
        named = each.join(best, each["tokens"] == best["block"]).groupBy("blocks")
        named = materialize(named.agg(F.array_distinct(F.flatten(F.collect_list("more"))).alias("more"), F.max("score").alias("score")), "named")
        plain = rows.filter("blocks IS NULL").select("doc_id", "n_words", "found", F.lit(None).cast("array<string>").alias("more"), F.lit(None).cast("double").alias("score"))
        met = rows.filter("blocks IS NOT NULL").join(named, "blocks", "left").select(*plain.columns)
        places = F.filter("found", lambda x: x.isNotNull())
        none = F.array().cast("array<string>")
        base = F.filter(F.array(*(F.when(F.get("found", F.lit(i)).isNotNull(), label) for i, (_, label) in enumerate(PHRASES))), lambda x: x.isNotNull())
        label_list = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
        out = plain.unionByName(met).select(
            "doc_id",
            "n_words",
            F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
            F.array_min(F.transform(places, lambda x: x["first"])).alias("first_word"),
            F.array_max(F.transform(places, lambda x: x["last"])).alias("last_word"),
            label_list(base).alias("base_labels"),
            label_list(F.concat(base, F.coalesce("more", none))).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
        return keep(out, "licenses")


def license_sql() -> str:
    """The same rows in DuckDB SQL: every sentence against every template."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    fold = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda c: f"regexp_extract_all({c}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    phrases = ", ".join(f"({p.split(' ')!r}, {quoted(label)})" for p, label in PHRASES)
    templates = ", ".join(f"({i}, {quoted(label)}, {quoted(text)})" for i, (label, text) in enumerate(TEMPLATES))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {fold("coalesce(text, '')")} AS t FROM documents),
    w AS (SELECT r, doc_id, t, {words("t")} AS ws FROM d),
    ph(ps, label) AS (VALUES {phrases}),
    hit AS (SELECT r, i, label FROM (SELECT r, ws, unnest(range(len(ws))) AS i FROM w WHERE len(list_intersect(ws, ['license', 'cc'])) > 0), ph
            WHERE ws[i + 1] = ps[1] AND ws[i + 1:i + len(ps)] = ps),
    base AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, array_to_string(list_sort(list_distinct(list(label))), ',') AS ls, list(label) AS raw FROM hit GROUP BY r),
    tp AS (SELECT k, label, list_distinct({words(fold("x"))}) AS own FROM (VALUES {templates}) v(k, label, x)),
    s AS (SELECT r, row_number() OVER () AS k, list_distinct({words("b")}) AS ts FROM
          (SELECT r, unnest(regexp_split_to_array(t, '[.!?;:]+[ \\t\\n\\x0B\\f\\r]+|\\n[ \\t\\x0B\\f\\r]*\\n')) AS b FROM d)),
    m AS (SELECT r, s.k, label, len(list_intersect(ts, own)) AS shared, len(own) AS size FROM s, tp),
    e AS (SELECT *, max(shared) OVER (PARTITION BY k) AS most FROM m WHERE shared >= greatest(1, ceil(size * {CONTAINMENT} - 1e-9))),
    g AS (SELECT r, list(label) AS raw, max(shared / size) AS score FROM e WHERE shared = most GROUP BY r)
    SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(ls, '') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(base.raw, []), coalesce(g.raw, [])))), ',') AS labels, coalesce(g.score, 0.0) AS score
    FROM w LEFT JOIN base USING (r) LEFT JOIN g USING (r)
    """
