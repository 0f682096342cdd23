"""Line-first quality rules in DataFrame functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import quoted

#: The white space between words, the characters counted as symbols.
BLANKS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: Punctuation: a line fails if more than MAX_PUNCTUATION percent of its characters are of these.
PUNCTUATION, MAX_PUNCTUATION = "!?#*$%&|<>=+~^_@/\\{}[];:.,", 12
#: A line of fewer than SHORT_LINE words fails without one of these at its end.
TERMINAL, SHORT_LINE = ".!?:;\"')]}»”’…。！？", 10
#: Navigation: a line fails if it has two or more of these as words of their own, or one in four words is one.
SEPARATORS = ("|", ">", ">>", "»", "•", "·", "→", "/", "-", "—")
#: Boilerplate: a line of fewer than BOILERPLATE_WORDS words with one of these phrases fails.
BOILERPLATE_WORDS = 25
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "javascript", "click here",
    "read more", "sign up", "log in", "subscribe to", "share this", "powered by", "licensed under", "released under the",
    "alle rechte vorbehalten", "datenschutz", "impressum", "nutzungsbedingungen", "mehr lesen", "jetzt anmelden",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "en savoir plus",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "leer más",
)
#: A document whose lines left hold under this percentage of its word characters is rejected.
MIN_LEFT = 60


def let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def split_words(text: Column) -> Column:
    """The words of a text: runs of characters other than blanks."""
    return let(trimmed(text), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \t\n\x0b\f\r]+")))


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, ""))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the text."""

    def covered(windows: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            return (F.get(windows, k - 1)["h"] == x["h"]) | (F.get(windows, k + 1)["h"] == x["h"])

        flagged = F.transform(windows, lambda x, k: F.when(twice(x, k), x["i"]))
        places = F.array_sort(F.filter(flagged, lambda x: x.isNotNull()))
        start = F.struct(F.lit(-1).alias("stop"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct((i + 3).alias("stop"), (a["n"] + i + 3 - F.greatest(a["stop"], i)).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def windows(hashes: Column) -> Column:
        window = lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), window)

    def count(keys: Column) -> Column:
        ordered = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(let(ordered, covered))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(hashed, count))


def has_phrase(text: Column) -> Column:
    """True if a boilerplate phrase is in the text, letter case aside."""
    return let(F.lower(text), lambda low: reduce(or_, (F.contains(low, F.lit(p)) for p in BOILERPLATE)))


def _breaks_rule(text: Column, phrases: Column) -> Column:
    """Whether a trimmed line breaks a rule. phrases: false where no line of its text holds a boilerplate phrase."""

    def rules(words: Column) -> Column:
        marks = F.length(text) - F.length(F.translate(text, PUNCTUATION, ""))
        separators = F.size(F.filter(words, lambda w: w.isin(*SEPARATORS)))
        n = F.size(words)
        punctuation = (100 * marks > MAX_PUNCTUATION * word_chars(text)) & (marks > 1)
        unended = (n < SHORT_LINE) & ~F.substring(text, -1, 1).isin(*TERMINAL)
        navigation = (separators >= 2) | (4 * separators >= n)
        return punctuation | unended | navigation | (phrases & (n < BOILERPLATE_WORDS) & has_phrase(text))

    return let(F.split(text, "[ \t\n\x0b\f\r]+"), rules)


def line_fails(line: Column) -> Column:
    """True if a line with words breaks the punctuation, navigation or boilerplate rule."""
    return let(trimmed(line), lambda text: _breaks_rule(text, F.lit(True)))


def judged_lines(text: Column) -> Column:
    """Each line of a text as a struct: x, blank and fails. A line is trimmed and split once, and phrases are looked for
    in the whole text first: most texts have none, so their lines are not searched, however long the list is."""

    def judged(line: Column, phrases: Column) -> Column:
        def of(bare: Column) -> Column:
            blank = bare == ""
            return F.struct(line.alias("x"), blank.alias("blank"), (~blank & _breaks_rule(bare, phrases)).alias("fails"))

        return let(trimmed(line), of)

    return let(has_phrase(text), lambda phrases: F.transform(F.split(text, "\n"), lambda x: judged(x, phrases)))


def quality_columns(text: Column, with_text: bool = False) -> Column:
    """All measures of a text as a struct, and with `with_text` the text of its kept lines. Null counts as empty."""

    def measured(t: Column) -> Column:
        def by_words(words: Column) -> Column:
            def by_lines(lines: Column) -> Column:
                with_words = F.transform(F.filter(lines, lambda x: ~x["blank"]), lambda x: x["x"])
                duplicate = let(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x)))
                left = F.filter(lines, lambda x: ~x["blank"] & ~x["fails"])
                measures = [
                    F.size(words).cast("long").alias("n_words"),
                    word_chars(t).cast("long").alias("word_chars"),
                    (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                    duplicate.cast("long").alias("n_dup_lines"),
                    repeated_words(words).alias("n_repeat_words"),
                    F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + word_chars(x["x"])).alias("chars_left"),
                ]
                kept = F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["x"])
                return F.struct(*measures, *([F.array_join(kept, "\n").alias("text")] if with_text else []))

            return let(judged_lines(t), by_lines)

        return let(split_words(t), by_words)

    return let(F.coalesce(text, F.lit("")), measured)


def _verdict() -> tuple[Column, Column]:
    failed = (F.col("_q.n_words") < 50) | (100 * F.col("_q.n_repeat_words") > 50 * F.col("_q.n_words"))
    return failed, ~failed & (100 * F.col("_q.chars_left") >= MIN_LEFT * F.col("_q.word_chars"))


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, and their texts without failing lines.

    Null and empty texts go. Repeated rows and null doc_ids are rows like others; an empty table gives an empty table.
    Lines without words stay with the rest. Each line is judged once: exploding an array of one struct keeps the
    optimizer from working the measures out again for the filter.
    """
    measured = F.explode(F.array(quality_columns(docs["text"], with_text=True))).alias("_q")
    judged = docs.select(F.struct(*(docs[quoted(c)] for c in docs.columns if c != "text")).alias("_row"), measured).filter(_verdict()[1])
    return judged.select(*(F.col("_q.text") if c == "text" else F.col(f"_row.{quoted(c)}") for c in docs.columns))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and chars_left.

    A document fails at the base with under 50 words or with over half of its words in repeated windows. Otherwise its
    lines are judged one by one, failing lines are removed, and it is kept if the rest holds at least MIN_LEFT percent
    of its word characters. Null and empty texts fail at the base. Repeated rows and null doc_ids give rows of their own;
    an empty table gives none; other columns are not read. No shuffle, no Python: one pass over the text.
    """
    failed, kept = _verdict()
    judged = docs.select("doc_id", quality_columns(docs["text"]).alias("_q"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *(F.col(f"_q.{c}") for c in base), failed.alias("base_failed"), kept.alias("kept"), "_q.chars_left"
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql() -> str:
    """The same rows in DuckDB SQL."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    words = r"'[^\x20\x09-\x0D]+'"
    listed = lambda xs: ", ".join(map(_quoted, xs))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, regexp_extract_all(t, {words}) AS ws FROM d),
    p AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
          FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    g AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM p) WHERE n > 1),
    rep AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) v(k) GROUP BY r),
    l AS (SELECT r, trim(x, {blanks}) AS s, x FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)),
    m AS (SELECT r, x, s, regexp_extract_all(s, {words}) AS ws, length(translate(s, {blanks}, '')) AS chars,
                 length(s) - length(translate(s, {_quoted(PUNCTUATION)}, '')) AS marks FROM l WHERE s <> ''),
    j AS (SELECT *, len(list_filter(ws, lambda y: y IN ({listed(SEPARATORS)}))) AS seps FROM m),
    f AS (SELECT r, x, chars, (100 * marks > {MAX_PUNCTUATION} * chars AND marks > 1)
                 OR (len(ws) < {SHORT_LINE} AND right(s, 1) NOT IN ({listed(TERMINAL)}))
                 OR seps >= 2 OR 4 * seps >= len(ws)
                 OR (len(ws) < {BOILERPLATE_WORDS} AND regexp_matches(lower(s), {_quoted("|".join(BOILERPLATE))})) AS bad FROM j),
    s AS (SELECT r, count(*) - count(DISTINCT x) AS dup, coalesce(sum(chars) FILTER (NOT bad), 0) AS chars_left FROM f GROUP BY r),
    b AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(t, {blanks}, '')) AS BIGINT) AS word_chars,
                 CAST(length(t) - length(translate(t, {_quoted(SYMBOLS)}, '')) AS BIGINT) AS n_symbols,
                 CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
                 CAST(coalesce(chars_left, 0) AS BIGINT) AS chars_left
          FROM w LEFT JOIN s USING (r) LEFT JOIN rep USING (r)),
    e AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND 100 * chars_left >= {MIN_LEFT} * word_chars AS kept, chars_left FROM e
    """
