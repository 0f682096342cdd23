"""Places in normalized texts and in the original ones."""

import random
import unicodedata

from pyspark.sql import functions as F

from quern.functions import places as P
from quern.functions import scalar as S
from quern.functions.text import normalized_text


def texts(n=60):
    draw = random.Random(5)
    alphabet = ["a", "b", "word", "é", "é", "\r\n", "\n", " ", "  ", " ", "　", "\t", "中", "\U0001f600", "한", "한", "---"]
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(n)] + ["", "   ", "one", None]


def test_normalized_places_by_binary_search(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    frame = spark.createDataFrame(rows, "id int, t string").withColumn("n", normalized_text(F.col("t"))).filter("length(n.text) > 0")
    frame = frame.select("id", "t", "n", P.segment_map(F.col("n.places")).alias("s")).select("*", F.explode(F.sequence(F.lit(0), F.length("n.text") - 1)).alias("at"))
    got = frame.select("id", "t", "n", "at", P.original_place(F.col("s"), F.col("at")).alias("place"), P.original_span(F.col("s"), F.col("at"), F.length("n.text")).alias("span"), F.size("s").alias("size")).collect()
    assert len(got) > 300
    for r in got:
        assert r.place == r.n.places[r.at] and r.span.start == r.place
        part = unicodedata.normalize("NFC", r.t[r.span.start : r.span.end].replace("\r\n", "\n"))
        assert r.n.text[r.at :].startswith(part[:1]) and r["size"] <= len(r.n.places)


def test_collapsed_places_and_quotes(spark):
    draw = random.Random(6)
    rows = []
    for t in texts(120):
        flat = " ".join((t or "").split())
        a = draw.randrange(len(flat) + 1)
        b = draw.randrange(a, len(flat) + 1)
        rows.append((t, flat[a:b], a, b))
    frame = spark.createDataFrame(rows, "t string, q string, a int, b int")
    got = frame.select("*", S.collapsed(F.col("t")).alias("flat"), P.collapsed_span(F.col("t"), F.col("a"), F.col("b")).alias("span"), P.quote_span(F.col("t"), F.col("q")).alias("found")).collect()
    for r in got:
        wanted = r.flat[r.a : r.b].strip()
        assert (r.span is None) == (not wanted) and (r.found is None) == (not wanted)
        if wanted:
            assert " ".join(r.t[r.span.start : r.span.end].split()) == wanted and not r.t[r.span.start].isspace() and not r.t[r.span.end - 1].isspace()
            assert " ".join(r.t[r.found.start : r.found.end].split()) == wanted
    (none,) = spark.sql("select 'a b' t, 'c' q").select(P.quote_span(F.col("t"), F.col("q")).alias("s")).collect()
    assert none.s is None


def test_windows_carry_their_span(spark):
    parent = " one　two three\n\nfour  five six\tseven eight "
    frame = spark.createDataFrame([(parent, "four five", 4), (parent, "one", 2), (parent, "eight", 100), (parent, "nine", 4), (parent, "", 4), (None, "x", 4)], "p string, c string, b int")
    for budget in (2, 4, 100):
        own = frame.filter(F.col("b") == budget) if budget != 4 else frame.filter("b = 4")
        for r in own.select("p", "c", S.context_window(F.col("p"), F.col("c"), budget).alias("w"), P.window_span(F.col("p"), F.col("c"), budget).alias("s")).collect():
            if r.s is None:
                assert r.w == ""
            else:
                shown = " ".join(r.p[r.s.start : r.s.end].split())
                assert " ".join(shown.replace(r.c, " ", 1).split()) == r.w
