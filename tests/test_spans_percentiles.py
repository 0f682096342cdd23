"""Span joins and percentiles against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators import indexing, percentiles
from quern.operators.filters import over_input_limit, upload_error
from quern.operators.percentiles import exact_percentiles
from quern.operators.spans import overlapping_spans

SPANS = "key string, id long, start long, `end` long"


def brute_pairs(left, right, share):
    out = set()
    for ka, a, s, e in left:
        for kb, b, x, y in right:
            if None not in (ka, kb, s, e, x, y) and ka == kb and e > s and y > x:
                overlap = max(0, min(e, y) - max(s, x)) / min(e - s, y - x)
                if overlap > 0 and overlap >= share:
                    out.add((a, b, round(overlap, 9)))
    return out


@pytest.mark.parametrize("share", [0.0, 0.8])
def test_span_join(spark, share):
    draw = random.Random(3)

    def spans(n, longest):
        rows = []
        for i in range(n):
            start = draw.randrange(-50, 3000)
            rows.append((draw.choice("ab"), i, start, start + draw.choice([0, 1, 2, 3, 7, 8, 9, 64, draw.randrange(1, longest)])))
        return rows + [("a", n, 5, 5), ("a", n + 1, 9, 3), (None, n + 2, 0, 9), ("a", n + 3, None, 9), ("a", n + 4, 0, None), ("c", n + 5, 0, 1), ("b", n + 6, 0, 4096)]

    left, right = spans(150, 700), spans(120, 40)
    for a, b in ((left, right), (right, left), (left, left)):
        got = overlapping_spans(spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS), share).collect()
        assert len(got) == len({(r.left_id, r.right_id) for r in got})
        assert {(r.left_id, r.right_id, round(r.overlap, 9)) for r in got} == brute_pairs(a, b, share)
    none = spark.createDataFrame([], SPANS)
    assert overlapping_spans(none, none).count() == 0 and overlapping_spans(none, spark.createDataFrame(left, SPANS)).count() == 0


def test_span_join_of_many_spans_in_one_key_compares_neighbours_only(spark):
    n = 20_000
    spans = spark.range(n).select(F.lit("k").alias("key"), "id", (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 12).alias("end"))
    assert overlapping_spans(spans, spans).count() == n + 2 * (n - 1)
    big = spark.createDataFrame([("k", -1, 0, n * 10 + 2)], SPANS)
    assert overlapping_spans(big, spans, 1.0).count() == n


@pytest.mark.parametrize("bins", [1024, 2, 3])
def test_percentiles(spark, monkeypatch, bins):
    monkeypatch.setattr(percentiles, "BINS", bins)
    draw = random.Random(bins)
    rows = [("g", draw.paretovariate(0.5)) for _ in range(300)] + [("h", float(draw.randrange(5))) for _ in range(200)] + [("one", 3.5), ("same", 2.0), ("same", 2.0), ("two", -1.0), ("two", 4.0)]
    rows += [(None, 1.0), (None, 1e300), (None, -1e300), ("none", None), ("h", None), ("tiny", 1e-300), ("tiny", 2e-300), ("tiny", 1.0)]
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in exact_percentiles(frame, ["k"], "v", shares).collect()}
    assert set(got) == {k for k, _ in rows} and got["none"].p50 is None
    for k, r in got.items():
        values = [v for name, v in rows if name == k and v is not None]
        for name, share in shares.items():
            if values:
                assert r[name] == pytest.approx(float(np.percentile(values, 100 * share)), rel=1e-12)
    assert exact_percentiles(frame.limit(0), ["k"], "v", shares).count() == 0


def test_flags_limits_and_sections(spark):
    records = spark.createDataFrame([(1, "m", True), (2, "m", False), (3, "n", True), (None, "m", True)], "id int, kind string, is_default boolean")
    chosen = spark.createDataFrame([(2,), (2,)], "id int")
    got = {(r.id, r.kind): r.is_default for r in indexing.default_switch(records, F.col("kind") == "m", chosen).collect()}
    assert got == {(1, "m"): False, (2, "m"): True, (3, "n"): True, (None, "m"): False}
    files = spark.createDataFrame([("CSV", 5), ("CSV", 50), ("EXE", 1), (None, 1), ("CSV", None)], "t string, n int")
    assert [r.e for r in files.select(upload_error(F.col("t"), F.col("n"), ("CSV",), 10).alias("e")).collect()] == [None, "TOO_LARGE", "UNSUPPORTED_TYPE", "UNSUPPORTED_TYPE", "TOO_LARGE"]
    texts = spark.createDataFrame([("a b c",), ("a",), (None,)], "t string")
    assert [r.o for r in texts.select(over_input_limit(F.col("t"), S.token_count, 2).alias("o")).collect()] == [True, False, False]
    assert spark.range(1).select(S.evidence_section(F.lit(3), F.lit("q"), F.lit("a"))).first()[0] == "[3] Q: q\nA: a"
    text = indexing.embedding_text(F.lit("d"), F.lit(" "), F.lit(None).cast("string"), F.lit("body"))
    assert spark.range(1).select(text).first()[0] == "Document: d\nbody"
