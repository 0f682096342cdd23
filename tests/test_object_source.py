"""The data source of objects: pushed filters, commits, and jobs that fail."""

import pytest
from pyspark.sql import functions as F

from quern.sources import objects


def test_objects_are_written_whole_and_read_by_pushed_filters(spark, tmp_path):
    objects.register(spark)
    path = str(tmp_path / "store")
    read = lambda **o: spark.read.format(objects.NAME).option("path", path).options(**o).load()
    assert read().count() == 0
    rows = spark.createDataFrame([(f"{d}/{i}.bin", bytes([i]) * i) for d in ("a", "b") for i in range(20)] + [("c.bin", None)], "key string, data binary").repartition(3)
    rows.write.format(objects.NAME).option("path", path).mode("append").save()
    got = {r.key: (r.size, bytes(r.data)) for r in read().collect()}
    assert len(got) == 41 and got["b/7.bin"] == (7, b"\7" * 7) and got["c.bin"] == (0, b"")
    one = read().filter("key = 'a/3.bin'")
    assert [bytes(r.data) for r in one.collect()] == [b"\3" * 3]
    shown = lambda df: spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(key,a/3.bin)]" in shown(one)
    part = shown(read().filter("key like 'b/%' and size > 3"))
    assert "PushedFilters: [StringStartsWith(key,b/)]" in part and "StartsWith(key" not in part.split("Condition")[1]
    assert read().filter(F.col("key").startswith("b/")).count() == 20 and read().filter("key in ('a/1.bin', 'b/2.bin', 'no')").count() == 2
    assert read().filter("key like 'a/%' and size > 17").count() == 2
    assert read(keysOnly="true").filter("data is null").count() == 41
    rows.limit(2).write.format(objects.NAME).option("path", path).mode("append").save()
    assert read().count() == 43
    rows.filter("key = 'c.bin'").write.format(objects.NAME).option("path", path).mode("overwrite").save()
    assert [r.key for r in read().collect()] == ["c.bin"]


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    objects.register(spark)
    path = tmp_path / "store"
    good = spark.createDataFrame([("x", b"1")], "key string, data binary")
    good.write.format(objects.NAME).option("path", str(path)).mode("append").save()
    bad = spark.createDataFrame([(f"k{i}", b"2") for i in range(30)] + [("../out", b"3")], "key string, data binary").repartition(4)
    with pytest.raises(Exception, match="is no key"):
        bad.write.format(objects.NAME).option("path", str(path)).mode("append").save()
    assert [r.key for r in spark.read.format(objects.NAME).option("path", str(path)).load().collect()] == ["x"]
    assert len(list((path / "_commits").iterdir())) == 1 and not (tmp_path / "out").exists()
    assert len(list((path / "parts").iterdir())) == 1
