"""Spark sessions with the settings that the plans here are written for."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of one Arrow batch handed to Python. Texts are whole documents, so few rows fill a batch.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, as they may not have it on their path."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="quern-package-")
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def session(app: str = "quern", **conf: str) -> SparkSession:
    """The current session, or one in UTC with adaptive execution. Keyword names use __ for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """The session's settings that results and the memory of Python workers depend on. Every query of this package sets
    them, and they stay: Spark reads them when a plan runs, not when it is made."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark
