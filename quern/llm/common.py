"""Helpers shared by the training-data operators: Arrow maps, record batches, raw files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.session import configure, ship
from quern.storage import keep, materialize, release, scratch, shared_dir, temporary

__all__ = ["arrow_map", "batch_of", "keep", "materialize", "open_store", "quoted", "release", "scratch", "shared_dir", "temporary", "texts_of"]


def arrow_map(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow with batches bounded in rows and bytes, as configure sets them."""
    ship(configure(df.sparkSession))
    return df.mapInArrow(function, schema)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch from Python lists or numpy arrays in the order of schema."""
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def quoted(name: str) -> str:
    """A column name for use in column expressions and type strings."""
    return f"`{name.replace('`', '``')}`"


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def open_store(uri: str):
    """The Arrow file system and the path in it for a URI of the shared folder."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    return fs.FileSystem.from_uri(uri)
