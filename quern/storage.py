"""Tables in the folder that the driver and all executors share, which cut lineage so that a lost executor costs a task."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: list[tuple[SparkSession, str]] = []
#: The tables of each open block of temporary(), innermost last.
_blocks: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("blocks", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is set only where it is unset, on a local master."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quern-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one. It is removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quern-{uuid.uuid4().hex}/{name}"
    if not _scratch:
        atexit.register(_clear)
    _scratch.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path).getParent()
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def _clear() -> None:
    for spark, path in _scratch:
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone already
            return


def _write(df: DataFrame, name: str, blocks: tuple[list[DataFrame], ...], **options: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_path = path  # for release
    if blocks:
        blocks[-1].append(out)
    return out


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again, so that a lost executor costs no recomputation. options are those
    of the writer."""
    return _write(df, name, _blocks.get(), **options)


def keep(df: DataFrame, name: str) -> DataFrame:
    """As materialize, for the result of a block of temporary(): it outlives the block."""
    return _write(df, name, _blocks.get()[:-1])


def release(df: DataFrame) -> None:
    """Removes the files of a table that materialize returned and that nothing reads any more."""
    _remove(df.sparkSession, df._quern_path)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables that are materialized in this block, in this thread, are removed at its end, but what keep() wrote."""
    made: list[DataFrame] = []
    token = _blocks.set((*_blocks.get(), made))
    try:
        yield
    finally:
        _blocks.reset(token)
        for df in made:
            release(df)


def store_of(uri: str):
    """The Arrow file system and the path in it for a URI, for use in tasks; a path without a scheme is local."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    if "://" not in uri and uri.startswith("file:/"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)
