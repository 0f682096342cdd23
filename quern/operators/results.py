"""A log of model calls named by what was asked: workers write each finished batch at once, later runs read it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import configure, ship
from quern.storage import materialize, store_of

LOG_DDL = "key string, run string, done boolean, result string"


def call_key(model: str, *asked: Column) -> Column:
    """The name of a call: a hash of the model and of what is asked."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), *(c.alias(f"c{i}") for i, c in enumerate(asked)))), 256)


def call_log(spark: SparkSession, folder: str) -> DataFrame:
    """key, run, done and result of all calls in the log; those of a task that ran twice once."""
    try:
        rows = spark.read.schema(LOG_DDL).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").json(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_DDL)
    return rows.groupBy("key", "run", "done").agg(F.min("result").alias("result"))


def finished_calls(spark: SparkSession, folder: str) -> DataFrame:
    """key and result of the calls that are done, each once."""
    return call_log(spark, folder).filter("done").groupBy("key").agg(F.min("result").alias("result"))


#: Files of a task that are merged into one.
MERGED = 256


class _TaskLog:
    """The files of one task in the log of a run: one for each finished batch, written before the task goes on. MERGED files
    of a kind become one, and so do all when the task ends, so a log has few files however many batches it holds. What is
    merged is removed after the merged file has its name: a task that dies leaves some lines twice, and none out."""

    def __init__(self, folder: str, run: str, part: int):
        self.files, base = store_of(folder)
        self.base, self.made = f"{base}/{run}-{part:06d}", False
        self.levels: list[list[str]] = []

    def _write(self, chunks: Iterator[bytes]) -> str:
        if not self.made:
            self.files.create_dir(self.base, recursive=True)
            self.made = True
        path = f"{self.base}/{uuid.uuid4().hex}.jsonl"
        with self.files.open_output_stream(f"{path}.draft") as out:  # its name ends in .jsonl when it is whole
            for chunk in chunks:
                out.write(chunk)
        self.files.move(f"{path}.draft", path)
        return path

    def _read(self, path: str) -> bytes:
        with self.files.open_input_stream(path) as found:
            return found.read()

    def earlier(self) -> dict[str, str]:
        """Results by key that earlier attempts of this task have logged."""
        from pyarrow.fs import FileSelector

        found = [i.path for i in self.files.get_file_info(FileSelector(self.base, allow_not_found=True)) if i.path.endswith(".jsonl")]
        known: dict[str, str] = {}
        for path in found:
            try:
                known |= {row["key"]: row["result"] for row in map(json.loads, self._read(path).splitlines())}
            except FileNotFoundError:  # an attempt that is still under way has merged it: its calls are asked again
                continue
        return known

    def add(self, lines: list[str]) -> None:
        path, level = self._write(iter([("\n".join(lines) + "\n").encode()])), 0
        while True:
            self.levels += [[]] * (level == len(self.levels))
            self.levels[level].append(path)
            if len(self.levels[level]) < MERGED:
                return
            path, level = self._merge(self.levels[level]), level + 1
            self.levels[level - 1] = []

    def _merge(self, paths: list[str]) -> str:
        whole = self._write(self._read(p) for p in paths)
        for path in paths:
            self.files.delete_file(path)
        return whole

    def close(self) -> None:
        rest = [path for level in self.levels for path in level]
        if len(rest) > 1:
            self._merge(rest)


def logged_calls(asked: DataFrame, folder: str, call: Callable[[list], list], batch: int = 64, done: Callable[[object], bool] = lambda result: True) -> DataFrame:
    """asked (key, payload and others) with result, the JSON of what call gives for the payload.

    call takes a list of payloads and returns as many results. Equal keys are asked once. What the log has done is not
    asked again. Of the rest, a worker asks batch by batch and logs each batch in a file of its own before it goes on, so a
    job that fails keeps what was finished, and a task that runs again reads its finished batches instead of asking.
    Results that are not done are logged and returned too, but asked again by a later run. Workers merge their files as
    they become many: runs of one log come one after the other.
    """
    spark = asked.sparkSession
    ship(configure(spark))
    known = finished_calls(spark, folder)
    new = asked.select("key", "payload").dropDuplicates(["key"]).join(known, "key", "left_anti")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # calls take time, not bytes, so few of them are dealt out too
    todo = materialize(new.repartition(parts, F.xxhash64("key")), "calls")  # so that a task that runs again has the same batches
    name = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        log = _TaskLog(folder, name, TaskContext.get().partitionId())
        earlier = log.earlier()

        def answers(keys: list[str], payloads: list) -> list[str]:
            if all(k in earlier for k in keys):
                return [earlier[k] for k in keys]
            made = call(payloads)
            if len(made) != len(keys):
                raise ValueError("the model returned another number of results")
            texts = [json.dumps(r) for r in made]
            log.add([json.dumps({"key": k, "run": name, "done": bool(done(r)), "result": t}) for k, r, t in zip(keys, made, texts)])
            return texts

        for frame in frames:
            keys, payloads = frame["key"].tolist(), frame["payload"].tolist()
            cuts = range(0, len(keys), batch)
            yield pd.DataFrame({"key": keys, "result": [r for low in cuts for r in answers(keys[low : low + batch], payloads[low : low + batch])]})
        log.close()

    fresh = materialize(todo.mapInPandas(run, "key string, result string"), "results")
    return asked.join(known.unionByName(fresh), "key", "left")


def logged_vectors(texts: DataFrame, folder: str, model: str, embed: Callable[[list[str]], list], batch: int = 64) -> DataFrame:
    """id and vector of each text (id, text), asked once for each different text and model and logged as it is done. A
    text that the model has no vector for (None) is asked again by a later run."""
    named = texts.select("id", F.col("text").alias("payload"), call_key(model, F.col("text")).alias("key"))
    done = logged_calls(named, folder, embed, batch, lambda vector: vector is not None)
    return done.select("id", F.from_json("result", "array<float>").alias("vector"))
