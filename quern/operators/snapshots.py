"""Collections that are published in snapshots: immutable segments, a manifest for each version, readers pinned to one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.indexing import rebuild_targets, rebuild_verified


class Conflict(Exception):
    """Another writer has published the next version first."""


class Collection:
    """Rows of documents (document_id, status and others) in a folder of shared storage.

    A publish writes its rows as a segment of files that nothing else names, then a manifest that lists the segments of
    the new version. A manifest gets its name by a rename that fails where the name is taken: that is the switch, and the
    compare-and-swap between writers. Readers see the rows of one version's segments, whatever is published meanwhile; a
    writer that dies before its switch leaves files that no version names. Where a later segment has a document, rows of
    earlier ones that were ACTIVE are read as SUPERSEDED, so that a publish writes in proportion to what it replaces.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _files(self, path):
        return path.getFileSystem(self._conf)

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        files = self._files(path)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def versions(self) -> list[int]:
        """Published versions, in order."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith("_"))

    def head(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default of the last one."""
        version = self.head() if version is None else version
        if version is None:
            raise LookupError(f"nothing is published in {self.folder}")
        text = self.spark.read.option("wholetext", True).text(f"{self.folder}/manifests/{version:012d}.json").first()
        return json.loads(text["value"])

    def _switch(self, manifest: dict) -> None:
        """Gives the manifest its name, unless the version exists."""
        folder = self._path("manifests")
        self._files(folder).mkdirs(folder)
        draft, target = self._path("manifests", f"_{uuid.uuid4().hex}"), self._path("manifests", f"{manifest['version']:012d}.json")
        out = self._files(draft).create(draft)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        no_overwrite = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._files(draft).getUri(), self._conf)
        try:
            context.rename(draft, target, no_overwrite)
        except Py4JJavaError as error:
            self._files(draft).delete(draft, False)
            if "FileAlreadyExistsException" in str(error.java_exception):
                raise Conflict(f"version {manifest['version']} of {self.folder} exists") from None
            raise

    def _segment(self, rows: DataFrame) -> dict:
        name = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/segments/{name}")
        return {"name": name, "schema": rows.schema.jsonValue()}

    def create(self, rows: DataFrame) -> int:
        """Publishes version 0."""
        if self.head() is not None:
            raise Conflict(f"{self.folder} is published already")
        self._switch({"version": 0, "segments": [self._segment(rows)], "run": None})
        return 0

    def publish(self, staged: DataFrame, expected: int | None = None, run: dict | None = None) -> int:
        """Publishes staged rows as ACTIVE and returns the version. With expected, the version they were made from, it is an
        error if another one is the last by now. Without, the switch is tried again on top of what others have published;
        the rows are written once. run is kept in the manifest."""
        segment = self._segment(staged.withColumn("status", F.lit("ACTIVE")))
        while True:
            base = self.manifest(expected)
            try:
                self._switch({"version": base["version"] + 1, "segments": [*base["segments"], segment], "run": run or base["run"]})
                return base["version"] + 1
            except Conflict:
                if expected is not None:
                    raise

    def _rows(self, segment: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(segment["schema"])).parquet(f"{self.folder}/segments/{segment['name']}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default of the last one. What is read does not change when others publish."""
        segments = self.manifest(version)["segments"]
        columns = self._rows(segments[0]).columns
        numbered = [self._rows(s).select(*columns, F.lit(i).alias("_segment")) for i, s in enumerate(segments)]
        if len(segments) == 1:
            return numbered[0].drop("_segment")
        later = reduce(DataFrame.unionByName, (n.select("document_id", "_segment").distinct() for n in numbered[1:]))
        newest = later.groupBy(F.col("document_id").alias("_document")).agg(F.max("_segment").alias("_newest"))
        joined = reduce(DataFrame.unionByName, numbered).join(newest, F.col("document_id").eqNullSafe(F.col("_document")), "left")
        old = (F.col("status") == "ACTIVE") & (F.col("_segment") < F.col("_newest"))
        return joined.withColumn("status", F.when(old, "SUPERSEDED").otherwise(F.col("status"))).select(*columns)

    def compact(self) -> int:
        """Publishes the last version's rows as one segment. It is an error if another version came meanwhile."""
        base = self.manifest()
        segment = self._segment(self.read(base["version"]))
        self._switch({"version": base["version"] + 1, "segments": [segment], "run": base["run"]})
        return base["version"] + 1

    def expire(self, keep: int = 1) -> list[str]:
        """Removes all but the last `keep` versions, and the segments that none of these names. Readers of removed versions
        and publishes under way must have ended. Returns the names of the removed segments."""
        versions = self.versions()
        named = {s["name"] for v in versions[-keep:] for s in self.manifest(v)["segments"]}
        gone = [n for n in self._names("segments") if n not in named]
        for version in versions[:-keep]:
            path = self._path("manifests", f"{version:012d}.json")
            self._files(path).delete(path, False)
        for name in gone:
            path = self._path("segments", name)
            self._files(path).delete(path, True)
        return gone


class RebuildError(Exception):
    """A rebuilt page does not hold the text of its sources."""


def rebuild(collection: Collection, run_id: str, version: str, build: Callable[[DataFrame], DataFrame], page: int = 10_000, first: int | str = -1) -> int:
    """Rebuilds all documents of a collection that are not of a chunker's version yet, page by page, and returns the number
    of pages.

    A page is the next documents in order of document_id; build makes new rows from its active ones, whose text is
    compared with the old one's. A page is published together with the last document_id, in one switch, so a run that is
    begun again under its run_id goes on behind the last page that was published: no page is lost or done twice. first is
    below all ids.
    """
    pages = 0
    while True:
        base = collection.manifest()
        run = base["run"] if base["run"] and base["run"]["id"] == run_id else {"id": run_id, "after": first}
        current = collection.read(base["version"])
        targets = rebuild_targets(current, version, run["after"], page)
        last = targets.agg(F.max("document_id")).first()[0]
        if last is None:
            return pages
        active = current.filter("status = 'ACTIVE'").join(targets, "document_id", "left_semi")
        made = build(active).withColumn("version", F.lit(version)).select(*current.columns)
        segment = collection._segment(made.withColumn("status", F.lit("ACTIVE")))
        own = "chunk_level = 'CHILD'"
        checked = rebuild_verified(active.filter(own), collection._rows(segment).filter(own))
        if not checked.filter("not verified").isEmpty():
            raise RebuildError(f"a page after {run['after']} does not hold its sources' text")
        manifest = {"version": base["version"] + 1, "segments": [*base["segments"], segment], "run": {"id": run_id, "after": last}}
        try:
            collection._switch(manifest)
        except Conflict:
            continue  # another publish came first: the page is made again on top of it
        pages += 1


def snapshot_counts(collection: Collection, versions: list[int]) -> DataFrame:
    """snapshot, status and n of several versions."""
    each = (collection.read(v).groupBy("status").agg(F.count("*").alias("n")).select(F.lit(v).alias("snapshot"), "status", "n") for v in versions)
    return reduce(DataFrame.unionByName, each)


def changed_documents(collection: Collection, before: int, after: int) -> DataFrame:
    """document_id of documents whose active rows differ between two versions: what a follower must take up again."""
    segments = collection.manifest(after)["segments"]
    known = {s["name"] for s in collection.manifest(before)["segments"]}
    new = [collection._rows(s).select("document_id") for s in segments if s["name"] not in known]
    if not new:
        return collection.read(after).select("document_id").limit(0)
    return reduce(DataFrame.union, new).distinct()
