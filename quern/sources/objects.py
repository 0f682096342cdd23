"""A data source of objects: spark.read.format("quern_objects") with filters that are pushed down, and writes that commit."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource

from quern.session import configure, ship

NAME, SCHEMA = "quern_objects", "key string, size long, data binary"


def object_source() -> type[DataSource]:
    """The source's class. A class of a function goes to Spark's Python processes by value: not all have this package."""
    import json
    import uuid
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

    def store(uri: str):
        from pyarrow import fs

        if uri.startswith("s3a://"):
            uri = "s3://" + uri[6:]
        if uri.startswith("file:/") and "://" not in uri:
            uri = "file://" + uri[5:]
        return fs.FileSystem.from_uri(uri)

    def listed(files, folder: str, recursive: bool = False) -> list:
        from pyarrow import fs

        return files.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=recursive))

    @dataclass
    class Folder(InputPartition):
        """What one task wrote."""

        name: str

    @dataclass
    class Written(WriterCommitMessage):
        """The folder of a task that ended well."""

        name: str
        objects: int

    class Reader(DataSourceReader):
        def __init__(self, path: str, keys: bool):
            self.path, self.keys_only = path, keys
            self.prefixes: list[str] = []
            self.wanted: list[set[str]] = []

        def pushFilters(self, filters):
            for f in filters:
                column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
                if isinstance(f, EqualTo) and column == "key":
                    self.wanted.append({f.value})
                elif isinstance(f, In) and column == "key":
                    self.wanted.append(set(f.value))
                elif isinstance(f, StringStartsWith) and column == "key":
                    self.prefixes.append(f.value)
                else:
                    yield f

        def partitions(self):
            files, base = store(self.path)
            names: list[str] = []
            for info in sorted(listed(files, f"{base}/_commits"), key=lambda i: i.path):
                if info.path.endswith(".json"):
                    with files.open_input_stream(info.path) as found:
                        commit = json.loads(found.read())
                    names = commit["folders"] if commit["overwrite"] else names + commit["folders"]
            return [Folder(n) for n in names] or [Folder("")]

        def _fits(self, key: str) -> bool:
            return all(key in w for w in self.wanted) and all(key.startswith(p) for p in self.prefixes)

        def read(self, partition):
            if not partition.name:
                return
            files, base = store(self.path)
            folder = f"{base}/parts/{partition.name}"
            for info in sorted(listed(files, folder, recursive=True), key=lambda i: i.path):
                key = info.path[len(folder) + 1 :]
                if info.is_file and self._fits(key):
                    data = None
                    if not self.keys_only:
                        with files.open_input_stream(info.path) as found:
                            data = found.read()
                    yield key, info.size, data

    class Writer(DataSourceWriter):
        def __init__(self, path: str, overwrite: bool, at: int, data: int):
            self.path, self.overwrite, self.columns, self.job = path, overwrite, (at, data), uuid.uuid4().hex

        def write(self, iterator):
            files, base = store(self.path)
            name, n = f"{self.job}-{uuid.uuid4().hex}", 0  # of this attempt alone
            for row in iterator:
                key, data = (row[i] for i in self.columns)
                if not key or key.startswith("/") or any(p in ("", ".", "..") for p in key.split("/")):
                    raise ValueError(f"{key!r} is no key")
                target = f"{base}/parts/{name}/{key}"
                files.create_dir(target.rpartition("/")[0], recursive=True)
                with files.open_output_stream(target, compression=None) as out:
                    out.write(bytes(data or b""))
                n += 1
            return Written(name, n)

        def commit(self, messages):
            files, base = store(self.path)
            files.create_dir(f"{base}/_commits", recursive=True)
            last = max((int(i.base_name.split("-")[0]) for i in listed(files, f"{base}/_commits") if i.base_name.endswith(".json")), default=-1)
            body = {"overwrite": self.overwrite, "folders": [m.name for m in messages if m is not None and m.objects]}
            draft = f"{base}/_commits/{self.job}"
            with files.open_output_stream(draft) as out:
                out.write(json.dumps(body).encode())
            files.move(draft, f"{base}/_commits/{last + 1:012d}-{self.job}.json")

        def abort(self, messages):
            files, base = store(self.path)
            for info in listed(files, f"{base}/parts"):
                if info.base_name.startswith(self.job):
                    files.delete_dir(info.path)

    class Objects(DataSource):
        @classmethod
        def name(cls):
            return NAME

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Reader(self.options["path"], self.options.get("keysonly", "false").lower() == "true")

        def writer(self, schema, overwrite):
            names = schema.fieldNames()
            return Writer(self.options["path"], overwrite, names.index("key"), names.index("data"))

    return Objects


def register(spark: SparkSession) -> None:
    """Makes the source known to the session as quern_objects.

    Options: path, a folder of shared storage; keysOnly, to leave data null. Rows are key, size and data. Filters for equal
    keys, for one of several and for a beginning are done by the source, so that only such objects are opened. A task
    writes to a folder of its attempt; the job's commit names the folders of the tasks that ended well in one file, which
    readers follow. So a job or task that fails leaves nothing that is read, and the driver handles a name for each task.
    Objects of one key that several appends wrote are several rows; overwrite replaces all. Spark keeps pushed filters with
    the loaded relation, so parts of one plan that filter differently need a load() each.
    """
    ship(configure(spark))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(object_source())
