"""Metadata of schemas, tables, layouts and files, and the manifest that says which files make a table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

FILE_KINDS = ("TEMPORARY_INGEST", "REGULAR", "TEMPORARY_GC", "RETIRED")
PERMISSIONS = ("DISABLED", "READ_ONLY", "READ_WRITE")


@dataclass
class Layout:
    """A variant of a table: the columns it has (None: all), and where its files are."""

    version: int
    path: str
    kind: str = "ORDERED"
    columns: list[str] | None = None
    permission: str = "READ_WRITE"


@dataclass
class Table:
    name: str
    columns: dict[str, str]
    key: list[str] = field(default_factory=list)
    layouts: list[Layout] = field(default_factory=list)
    row_count: int | None = None
    versions: list[tuple[int, dict[str, str]]] = field(default_factory=list)

    def schema_at(self, ts: int) -> dict[str, str]:
        """The columns as of a transaction timestamp."""
        known = [c for t, c in sorted(self.versions) if t <= ts]
        return known[-1] if known else self.columns


@dataclass
class Catalog:
    """Schemas of tables and views, and remote sites that hold some columns. Small, and kept on the driver."""

    schemas: dict[str, dict[str, Table]] = field(default_factory=dict)
    views: dict[str, dict[str, str]] = field(default_factory=dict)
    peers: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def create_schema(self, name: str) -> None:
        if name in self.schemas:
            raise ValueError(f"schema {name} is there already")
        self.schemas[name], self.views[name] = {}, {}

    def drop_schema(self, name: str) -> None:
        del self.schemas[name], self.views[name]

    def create_table(self, schema: str, table: Table) -> None:
        if table.name in self.schemas[schema]:
            raise ValueError(f"table {table.name} is there already")
        self.schemas[schema][table.name] = table

    def drop_table(self, schema: str, name: str) -> None:
        del self.schemas[schema][name]

    def table(self, schema: str, name: str) -> Table:
        try:
            return self.schemas[schema][name]
        except KeyError:
            raise KeyError(f"no table {schema}.{name}") from None

    def add_layout(self, schema: str, name: str, layout: Layout) -> None:
        if layout.permission not in PERMISSIONS:
            raise ValueError(f"no such permission: {layout.permission}")
        self.table(schema, name).layouts.append(layout)

    def alter(self, schema: str, name: str, columns: dict[str, str], ts: int) -> None:
        table = self.table(schema, name)
        table.versions.append((ts, columns))
        table.columns = columns

    def register(self, spark: SparkSession, schema: str) -> None:
        """Makes the readable tables and the views of a schema known to Spark SQL."""
        for table in self.schemas[schema].values():
            if readable := [x for x in table.layouts if x.permission != "DISABLED" and x.columns is None]:
                spark.read.parquet(max(readable, key=lambda x: x.version).path).createOrReplaceTempView(table.name)
        for name, sql in self.views[schema].items():
            spark.sql(sql).createOrReplaceTempView(name)

    def describe(self, spark: SparkSession, schema: str) -> DataFrame:
        rows = [(schema, t.name, c, k, i) for t in self.schemas[schema].values() for i, (c, k) in enumerate(t.columns.items())]
        return spark.createDataFrame(rows, "schema_name string, table_name string, column_name string, column_type string, position int")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Catalog:
        raw = json.loads(text)
        schemas = {s: {n: Table(**{**t, "layouts": [Layout(**x) for x in t["layouts"]], "versions": [(a, b) for a, b in t["versions"]]}) for n, t in ts.items()} for s, ts in raw["schemas"].items()}
        return Catalog(schemas, raw["views"], raw["peers"])


class Manifest:
    """The files of a table, in versions: each version is a file of its own that lists all paths and their kinds, and
    is written under its number or not at all. Readers see the newest whole version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/_versions"))

    def _version(self) -> int:
        found = self._fs.listStatus(self._path(f"{self.root}/_versions"))
        names = [str(x.getPath().getName()) for x in found]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def files(self, version: int | None = None) -> dict[str, str]:
        v = self._version() if version is None else version
        if not v:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_versions/{v}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, change: Callable[[dict[str, str]], dict[str, str]]) -> int:
        v = self._version()
        files = change(self.files(v))
        draft = self._path(f"{self.root}/_versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps(files).encode()))
        stream.close()
        if not self._fs.rename(draft, self._path(f"{self.root}/_versions/{v + 1}")):
            self._fs.delete(draft, False)
            raise RuntimeError(f"version {v + 1} was written by another")
        return v + 1

    def add(self, paths: list[str], kind: str = "REGULAR") -> int:
        """Registers files that are there, such as imported ones."""
        if kind not in FILE_KINDS:
            raise ValueError(f"no such kind of file: {kind}")
        return self.commit(lambda old: old | dict.fromkeys(paths, kind))

    def swap(self, old: list[str], new: list[str]) -> int:
        """At once, the new files take the place of the old ones, which are retired."""

        def change(files: dict[str, str]) -> dict[str, str]:
            if lacking := [p for p in old if files.get(p) != "REGULAR"]:
                raise ValueError(f"no files of the table: {lacking}")
            return files | dict.fromkeys(old, "RETIRED") | dict.fromkeys(new, "REGULAR")

        return self.commit(change)

    def read(self, version: int | None = None) -> DataFrame:
        paths = sorted(p for p, kind in self.files(version).items() if kind == "REGULAR")
        if not paths:
            raise ValueError("the table has no files")
        return self.spark.read.parquet(*paths)

    def append(self, df: DataFrame) -> int:
        """Writes the rows aside, then publishes them; if either fails, what was written is deleted and the table is as
        it was."""
        path = f"{self.root}/data-{uuid.uuid4().hex}"
        try:
            df.write.parquet(path)
            return self.add([path])
        except BaseException:
            self._fs.delete(self._path(path), True)
            raise

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def clean(self) -> list[str]:
        """Deletes retired files and forgets them."""
        gone = [p for p, kind in self.files().items() if kind == "RETIRED"]
        self.commit(lambda old: {p: k for p, k in old.items() if p not in gone})
        for p in gone:
            self._fs.delete(self._path(p), True)
        return gone
