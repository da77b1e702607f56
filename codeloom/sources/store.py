"""Versioned snapshots of a graph in Parquet.

A snapshot is a folder of tables that is written once.  A small file names the current one and
is replaced last, so readers see the old graph or the new one.  Nothing is overwritten that is
being read.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.build import DERIVED, RAW, Graph

TABLES = (*RAW, *DERIVED, "metadata")
SCHEMAS = {
    "files": "path string, language string, hash string, line_count int, last_indexed bigint",
    "raw_symbols": "file_path string, language string, ord int, id string, name string, kind string, start_line int, end_line int, signature string, visibility string, is_async boolean, docstring string, parent_id string, parent_name string",
    "raw_imports": "file_path string, ord int, target string, alias string, items array<string>, line int",
    "raw_calls": "file_path string, ord int, callee_name string, line int",
    "raw_inherits": "file_path string, ord int, child_name string, child_kinds array<string>, parent_name string",
    "symbols": "node_key string, label string, id string, name string, file_path string, start_line int, end_line int, signature string, visibility string, is_async boolean, docstring string, language string, ord int",
    "modules": "name string, is_external boolean",
    "contains": "src_key string, dst_key string",
    "calls": "src_key string, dst_key string, call_site_line int",
    "imports": "src_key string, dst_key string, alias string, items string, line int",
    "inherits": "src_key string, dst_key string",
    "metadata": "key string, value string",
}
#: Tables that are laid out by a column, so that a scan of one label reads only its files.
PARTITIONED = {"symbols": "label"}
LAST_COMMIT = "last_indexed_commit"
#: Tables that are written at the same time.
WRITERS = 6


def _fields(table: str) -> list[str]:
    return StructType.fromDDL(SCHEMAS[table]).fieldNames()


class Store:
    """Snapshots of one named graph below a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, base: str, graph: str = "codeloom"):
        self.spark, self.graph = spark, graph
        self.path = f"{base.rstrip('/')}/{graph}"

    @property
    def name(self) -> str:
        return self.graph

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self) -> str | None:
        """Folder of the snapshot that counts, None before the first."""
        fs, p = self._fs(f"{self.path}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            name = bytes(stream.readAllBytes()).decode().strip()
        finally:
            stream.close()
        return f"{self.path}/{name}"

    def _point(self, name: str) -> None:
        """Let a snapshot count: written beside, then renamed."""
        fs, target = self._fs(f"{self.path}/CURRENT")
        _, temporary = self._fs(f"{self.path}/.CURRENT-{uuid.uuid4().hex[:8]}")
        stream = fs.create(temporary, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(temporary, target, options)

    def table(self, name: str) -> DataFrame:
        """A table of the current snapshot; an empty one before the first."""
        folder = self.current()
        if folder is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}").select(*_fields(name))

    def load(self) -> Graph:
        return Graph(*[self.table(n) for n in (*RAW, *DERIVED)])

    def write(self, graph: Graph, metadata: DataFrame | None = None) -> str:
        """Write all tables as a new snapshot and make it count."""
        metadata = metadata if metadata is not None else self.table("metadata")
        name = f"v-{uuid.uuid4().hex}"
        self._write(graph.tables() | {"metadata": metadata}, f"{self.path}/{name}")
        self._point(name)
        return f"{self.path}/{name}"

    def _write(self, tables: dict[str, DataFrame], folder: str) -> None:
        """Write tables side by side: each is a job of its own, and most are small."""

        def one(item: tuple[str, DataFrame]) -> None:
            table, df = item
            writer = df.select(*_fields(table)).write
            if table in PARTITIONED:
                writer = writer.partitionBy(PARTITIONED[table])
            writer.parquet(f"{folder}/{table}")

        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(one), tables.items()))

    def stage(self, raw: Graph) -> Graph:
        """Write the raw tables to a scratch folder and read them back: they are derived from often."""
        folder = f"{self.path}/tmp-{uuid.uuid4().hex}"
        self._write({name: getattr(raw, name) for name in RAW}, folder)
        return Graph(**{name: self.spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}") for name in RAW})

    def vacuum(self, older_than: float = 86400) -> None:
        """Delete snapshots and scratch folders that do not count.

        Those of the last ``older_than`` seconds stay: a job or a reader may still need them.
        """
        keep, latest = self.current(), (time.time() - older_than) * 1000
        fs, p = self._fs(self.path)
        if fs.exists(p):
            for entry in fs.listStatus(p):
                name = entry.getPath().getName()
                if entry.isDirectory() and entry.getModificationTime() <= latest and (keep is None or not keep.endswith("/" + name)):
                    fs.delete(entry.getPath(), True)

    def clear(self) -> None:
        """Start anew: an empty snapshot, without metadata."""
        empty = {n: self.spark.createDataFrame([], SCHEMAS[n]) for n in TABLES}
        metadata = empty.pop("metadata")
        self.write(Graph(**empty), metadata)

    def get_metadata(self, key: str) -> str | None:
        row = self.table("metadata").where(F.col("key") == F.lit(key)).select("value").first()
        return row and row.value

    def with_metadata(self, key: str, value: str) -> DataFrame:
        """The metadata with one key set."""
        rest = self.table("metadata").where(F.col("key") != F.lit(key))
        return rest.unionByName(self.spark.createDataFrame([(key, value)], SCHEMAS["metadata"]))

    def set_metadata(self, key: str, value: str) -> None:
        self.write(self.load(), self.with_metadata(key, value))
