"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship

#: Bytes of text that one call of a per-batch function gets, unless one text is longer.
BATCH_BYTES = 4 << 20


#: Shuffle files go when the job that wrote them is over, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A private one is made only where that setting is absent and all runs on one machine (tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="codeloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/codeloom-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those written with ``stays``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_path(spark, path)


def written(df: DataFrame, name: str, path: str | None = None, stays: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    owner = _scopes[-1 - stays :][:1]
    for paths in owner if len(_scopes) > stays else []:
        paths.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, wherever it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remainder(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about ``limit`` bytes; each run has one row at least."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    make: Callable[[], Callable[[list[bytes | None]], dict[str, list]]],
    schema: pa.Schema,
    spark_schema: str,
    limit: int = BATCH_BYTES,
) -> DataFrame:
    """Apply a function over batches of UTF-8 texts, with the columns ``keep`` passed on.

    ``make`` runs once a task and returns the function, which gets a list of bytes (None for
    null) and returns a dict of the columns in ``schema``.  A batch holds ``limit`` bytes or
    one text, whichever is more, so memory does not grow with the partition.
    """
    ship(df.sparkSession)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for a, b in cut(sizes, limit):
                out = fn(texts.slice(a, b - a).cast(pa.binary()).to_pylist())
                columns = [batch.column(batch.schema.get_field_index(k)).slice(a, b - a) for k in keep]
                names = list(keep)
                for field in schema:
                    columns.append(pa.array(out[field.name], type=field.type))
                    names.append(field.name)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    wanted = list(dict.fromkeys([*keep, text]))
    return df.select(*wanted).mapInArrow(run, f"{head}, {spark_schema}" if keep else spark_schema)
