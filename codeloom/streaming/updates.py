"""An extension: a graph kept current by Structured Streaming.

Files arrive as rows of path and content (null: deleted).  Each micro-batch becomes one update
of the store, the same as an incremental run, so the graph equals one that is indexed anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import names
from ..plans.index import apply_changes
from ..sources.store import Store

#: Columns of the stream; ``seq`` orders several states of one file within a batch.
SCHEMA = "path string, content binary, seq bigint"


def apply_batch(store: Store, rows: DataFrame) -> None:
    """One batch: of several states of a file the last one counts."""
    latest = rows.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))).where("_n = 1")
    latest = latest.withColumn("language", names.language_column(F.col("path"))).where("language is not null")
    if latest.isEmpty():
        return
    changes = latest.select("path", F.lit(None).cast("string").alias("old_path"), F.when(F.col("content").isNull(), "Deleted").otherwise("Modified").alias("kind"))
    graph, _ = apply_changes(rows.sparkSession, store, changes, latest.select("path", "language", "content"))
    store.write(graph)


def follow(stream: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that applies every batch of the stream to the store."""

    def each(rows: DataFrame, _: int) -> None:
        rows.persist()
        try:
            apply_batch(store, rows)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
