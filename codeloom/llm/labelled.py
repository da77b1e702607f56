"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each class to fit on at most.
SAMPLE_ROWS = 4000


def sample(docs: DataFrame, labels: DataFrame, column: str, rows: int = SAMPLE_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) drawn by a hash of the id, and how many labelled rows each class has.

    Texts are whole and stay with the executors; callers fetch what they measure on them.  Only
    rows that the folds leave for learning are drawn (crc32 of the id, modulo 5, not 0).  The draw
    is a top-n in each task, so labels may have any number of rows.  Where documents repeat an id
    so often that more than 4 * rows of a class would be found, a hash of the text draws among them.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (common.remainder() != 0)).select("doc_id", F.col(column).cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = None
    for y in sorted(sizes):
        part = known.where(F.col("y") == y).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(rows).select("doc_id", "y")
        drawn = part if drawn is None else drawn.unionByName(part)
    if drawn is None:
        drawn = known
    drawn = F.broadcast(common.written(drawn, "labels"))  # 2 * rows at most
    found = docs.select("doc_id", "text").join(drawn, "doc_id")
    many = docs.select("doc_id").join(drawn, "doc_id").groupBy("y").agg(F.count("*").alias("n")).where(F.col("n") > 4 * rows).collect()
    if many:
        found = found.dropDuplicates(["doc_id", "text", "y"])
        share = F.lit(1 << 20)
        for r in many:
            share = F.when(F.col("y") == r.y, F.lit(2 * rows * (1 << 20) // r.n)).otherwise(share)
        found = found.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share)
    return found, sizes
