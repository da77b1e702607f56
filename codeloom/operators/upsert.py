"""Keyed upserts and deletes over tables that are never changed in place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key: the one that comes last in ``order``.

    The choice is an aggregate, so it is made within each task before rows meet.
    """
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.dropDuplicates(keys)
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    best = F.max_by(F.struct(*others), F.struct(*[c.alias(f"o{k}") for k, c in enumerate(columns)]))
    found = rows.groupBy(*keys).agg(best.alias("_last"))
    return found.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def distinct_edges(edges: DataFrame, keys: Iterable[str] = ("src_key", "dst_key")) -> DataFrame:
    return edges.dropDuplicates(list(keys))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column | str] = ()) -> DataFrame:
    """Rows of both; of equal keys the new row stays, and of new ones the last."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, keys, ["_age", *order]).drop("_age")


def without(rows: DataFrame, gone: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose ``column`` is not among ``gone``'s ``key``."""
    names = gone.select(F.col(key).alias("_gone")).distinct()
    return rows.join(names.hint("merge"), F.col(column) == F.col("_gone"), "left_anti")
