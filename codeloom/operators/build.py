"""From extracted files to the tables of the graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resolve

RAW = ("files", "raw_symbols", "raw_imports", "raw_calls", "raw_inherits")
DERIVED = ("symbols", "modules", "contains", "calls", "imports", "inherits")


@dataclass
class Graph:
    """``files`` and the raw records they gave, and the nodes and edges that follow from them."""

    files: DataFrame
    raw_symbols: DataFrame
    raw_imports: DataFrame
    raw_calls: DataFrame
    raw_inherits: DataFrame
    symbols: DataFrame | None = None
    modules: DataFrame | None = None
    contains: DataFrame | None = None
    calls: DataFrame | None = None
    imports: DataFrame | None = None
    inherits: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in (*RAW, *DERIVED) if getattr(self, name) is not None}


def raw_tables(extracted: DataFrame) -> Graph:
    """Nested rows of one file each, taken apart; files with an error are left out."""
    good = extracted.where("error is null")
    files = good.select("path", "language", F.col("content_hash").alias("hash"), "line_count", F.unix_millis(F.current_timestamp()).alias("last_indexed"))

    def rows(column: str) -> DataFrame:
        return good.select(F.col("path").alias("file_path"), "language", F.explode(column).alias("r")).select("file_path", "language", "r.*")

    return Graph(files, rows("symbols"), rows("imports").drop("language"), rows("calls").drop("language"), rows("inherits").drop("language"))


def derive(graph: Graph, sequential: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None, shown: Iterable[str] | None = None) -> Graph:
    """Resolve the raw records of all files into nodes and edges.

    Edges of all types read the nodes, so ``keep`` may write them and read them back.  ``shown``:
    columns of the nodes that are wanted beside those that edges need; without it all are.
    """
    symbols = resolve.parents(graph.raw_symbols)
    nodes = resolve.nodes(symbols, None if shown is None else {*resolve.NEEDED, *shown})
    graph.symbols = keep(nodes) if keep else nodes
    graph.modules = resolve.modules(graph.raw_imports)
    graph.contains = resolve.contain_edges(symbols, graph.symbols)
    graph.imports = resolve.import_edges(graph.raw_imports)
    graph.calls = resolve.call_edges(resolve.enclosing(graph.raw_calls, graph.raw_symbols), graph.symbols, sequential)
    wanted = graph.raw_inherits.select("file_path", F.col("child_name").alias("name"), F.col("child_kinds").alias("kinds"), "parent_name").distinct()
    records = resolve.first_match(wanted, graph.raw_symbols).select("file_path", F.col("found_id").alias("child_id"), "parent_name")
    graph.inherits = resolve.inherit_edges(records, graph.symbols, sequential)
    return graph


def statistics(extracted: DataFrame) -> DataFrame:
    """One row: files_discovered, files_parsed, files_failed and the records that were found.

    ``extracted``: what ``registry.extract`` gives, or ``registry.counts``.
    """
    ok = F.col("error").isNull()
    number = lambda c: F.size(c) if extracted.schema[c].dataType.typeName() == "array" else F.col(c)
    total = lambda c: F.coalesce(F.sum(F.when(ok, number(c))), F.lit(0)).cast("long")
    return extracted.agg(F.count("*").alias("files_discovered"), F.count_if(ok).alias("files_parsed"), F.count_if(~ok).alias("files_failed"), total("symbols").alias("symbols_written"), total("imports").alias("imports_written"), total("calls").alias("call_sites"))
