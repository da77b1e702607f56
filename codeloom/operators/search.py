"""Symbol search by wildcard, callers and callees, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, text
from .traverse import distances, trails

FIND_LIMIT, CALLS_LIMIT, CALLS_DEPTH = 20, 50, 3


def matches(name: Column, pattern: str) -> Column:
    """Whether a name fits a pattern, whatever its case.

    A star first or last stands for anything; any other star, and what other languages would
    take for a wildcard, is literal.  A pattern of stars alone fits all names.
    """
    term = pattern.strip("*").lower()
    if not term:
        return F.lit(True)
    lower, first, last = F.lower(name), pattern.startswith("*"), pattern.endswith("*")
    if first and last:
        return F.contains(lower, F.lit(term))
    if first:
        return F.endswith(lower, F.lit(term))
    if last:
        return F.startswith(lower, F.lit(term))
    return lower == F.lit(term)


def find(symbols: DataFrame, pattern: str, kind: str | None = None, language: str | None = None, limit: int | None = FIND_LIMIT, compat: bool = False) -> DataFrame:
    """name, kind, file_path and start_line of fitting symbols in the order of their names.

    ``symbols`` has name, label, language, file_path and start_line.  ``compat`` compares the
    language's argument in upper case with the stored name, which hardly ever fits.
    """
    rows = symbols.where(F.col("label") == names.parse_kind(kind) if kind is not None else F.col("label").isin(*names.SYMBOL_LABELS))
    rows = rows.where(matches(F.col("name"), pattern))
    if language is not None:
        rows = rows.where(F.col("language") == (language.upper() if compat else names.parse_language(language)))
    rows = rows.select("name", F.col("label").alias("kind"), "file_path", "start_line").orderBy("name", "file_path", "start_line", "kind")
    return rows if limit is None else rows.limit(limit)


def calls(symbols: DataFrame, edges: DataFrame, function: str, direction: str = "callers", depth: int = CALLS_DEPTH, limit: int | None = CALLS_LIMIT, distinct: bool = False) -> DataFrame:
    """name, file_path and distance of functions that call a function, or that it calls.

    One row for each path, or with ``distinct`` for each function.  ``symbols`` has node_key,
    label, name and file_path; only functions are ends of paths.
    """
    functions = symbols.where(F.col("label") == "Function")
    starts = functions.where(F.col("name") == F.lit(function)).select(F.col("node_key").alias("node"))
    pairs = edges.select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst"))
    walk = distances if distinct else trails
    found = walk(starts, pairs, depth, reverse=direction == "callers")
    ends = functions.select(F.col("node_key").alias("node"), "name", "file_path")
    if distinct:
        found = found.groupBy("node").agg(F.min("distance").alias("distance"))
    rows = found.join(ends, "node").select("name", "file_path", F.col("distance").cast("long").alias("distance")).orderBy("distance", "name", "file_path")
    return rows if limit is None else rows.limit(limit)


def both_calls(symbols: DataFrame, edges: DataFrame, function: str, depth: int = CALLS_DEPTH, limit: int | None = CALLS_LIMIT, distinct: bool = False) -> DataFrame:
    """Callers, then callees, told apart by ``direction``."""
    parts = [calls(symbols, edges, function, d, depth, limit, distinct).withColumn("direction", F.lit(d)) for d in ("callers", "callees")]
    return parts[0].unionByName(parts[1])


def status(files: DataFrame, symbols: DataFrame, call_edges: DataFrame, import_edges: DataFrame) -> DataFrame:
    """One row: files, functions, classes, structs, calls, imports."""
    by_label = symbols.agg(*[F.count_if(F.col("label") == label).alias(name) for name, label in (("functions", "Function"), ("classes", "Class"), ("structs", "Struct"))])
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [count(files, "files"), by_label, count(call_edges, "calls"), count(import_edges, "imports")]
    named = [p.withColumn("_one", F.lit(1)) for p in parts]  # each side is one row
    out = named[0]
    for p in named[1:]:
        out = out.join(p, "_one")
    return out.drop("_one")


def files_by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "language")


def file_list(files: DataFrame) -> DataFrame:
    return files.select("path", "language", "line_count").orderBy("path")


def rendered_find(rows: DataFrame, full_paths: bool = False) -> DataFrame:
    """One padded line for each row of ``find``."""
    cut = (lambda c, n: c) if full_paths else text.truncate
    columns = [text.pad(cut(F.col("name"), 30), 30), text.pad(F.col("kind"), 12), text.pad(cut(F.col("file_path"), 40), 40), text.pad(F.col("start_line").cast("string"), 6)]
    return rows.select(F.concat_ws(" ", *columns).alias("line"))


def rendered_calls(rows: DataFrame) -> DataFrame:
    """One padded line for each row of ``calls``, indented by distance."""
    width = F.greatest(F.lit(30) - 2 * F.greatest(F.col("distance") - 1, F.lit(0)), F.lit(0)).cast("int")
    name = F.when(width < 4, F.expr("substring(name, 1, cast(greatest(30 - 2 * greatest(distance - 1, 0), 0) as int))")).when(F.length("name") <= width, F.col("name")).otherwise(F.concat(F.expr("substring(name, 1, cast(27 - 2 * greatest(distance - 1, 0) as int))"), F.lit("...")))
    return rows.select(F.concat(text.indent(F.col("distance")), text.pad(name, 30), F.lit(" "), text.pad(text.truncate(F.col("file_path"), 40), 40), F.lit(" "), F.col("distance").cast("string")).alias("line"))
