"""Commands: index, update, query, find, calls and status over a stored graph."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.sql import SparkSession

from .functions import names
from .operators import search
from .plans import index, render
from .plans.cypher import CypherError
from .plans.cypher_write import execute
from .sources import git, paths
from .sources.store import LAST_COMMIT, Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description="A code index: symbols and calls as a graph that Spark queries")
    p.add_argument("-v", "--verbose", action="store_true", help="show Spark's progress and messages")
    p.add_argument("--store", default=os.environ.get("CODELOOM_STORE", os.path.join(os.path.expanduser("~"), ".codeloom")), help="folder of the graphs")
    p.add_argument("--graph", default="codeloom", help="name of the graph")
    p.add_argument("--compat", action="store_true", help="reproduce observed behaviour where it departs from what is intended")
    c = p.add_subparsers(dest="command", required=True)
    x = c.add_parser("index", help="index a directory")
    x.add_argument("path", nargs="?", default=".")
    x.add_argument("-j", "--jobs", type=int, help="number of partitions to parse in")
    x.add_argument("-l", "--languages", help="comma-separated: py,rs,ts,js,go,cpp")
    x.add_argument("--no-clear", action="store_true", help="keep what was indexed before")
    x = c.add_parser("update", help="index what git says has changed")
    x.add_argument("path", nargs="?", default=".")
    x.add_argument("--since", help="commit to compare with; the last indexed one by default")
    x.add_argument("--dry-run", action="store_true")
    x = c.add_parser("query", help="run a Cypher query")
    x.add_argument("cypher")
    x.add_argument("-f", "--format", default="table", help="table or json")
    x = c.add_parser("find", help="find symbols by a pattern, in which * may stand first and last")
    x.add_argument("pattern")
    x.add_argument("-k", "--kind", help=", ".join(k.lower() for k in names.SYMBOL_LABELS))
    x.add_argument("-l", "--language", help="rs, py, ts, js, go, cpp")
    x.add_argument("-n", "--limit", type=int, default=search.FIND_LIMIT)
    x.add_argument("--full-paths", action="store_true")
    x = c.add_parser("calls", help="callers and callees of a function")
    x.add_argument("function")
    x.add_argument("-d", "--direction", default="both", help="callers, callees or both")
    x.add_argument("-D", "--depth", type=int, default=search.CALLS_DEPTH)
    x = c.add_parser("status", help="what is indexed")
    x.add_argument("--files", action="store_true")
    return p


def session(verbose: bool = False) -> SparkSession:
    spark = SparkSession.builder.appName("codeloom").config("spark.ui.showConsoleProgress", str(verbose).lower()).getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if verbose else "ERROR")
    return spark


def run(args: argparse.Namespace, spark: SparkSession) -> str:
    """Carry out a command and return what it prints."""
    store = Store(spark, args.store, args.graph)
    if args.command == "index":
        return index.full_index(spark, args.path, store, names.parse_languages(args.languages), not args.no_clear, args.jobs, args.compat).text()
    if args.command == "update":
        got = index.update(spark, args.path, store, args.since, args.dry_run, None, args.compat)
        head = ["Dry run - not writing to the store:", *[f"  {kind}: {path}" for path, _, kind in got.changes], ""] if args.dry_run else []
        return "\n".join([*head, got.text()])
    if args.command == "query":
        rows = execute(store, args.cypher)
        return render.as_json(rows) if args.format == "json" else render.as_table(rows)
    graph = store.load()
    if args.command == "find":
        rows = search.find(graph.symbols, args.pattern, args.kind, args.language, args.limit, args.compat)
        return render.find_table(rows, args.pattern, args.full_paths)
    if args.command == "calls":
        directions = [args.direction] if args.direction in ("callers", "callees") else ["callers", "callees"]
        parts = []
        for d in directions:
            shown = render.calls_table(search.calls(graph.symbols, graph.calls, args.function, d, args.depth), args.function, d)
            title = {"callers": f"=== Callers (functions that call {args.function}) ===\n\n", "callees": f"\n=== Callees (functions called by {args.function}) ===\n\n"}[d]
            parts.append((title if len(directions) > 1 else "") + shown)
        return "\n".join(parts)
    counts = search.status(graph.files, graph.symbols, graph.calls, graph.imports).first()
    files = search.file_list(graph.files).collect() if args.files else None
    return render.status_text(counts, args.graph, store.get_metadata(LAST_COMMIT), search.files_by_language(graph.files).collect(), files)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    spark = session(args.verbose)
    try:
        print(run(args, spark))
        return 0
    except (CypherError, names.UnknownName, git.NotARepository, git.InvalidReference, paths.NotADirectory) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
