"""Results as JSON text and as tables of text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.types import Row


def plain(value):
    """A value of a result as JSON has it; rows become objects, absent properties go."""
    if isinstance(value, Row):
        fields = value.asDict()
        if fields.get("type") in ("node", "edge") and "properties" in fields:
            properties = {k: plain(v) for k, v in fields["properties"].asDict().items() if v is not None}
            return {k: plain(v) for k, v in fields.items() if k != "properties"} | {"properties": properties}
        return {k: plain(v) for k, v in fields.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if value is None or isinstance(value, bool | int | float | str):
        return value
    return str(value)


def as_json(rows: DataFrame) -> str:
    """An array of arrays, without the names of the columns."""
    return json.dumps([[plain(v) for v in r] for r in rows.collect()], indent=2, ensure_ascii=False)


def as_table(rows: DataFrame) -> str:
    found = rows.collect()
    if not found:
        return "No results found."
    lines = []
    for i, row in enumerate(found, 1):
        lines.append(f"--- Row {i} ---")
        lines += [f"  [{j}]: {json.dumps(plain(v), ensure_ascii=False)}" for j, v in enumerate(row)]
    return "\n".join([*lines, f"\n{len(found)} row(s) returned."])


def truncate(text: str, limit: int) -> str:
    """At most ``limit`` characters, the last three dots where something was cut."""
    if limit < 4:
        return text[: max(limit, 0)]
    return text if len(text) <= limit else text[: limit - 3] + "..."


def find_table(rows: DataFrame, pattern: str, full_paths: bool = False) -> str:
    found = rows.collect()
    if not found:
        return f"No symbols found matching '{pattern}'"
    cut = (lambda s, n: s) if full_paths else truncate
    lines = [f"{'NAME':<30} {'KIND':<12} {'FILE':<40} {'LINE':<6}", "-" * 90]
    lines += [f"{cut(r.name, 30):<30} {r.kind:<12} {cut(r.file_path, 40):<40} {r.start_line:<6}" for r in found]
    return "\n".join([*lines, f"\nFound {len(found)} symbol(s)."])


def calls_table(rows: DataFrame, function: str, direction: str) -> str:
    found, word = rows.collect(), direction.removesuffix("s")
    if not found:
        return f"No {direction} found for '{function}'"
    lines = [f"{word.upper():<30} {'FILE':<40} {'DISTANCE':<8}", "-" * 80]
    for r in found:
        indent = "  " * max(r.distance - 1, 0)
        lines.append(f"{indent}{truncate(r.name, 30 - len(indent)):<30} {truncate(r.file_path, 40):<40} {r.distance}")
    return "\n".join([*lines, f"\nFound {len(found)} {word}(s)."])


def status_text(counts: Row, graph: str, commit: str | None, languages: list[Row], files: list[Row] | None = None) -> str:
    lines = [f"Index Status for graph '{graph}'", "================================", "", "Graph Statistics:"]
    lines += [f"  {name + ':':<10} {counts[name.lower()]}" for name in ("Files", "Functions", "Classes", "Structs", "Calls", "Imports")]
    lines += ["", f"Last indexed commit: {commit or '(none)'}"]
    if files is not None:
        lines += ["", "--- Indexed Files ---", ""]
        if files:
            lines += [f"{'PATH':<60} {'LANGUAGE':<12} {'LINES':<8}", "-" * 82]
            lines += [f"{truncate(r.path, 60):<60} {r.language or '':<12} {r.line_count:<8}" for r in files]
            lines += ["", f"Total: {len(files)} files"]
        else:
            lines.append("No files indexed.")
    lines += ["", "--- Files by Language ---", ""]
    return "\n".join([*lines, *[f"  {r.language or '':<12} {r['count']}" for r in languages]])
