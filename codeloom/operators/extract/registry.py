"""Extraction as a table operator: one row for each file, with nested symbols and relations."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ...plans.shipping import ship
from . import cpp, go, python, rust, script
from .records import Found

Extractor = Callable[[str, bool], Found]
EXTRACTORS: dict[str, Extractor] = {"Python": python.extract, "Rust": rust.extract, "JavaScript": script.extract_javascript, "TypeScript": script.extract_typescript, "Go": go.extract, "C++": cpp.extract}

_SYMBOL = [("ord", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("visibility", pa.string()), ("is_async", pa.bool_()), ("docstring", pa.string()), ("parent_id", pa.string()), ("parent_name", pa.string())]
_IMPORT = [("ord", pa.int32()), ("target", pa.string()), ("alias", pa.string()), ("items", pa.list_(pa.string())), ("line", pa.int32())]
_CALL = [("ord", pa.int32()), ("callee_name", pa.string()), ("line", pa.int32())]
_INHERIT = [("ord", pa.int32()), ("child_name", pa.string()), ("child_kinds", pa.list_(pa.string())), ("parent_name", pa.string())]
_ARROW = pa.schema([("path", pa.string()), ("language", pa.string()), ("content_hash", pa.string()), ("line_count", pa.int32()), ("error", pa.string()), ("symbols", pa.list_(pa.struct(_SYMBOL))), ("imports", pa.list_(pa.struct(_IMPORT))), ("calls", pa.list_(pa.struct(_CALL))), ("inherits", pa.list_(pa.struct(_INHERIT)))])
SCHEMA = (
    "path string, language string, content_hash string, line_count int, error string, "
    "symbols array<struct<ord: int, id: string, name: string, kind: string, start_line: int, end_line: int, signature: string, visibility: string, is_async: boolean, docstring: string, parent_id: string, parent_name: string>>, "
    "imports array<struct<ord: int, target: string, alias: string, items: array<string>, line: int>>, "
    "calls array<struct<ord: int, callee_name: string, line: int>>, "
    "inherits array<struct<ord: int, child_name: string, child_kinds: array<string>, parent_name: string>>"
)


def extract_file(path: str, language: str, content: bytes, compat: bool = False) -> dict:
    """One row of ``SCHEMA``; a failure is told in ``error`` and leaves the lists empty."""
    error, found = _find(language, content, compat)
    row: dict = {"path": path, "language": language, "content_hash": hashlib.sha256(content).hexdigest(), "line_count": content.count(b"\n") + 1, "error": error, "symbols": [], "imports": [], "calls": [], "inherits": []}
    ids = [f"{path}:{s.name}:{s.start_line}" for s in found.symbols]
    row["symbols"] = [{"ord": k, "id": ids[k], "name": s.name, "kind": s.kind, "start_line": s.start_line, "end_line": s.end_line, "signature": s.signature, "visibility": s.visibility, "is_async": s.is_async, "docstring": s.docstring, "parent_id": None if s.parent is None else ids[s.parent], "parent_name": s.parent_name} for k, s in enumerate(found.symbols)]
    row["imports"] = [{"ord": k, "target": t, "alias": a, "items": i, "line": n} for k, (t, a, i, n) in enumerate(found.imports)]
    row["calls"] = [{"ord": k, "callee_name": c, "line": n} for k, (c, n) in enumerate(found.calls)]
    row["inherits"] = [{"ord": k, "child_name": c, "child_kinds": kinds, "parent_name": p} for k, (c, kinds, p) in enumerate(found.inherits)]
    return row


#: Records, and at most files, that one batch of results holds unless one file has more.
BATCH_RECORDS, BATCH_FILES = 20_000, 1_000
#: Nested columns.
RECORDS = ("symbols", "imports", "calls", "inherits")
_FLAT = ("path", "language", "content_hash", "line_count", "error")


def _lists(column: str, rows: list[tuple], lengths: list[int]) -> pa.Array:
    """A column of lists from the fields of all their elements."""
    kind = _ARROW.field(column).type
    fields = list(kind.value_type)
    values = list(zip(*rows, strict=True)) if rows else [() for _ in fields]
    structs = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(values, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(list(accumulate(lengths, initial=0)), pa.int32()), structs, type=kind)


def _batch(held: list[tuple], columns: tuple[str, ...]) -> pa.RecordBatch:
    """Rows of (path, language, hash, lines, error, what was found)."""
    found = [h[5] for h in held]
    arrays = [pa.array([h[k] for h in held], _ARROW.field(name).type) for k, name in enumerate(_FLAT)]
    for column in columns:
        rows: list[tuple] = []
        for h in held:
            if column == "symbols":
                ids = [f"{h[0]}:{s.name}:{s.start_line}" for s in h[5].symbols]
                rows += [(k, ids[k], s.name, s.kind, s.start_line, s.end_line, s.signature, s.visibility, s.is_async, s.docstring, None if s.parent is None else ids[s.parent], s.parent_name) for k, s in enumerate(h[5].symbols)]
            else:
                rows += [(k, *r) for k, r in enumerate(getattr(h[5], column))]
        arrays.append(_lists(column, rows, [len(getattr(f, column)) for f in found]))
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema([_ARROW.field(c) for c in (*_FLAT, *columns)]))


def _find(language: str, content: bytes | None, compat: bool) -> tuple[str | None, Found]:
    """What failed, if anything, and what was found."""
    if content is None:
        return "unreadable", Found()
    extractor = EXTRACTORS.get(language)
    if extractor is None:
        return f"Unknown language: {language}", Found()
    try:
        return None, extractor(content.decode("utf-8", "replace").removeprefix("\ufeff"), compat)
    except Exception as error:  # one file must not end the job
        return f"{type(error).__name__}: {error}", Found()


def extract(files: DataFrame, compat: bool = False, columns: tuple[str, ...] = RECORDS) -> DataFrame:
    """Extract from ``path``, ``language`` and ``content`` (binary); null content is an error.

    ``columns``: the nested columns of the result, all unless only some are wanted.
    """
    ship(files.sparkSession)
    columns = tuple(c for c in RECORDS if c in columns)

    def run(batches):
        held, records = [], 0
        for batch in batches:
            for path, language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                error, found = _find(language, content, compat)
                held.append((path, language, hashlib.sha256(content or b"").hexdigest(), (content or b"").count(b"\n") + 1, error, found))
                records += len(found.symbols) + len(found.imports) + len(found.calls) + len(found.inherits)
                if records >= BATCH_RECORDS or len(held) >= BATCH_FILES:
                    yield _batch(held, columns)
                    held, records = [], 0
        if held:
            yield _batch(held, columns)

    kinds = StructType.fromDDL(SCHEMA)
    return files.select("path", "language", F.col("content").cast("binary")).mapInArrow(run, StructType([kinds[c] for c in (*_FLAT, *columns)]))


def counts(files: DataFrame, compat: bool = False) -> DataFrame:
    """``extract`` where only numbers are wanted: error, and how many records of each kind."""
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            errors, numbers = [], []
            for language, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                error, found = _find(language, content, compat)
                errors.append(error)
                numbers.append([len(getattr(found, c)) for c in RECORDS])
            columns = list(zip(*numbers, strict=True)) or [() for _ in RECORDS]
            yield pa.RecordBatch.from_arrays([pa.array(errors, pa.string()), *[pa.array(n, pa.int32()) for n in columns]], names=["error", *RECORDS])

    return files.select("language", F.col("content").cast("binary")).mapInArrow(run, "error string, " + ", ".join(f"{c} int" for c in RECORDS))
