"""Source files of a directory tree: which there are, their language and their bytes.

The driver lists names only; executors read contents, in other stores through Spark's binary
file source.  Inside a local git work tree the ignore rules of git apply; elsewhere hidden files
are left out and ``.gitignore`` files are matched here, whatever store the tree lies in.
"""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from ..plans.shipping import ship
from . import scratch

#: Folders that are never indexed; fixed values.
IGNORED = ("node_modules", "target", ".git", "vendor", "dist", "build", "__pycache__", ".venv", "venv")


#: Bytes of content that the driver, or a task, holds before they are passed on.
BLOCK_BYTES = 16 << 20


class NotADirectory(ValueError):
    """The root is no directory."""


def local_root(root: str) -> str | None:
    """The root as this machine's path, or None if it lies in another store."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return None if "://" in root else os.path.abspath(root)


def _git_list(root: str) -> list[str] | None:
    got = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True)
    if got.returncode:
        return None
    return sorted({p for p in got.stdout.decode("utf-8", "surrogateescape").split("\0") if p and os.path.isfile(os.path.join(root, p))})


def _rules(content: str) -> list[tuple[str, bool, bool, bool]]:
    """(pattern, keep, folders only, anchored) of the lines of an ignore file."""
    out = []
    for line in content.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[keep:]
        only = line.endswith("/")
        line = line.rstrip("/")
        out.append((line.lstrip("/"), keep, only, "/" in line))
    return out


def _ignored(path: str, is_folder: bool, rules: list[tuple[str, list[tuple[str, bool, bool, bool]]]]) -> bool:
    state = False
    for base, own in rules:
        below = path[len(base) :].lstrip("/") if base else path
        for pattern, keep, only, anchored in own:
            if only and not is_folder:
                continue
            name = below if anchored else below.rpartition("/")[2]
            if fnmatch.fnmatchcase(name, pattern) or pattern.startswith("**/") and fnmatch.fnmatchcase(below, "*" + pattern[2:]):
                state = not keep
    return state


class _Local:
    """Folders of this machine."""

    def __init__(self, root: str):
        self.root = root

    def entries(self, below: str) -> Iterator[tuple[str, bool, bool]]:
        """(name, whether a folder, whether a file) of what a folder holds; links count as files."""
        try:
            for e in os.scandir(os.path.join(self.root, below)):
                is_folder = e.is_dir(follow_symlinks=False)
                yield e.name, is_folder, not is_folder and e.is_file()
        except OSError:
            return

    def content(self, below: str) -> bytes:
        with open(os.path.join(self.root, below), "rb") as f:
            return f.read()


class _Remote:
    """Folders of any store that Hadoop's file systems know, listed by the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = self.fs.makeQualified(self.path(root)).toString().rstrip("/")

    def is_folder(self) -> bool:
        place = self.path(self.root)
        return self.fs.exists(place) and self.fs.getFileStatus(place).isDirectory()

    def entries(self, below: str) -> Iterator[tuple[str, bool, bool]]:
        for status in self.fs.listStatus(self.path(f"{self.root}/{below}" if below else self.root)):
            yield status.getPath().getName(), status.isDirectory(), status.isFile()

    def lengths(self, below: str) -> dict[str, int]:
        """Bytes of every file in a folder."""
        return {status.getPath().getName(): status.getLen() for status in self.fs.listStatus(self.path(f"{self.root}/{below}" if below else self.root)) if status.isFile()}

    def content_or_none(self, below: str) -> bytes | None:
        """None where the store gives no content; the file then counts as failed."""
        try:
            return self.content(below)
        except Py4JJavaError:
            return None

    def content(self, below: str) -> bytes:
        stream = self.fs.open(self.path(f"{self.root}/{below}"))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()


def _walk_list(folders: _Local | _Remote, skipped: set[str] = frozenset()) -> list[str]:
    """Paths of all files but hidden and ignored ones; folders of a skipped name aren't listed."""
    out: list[str] = []
    open_ = [("", [])]
    while open_:
        below, rules = open_.pop()
        entries = sorted(folders.entries(below))
        if any(name == ".gitignore" and is_file for name, _, is_file in entries):
            own = _rules(folders.content(f"{below}/.gitignore" if below else ".gitignore").decode("utf-8", "replace"))
            rules = [*rules, (below, own)]
        for name, is_folder, is_file in entries:
            path = f"{below}/{name}" if below else name
            if name.startswith(".") or is_folder and name in skipped or _ignored(path, is_folder, rules):
                continue
            if is_folder:
                open_.append((path, rules))
            elif is_file:
                out.append(path)
    return sorted(out)


def _wanted(found: list[str], languages: list[str] | None, ignored: set[str]) -> list[str]:
    out = []
    for path in found:
        language = names.language_of(path)
        if language and (languages is None or language in languages) and not ignored.intersection(path.split("/")[:-1]):
            out.append(path)
    return out


def _ignored_folders(compat: bool) -> set[str]:
    return set(IGNORED[-1:] if compat else IGNORED)


def list_paths(root: str, languages: list[str] | None = None, compat: bool = False) -> list[str]:
    """Paths below a local root of files in a supported (or wanted) language, in order.

    ``compat`` applies only the last of the built-in folder names, as is observed.
    """
    found, ignored = _git_list(root), _ignored_folders(compat)
    found = _walk_list(_Local(root), ignored) if found is None else [p for p in found if not any(x.startswith(".") for x in p.split("/"))]
    return _wanted(found, languages, ignored)


def crawl(spark: SparkSession, root: str, languages: list[str] | None = None, compat: bool = False) -> DataFrame:
    """``path`` (below the root) and ``language`` of every file to index."""
    local = local_root(root)
    if local is not None:
        if not os.path.isdir(local):
            raise NotADirectory(root)
        paths = list_paths(local, languages, compat)
    else:
        folders, ignored = _Remote(spark, root), _ignored_folders(compat)
        if not folders.is_folder():
            raise NotADirectory(root)
        paths = _wanted(_walk_list(folders, ignored), languages, ignored)
    return spark.createDataFrame([(p, names.language_of(p)) for p in paths], "path string, language string")


def count_by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("count"))


def _blocks(rows: Iterator[tuple[str, str | None]], content: Callable[[str], bytes | None]):
    """Record batches of path, language and content, each of about BLOCK_BYTES."""
    import pyarrow as pa

    held: list[tuple[str, str | None, bytes | None]] = []
    size = 0

    def batch():
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary())], names=["path", "language", "content"])

    for path, language in rows:
        got = content(path)
        held.append((path, language, got))
        size += len(path) + len(got or b"")
        if size >= BLOCK_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _reader(root: str):
    def content(path: str) -> bytes | None:
        try:
            with open(os.path.join(root, path), "rb") as f:
                return f.read()
        except OSError:
            return None

    def run(batches):
        yield from _blocks((row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), content)

    return run


#: Characters that mean something in a glob of Hadoop's.
_GLOB = re.compile(r"([\\*?\[\]{}])")


def _read_remote(files: DataFrame, root: str) -> DataFrame:
    """Contents of crawled files in another store.

    Spark lists only folders with such files and reads only names with their extensions.  Its
    file source passes over empty files and names that begin with an underscore; the driver hands
    those on, a block at a time, and each block is written before the next is read.
    """
    import pyarrow as pa

    spark, folders, schema = files.sparkSession, _Remote(files.sparkSession, root), "path string, language string, content binary"
    by_folder: dict[str, list[tuple[str, str | None]]] = {}
    for r in files.select("path", "language").collect():  # names only, as the crawl listed them
        folder, _, name = r.path.rpartition("/")
        by_folder.setdefault(folder, []).append((name, r.language))
    seen, unseen = {}, []
    for folder, listed in by_folder.items():
        lengths, before = folders.lengths(folder), f"{folder}/" if folder else ""
        for name, language in listed:
            if lengths.get(name) and (not name.startswith("_") or "=" in name):
                seen.setdefault(before, set()).add(name.rpartition(".")[2])
            else:
                unseen.append((before + name, language))
    parts = []
    if seen:
        places = [f"{folders.root}/{_GLOB.sub(r'\\\1', before)}*.{extension}" for before, extensions in seen.items() for extension in sorted(extensions)]
        stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(places)
        stored = stored.select(text.relative_path(F.col("path"), folders.root).alias("path"), "content")
        parts.append(stored.join(files.select("path", "language"), "path").select("path", "language", "content"))
    if unseen:
        place = scratch.scratch_path(spark, "unseen")
        for block in _blocks(iter(unseen), folders.content_or_none):
            spark.createDataFrame(pa.Table.from_batches([block]), schema).write.mode("append").parquet(place)
        parts.append(spark.read.schema(schema).parquet(place))
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read(files: DataFrame, root: str, partitions: int | None = None) -> DataFrame:
    """``path``, ``language`` and ``content`` of crawled files, spread over the cluster.

    A local root must be one that executors see too, as on one machine or a shared disk; any
    other root is read by Spark's own file source and joined by path.
    """
    ship(files.sparkSession)
    local = local_root(root)
    if local is None:
        return _read_remote(files, root)
    spread = files.repartition(partitions or files.sparkSession.sparkContext.defaultParallelism * 2, "path")
    return spread.mapInArrow(_reader(local), "path string, language string, content binary")
