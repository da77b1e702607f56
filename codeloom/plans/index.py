"""Full and incremental indexing.

The raw records of every file are kept beside the graph, and edges are always resolved from all
of them; so an update gives the same graph as indexing anew.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import build, upsert
from ..operators.extract import registry
from ..sources import git, paths
from ..sources.store import LAST_COMMIT, Store


@dataclass
class Statistics:
    """What an indexing run did."""

    files_discovered: int = 0
    files_parsed: int = 0
    files_skipped: int = 0
    files_failed: int = 0
    symbols_written: int = 0
    duration: float = 0.0
    changes: list[git.Change] = field(default_factory=list)

    def text(self) -> str:
        rows = [("Files discovered:", self.files_discovered), ("Files parsed:", self.files_parsed), ("Files skipped:", self.files_skipped), ("Files failed:", self.files_failed), ("Symbols written:", self.symbols_written), ("Duration:", f"{self.duration:.2f}s")]
        return "\n".join(["Indexing Statistics:", *[f"  {name:<17} {value}" for name, value in rows], ""])


def _repository(root: str) -> git.Repository | None:
    local = paths.local_root(root)
    try:
        return git.Repository(local) if local else None
    except git.NotARepository:
        return None


def base_folder(root: str, compat: bool = False) -> str:
    """The folder that stored paths are relative to: the repository's, where there is one.

    ``compat`` keeps to the folder that was given, as is observed.
    """
    repository = None if compat else _repository(root)
    return repository.root if repository else root


def merge(old: build.Graph, gone: DataFrame, new: build.Graph) -> build.Graph:
    """Raw tables without the files that are gone, and with the new ones."""
    tables = {}
    for name in build.RAW:
        column = "path" if name == "files" else "file_path"
        tables[name] = upsert.without(getattr(old, name), gone, column, "path").unionByName(getattr(new, name))
    return build.Graph(**tables)


def _statistics(extracted: DataFrame, started: float, skipped: int = 0) -> Statistics:
    row = build.statistics(extracted).first()
    return Statistics(row.files_discovered + skipped, row.files_parsed, skipped, row.files_failed, row.symbols_written, time.time() - started)


def full_index(spark: SparkSession, root: str, store: Store, languages: list[str] | None = None, clear: bool = True, jobs: int | None = None, compat: bool = False, sequential: bool = False) -> Statistics:
    """Index a directory.  Without ``clear`` the files of earlier runs stay, unless found again."""
    started = time.time()
    base = base_folder(root, compat)
    files = paths.crawl(spark, root, languages, compat)
    local, local_base = paths.local_root(root), paths.local_root(base)
    if local and local_base and local != local_base:
        files = files.withColumn("path", F.concat(F.lit(local[len(local_base) :].strip("/") + "/"), "path"))
    extracted = _kept(store, registry.extract(paths.read(files, base, jobs), compat))
    raw = build.raw_tables(extracted)
    if not clear:
        raw = merge(store.load(), files.select("path"), raw)
    graph = build.derive(store.stage(raw), sequential)
    repository = _repository(root)
    empty = spark.createDataFrame([], "key string, value string")
    metadata = empty if clear else store.table("metadata")
    if repository is not None:
        try:
            commit = spark.createDataFrame([(LAST_COMMIT, repository.head())], metadata.schema)
            metadata = metadata.where(F.col("key") != LAST_COMMIT).unionByName(commit)
        except git.InvalidReference:
            pass  # no commit yet
    store.write(graph, metadata)
    return _statistics(extracted, started)


def _kept(store: Store, extracted: DataFrame) -> DataFrame:
    """Extraction is done once: its rows are written and read back."""
    import uuid

    path = f"{store.path}/tmp-{uuid.uuid4().hex}/extracted"
    extracted.write.parquet(path)
    return store.spark.read.schema(registry.SCHEMA).parquet(path)


def apply_changes(spark: SparkSession, store: Store, changes: DataFrame, contents: DataFrame, compat: bool = False, sequential: bool = False) -> tuple[build.Graph, DataFrame]:
    """The graph after changes, and what was extracted.

    ``changes``: path, old_path, kind.  ``contents``: path, language, content of files that were
    added, modified or renamed.
    """
    gone, wanted = git.split_changes(changes)
    extracted = _kept(store, registry.extract(contents.join(wanted, "path", "left_semi"), compat))
    raw = merge(store.load(), gone, build.raw_tables(extracted))
    return build.derive(store.stage(raw), sequential), extracted


def update(spark: SparkSession, root: str, store: Store, since: str | None = None, dry_run: bool = False, languages: list[str] | None = None, compat: bool = False, sequential: bool = False) -> Statistics:
    """Bring the graph up to date with what git says has changed since a commit.

    Files whose content is as stored are skipped.  A dry run writes nothing.
    """
    started = time.time()
    local = paths.local_root(root)
    if local is None:
        raise git.NotARepository(root)
    repository = git.Repository(local)
    since = since or store.get_metadata(LAST_COMMIT)
    if since is None:
        raise git.InvalidReference("No previous index found. Run full index first.")
    found = [c for c in repository.since(since, compat) if (language := names.language_of(c[0])) and (languages is None or language in languages)]
    below = repository.root if not compat else local
    if dry_run:
        return Statistics(files_discovered=len(found), duration=time.time() - started, changes=found)
    changes = git.frame(spark, found)
    present = [(p, names.language_of(p)) for p, _, kind in found if kind != "Deleted"]
    contents = paths.read(spark.createDataFrame(present, "path string, language string"), below)
    skipped = 0
    if present and not compat:
        hashes = contents.select("path", F.sha2("content", 256).alias("hash"))
        same = {r.path for r in hashes.join(store.table("files").select("path", "hash"), ["path", "hash"], "left_semi").collect()}  # of changed files only
        skipped = len(same)
        changes = changes.where(~F.col("path").isin(list(same))) if same else changes
    graph, extracted = apply_changes(spark, store, changes, contents, compat, sequential)
    store.write(graph, store.with_metadata(LAST_COMMIT, repository.head()))
    stats = _statistics(extracted, started, skipped)
    stats.files_discovered, stats.changes = len(found), found
    return stats


def delete_file(store: Store, path: str) -> None:
    """Take one file, its symbols and all their edges out of the graph; modules stay.

    The edges are resolved anew, so what remains is what indexing the other files gives.
    """
    gone = store.spark.createDataFrame([(path,)], "path string")
    old = store.load()
    none = build.Graph(*[getattr(old, n).limit(0) for n in build.RAW])
    graph = build.derive(store.stage(merge(old, gone, none)))
    graph.modules = old.modules.unionByName(graph.modules).distinct()
    store.write(graph)
