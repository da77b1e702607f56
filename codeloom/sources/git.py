"""Changes that git knows of, as rows of path, old_path and kind."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

SCHEMA = "path string, old_path string, kind string"
_KIND = {"A": "Added", "C": "Added", "M": "Modified", "D": "Deleted", "R": "Renamed"}
Change = tuple[str, str | None, str]


class NotARepository(ValueError):
    """No git repository is here or above."""


class InvalidReference(ValueError):
    """A commit that git does not know, or none to compare with."""


class Repository:
    """The repository that holds a directory."""

    def __init__(self, path: str):
        if not os.path.isdir(path):
            raise NotARepository(path)
        self.path = path
        got = self._run("rev-parse", "--show-toplevel", check=False)
        if got is None:
            raise NotARepository(path)
        self.root = got.strip()

    def _run(self, *args: str, check: bool = True) -> str | None:
        got = subprocess.run(["git", "-C", self.path, "-c", "core.quotepath=off", *args], capture_output=True)
        if got.returncode:
            if check:
                raise InvalidReference(got.stderr.decode("utf-8", "replace").strip())
            return None
        return got.stdout.decode("utf-8", "surrogateescape")

    def head(self) -> str:
        return self._run("rev-parse", "--verify", "HEAD^{commit}").strip()

    def resolve(self, reference: str) -> str:
        return self._run("rev-parse", "--verify", "--end-of-options", f"{reference}^{{commit}}").strip()

    def _diff(self, *args: str) -> list[Change]:
        parts = self._run("diff", "--name-status", "--no-renames", "-z", *args, "--").split("\0")
        out: list[Change] = []
        for status, path in zip(parts[::2], parts[1::2], strict=False):
            if kind := _KIND.get(status[:1]):
                out.append((path, None, kind))
        return out

    def between(self, older: str, newer: str) -> list[Change]:
        """Changes from one commit to another."""
        return self._diff(self.resolve(older), self.resolve(newer))

    def untracked(self) -> list[str]:
        return [p for p in self._run("-C", self.root, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if p]

    def since(self, commit: str, compat: bool = False) -> list[Change]:
        """Changes from a commit to the work tree, files that git does not track among them.

        ``compat`` leaves out untracked files below untracked folders, as is observed.
        """
        out = self._diff(self.resolve(commit))
        known = {c[0] for c in out}
        new = self.untracked()
        if compat:
            tracked = {p.rpartition("/")[0] for p in self._run("-C", self.root, "ls-files", "-z").split("\0") if p}
            folders = {f[:k] for f in tracked for k in [*(i for i, c in enumerate(f) if c == "/"), len(f)]}
            new = [p for p in new if "/" not in p or p.rpartition("/")[0] in folders]
        return out + [(p, None, "Added") for p in new if p not in known]

    def uncommitted(self) -> list[Change]:
        """State of the work tree: new before deleted before modified before renamed."""
        parts = self._run("-C", self.root, "status", "--porcelain", "-uall", "-z").split("\0")
        out, k = [], 0
        while k < len(parts) and parts[k]:
            code, path = parts[k][:2], parts[k][3:]
            k += 2 if "R" in code or "C" in code else 1
            for marks, kind in (("?A", "Added"), ("D", "Deleted"), ("MT", "Modified"), ("R", "Renamed")):
                if any(c in code for c in marks):
                    out.append((path, None, kind))
                    break
        return out

    def is_tracked(self, path: str) -> bool:
        """Whether git has a state for a path and does not ignore it; a new file counts as well."""
        full = os.path.join(self.root, path)
        if not os.path.exists(full) and self._run("-C", self.root, "ls-files", "--error-unmatch", "--", path, check=False) is None:
            return False
        return self._run("-C", self.root, "check-ignore", "-q", "--", path, check=False) is None


def with_extensions(changes: list[Change], extensions: list[str]) -> list[Change]:
    """Changes of files whose extension is listed, in just that case."""
    return [c for c in changes if "." in c[0].rpartition("/")[2] and c[0].rpartition(".")[2] in extensions]


def supported(changes: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Changes of files in a supported (or wanted) language."""
    language = names.language_column(F.col("path"))
    return changes.where(language.isNotNull() if languages is None else language.isin(languages))


def frame(spark: SparkSession, changes: list[Change]) -> DataFrame:
    return spark.createDataFrame(changes, SCHEMA)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two tables of ``path`` and ``hash``, where there is no git to ask."""
    a, b = old.select("path", F.col("hash").alias("_old"), F.lit(True).alias("_had")), new.select("path", F.col("hash").alias("_new"), F.lit(True).alias("_has"))
    joined = a.join(b, "path", "full_outer")
    kind = F.when(F.col("_had").isNull(), "Added").when(F.col("_has").isNull(), "Deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "Modified")
    return joined.select("path", F.lit(None).cast("string").alias("old_path"), kind.alias("kind")).where("kind is not null")


def split_changes(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``path`` to delete, ``path`` to parse): every parsed path is deleted first."""
    gone = changes.where(F.col("old_path").isNotNull()).select(F.col("old_path").alias("path")).unionByName(changes.select("path")).distinct()
    return gone, changes.where("kind != 'Deleted'").select("path").distinct()
