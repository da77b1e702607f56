"""Languages, symbol kinds, visibilities and change kinds, and how each is spelt.

An unknown spelling raises ``UnknownName``; the column forms give null instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that stored tables and commands share with the tool whose queries run here; fixed values.
LANGUAGES = ("Python", "Rust", "JavaScript", "TypeScript", "Go", "C++")
EXTENSIONS = {
    "Python": ("py",),
    "Rust": ("rs",),
    "JavaScript": ("js", "mjs", "cjs"),
    "TypeScript": ("ts", "tsx"),
    "Go": ("go",),
    "C++": ("cpp", "cc", "cxx", "c++", "hpp", "hxx", "h"),
}
SPELLINGS = {"python": "Python", "py": "Python", "rust": "Rust", "rs": "Rust", "javascript": "JavaScript", "js": "JavaScript", "typescript": "TypeScript", "ts": "TypeScript", "go": "Go", "cpp": "C++", "c++": "C++"}
KINDS = ("Function", "Class", "Struct", "Interface", "Module", "Method", "Trait", "Enum", "Constant", "Variable")
SYMBOL_LABELS = ("Function", "Class", "Struct", "Interface", "Method", "Trait", "Enum")
PARENT_LABELS = ("Class", "Struct", "Interface", "Trait")
CALLER_LABELS = ("Function", "Method")
VISIBILITIES = ("public", "private", "protected")
CHANGES = ("Added", "Modified", "Deleted", "Renamed")

LANGUAGE_OF_EXTENSION = {e: language for language, extensions in EXTENSIONS.items() for e in extensions}


class UnknownName(ValueError):
    """A language or kind that is not known."""


def extension(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rpartition(".")[2].lower() if "." in name[1:] else ""


def language_of(path: str) -> str | None:
    """Language of a file by its extension, whatever its case."""
    return LANGUAGE_OF_EXTENSION.get(extension(path))


def parse_language(text: str) -> str:
    try:
        return SPELLINGS[text.strip().lower()]
    except KeyError:
        raise UnknownName(f"Unknown language: {text.strip()}") from None


def parse_languages(text: str | None) -> list[str] | None:
    """Languages from a comma-separated list; None stands for all."""
    return None if text is None else [parse_language(part) for part in text.split(",")]


def parse_kind(text: str) -> str:
    """The label of a symbol kind, given in lower case."""
    found = {label.lower(): label for label in SYMBOL_LABELS}.get(text)
    if found is None:
        raise UnknownName(f"Unknown symbol kind: {text}")
    return found


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def extension_column(path: Column) -> Column:
    """The extension in lower case; empty where a name has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def language_column(path: Column) -> Column:
    """Language of a path, null if not supported."""
    return _lookup(extension_column(path), LANGUAGE_OF_EXTENSION)


def symbol_id(path: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", path, name, line.cast("string"))


def node_key(label: Column, identity: Column) -> Column:
    """Nodes are told apart by label and identity: two labels may share an identity."""
    return F.concat_ws("|", label, identity)
