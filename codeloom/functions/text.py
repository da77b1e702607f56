"""Column functions over source text: digests, signatures, comments, cutting and padding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, in hexadecimal."""
    return F.sha2(content, 256)


def line_count(text: Column) -> Column:
    """Newlines and one more; of a text column."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def first_line(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "\n", 1), "\r$", "")


def signature_to_brace(text: Column) -> Column:
    """What stands before the first opening brace, else the first line."""
    return F.when(F.contains(text, F.lit("{")), F.trim(F.substring_index(text, "{", 1))).otherwise(first_line(text))


def signature_of_block(text: Column) -> Column:
    """The first line without the colons that end it."""
    return F.regexp_replace(first_line(text), ":+$", "")


def signature_of_class(text: Column) -> Column:
    """The first line without the braces that end it."""
    return F.trim(F.regexp_replace(first_line(text), r"\{+$", ""))


def trim_doc(text: Column, marks: tuple[str, ...] = ("///", "//!")) -> Column:
    """A comment without the marks that begin it, each as often as it stands there."""
    for mark in marks:
        text = F.regexp_replace(text, rf"^(?:{mark})+", "")
    return F.trim(text)


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three dots where something was cut."""
    if limit < 4:
        return F.substring(text, 1, limit)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def pad(text: Column, width: int) -> Column:
    """Spaces up to a width; longer texts stay whole."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def indent(distance: Column) -> Column:
    return F.repeat(F.lit("  "), F.greatest(distance - 1, F.lit(0)).cast("int"))


def relative_path(path: Column, root: str) -> Column:
    """The path below a root; others stay as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def short_commit(commit: Column) -> Column:
    return F.substring(commit, 1, 12)


def items_json(items: Column) -> Column:
    return F.to_json(items)


def python_visibility(name: Column, is_class: Column | None = None) -> Column:
    """private, protected or public by the underscores of a Python name."""
    function = F.when(F.startswith(name, F.lit("__")) & ~F.endswith(name, F.lit("__")), "private").when(F.startswith(name, F.lit("_")), "protected").otherwise("public")
    if is_class is None:
        return function
    return F.when(is_class, F.when(F.startswith(name, F.lit("_")), "private").otherwise("public")).otherwise(function)


def case_visibility(name: Column) -> Column:
    """public if the first letter is upper case."""
    first = F.substring(name, 1, 1)
    return F.when((F.upper(first) == first) & (F.lower(first) != first), "public").otherwise("private")


def escaped(text: str) -> str:
    """A string literal's inside, for the query language's text form."""
    for plain, code in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(plain, code)
    return text
