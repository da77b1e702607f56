"""What an extractor gathers from one file."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Symbol:
    """``parent`` is the place of the parent in the same list; ``parent_name`` is looked up later."""

    name: str
    kind: str
    start_line: int
    end_line: int
    signature: str | None
    visibility: str = "public"
    is_async: bool = False
    docstring: str | None = None
    parent: int | None = None
    parent_name: str | None = None


@dataclass
class Found:
    """``imports``: target, alias, items, line.  ``calls``: callee, line.  ``inherits``: name of
    the child, kinds that the child may have (none: any), name of the parent."""

    symbols: list[Symbol] = field(default_factory=list)
    imports: list[tuple[str, str | None, list[str], int]] = field(default_factory=list)
    calls: list[tuple[str, int]] = field(default_factory=list)
    inherits: list[tuple[str, list[str], str]] = field(default_factory=list)


class Lines:
    """Line numbers of places in a text."""

    def __init__(self, text: str):
        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)

    def __call__(self, place: int) -> int:
        return bisect_right(self.starts, place)


def first_line(text: str) -> str:
    return text.split("\n", 1)[0].removesuffix("\r")


def to_brace(text: str) -> str:
    """The signature form of functions in languages with braces."""
    head, brace, _ = text.partition("{")
    return head.strip() if brace else first_line(text)
