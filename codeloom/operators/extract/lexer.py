"""Tokens of languages with braces: strings, comments and directives are told from code.

Broken text never fails: an open string or comment ends with its line or the file, and a bracket
without partner closes at the end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, number, string, template, punct
    text: str
    start: int
    end: int


_NAME = r"(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)"
_NUMBER = r"(?P<number>\d(?:[\w]|\.(?=\d))*)"
_PUNCT = r"(?P<punct>=>|->|::|\.\.\.|\?\.|==|!=|<=|>=|&&|\|\||:=|\S)"
_LINE_COMMENT, _BLOCK_COMMENT = r"(?P<comment>//[^\n]*", r"|/\*.*?(?:\*/|\Z))"
_QUOTED = r'"(?:[^"\\\n]|\\.)*"?'
_SINGLE = r"'(?:[^'\\\n]|\\.)*'?"

_MASTER = {
    "go": rf"{_LINE_COMMENT}{_BLOCK_COMMENT}|(?P<string>{_QUOTED}|{_SINGLE}|`[^`]*`?)|{_NAME}|{_NUMBER}|{_PUNCT}",
    "script": rf"{_LINE_COMMENT}{_BLOCK_COMMENT}|(?P<string>{_QUOTED}|{_SINGLE})|(?P<template>`)|{_NAME}|{_NUMBER}|{_PUNCT}",
    "rust": rf"""{_LINE_COMMENT})|(?P<nested>/\*)|(?P<raw>b?r(?P<fence>\#*)".*?(?:"(?P=fence)|\Z))|(?P<string>b?"(?:[^"\\]|\\.)*"?|b?'(?:\\[^'\n]*|[^\\'\n])')|(?P<lifetime>'[A-Za-z_]\w*)|(?:r\#)?{_NAME}|{_NUMBER}|{_PUNCT}""",
    "cpp": rf"""{_LINE_COMMENT}{_BLOCK_COMMENT}|(?P<directive>(?m:^)[ \t]*\#(?:[^\n\\/]|\\(?:\r?\n|.)|/(?![/*]))*)|(?P<raw>(?:u8|[uUL])?R"(?P<fence>[^\s()\\]{{0,16}})\(.*?(?:\)(?P=fence)"|\Z))|(?P<string>(?:u8|[uUL])?(?:{_QUOTED}|{_SINGLE}))|{_NAME}|{_NUMBER}|{_PUNCT}""",
}
_COMPILED = {k: re.compile(v, re.DOTALL) for k, v in _MASTER.items()}
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "instanceof", "else", "do", "yield", "await"}
_PAIRS = {")": "(", "]": "[", "}": "{"}
_BRACKETS = frozenset("()[]{}")
_new = tuple.__new__  # makes a Token without the call of its own constructor


#: Pieces that make up a whole text, white space too; the order of kinds is that of ``_MASTER``.
_SPACE = r"\n+|[^\S\n]+"
_PLAIN = r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*|\d(?:[\w]|\.(?=\d))*|=>|->|::|\.\.\.|\?\.|==|!=|<=|>=|&&|\|\||:=|\S"
_ANY_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_PIECES = {
    "go": rf"{_SPACE}|{_ANY_COMMENT}|{_QUOTED}|{_SINGLE}|`[^`]*`?|{_PLAIN}",
    "script": rf"{_SPACE}|{_ANY_COMMENT}|{_QUOTED}|{_SINGLE}|{_PLAIN}",
    "rust": rf"""{_SPACE}|//[^\n]*|b?"(?:[^"\\]|\\.)*"?|b?'(?:\\[^'\n]*|[^\\'\n])'|'[A-Za-z_]\w*|{_PLAIN}""",
    "cpp": rf"""{_ANY_COMMENT}|(?m:^)[ \t]*\#(?:[^\n\\/]|\\(?:\r?\n|.)|/(?![/*]))*|{_SPACE}|(?:u8|[uUL])?(?:{_QUOTED}|{_SINGLE})|{_PLAIN}""",
}
_FINDALL = {k: re.compile(v, re.DOTALL).findall for k, v in _PIECES.items()}
#: What needs a look at the tokens before it or nests, so that a text cannot be cut in one go.
_HARD = {
    "go": None,
    "script": re.compile(r"`|/(?![/*])").search,
    "rust": re.compile(r"""/\*|r\#|r"|"(?=\#)""").search,
    "cpp": re.compile(r'R"').search,
}
_SPACE_KIND, _COMMENT_KIND, _MAYBE_STRING = "space", "comment", "prefix"
_FIRST: dict[str, dict[str, str]] = {}
for _language in _PIECES:
    _first = _FIRST[_language] = {chr(c): "punct" for c in range(33, 127)}
    _first |= {c: "name" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$"} | {c: "number" for c in "0123456789"}
    _first |= {c: _SPACE_KIND for c in " \t\n\r\f\v\x1c\x1d\x1e\x1f"} | {'"': "string", "'": "string", "/": "slash"}
_FIRST["go"] |= {"`": "string"}
_FIRST["rust"] |= {"b": _MAYBE_STRING, "'": "quote"}
_FIRST["cpp"] |= {c: _MAYBE_STRING for c in "uUL"} | {"#": "directive", " ": "blank", "\t": "blank"}


class Code:
    """Tokens of one file with comments, directives and matching brackets."""

    def __init__(self, text: str, language: str):
        self.text, self.tokens, self.comments, self.directives = text, [], [], []
        hard = _HARD[language]
        if text.isascii() and not (hard and hard(text)):
            self._cut(language)
        else:
            self._scan(0, len(text), language, False)
        self.count = n = len(self.tokens)
        #: Texts of names and marks, and of names alone, by place; None for other tokens.
        self.words = words = [t[1] if t[0] == "name" or t[0] == "punct" else None for t in self.tokens]
        self.names = [t[1] if t[0] == "name" else None for t in self.tokens]
        self.found: dict[str, list[int]] = {}
        self.close, self.open = close, opened = [n] * n, [-1] * n
        self.depth_owner = owners = []
        stack: list[int] = []
        owner, found, owned = -1, self.found, owners.append
        for i, word in enumerate(words):
            if word is None:
                owned(owner)
                continue
            if word in found:
                found[word].append(i)
            else:
                found[word] = [i]
            if word not in _BRACKETS:
                owned(owner)
            elif word in _PAIRS:
                for k in range(len(stack) - 1, -1, -1):
                    if words[stack[k]] == _PAIRS[word]:
                        close[stack[k]], opened[i] = i, stack[k]
                        del stack[k:]
                        owner = stack[-1] if stack else -1
                        break
                owned(owner)
            else:
                owned(owner)
                stack.append(i)
                owner = i
        self.comment_ends = [b for _, b in self.comments]

    def _cut(self, language: str) -> None:
        """The same as ``_scan`` of a whole text that holds nothing hard: all is cut in one go."""
        at, first, add = 0, _FIRST[language], self.tokens.append
        for piece in _FINDALL[language](self.text):
            end, kind = at + len(piece), first.get(piece[0], "punct")
            if kind == "name" or kind == "punct" or kind == "number" or kind == "string":
                add(_new(Token, (kind, piece, at, end)))
            elif kind == _SPACE_KIND:
                pass
            elif kind == _MAYBE_STRING:
                add(_new(Token, ("string" if '"' in piece or "'" in piece else "name", piece, at, end)))
            elif kind == "slash":
                if len(piece) > 1:
                    self.comments.append((at, end))
                else:
                    add(_new(Token, ("punct", piece, at, end)))
            elif kind == "quote":  # a character, a lifetime, or a mark alone
                if len(piece) == 1:
                    add(_new(Token, ("punct", piece, at, end)))
                elif piece[-1] == "'":
                    add(_new(Token, ("string", piece, at, end)))
            elif kind == "blank":
                if "#" in piece:
                    self.directives.append((at, end))
            elif at == 0 or self.text[at - 1] == "\n":
                self.directives.append((at, end))
            else:
                add(_new(Token, ("punct", piece, at, end)))
            at = end

    def _scan(self, at: int, end: int, language: str, inside: bool) -> int:
        """Read tokens; ``inside`` a template's expression, up to the brace that ends it."""
        find, depth, text, tokens = _COMPILED[language].search, 0, self.text, self.tokens
        while at < end and (m := find(text, at, end)):
            kind, at = m.lastgroup, m.end()
            if kind == "name" and not inside:
                start = m.start(kind)
                tokens.append(_new(Token, (kind, text[start:at], start, at)))
                continue
            if kind == "fence":
                kind = "raw"
            if kind == "comment":
                self.comments.append(m.span())
            elif kind == "nested":
                at = self._nested(m.start(), end)
                self.comments.append((m.start(), at))
            elif kind == "directive":
                self.directives.append(m.span())
            elif kind == "template":
                at = self._template(m.start(), end, language)
            elif kind in ("string", "raw"):
                self.tokens.append(Token("string", m.group(), *m.span()))
            elif kind == "lifetime":
                continue
            elif kind == "punct" and m.group() == "/" and language == "script" and self._regex_may_follow() and (r := _REGEX.match(self.text, m.start(), end)):
                self.tokens.append(Token("string", r.group(), *r.span()))
                at = r.end()
            else:
                if inside and kind == "punct":
                    depth += (m.group() == "{") - (m.group() == "}")
                    if depth < 0:
                        return at
                start = m.start(kind) if kind == "name" else m.start()
                tokens.append(_new(Token, (kind, text[start : m.end()], start, m.end())))
        return end

    def _nested(self, at: int, end: int) -> int:
        depth = 0
        for m in re.compile(r"/\*|\*/").finditer(self.text, at, end):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        return end

    def _template(self, at: int, end: int, language: str) -> int:
        """A template string: one token, then those of the expressions in it."""
        self.tokens.append(Token("template", "`", at, at + 1))
        at += 1
        while at < end:
            c = self.text[at]
            if c == "\\":
                at += 2
            elif c == "`":
                return at + 1
            elif c == "$" and self.text.startswith("${", at):
                at = self._scan(at + 2, end, language, True)
            else:
                at += 1
        return end

    def _regex_may_follow(self) -> bool:
        if not self.tokens:
            return True
        t = self.tokens[-1]
        return t.kind == "punct" and t.text not in ")]}" or t.kind == "name" and t.text in _BEFORE_REGEX

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.count and self.words[i] in texts

    def name(self, i: int) -> str | None:
        return self.names[i] if 0 <= i < self.count else None

    def places(self, *texts: str) -> list[int]:
        """Places of names and marks with one of these texts, in order."""
        if len(texts) == 1:
            return self.found.get(texts[0], [])
        return sorted(i for text in set(texts) for i in self.found.get(text, ()))

    def comment_before(self, i: int) -> str | None:
        """The comment that stands directly before a token, with only space between."""
        start = self.tokens[i].start
        k = bisect_left(self.comment_ends, start + 1) - 1
        if k < 0 or self.text[self.comments[k][1] : start].strip():
            return None
        return self.text[self.comments[k][0] : self.comments[k][1]]

    def between(self, i: int, j: int) -> str:
        """Text from the start of one token to the end of another."""
        return self.text[self.tokens[i].start : self.tokens[min(j, len(self.tokens) - 1)].end]

    def skip_angles(self, i: int) -> int:
        """The token behind a list in angle brackets that opens at ``i``; ``i`` itself if none does."""
        if not self.is_(i, "<"):
            return i
        depth, k = 0, i
        while k < len(self.tokens):
            t = self.tokens[k].text
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return k + 1
            elif t in ("(", "[", "{"):
                k = self.close[k]
            elif t in (";", ")", "]", "}"):
                return i
            k += 1
        return i
