"""Rust: functions, types, traits, impl blocks, use clauses and calls."""

from __future__ import annotations

from .lexer import Code
from .records import Found, Lines, Symbol, first_line, to_brace

_MODIFIERS = frozenset("pub const async unsafe extern default".split())
_KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self static struct super trait true type unsafe use where while".split())
_NOT_CALLED = (_KEYWORDS - {"self", "super", "crate"}) | {"Fn", "FnMut", "FnOnce"}


def _start(code: Code, i: int) -> int:
    """The first modifier of an item whose keyword is at ``i``."""
    while i > 0:
        if code.name(i - 1) in _MODIFIERS or code.tokens[i - 1].kind == "string" and code.name(i - 2) == "extern":
            i -= 1
        elif code.is_(i - 1, ")") and code.name(code.open[i - 1] - 1) == "pub":
            i = code.open[i - 1]
        else:
            break
    return i


def _hidden(code: Code) -> set[int]:
    """Tokens in macro calls, macro rules and attributes: no items or calls to the grammar."""
    out: set[int] = set()
    for i in code.places("!", "#"):
        if code.is_(i, "!") and code.name(i - 1):
            k = i + 1 + (code.name(i + 1) is not None and code.name(i - 1) == "macro_rules")
            if code.is_(k, "(", "[", "{"):
                out.update(range(k, code.close[k] + 1))
        elif code.is_(i, "#"):
            k = i + 1 + code.is_(i + 1, "!")
            if code.is_(k, "["):
                out.update(range(k, code.close[k] + 1))
    return out


def _end(code: Code, i: int) -> int | None:
    """The brace or semicolon that follows an item's head; None if neither does."""
    while i < len(code.tokens):
        if code.is_(i, "(", "["):
            i = code.close[i]
        elif code.is_(i, "{", ";"):
            return i
        elif code.is_(i, "}", ")"):
            return None
        i += 1
    return None


def _last(code: Code, k: int) -> int:
    return code.close[k] if code.is_(k, "{") else k


def _doc(code: Code, start: int, marks: tuple[str, ...]) -> str | None:
    raw = code.comment_before(start)
    if raw is None:
        return None
    for mark in marks:
        while raw.startswith(mark):
            raw = raw[len(mark) :]
    return raw.strip()


def _path(code: Code, k: int) -> tuple[str, int]:
    """A type's path without type arguments, and the token behind it with them."""
    parts = []
    while k < len(code.tokens):
        if code.is_(k, "&", "*", "mut", "dyn", "const", "(") and not parts:
            k += 1
        elif code.name(k) and code.name(k) not in ("for", "where"):
            parts.append(code.tokens[k].text)
            k = code.skip_angles(k + 1)
            if code.is_(k, "::"):
                k = code.skip_angles(k + 1)
                continue
            break
        else:
            break
    return "::".join(parts), k


class _Impl:
    def __init__(self, code: Code, i: int):
        k = code.skip_angles(i + 1)
        k += code.is_(k, "!")
        self.first_from = k
        self.first, k = _path(code, k)
        self.second = None
        self.first_text = code.text[code.tokens[self.first_from].start : code.tokens[k - 1].end] if k > self.first_from else ""
        if code.is_(k, "for"):
            at = k + 1
            self.second, k = _path(code, at)
            self.second_text = code.text[code.tokens[at].start : code.tokens[k - 1].end] if k > at else ""
        self.brace = _end(code, k)


def _use(code: Code, i: int, compat: bool) -> tuple[str, list[str]] | None:
    """Target and items of a use clause, from the token behind ``use``."""
    k = i
    while k < len(code.tokens) and not code.is_(k, ";", "{", "as", "*"):
        k += 1
    text = "".join(t.text for t in code.tokens[i:k])
    if code.is_(k, "*"):
        return text.removesuffix("::") + "::*", []
    if code.is_(k, "{"):
        items, at, end = [], k + 1, code.close[k]
        while at < end:
            stop = at
            while stop < end and not code.is_(stop, ","):
                stop = code.close[stop] + 1 if code.is_(stop, "{") else stop + 1
            part = code.tokens[at:stop]
            words = [t.text for t in part]
            if words and all(t.kind == "name" or t.text == "::" for t in part) and "as" not in words and words != ["self"]:
                items.append("".join(words))
            elif words and not compat and "as" in words:
                items.append("".join(words[: words.index("as")]))
            at = stop + 1
        return text.removesuffix("::"), items
    return text, []


def _patterns(code: Code) -> set[int]:
    """Tokens in patterns, where a name before a parenthesis is a constructor that is taken apart."""
    out: set[int] = set()
    n = len(code.tokens)
    for i in code.places("let", "for", "match"):
        if code.is_(i, "let", "for") and not (code.is_(i, "for") and (code.is_(i + 1, "<") or code.depth_owner[i] < 0)):
            stop = "=" if code.is_(i, "let") else "in"
            k = i + 1
            while k < n and not code.is_(k, stop, ";", "{", "}"):
                if code.is_(k, "(", "["):
                    out.update(range(k, code.close[k]))
                    k = code.close[k]
                out.add(k)
                k += 1
        elif code.is_(i, "match"):
            k = i + 1
            while k < n and not code.is_(k, "{", ";"):
                k = code.close[k] + 1 if code.is_(k, "(", "[") else k + 1
            if not code.is_(k, "{"):
                continue
            end, at = code.close[k], k + 1
            while at < end:
                while at < end and not code.is_(at, "=>", "if"):
                    out.add(at)
                    if code.is_(at, "(", "[", "{"):
                        out.update(range(at, min(code.close[at], end)))
                        at = code.close[at]
                    at += 1
                while at < end and not code.is_(at, "=>"):
                    at = code.close[at] + 1 if code.is_(at, "(", "[", "{") else at + 1
                at += 1
                if code.is_(at, "{"):
                    at = code.close[at] + 1
                    at += code.is_(at, ",")
                    continue
                while at < end and not code.is_(at, ","):
                    at = code.close[at] + 1 if code.is_(at, "(", "[", "{") else at + 1
                at += 1
    return out


def _call_start(code: Code, i: int) -> tuple[str, int] | None:
    """Name and first token of the call whose last name is at ``i``."""
    if code.is_(i - 1, "."):
        k = i - 1
        while k > 0 and code.is_(k, ".", "?"):
            k -= 1
            while code.is_(k, "?"):
                k -= 1
            if code.is_(k, ")", "]", "}"):
                k = code.open[k]
                while code.is_(k - 1, ")", "]"):
                    k = code.open[k - 1]
                if code.name(k - 1) and code.name(k - 1) not in _KEYWORDS or code.is_(k - 1, "!"):
                    k -= 1
                    k -= code.is_(k, "!")
                elif code.is_(k - 1, ">"):
                    return code.tokens[i].text, k
            while code.is_(k - 1, "::") and code.name(k - 2):
                k -= 2
            if code.is_(k - 1, "."):
                k -= 1
        return code.tokens[i].text, max(k, 0)
    k = i
    while code.is_(k - 1, "::"):
        if code.name(k - 2):
            k -= 2
        elif code.is_(k - 2, ">"):
            depth, at = 0, k - 2
            while at >= 0:
                depth += code.is_(at, ">") - code.is_(at, "<")
                if not depth:
                    break
                at -= 1
            k = at
            if code.is_(k - 1, "::") and code.name(k - 2):
                k -= 2
            elif code.name(k - 1) and code.name(k - 1) not in _KEYWORDS:
                k -= 1
            else:
                break
        else:
            k -= 1
            break
    return code.text[code.tokens[k].start : code.tokens[i].end], k


def extract(source: str, compat: bool = False) -> Found:
    code, lines, found = Code(source, "rust"), Lines(source), Found()
    n, hidden, patterns = len(code.tokens), _hidden(code), _patterns(code)
    here = lambda *words: [i for i in code.places(*words) if i not in hidden]
    line_end = lambda k: lines(code.tokens[min(k, n - 1)].end - 1)

    def function(i: int) -> Symbol | None:
        brace = _end(code, i + 2)
        if not code.name(i + 1) or brace is None or not code.is_(brace, "{"):
            return None
        start = _start(code, i)
        text = code.between(start, _last(code, brace))
        head = text[: text.find("{")] if "{" in text else text
        is_async = "async fn" in (text if compat else " ".join(head.split()))
        return Symbol(code.name(i + 1), "Function", lines(code.tokens[start].start), line_end(_last(code, brace)), to_brace(text), "public" if text.startswith("pub") else "private", is_async, _doc(code, start, ("///", "//!")))

    functions = {i: s for i in here("fn") if (s := function(i))}
    found.symbols += functions.values()
    bodies = set()
    for word, kind in (("struct", "Struct"), ("enum", "Enum"), ("trait", "Trait")):
        for i in here(word):
            if not code.name(i + 1) or code.is_(i - 1, ".", "::"):
                continue
            end = _end(code, i + 2)
            if end is None:
                continue
            start = _start(code, i)
            text = code.between(start, _last(code, end))
            found.symbols.append(Symbol(code.name(i + 1), kind, lines(code.tokens[start].start), line_end(_last(code, end)), first_line(text), "public" if text.startswith("pub") else "private", False, _doc(code, start, ("///",))))
            if kind != "Trait":
                bodies.update(range(i, _last(code, end)))
    for i in here("impl"):
        if code.depth_owner[i] >= 0 and not code.is_(code.depth_owner[i], "{") or code.is_(i - 1, "->", ":", ",", "<", "&", "(", "=", "+"):
            continue
        impl = _Impl(code, i)
        if impl.brace is None or not code.is_(impl.brace, "{"):
            continue
        if compat:
            parent = impl.first_text if "::" not in impl.first else impl.second_text if impl.second and "::" not in impl.second else None
        else:
            parent = (impl.second if impl.second is not None else impl.first).rpartition("::")[2]
        for k, s in functions.items():
            if impl.brace < k < code.close[impl.brace] and code.depth_owner[k] == impl.brace:
                found.symbols.append(Symbol(s.name, "Method", s.start_line, s.end_line, s.signature, s.visibility, s.is_async, s.docstring, None, parent or None))
        if impl.second is not None:
            if not compat:
                found.inherits.append((impl.second.rpartition("::")[2], [], impl.first.rpartition("::")[2]))
            elif "::" not in impl.first and "::" not in impl.second:
                found.inherits.append((impl.second_text, [], impl.first_text))
    for i in here("use"):
        at = _start(code, i)
        line = lines(code.tokens[at].start)
        if compat and at != i:
            found.imports.append(("use", None, [], line))
        elif (got := _use(code, i + 1, compat)) and got[0]:
            found.imports.append((got[0], None, got[1], line))
    for i in here("crate"):
        if code.is_(i - 1, "extern") and code.name(i + 1):
            found.imports.append((code.name(i + 1), None, [], lines(code.tokens[_start(code, i)].start)))
    for at in code.places("("):
        i, name = at - 1, code.name(at - 1)
        if name is None or i in hidden or name in _NOT_CALLED or name in ("self", "super", "crate") or i in patterns or i in bodies or code.is_(i - 1, "fn", "struct", "dyn", "impl"):
            continue
        got = _call_start(code, i)
        if got and got[0]:
            found.calls.append((got[0], lines(code.tokens[got[1]].start)))
    return found
