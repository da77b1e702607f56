"""C++: functions, classes, structs, enums, members, includes and calls."""

from __future__ import annotations

import re

from .lexer import Code
from .records import Found, Lines, Symbol, first_line, to_brace

_KEYWORDS = frozenset("alignas alignof asm auto break case catch class const constexpr consteval constinit const_cast continue co_await co_return co_yield decltype default delete do else enum explicit export extern final for friend goto if inline mutable namespace new noexcept operator override private protected public register requires return sizeof static static_assert struct switch template this thread_local throw try typedef typeid typename union using virtual volatile while".split())
_NOT_CALLED = frozenset("if for while switch catch return sizeof alignof alignas decltype noexcept static_assert new delete throw operator requires typeid defined case else do explicit __attribute__ __declspec asm".split())
_TYPES = frozenset("void bool char short int long float double signed unsigned wchar_t auto".split())
_NO_DECLARATOR = _KEYWORDS | _TYPES
_AFTER = frozenset("const noexcept override final volatile mutable try".split())
_EXPRESSION_BEFORE = frozenset("return else do case throw co_return co_await co_yield and or not".split())
_INCLUDE = re.compile(r"[ \t]*#[ \t]*include[ \t]*(\"[^\"\n]*\"|<[^>\n]*>)")


class Cpp:
    def __init__(self, source: str, compat: bool):
        self.code, self.lines, self.found, self.compat = Code(source, "cpp"), Lines(source), Found(), compat
        self.n = len(self.code.tokens)
        self.names: set[int] = set()  # names of functions that are declared or defined
        self.classes: list[tuple[int, int, int | None]] = []  # keyword, name, brace
        self.not_code: set[int] = set()  # members of enums
        self._find_classes()
        self.scopes = {b for _, _, b in self.classes if b is not None} | self._namespaces()
        self.functions = self._find_functions()

    def line(self, i: int, end: bool = False) -> int:
        t = self.code.tokens[min(i, self.n - 1)]
        return self.lines(max(t.end - 1, 0) if end else t.start)

    def _namespaces(self) -> set[int]:
        code, out = self.code, set()
        for i in code.places("namespace", "extern"):
            if code.is_(i, "namespace"):
                k = i + 1
                while code.name(k) or code.is_(k, "::"):
                    k += 1
                if code.is_(k, "{"):
                    out.add(k)
            elif code.is_(i, "extern") and i + 1 < self.n and code.tokens[i + 1].kind == "string" and code.is_(i + 2, "{"):
                out.add(i + 2)
        return out

    def _find_classes(self) -> None:
        code = self.code
        for i in code.places("class", "struct"):
            if code.is_(i - 1, "enum", "<", ",", "typename", "friend"):
                continue
            k = i + 1
            while code.is_(k, "[") or code.is_(k, "alignas") or code.name(k) and code.name(k + 1) and not code.is_(k + 1, "final"):
                if code.is_(k, "["):
                    k = code.close[k] + 1
                elif code.is_(k + 1, "("):
                    k = code.close[k + 1] + 1
                else:
                    k += 1
            if code.name(k) is None:
                continue
            name, k = k, code.skip_angles(k + 1)
            k += code.is_(k, "final")
            if code.is_(k, ":"):
                while k < self.n and not code.is_(k, "{", ";"):
                    k += 1
            if code.is_(k, "{"):
                self.classes.append((i, name, k))
            elif code.is_(k, ";") and self._begins(i):
                self.classes.append((i, name, None))

    def _begins(self, i: int) -> bool:
        """Whether a statement begins at ``i``, but for a template's head."""
        code = self.code
        return i <= 0 or code.is_(i - 1, ";", "{", "}", ":") or code.is_(i - 1, ">") or any(a <= code.tokens[i].start and code.tokens[i - 1].end <= a for a, _ in code.directives)

    def _declarator(self, i: int) -> tuple[int, int, int] | None:
        """(first token of the name, the last, its parenthesis) for a name before a parenthesis."""
        code = self.code
        if not code.is_(i + 1, "(") or code.name(i) is None or code.name(i) in _NO_DECLARATOR:
            return None
        first = i
        if code.is_(first - 1, "~"):
            first -= 1
        while code.is_(first - 1, "::"):
            k = first - 2
            if code.is_(k, ">"):
                depth = 0
                while k >= 0:
                    depth += code.is_(k, ">") - code.is_(k, "<")
                    if not depth:
                        break
                    k -= 1
                k -= 1
            if code.name(k) is None or code.name(k) in _KEYWORDS:
                first -= 1
                break
            first = k
        return first, i, i + 1

    def _find_functions(self) -> dict[int, tuple[int, int, int | None, int]]:
        """For the name of each function: first token, first of its name, body's brace, last token."""
        code, out, k = self.code, {}, 0
        while k < self.n:
            owner = code.depth_owner[k]
            if owner >= 0 and owner not in self.scopes:
                # Past what is no scope of declarations.
                k = max(k + 1, min(code.close[owner], self.n))
                continue
            got = self._declarator(k)
            if got is None:
                k += 1
                continue
            first, name, paren = got
            at = code.close[paren] + 1
            while at < self.n:
                if code.name(at) in _AFTER:
                    at += 1
                    if code.is_(at, "("):
                        at = code.close[at] + 1
                elif code.is_(at, "&", "&&"):
                    at += 1
                elif code.is_(at, "->"):
                    at += 1
                    while at < self.n and not code.is_(at, "{", ";", "="):
                        at = code.skip_angles(at) if code.is_(at, "<") and code.skip_angles(at) != at else code.close[at] + 1 if code.is_(at, "(", "[") else at + 1
                else:
                    break
            body = None
            if code.is_(at, ":") and not code.is_(at - 1, "public", "private", "protected"):
                at += 1
                while at < self.n and not code.is_(at, ";"):
                    if code.is_(at, "(") or code.is_(at, "{") and (code.name(at - 1) or code.is_(at - 1, ">")) and not code.is_(at - 1, ")"):
                        at = code.close[at] + 1
                        if code.is_(at, "{") and not code.is_(at - 1, ","):
                            break
                    else:
                        at += 1
            if code.is_(at, "{"):
                body, last = at, code.close[at]
            elif code.is_(at, "=") and (code.is_(at + 1, "default", "delete") or at + 1 < self.n and code.tokens[at + 1].text == "0"):
                defined = code.name(at + 1) is not None
                last = at + 2
                if defined:
                    body = at
            elif code.is_(at, ";"):
                last = at
            else:
                k = code.close[paren] + 1
                continue
            start = self._type_start(first)
            typed = start < first or code.is_(first, "~") or code.is_(first + 1, "::") or owner in {b for _, _, b in self.classes}
            if typed:
                out[name] = (start, first, body, min(last, self.n - 1))
                self.names.update(range(first, name + 1))
            k = min(last, self.n - 1) + 1
        return out

    def _type_start(self, i: int) -> int:
        """The first token of a declaration whose name is at ``i``; a template's head is not in it."""
        code, k = self.code, i
        while k > 0:
            p = k - 1
            if code.is_(p, ";", "{", "}", ":", ")", ",", "(", "=") or any(code.tokens[p].end <= a < code.tokens[k].start for a, _ in code.directives):
                break
            if code.is_(p, ">"):
                depth, at = 0, p
                while at >= 0:
                    depth += code.is_(at, ">") - code.is_(at, "<")
                    if not depth:
                        break
                    at -= 1
                if at <= 0 or code.is_(at - 1, "template"):
                    break
                k = at
                continue
            if code.is_(p, "]"):
                k = max(code.open[p], 0)
                continue
            k = p
        return k

    def _symbol(self, name: int, kind: str, visibility: str = "public", parent: int | None = None) -> Symbol:
        code = self.code
        start, first, body, last = self.functions[name]
        text = code.between(start, last)
        shown = code.text[code.tokens[first].start : code.tokens[name].end]
        if body is None:
            return Symbol(shown, kind, self.line(first), self.line(code.close[name + 1], True), None, visibility, False, None, parent)
        return Symbol(shown, kind, self.line(start), self.line(last, True), to_brace(text), visibility, False, code.comment_before(start), parent)

    def _observed(self, name: int, in_class: bool) -> bool:
        """Whether the observed behaviour recognises a name: plain members have none that it knows."""
        if not self.compat or not in_class:
            return True
        _, first, body, _ = self.functions[name]
        owner = next(self.code.name(n) for _, n, b in self.classes if b == self.code.depth_owner[name])
        return self.code.is_(first, "~") or self.code.name(name) == owner and body is not None

    def run(self) -> Found:
        code, found = self.code, self.found
        bodies = {b for _, _, b in self.classes if b is not None}
        for name in self.functions:
            if self.functions[name][2] is not None and self._observed(name, code.depth_owner[name] in bodies):
                found.symbols.append(self._symbol(name, "Function"))
        for word in ("class", "struct"):
            for i, n, brace in self.classes:
                if code.tokens[i].text == word:
                    self._class(i, n, brace, word)
        for i in code.places("enum"):
            k = i + 1 + code.is_(i + 1, "class", "struct")
            if code.name(k) and not code.is_(k, "class"):
                end = k + 1
                while end < self.n and not code.is_(end, "{", ";", ")", "(", "="):
                    end += 1
                if code.is_(end, "{"):
                    self.not_code.update(range(end, code.close[end]))
                    found.symbols.append(Symbol(code.name(k), "Enum", self.line(i), self.line(code.close[end], True), first_line(code.between(i, code.close[end])), "public", False, code.comment_before(i)))
        self._imports()
        self._calls()
        return found

    def _class(self, i: int, n: int, brace: int | None, word: str) -> None:
        code, found = self.code, self.found
        last = code.close[brace] if brace is not None else n
        me, name = len(found.symbols), code.tokens[n].text
        found.symbols.append(Symbol(name, "Class" if word == "class" else "Struct", self.line(i), self.line(last, True), first_line(code.between(i, last)), "public", False, code.comment_before(i)))
        if brace is None:
            return
        k = code.skip_angles(n + 1)
        k += code.is_(k, "final")
        if code.is_(k, ":"):
            k += 1
            while k < brace:
                if code.name(k) and code.name(k) not in _KEYWORDS:
                    at = k
                    while code.is_(at + 1, "::") and code.name(at + 2):
                        at += 2
                    after = code.skip_angles(at + 1)
                    if after == at + 1:
                        found.inherits.append((name, ["Class", "Struct"], code.text[code.tokens[k].start : code.tokens[at].end]))
                    k = after
                else:
                    k += 1
        access = "private" if word == "class" else "public"
        for k in range(brace + 1, min(code.close[brace], self.n)):
            if code.depth_owner[k] != brace:
                continue
            if code.is_(k, "public", "private", "protected") and code.is_(k + 1, ":"):
                access = code.tokens[k].text
            elif k in self.functions and self._observed(k, True):
                found.symbols.append(self._symbol(k, "Method", access, me))

    def _imports(self) -> None:
        code, out = self.code, self.found.imports
        for a, b in code.directives:
            if m := _INCLUDE.match(code.text, a, b):
                at = a + len(code.text[a:b]) - len(code.text[a:b].lstrip())
                if target := m[1].strip('"').strip("<").strip(">"):
                    out.append((target, None, [], self.lines(at)))
        for i in code.places("using"):
            k = i + 1
            while k < self.n and not code.is_(k, ";", "=", "{", "}"):
                k += 1
            if code.is_(k, ";") and k > i + 1:
                out.append((code.text[code.tokens[i].end : code.tokens[k].start].strip(), None, [], self.line(i)))

    def _calls(self) -> None:
        code = self.code
        inside = [False] * self.n
        for _, _, body, _ in self.functions.values():
            if body is not None and code.is_(body, "{"):
                for k in range(body, min(code.close[body], self.n)):
                    inside[k] = True
        for at in code.places("(", "<"):
            i, name = at - 1, code.name(at - 1)
            if name is None or i in self.names or i in self.not_code or name in _NOT_CALLED or name in _TYPES:
                continue
            after = code.skip_angles(i + 1) if not code.is_(i + 1, "(") else i + 1
            if not code.is_(after, "("):
                continue
            template, member = after != i + 1, code.is_(i - 1, ".", "->")
            if name in _KEYWORDS and not (template and name == "const_cast") or member and template or code.is_(i - 1, "~", "[", "operator"):
                continue
            start = i
            while code.is_(start - 1, "::") and code.name(start - 2):
                start -= 2
            before = code.name(start - 1)
            if not member and (before is not None and before not in _EXPRESSION_BEFORE or code.is_(start - 1, ">") and not inside[i]):
                continue  # a declaration, or the type after new
            if not member and not inside[i] and not self._initialiser(i):
                continue
            if code.is_(start - 1, "*", "&") and (code.name(start - 2) and code.name(start - 2) not in _EXPRESSION_BEFORE) and self._begins(start - 2) and code.is_(code.close[after] + 1, ";"):
                continue
            if member:
                shown, start = name, self._chain(i)
            elif template:
                shown = name
                if start != i:
                    shown = code.text[code.tokens[start].start : code.tokens[after - 1].end]
            else:
                shown = code.text[code.tokens[start].start : code.tokens[i].end]
            self.found.calls.append((shown, self.line(start)))

    def _initialiser(self, i: int) -> bool:
        """Whether a call outside of bodies stands in a value."""
        code, k = self.code, i
        while k > 0 and not code.is_(k, ";", "{", "}"):
            if code.is_(k, "=", "return"):
                return True
            k -= 1
        return False

    def _chain(self, i: int) -> int:
        code = self.code
        while code.is_(i - 1, ".", "->"):
            k = i - 2
            while code.is_(k, ")", "]") and code.open[k] >= 0:
                k = code.open[k] - 1
                if code.is_(k, ">"):
                    break
            if k < 0 or code.name(k) is None or code.name(k) in _KEYWORDS - {"this"}:
                return max(k + 1, 0)
            while code.is_(k - 1, "::") and code.name(k - 2):
                k -= 2
            i = k
        return i


def extract(source: str, compat: bool = False) -> Found:
    return Cpp(source, compat).run()
