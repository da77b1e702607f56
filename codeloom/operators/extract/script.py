"""JavaScript and TypeScript: functions, arrows, classes, interfaces, imports and calls."""

from __future__ import annotations

from .lexer import Code
from .records import Found, Lines, Symbol, first_line, to_brace

_KEYWORDS = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let static async await of get set".split())
_NOT_CALLED = frozenset("if for while switch catch with function return typeof super import delete void throw case do else in instanceof new class constructor_ await yield extends".split())
_RESERVED = _KEYWORDS - {"get", "set", "of", "let", "static", "async"}
#: What may stand behind the name of what is called; None: a template, or another literal.
_CALLING = frozenset(["(", "<", "?.", None])
_MEMBER_WORDS = frozenset("public private protected static override readonly abstract async get set declare accessor".split())
_CONTINUES = frozenset(". ?. , = + - * / % & | ^ < > ( [ ? : => && || == != <= >= instanceof in as satisfies extends is ` ...".split())
_EXPECTS = frozenset(". ?. , = + - * / % & | ^ < > ( [ { ? : => && || == != <= >= ! ~ instanceof in of as typeof new return keyof extends satisfies ...".split())


def _newline(code: Code, a: int, b: int) -> bool:
    return "\n" in code.text[code.tokens[a].end : code.tokens[b].start]


def _statement_end(code: Code, i: int, commas: bool = False) -> int:
    """The last token of an expression or type from ``i``: to a semicolon (its own last token),
    a bracket that closes around it, a comma if ``commas``, or a line break where none is needed."""
    k, n = i, len(code.tokens)
    while k < n:
        if code.is_(k, "(", "[", "{"):
            k = min(code.close[k], n - 1)
        nxt = k + 1
        if nxt >= n or code.is_(nxt, ")", "]", "}") or commas and code.is_(nxt, ","):
            return k
        if code.is_(nxt, ";"):
            return nxt
        if _newline(code, k, nxt) and code.tokens[k].text not in _EXPECTS and code.tokens[nxt].text not in _CONTINUES:
            return k
        k = nxt
    return n - 1


def _body(code: Code, k: int, typed: bool) -> int | None:
    """The brace of a function's body behind its parameters, past a result type."""
    if typed and code.is_(k, ":"):
        k += 1
        while k < len(code.tokens):
            if code.is_(k, "{"):
                # A brace right behind the colon or an operator is part of the type.
                if code.is_(k - 1, ":", "|", "&", "is", "=>", "<", ","):
                    k = code.close[k] + 1
                    continue
                return k
            if code.is_(k, ";", ")", "}", "=") or code.tokens[k].text in ("=>",) and not code.is_(k - 1, ")"):
                return None
            after = code.skip_angles(k)
            if after != k:
                k = after
                continue
            k = code.close[k] + 1 if code.is_(k, "(", "[") else k + 1
        return None
    return k if code.is_(k, "{") else None


class Script:
    def __init__(self, source: str, typed: bool, compat: bool):
        self.code, self.lines, self.found, self.typed, self.compat = Code(source, "script"), Lines(source), Found(), typed, compat
        self.n = len(self.code.tokens)
        self.not_calls: set[int] = set()
        self.types: set[int] = set()  # tokens inside interfaces and type aliases

    def line(self, i: int, end: bool = False) -> int:
        t = self.code.tokens[min(i, self.n - 1)]
        return self.lines(max(t.end - 1, 0) if end else t.start)

    def functions(self) -> None:
        code = self.code
        for i in code.places("function"):
            if code.is_(i + 1, "*") or code.is_(i - 1, "."):
                continue
            name = code.name(i + 1)
            if name is None:
                continue
            self.not_calls.add(i + 1)
            start = i - 1 if code.is_(i - 1, "async") else i
            if not self._statement_here(start):
                continue
            k = code.skip_angles(i + 2)
            brace = _body(code, code.close[k] + 1, self.typed) if code.is_(k, "(") else None
            if brace is None:
                continue
            text = code.between(start, code.close[brace])
            visibility = "public" if not self.typed or code.is_(start - 1, "export") else "private"
            self.found.symbols.append(Symbol(name, "Function", self.line(start), self.line(code.close[brace], True), to_brace(text), visibility, text.startswith("async"), code.comment_before(start)))

    def _statement_here(self, i: int) -> bool:
        """Whether a declaration may begin at ``i``, rather than an expression."""
        code = self.code
        if i <= 0 or code.is_(i - 1, "{", "}", ";", "export", "default", "else"):
            return True
        if code.is_(i - 1, ")"):
            return True
        return _newline(code, i - 1, i) and code.tokens[i - 1].text not in _EXPECTS

    def arrows(self) -> None:
        code = self.code
        order = {"const": 0, "let": 0, "var": 1}
        got = []
        for i in code.places(*order):
            if code.name(i) is None or code.is_(i - 1, "."):
                continue
            k = i + 1
            while k < self.n:
                at = k
                name = code.name(k)
                if code.is_(k, "{", "["):
                    k = code.close[k] + 1
                    name = None
                else:
                    k += 1
                if self.typed and code.is_(k, "!"):
                    k += 1
                if self.typed and code.is_(k, ":"):
                    k += 1
                    while k < self.n and not code.is_(k, "=", ",", ";") and not (code.is_(k, "in", "of")):
                        after = code.skip_angles(k)
                        k = after if after != k else code.close[k] + 1 if code.is_(k, "(", "[", "{") else k + 1
                        if code.is_(k, "=>"):
                            k += 1
                end = k
                if code.is_(k, "="):
                    end = _statement_end(code, k + 1, True)
                    if name and (last := self._arrow(k + 1)) is not None:
                        got.append((order[code.tokens[i].text], i, at, k + 1, last))
                    if code.is_(end, ";"):
                        break
                    k = end + 1
                if not code.is_(k, ","):
                    break
                k += 1
        for _, _, at, first, last in sorted(got):
            text = code.between(first, last)
            head = text[: text.find("=>") + 2].strip()
            self.found.symbols.append(Symbol(code.tokens[at].text, "Function", self.line(at), self.line(last, True), f"const {code.tokens[at].text} = {head}", "public", text.startswith("async"), None))

    def _arrow(self, k: int) -> int | None:
        """The last token of an arrow function that is the value at ``k``; None if it is none."""
        code = self.code
        if code.is_(k, "async") and not code.is_(k + 1, "=>"):
            k += 1
        if self.typed:
            k = code.skip_angles(k)
        if code.is_(k, "("):
            k = code.close[k] + 1
            if self.typed and code.is_(k, ":"):
                k += 1
                while k < self.n and not code.is_(k, "=>", ";", "="):
                    after = code.skip_angles(k)
                    k = after if after != k else code.close[k] + 1 if code.is_(k, "(", "[", "{") else k + 1
        elif code.name(k):
            k += 1
        else:
            return None
        if not code.is_(k, "=>") or k + 1 >= self.n:
            return None
        if code.is_(k + 1, "{"):
            return min(code.close[k + 1], self.n - 1)
        last = _statement_end(code, k + 1, True)
        return last - 1 if code.is_(last, ";") else last

    def classes(self) -> None:
        code = self.code
        for i in code.places("class"):
            if code.is_(i - 1, ".", "abstract") or code.name(i + 1) in (None, "extends") or not self._statement_here(i):
                continue
            name = code.name(i + 1)
            k, extends, implements, mode = code.skip_angles(i + 2), None, [], None
            while k < self.n and not code.is_(k, "{"):
                if code.is_(k, "extends", "implements"):
                    mode = code.tokens[k].text
                    k += 1
                    continue
                if code.is_(k, ";", "}", ")"):
                    break
                whole = code.name(k) and not code.is_(k - 1, ".") and not code.is_(k + 1, ".", "(", "?.")
                after = code.skip_angles(k + 1)
                if mode == "extends" and whole and extends is None and code.is_(k - 1, "extends"):
                    extends = code.tokens[k].text
                elif mode == "implements" and whole and after == k + 1:
                    implements.append(code.tokens[k].text)
                k = after if after != k + 1 else code.close[k] + 1 if code.is_(k, "(", "[") else k + 1
            if not code.is_(k, "{"):
                continue
            text = code.between(i, code.close[k])
            me = len(self.found.symbols)
            head = first_line(text).rstrip("{").strip()
            self.found.symbols.append(Symbol(name, "Class", self.line(i), self.line(code.close[k], True), head, "public", False, code.comment_before(i)))
            self._members(k, me)
            parents = ([extends] if extends else []) + (implements if self.typed else [])
            self.found.inherits += [(name, ["Class"], p) for p in parents]

    def _members(self, brace: int, me: int) -> None:
        code, k, end = self.code, brace + 1, min(self.code.close[brace], self.n)
        while k < end:
            if code.is_(k, ";"):
                k += 1
                continue
            if code.is_(k, "@"):
                k += 2
                while code.is_(k, "."):
                    k += 2
                k = code.close[k] + 1 if code.is_(k, "(") else k
                continue
            start, abstract = k, False
            while code.name(k) in _MEMBER_WORDS and not code.is_(k + 1, "(", "=", ":", ";", "<", "?", "!", "}"):
                abstract |= code.is_(k, "abstract")
                k += 1
            k += code.is_(k, "*")
            name, private = code.name(k), code.is_(k, "#")
            if private:
                k += 1
                name = None
            at = k
            self.not_calls.add(at)
            k = code.close[k] + 1 if code.is_(k, "[", "{") else k + 1
            k += code.is_(k, "?", "!")
            after = code.skip_angles(k) if self.typed else k
            if code.is_(after, "("):
                k = code.close[after] + 1
                body = _body(code, k, self.typed)
                if body is not None:
                    if name and not abstract:
                        self._method(start, name, body, me)
                    k = code.close[body] + 1
                    continue
            last = _statement_end(code, k - 1) if k - 1 > at else _statement_end(code, at)
            k = max(last + 1, at + 1)

    def _method(self, start: int, name: str, body: int, me: int) -> None:
        code = self.code
        text = code.between(start, code.close[body])
        if self.typed:
            visibility = "private" if "private" in text else "protected" if "protected" in text else "public"
        else:
            visibility = "private" if name.startswith("_") else "public"
        self.found.symbols.append(Symbol(name, "Method", self.line(start), self.line(code.close[body], True), to_brace(text), visibility, text.startswith("async"), None, me))

    def interfaces(self) -> None:
        code = self.code
        for i in code.places("interface"):
            if code.name(i + 1) is None or not self._declared(i):
                continue
            k, parents = code.skip_angles(i + 2), []
            while k < self.n and not code.is_(k, "{"):
                after = code.skip_angles(k + 1)
                if code.name(k) and code.name(k) != "extends" and not code.is_(k - 1, ".") and not code.is_(k + 1, ".") and after == k + 1:
                    parents.append(code.tokens[k].text)
                k = after
            if not code.is_(k, "{"):
                continue
            text = code.between(i, code.close[k])
            self.types.update(range(i, code.close[k]))
            self.found.symbols.append(Symbol(code.name(i + 1), "Interface", self.line(i), self.line(code.close[k], True), first_line(text).rstrip("{").strip(), "public", False, code.comment_before(i)))
            self.found.inherits += [(code.name(i + 1), ["Interface"], p) for p in parents]

    def _declared(self, i: int) -> bool:
        return self._statement_here(i) or self.code.is_(i - 1, "declare")

    def aliases(self) -> None:
        code = self.code
        for i in code.places("type"):
            if code.name(i + 1) is None or not self._declared(i):
                continue
            k = code.skip_angles(i + 2)
            if not code.is_(k, "="):
                continue
            first = k + 1 + code.is_(k + 1, "|", "&")
            last = _statement_end(code, first)
            self.types.update(range(i, last + 1))
            self.found.symbols.append(Symbol(code.name(i + 1), "Interface", self.line(i), self.line(last, True), code.between(i, last), "public", False, None))

    def imports(self) -> None:
        code, required = self.code, []
        for i in code.places("require", "import"):
            if code.is_(i, "require") and not self.typed and code.is_(i + 1, "(") and not code.is_(i - 1, ".") and i + 2 < code.close[i + 1]:
                end = i + 2
                while end + 1 < code.close[i + 1] and not code.is_(end + 1, ","):
                    end += 1
                required.append((code.between(i + 2, end).strip('"').strip("'"), None, [], self.line(i)))
            if not code.is_(i, "import") or code.is_(i + 1, "(", ".") or code.is_(i - 1, ".") or code.depth_owner[i] >= 0:
                continue
            k, items, default, target = i + 1, [], None, ""
            k += code.is_(k, "type") and not code.is_(k + 1, "from", ",")
            if code.name(k) and not code.is_(k, "from"):
                default, k = code.tokens[k].text, k + 1
                if code.is_(k, "="):
                    continue  # import x = require(...)
            while k < self.n and not code.is_(k, ";"):
                if code.tokens[k].kind == "string":
                    target = code.tokens[k].text.strip('"').strip("'")
                    break
                if code.is_(k, "{"):
                    at = k + 1
                    while at < code.close[k]:
                        at += code.is_(at, "type") and code.name(at + 1) is not None and not code.is_(at + 1, "as")
                        if code.name(at):
                            items.append(code.tokens[at].text)
                        while at < code.close[k] and not code.is_(at, ","):
                            at += 1
                        at += 1
                    k = code.close[k]
                k += 1
            self.found.imports.append((target, None, items + ([default] if default else []), self.line(i)))
        self.found.imports += required

    def calls(self) -> None:
        code = self.code
        for i, name in enumerate(code.names):
            if name is None or i + 1 < self.n and code.words[i + 1] not in _CALLING:
                continue
            if i in self.not_calls or i in self.types or name in _NOT_CALLED:
                continue
            k = i + 1
            if code.is_(k, "<") and self.typed:
                after = code.skip_angles(k)
                k = after if code.is_(after, "(") else k
            if code.is_(k, "?.") and code.is_(k + 1, "("):
                k += 1
            template = k < self.n and code.tokens[k].kind == "template"
            if not code.is_(k, "(") and not template:
                continue
            member = code.is_(i - 1, ".", "?.")
            if code.is_(i - 1, "#") or not member and name in _RESERVED:
                continue
            if not template and not member and code.is_(code.close[k] + 1, "{") and not _newline(code, code.close[k], code.close[k] + 1) and (code.is_(i - 1, "{", ",", "async", "get", "set", "*", "static")):
                continue  # a method of an object
            if self.typed and not member and not template and code.is_(code.close[k] + 1, ":") and code.is_(i - 1, "{", ",", "async") and _body(code, code.close[k] + 1, True) is not None:
                continue
            if name == "async" and not template and code.is_(code.close[k] + 1, "=>", ":"):
                continue
            start = self._chain(i)
            if code.is_(start - 1, "new"):
                continue
            if name == "require" and not self.typed:
                continue
            self.found.calls.append((name, self.line(start)))

    def _chain(self, i: int) -> int:
        """The first token of the member expression whose last name is at ``i``."""
        code = self.code
        while code.is_(i - 1, ".", "?."):
            k = i - 2
            k -= code.is_(k, "!")
            if code.is_(k, ")", "]") and code.open[k] >= 0:
                k = code.open[k]
                while code.is_(k - 1, ")", "]") and code.open[k - 1] >= 0:
                    k = code.open[k - 1]
                if code.name(k - 1) and code.name(k - 1) not in _NOT_CALLED:
                    k -= 1
                elif code.is_(k - 1, "?."):
                    k -= 2
            if k < 0:
                break
            i = k
        return i


def extract(source: str, typed: bool, compat: bool = False) -> Found:
    s = Script(source, typed, compat)
    s.functions()
    s.arrows()
    s.classes()
    if typed:
        s.interfaces()
        s.aliases()
    s.imports()
    s.calls()
    return s.found


def extract_javascript(source: str, compat: bool = False) -> Found:
    return extract(source, False, compat)


def extract_typescript(source: str, compat: bool = False) -> Found:
    return extract(source, True, compat)
