"""Go: functions, methods, types, imports, calls and embedding."""

from __future__ import annotations

from .lexer import Code
from .records import Found, Lines, Symbol, first_line, to_brace

_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


def visibility(name: str) -> str:
    return "public" if name[:1].isupper() else "private"


def _body(code: Code, i: int) -> int | None:
    """The brace that opens a function's body, from the token behind its parameters.

    Results may hold braces of their own, as in ``interface{}`` and ``struct{}``.
    """
    while i < len(code.tokens):
        t = code.tokens[i]
        if t.text in ("(", "["):
            i = code.close[i] + 1
        elif t.text == "{":
            if code.is_(i - 1, "interface", "struct"):
                i = code.close[i] + 1
                continue
            return i
        elif t.kind == "name" and t.text in _KEYWORDS - {"func", "interface", "struct", "map", "chan"} or t.text in (";", ")", "}", "=", ":="):
            return None
        else:
            if code.text.count("\n", code.tokens[i - 1].end, t.start) and not code.is_(i - 1, "*", ".", ",", "chan"):
                return None
            i += 1
    return None


def _functions(code: Code, lines: Lines, compat: bool) -> tuple[list[Symbol], list[Symbol], set[int]]:
    plain, methods, names = [], [], set()
    for i in code.places("func"):
        if code.depth_owner[i] >= 0:
            continue
        receiver, k = None, i + 1
        if code.is_(k, "("):
            inside = [t.text for t in code.tokens[k + 1 : code.close[k]] if t.kind == "name"]
            cut = next((n for n, t in enumerate(code.tokens[k + 1 : code.close[k]]) if t.text == "["), None)
            if cut is not None:  # type parameters do not name the receiver
                inside = [t.text for t in code.tokens[k + 1 : k + 1 + cut] if t.kind == "name"]
            receiver = inside[-1] if inside else ""
            k = code.close[k] + 1
        name = code.name(k)
        if name is None or name in _KEYWORDS:
            continue
        names.add(k)
        k += 1
        if code.is_(k, "["):
            k = code.close[k] + 1
        if not code.is_(k, "("):
            continue
        brace = _body(code, code.close[k] + 1)
        last = code.close[brace] if brace is not None else code.close[k]
        text = code.between(i, last)
        symbol = Symbol(name, "Function", lines(code.tokens[i].start), lines(code.tokens[min(last, len(code.tokens) - 1)].end - 1), to_brace(text), visibility(name), False, code.comment_before(i))
        if receiver is None:
            plain.append(symbol)
        else:
            symbol.kind = "Method"
            # Methods come before types, so the observed look-up of the receiver finds nothing.
            symbol.parent_name = None if compat else receiver or None
            methods.append(symbol)
    return plain, methods, names


def _specs(code: Code) -> list[int]:
    """Names of the types that are declared."""
    out = []
    for i in code.places("type"):
        if code.is_(i - 1, ".") or code.is_(i + 1, ")"):
            continue
        if code.is_(i + 1, "("):
            k, end = i + 2, code.close[i + 1]
            fresh = True
            while k < end:
                if fresh and code.name(k):
                    out.append(k)
                fresh = False
                if code.tokens[k].text in "([{" and code.tokens[k].kind == "punct":
                    k = code.close[k]
                k += 1
                if k < end and (code.tokens[k - 1].text == ";" or "\n" in code.text[code.tokens[k - 1].end : code.tokens[k].start]):
                    fresh = True
        elif code.name(i + 1):
            out.append(i + 1)
    return out


def _type_end(code: Code, k: int) -> int:
    """The last token of a type that begins at ``k``."""
    while k < len(code.tokens):
        t = code.tokens[k]
        if t.kind == "punct" and t.text in "([{":
            k = code.close[k]
            if code.is_(k, "}"):
                return k
        nxt = k + 1
        if nxt >= len(code.tokens) or code.is_(nxt, ";", ")", "}", "=") or "\n" in code.text[t.end : code.tokens[nxt].start] and not code.is_(k, "*", ".", "]", "map", "chan"):
            return k
        k = nxt
    return len(code.tokens) - 1


def _embedded(code: Code, brace: int, is_struct: bool) -> list[str]:
    """Names of plain types that stand alone in a struct or interface."""
    out, k, end = [], brace + 1, min(code.close[brace], len(code.tokens))
    while k < end:
        row = [k]
        while row[-1] + 1 < end:
            t, nxt = code.tokens[row[-1]], row[-1] + 1
            if t.kind == "punct" and t.text in "([{":
                nxt = code.close[row[-1]] + 1
                if nxt >= end:
                    break
            if code.tokens[nxt].text == ";" or "\n" in code.text[code.tokens[nxt - 1].end : code.tokens[nxt].start]:
                break
            row.append(nxt)
        words = [code.tokens[i] for i in row if code.tokens[i].kind != "string"]
        if is_struct and words and words[0].text == "*":
            words = words[1:]
        if len(words) == 1 and words[0].kind == "name":
            out.append(words[0].text)
        k = row[-1]
        if code.tokens[k].kind == "punct" and code.tokens[k].text in "([{":
            k = code.close[k]
        k += 1
        while code.is_(k, ";"):
            k += 1
    return out


def _types(code: Code, lines: Lines, found: Found) -> set[int]:
    names = set()
    for k in _specs(code):
        name, at = code.tokens[k].text, k + 1
        names.add(k)
        if code.is_(at, "[") and code.name(at + 1) and not code.is_(at + 2, "]"):
            at = code.close[at] + 1  # type parameters; an array type has a number or nothing there
        if code.is_(at, "="):
            continue  # an alias is no type of its own
        kind = "Struct" if code.is_(at, "struct") else "Interface"
        last = _type_end(code, at)
        text = code.between(k, last)
        found.symbols.append(Symbol(name, kind, lines(code.tokens[k].start), lines(code.tokens[min(last, len(code.tokens) - 1)].end - 1), first_line(text), visibility(name), False, code.comment_before(k)))
        if code.is_(at, "struct", "interface") and code.is_(at + 1, "{"):
            found.inherits += [(name, [kind], parent) for parent in _embedded(code, at + 1, kind == "Struct")]
    return names


def _imports(code: Code, lines: Lines, compat: bool) -> list[tuple[str, str | None, list[str], int]]:
    out = []

    def spec(k: int, line_of: int) -> int:
        alias = None
        if code.name(k) or code.is_(k, "."):
            alias, k = code.tokens[k].text, k + 1
        if k < len(code.tokens) and code.tokens[k].kind == "string":
            if code.tokens[k].text.startswith('"'):
                out.append((code.tokens[k].text.strip('"'), alias, [], lines(code.tokens[line_of].start)))
            return k + 1
        return k + 1

    for i in code.places("import"):
        if code.depth_owner[i] >= 0:
            continue
        if code.is_(i + 1, "("):
            k, end = i + 2, code.close[i + 1]
            while k < end:
                k = spec(k, k) if not code.is_(k, ";") else k + 1
        elif not compat:  # the observed look-up misses a path that stands alone
            spec(i + 1, i)
    return out


def extract(source: str, compat: bool = False) -> Found:
    code, lines, found = Code(source, "go"), Lines(source), Found()
    plain, methods, names = _functions(code, lines, compat)
    found.symbols = plain + methods
    names |= _types(code, lines, found)
    found.imports = _imports(code, lines, compat)
    signatures = set()  # method lists of interfaces hold no calls
    for i in code.places("interface"):
        if code.is_(i + 1, "{"):
            signatures.update(range(i + 1, code.close[i + 1]))
    for at in code.places("("):
        i, name = at - 1, code.name(at - 1)
        if name is None or name in _KEYWORDS or i in names or i in signatures:
            continue
        if code.is_(i - 1, "]") and not code.is_(code.open[i - 1] - 1, ")") and code.name(code.open[i - 1] - 1) is None:
            continue  # a conversion to a slice or array
        start = i
        while code.is_(start - 1, "."):
            before = start - 2
            if code.is_(before, ")", "]"):
                before = code.open[before]
                while before > 0 and (code.is_(before - 1, ")", "]")):
                    before = code.open[before - 1]
                before -= code.name(before - 1) is not None
            if before < 0:
                break
            start = before
        found.calls.append((name, lines(code.tokens[max(start, 0)].start)))
    return found
