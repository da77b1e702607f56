"""Python: by its own parser, or line by line where a file does not parse."""

from __future__ import annotations

import ast
import io
import re
import tokenize

from .records import Found, Symbol, first_line


class _Text:
    """Source by the parser's places: lines and UTF-8 columns."""

    def __init__(self, text: str):
        self.lines = [x.encode() for x in text.splitlines(keepends=True)] if "\f" not in text and "\x0b" not in text else [x.encode() for x in re.split(r"(?<=\n)", text)]

    def of(self, node: ast.AST) -> str:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            return self.lines[a][node.col_offset : node.end_col_offset].decode("utf-8", "replace")
        parts = [self.lines[a][node.col_offset :], *self.lines[a + 1 : b], self.lines[b][: node.end_col_offset]]
        return b"".join(parts).decode("utf-8", "replace")

    def head(self, node: ast.AST) -> str:
        line = self.lines[node.lineno - 1][node.col_offset :].decode("utf-8", "replace")
        if node.lineno == node.end_lineno:
            line = self.of(node)
        return first_line(line).rstrip(":")


def visibility(name: str, is_class: bool) -> str:
    if is_class:
        return "private" if name.startswith("_") else "public"
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") else "public"


def _strip(raw: str) -> str:
    """A docstring's text: triple quotes go, others stay."""
    for quotes in ('"""', "'''"):
        while raw.startswith(quotes):
            raw = raw[3:]
    for quotes in ('"""', "'''"):
        while raw.endswith(quotes):
            raw = raw[:-3]
    return raw.strip()


def _docstring(node, text: _Text) -> str | None:
    """The first expression statement, wherever it stands in the body, if it is one string."""
    for statement in node.body:
        if isinstance(statement, ast.Expr):
            value = statement.value
            if isinstance(value, ast.JoinedStr) or isinstance(value, ast.Constant) and isinstance(value.value, str | bytes):
                raw = text.of(value)
                if raw.startswith('"""') and "\\" not in raw and raw.find('"""', 3) == len(raw) - 3:
                    return _strip(raw)  # one string, without a look at its tokens
                try:
                    strings = [t for t in tokenize.generate_tokens(io.StringIO(raw + "\n").readline) if t.type == tokenize.STRING]
                except (tokenize.TokenError, SyntaxError):
                    strings = []
                return _strip(raw) if len(strings) < 2 else None
            return None
    return None


#: Nodes that hold no others but such.
_LEAVES = (ast.Name, ast.Constant, ast.alias, ast.expr_context, ast.operator, ast.boolop, ast.unaryop, ast.cmpop)
#: By type of node: whether it is a leaf, and by type of value: whether it is a node that is none.
_INNER: dict[type, bool] = {}


def _inner(kind: type) -> bool:
    found = _INNER[kind] = issubclass(kind, ast.AST) and not issubclass(kind, _LEAVES)
    return found


def _walk(node: ast.AST) -> list[ast.AST]:
    """All nodes but leaves, a parent before its children, in order of the text."""
    stack, out, inner = [node], [], _INNER
    while stack:
        node = stack.pop()
        out.append(node)
        children = []
        for value in node.__dict__.values():
            kind = type(value)
            if kind is list:
                for x in value:
                    of = type(x)
                    if inner[of] if of in inner else _inner(of):
                        children.append(x)
            elif inner[kind] if kind in inner else _inner(kind):
                children.append(value)
        if len(children) > 1:
            children.reverse()
        stack += children
    return out


def _place(node: ast.AST) -> tuple[int, int, int, int]:
    return node.lineno, node.col_offset, -node.end_lineno, -node.end_col_offset


def _symbol(node, text: _Text, kind: str, compat: bool, parent: int | None = None) -> Symbol:
    is_class = kind == "Class"
    # The observed behaviour looks for "async" beside the definition, where it never stands.
    is_async = isinstance(node, ast.AsyncFunctionDef) and not compat
    return Symbol(node.name, kind, node.lineno, node.end_lineno, text.head(node), visibility(node.name, is_class), is_async, _docstring(node, text), parent)


def _imports(nodes: list[ast.AST], compat: bool) -> list[tuple[str, str | None, list[str], int]]:
    out = []
    for node in nodes:
        if isinstance(node, ast.Import):
            if compat:
                alias = next((a.asname for a in node.names if a.asname), None)
                out += [(a.name, alias, [], node.lineno) for a in node.names if not a.asname]
            else:
                out += [(a.name, a.asname, [], node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            target = "." * node.level + (node.module or "")
            items = [a.name for a in node.names if a.name != "*" and not (compat and a.asname)]
            if compat and node.level:
                target, items = (items[0], items[1:]) if items else (target, [])
            out.append((target, None, items, node.lineno))
    return out


def extract(source: str, compat: bool = False) -> Found:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_lines(source)
    text, found = _Text(source), Found()
    of_type: dict[type, list[ast.AST]] = {}
    for n in _walk(tree):
        of_type.setdefault(type(n), []).append(n)

    def placed(*types: type) -> list[ast.AST]:
        return sorted((n for t in types for n in of_type.get(t, ())), key=_place)

    functions, classes = placed(ast.FunctionDef, ast.AsyncFunctionDef), placed(ast.ClassDef)
    found.symbols += [_symbol(n, text, "Function", compat) for n in functions]
    symbol_of = dict(zip(functions, found.symbols, strict=True))
    for node in classes:
        me = len(found.symbols)
        found.symbols.append(_symbol(node, text, "Class", compat))
        for child in node.body:
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef) and not (compat and child.decorator_list):
                f = symbol_of[child]
                found.symbols.append(Symbol(f.name, "Method", f.start_line, f.end_line, f.signature, f.visibility, f.is_async, f.docstring, me, f.parent_name))
        found.inherits += [(node.name, ["Class"], text.of(b)) for b in node.bases if isinstance(b, ast.Name | ast.Attribute)]
    found.imports = _imports(placed(ast.Import, ast.ImportFrom), compat)
    for node in placed(ast.Call):
        callee = node.func
        if isinstance(callee, ast.Name):
            found.calls.append((callee.id, node.lineno))
        elif isinstance(callee, ast.Attribute):
            receiver = callee.value
            name = receiver.id if compat and isinstance(receiver, ast.Name) else callee.attr
            found.calls.append((name, node.lineno))
    return found


_DEFINITION = re.compile(r"^(?P<indent>[ \t]*)(?P<async>async[ \t]+)?(?P<what>def|class)[ \t]+(?P<name>[^\W\d]\w*)(?P<rest>[^\n]*)", re.M)
_IMPORT = re.compile(r"^[ \t]*import[ \t]+([^\n#;]+)|^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import[ \t]+(?:\(([^)]*)\)|([^\n#;]+))", re.M)
_CALL = re.compile(r"([^\W\d]\w*)[ \t]*\(")
_NOT_CALLED = frozenset("def class if elif while for return and or not in is lambda print_ yield await assert del raise except with from import else".split())


def _masked(source: str) -> str:
    """Strings and comments as blanks, line by line the same length."""
    pattern = re.compile(r"#[^\n]*|(\"\"\"|''').*?(?:\1|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)


def _by_lines(source: str) -> Found:
    """Definitions by their indentation, for files that do not parse."""
    found, code = Found(), _masked(source)
    lines = code.split("\n")
    line_of = lambda at: code.count("\n", 0, at) + 1
    spans = []
    for m in _DEFINITION.finditer(code):
        depth, first = len(m["indent"].expandtabs(8)), line_of(m.start("what"))
        last = first
        for k in range(first, len(lines)):
            if lines[k].strip():
                if len(lines[k].expandtabs(8)) - len(lines[k].expandtabs(8).lstrip()) <= depth and not lines[k].lstrip().startswith((")", "]", "}")):
                    break
                last = k + 1
        spans.append((m, depth, first, last))
    place: dict[int, int] = {}

    def add(m, first: int, last: int, kind: str, parent: int | None = None) -> None:
        head = source.split("\n")[first - 1].strip().rstrip("\r").rstrip(":")
        found.symbols.append(Symbol(m["name"], kind, first, last, head, visibility(m["name"], kind == "Class"), bool(m["async"]), None, parent))

    for m, _, first, last in spans:
        if m["what"] == "def":
            add(m, first, last, "Function")
    for k, (m, depth, first, last) in enumerate(spans):
        if m["what"] != "class":
            continue
        place[k] = len(found.symbols)
        add(m, first, last, "Class")
        inner = [s for s in spans[k + 1 :] if s[2] <= last]
        nearest = min((s[1] for s in inner), default=depth)
        for s in inner:
            if s[0]["what"] == "def" and s[1] == nearest:
                add(s[0], s[2], s[3], "Method", place[k])
        bases = re.match(r"\s*\(([^()]*)\)", m["rest"])
        for base in (bases[1].split(",") if bases else []):
            if re.fullmatch(r"\s*[^\W\d][\w.]*\s*", base):
                found.inherits.append((m["name"], ["Class"], base.strip()))
    for m in _IMPORT.finditer(code):
        line = line_of(m.start() + len(m.group()) - len(m.group().lstrip()))
        if m[1]:
            for part in m[1].split(","):
                target, _, alias = part.partition(" as ")
                if target.strip():
                    found.imports.append((target.strip(), alias.strip() or None, [], line))
        else:
            items = [p.partition(" as ")[0].strip() for p in (m[3] or m[4] or "").split(",")]
            found.imports.append((m[2], None, [i for i in items if i and i != "*"], line))
    defined = {(m.start("name")) for m, *_ in spans}
    for m in _CALL.finditer(code):
        if m[1] not in _NOT_CALLED and m.start() not in defined:
            found.calls.append((m[1], line_of(m.start())))
    return found
