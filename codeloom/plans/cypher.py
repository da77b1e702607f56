"""Reading queries of the Cypher language, lowered to DataFrames.

Reading clauses: MATCH, OPTIONAL MATCH, WHERE, WITH, UNWIND, RETURN [DISTINCT], ORDER BY, SKIP,
LIMIT and UNION [ALL].  A pattern becomes a chain of equi-joins between the node and edge tables;
paths of variable length are unrolled; a pattern in a condition is a semi- or anti-join; the items
of RETURN and WITH without an aggregate are the grouping.  A property that no node has is null.
``*`` without an upper bound follows trails, which use no edge twice, until none goes on.  Clauses
that write are parsed here and carried out by ``cypher_write``; ``cypher`` refuses them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import Graph
from ..sources import scratch

class CypherError(ValueError):
    """The text is no query of the language."""


class UnsupportedCypher(CypherError):
    """The query is outside the subset."""


# --- text to tree -------------------------------------------------------------------------

_TOKEN = re.compile(r"""\s+|//[^\n]*|/\*.*?\*/|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d]\w*|`[^`]*`)|(?P<op><=|>=|<>|=~|\.\.|->|<-|[-+*/%^=<>()\[\]{},.:|;$])""", re.S)
_WRITING = {"create", "merge", "set", "delete", "detach", "remove", "foreach", "drop", "call", "load"}
_AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def _unquote(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)


@dataclass
class Node:
    name: str
    labels: list[str]
    properties: dict[str, tuple]


@dataclass
class Edge:
    name: str
    types: list[str]
    properties: dict[str, tuple]
    direction: str  # out, in, any
    length: tuple[int, int | None] | None  # None: one edge


@dataclass
class Path:
    name: str | None
    nodes: list[Node]
    edges: list[Edge]


@dataclass
class Match:
    optional: bool
    paths: list[Path]
    where: tuple | None


@dataclass
class Unwind:
    value: tuple
    name: str


@dataclass
class Assign:
    """SET or REMOVE: (variable, property, value)."""

    items: list[tuple[str, str, tuple]]


@dataclass
class Delete:
    names: list[str]


@dataclass
class Foreach:
    name: str
    value: tuple
    updates: list


@dataclass
class Create:
    """CREATE, or MERGE with what is set in either case."""

    paths: list[Path]
    merge: bool = False
    made: Assign | None = None
    met: Assign | None = None


#: Clauses that write.
UPDATES = (Assign, Delete, Create, Foreach)


@dataclass
class Projection:
    """RETURN, or WITH, which may filter what it gives."""

    distinct: bool = False
    items: list[tuple[tuple, str]] = field(default_factory=list)
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    skip: int = 0
    limit: int | None = None
    where: tuple | None = None


@dataclass
class Query:
    """Clauses in their order, the last one RETURN unless the query writes; ``union`` is what UNION
    adds, and whether ALL."""

    clauses: list = field(default_factory=list)
    union: tuple[Query, bool] | None = None


class Parser:
    """Recursive descent; expressions are tuples of an operator and its operands."""

    def __init__(self, text: str, writing: bool = False):
        self.writing = writing
        self.tokens: list[tuple[str, str]] = []
        self.ends: list[tuple[int, int]] = []
        self.text, at, self.hidden = text, 0, count()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
                self.ends.append(m.span())
            at = m.end()
        self.at = 0

    def word(self, k: int = 0) -> str:
        i = self.at + k
        return self.tokens[i][1].lower() if i < len(self.tokens) and self.tokens[i][0] == "name" else ""

    def op(self, k: int = 0) -> str:
        i = self.at + k
        return self.tokens[i][1] if i < len(self.tokens) and self.tokens[i][0] == "op" else ""

    def take_word(self, *words: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def take(self, op: str) -> bool:
        if self.op() == op:
            self.at += 1
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            self.fail(f"expected {op!r}")

    def fail(self, what: str) -> None:
        place = self.ends[self.at][0] if self.at < len(self.ends) else len(self.text)
        raise CypherError(f"{what} at {place}")

    def identifier(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1].strip("`")
        self.fail("expected a name")
        raise AssertionError

    def query(self) -> Query:
        q = Query()
        while True:
            if self.word() in _WRITING:
                q.clauses.append(self.update())
                continue
            if any(isinstance(c, UPDATES) for c in q.clauses) and self.word() != "return":
                if self.word():
                    raise UnsupportedCypher(f"{self.word().upper()} is not supported after clauses that write")
                break
            optional = self.take_word("optional")
            if self.take_word("match"):
                paths = [self.path()]
                while self.take(","):
                    paths.append(self.path())
                q.clauses.append(Match(optional, paths, self.expression() if self.take_word("where") else None))
            elif optional:
                self.fail("expected MATCH")
            elif self.take_word("unwind"):
                value = self.expression()
                if not self.take_word("as"):
                    self.fail("expected AS")
                q.clauses.append(Unwind(value, self.identifier()))
            elif self.take_word("with"):
                p = self.projection(True)
                p.where = self.expression() if self.take_word("where") else None
                q.clauses.append(p)
            else:
                break
        if self.take_word("return"):
            q.clauses.append(self.projection(False))
        elif not q.clauses or not isinstance(q.clauses[-1], UPDATES):
            self.fail("expected MATCH or RETURN")
        if self.take_word("union"):
            every = self.take_word("all")
            q.union = (self.query(), every)
            return q
        self.take(";")
        if self.at < len(self.tokens):
            if self.word() in _WRITING:
                raise UnsupportedCypher(f"{self.word().upper()} is not supported here")
            self.fail("unexpected text")
        return q

    def update(self) -> Assign | Delete | Create | Foreach:
        word = self.word()
        if not self.writing:
            raise UnsupportedCypher(f"{word.upper()} is not a reading clause")
        if word in ("set", "remove"):
            return self.assignments()
        if self.take_word("detach", "delete") or self.take_word("delete"):
            return Delete(self.several(self.identifier))
        if self.take_word("create"):
            return Create(self.several(self.path))
        if self.take_word("merge"):
            c = Create([self.path()], True)
            while self.take_word("on"):
                made = self.take_word("create")
                if not made and not self.take_word("match"):
                    self.fail("expected CREATE or MATCH")
                if made:
                    c.made = self.assignments()
                else:
                    c.met = self.assignments()
            return c
        if self.take_word("foreach"):
            self.need("(")
            name = self.identifier()
            if not self.take_word("in"):
                self.fail("expected IN")
            value, updates = self.expression(), []
            self.need("|")
            while not self.take(")"):
                if self.word() not in _WRITING:
                    self.fail("expected a clause that writes")
                updates.append(self.update())
            return Foreach(name, value, updates)
        raise UnsupportedCypher(f"{word.upper()} is not supported")

    def several(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    def assignments(self) -> Assign:
        removing = self.take_word("remove")
        if not removing and not self.take_word("set"):
            self.fail("expected SET")

        def one() -> list[tuple[str, str, tuple]]:
            name = self.identifier()
            if not removing and self.take("+"):
                self.need("=")
                return [(name, key, e) for key, e in self.properties().items()]
            if not self.take("."):
                raise UnsupportedCypher("only properties can be set or removed")
            key = self.identifier()
            if removing:
                return [(name, key, ("value", None))]
            self.need("=")
            return [(name, key, self.expression())]

        return Assign([x for items in self.several(one) for x in items])

    def projection(self, named: bool) -> Projection:
        p = Projection(self.take_word("distinct"))
        if self.take("*"):
            p.items = [(("all",), "*")]
        else:
            p.items.append(self.item(named))
        while self.take(","):
            p.items.append(self.item(named))
        if self.take_word("order", "by"):
            while True:
                e = self.expression()
                down = self.take_word("desc") or self.take_word("descending")
                _ = down or self.take_word("asc") or self.take_word("ascending")
                p.order.append((e, down))
                if not self.take(","):
                    break
        if self.take_word("skip"):
            p.skip = self.number()
        if self.take_word("limit"):
            p.limit = self.number()
        return p

    def number(self) -> int:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "number" and self.tokens[self.at][1].isdigit():
            self.at += 1
            return int(self.tokens[self.at - 1][1])
        self.fail("expected a number")
        raise AssertionError

    def item(self, named: bool) -> tuple[tuple, str]:
        first = self.at
        e = self.expression()
        if self.take_word("as"):
            return e, self.identifier()
        if named and e[0] != "name":
            self.fail("WITH needs a name (AS)")
        return e, self.text[self.ends[first][0] : self.ends[self.at - 1][1]].strip("`")

    def path(self) -> Path:
        name = None
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" and self.op(1) == "=":
            name = self.identifier()
            self.need("=")
        nodes, edges = [self.node()], []
        while self.op() in ("-", "<-", "->"):
            edges.append(self.edge())
            nodes.append(self.node())
        return Path(name, nodes, edges)

    def labels(self) -> list[str]:
        out = []
        while self.take(":") or out and self.take("|"):
            self.take(":")
            out.append(self.identifier())
        return out

    def properties(self) -> dict[str, tuple]:
        out: dict[str, tuple] = {}
        if self.take("{"):
            while not self.take("}"):
                key = self.identifier()
                self.need(":")
                out[key] = self.expression()
                if not self.take(",") and self.op() != "}":
                    self.fail("expected ',' or '}'")
        return out

    def variable(self) -> str:
        return self.identifier() if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" else f"_{next(self.hidden)}"

    def node(self) -> Node:
        self.need("(")
        n = Node(self.variable(), self.labels(), self.properties())
        self.need(")")
        return n

    def edge(self) -> Edge:
        left = self.take("<-")
        if not left:
            self.need("-")
        name, types, properties, length = f"_{next(self.hidden)}", [], {}, None
        if self.take("["):
            name, types = self.variable(), self.labels()
            if self.take("*"):
                low, high = 1, None
                if self.at < len(self.tokens) and self.tokens[self.at][0] == "number":
                    low = high = self.number()
                if self.take(".."):
                    high = self.number() if self.at < len(self.tokens) and self.tokens[self.at][0] == "number" else None
                length = (low, high)
            properties = self.properties()
            self.need("]")
        right = self.take("->")
        if not right:
            self.need("-")
        return Edge(name, types, properties, "any" if left == right else "in" if left else "out", length)

    def expression(self) -> tuple:
        e = self.xor()
        while self.take_word("or"):
            e = ("or", e, self.xor())
        return e

    def xor(self) -> tuple:
        e = self.conjunction()
        while self.take_word("xor"):
            e = ("xor", e, self.conjunction())
        return e

    def conjunction(self) -> tuple:
        e = self.negation()
        while self.take_word("and"):
            e = ("and", e, self.negation())
        return e

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take_word("not") else self.comparison()

    def comparison(self) -> tuple:
        e, parts = self.sum(), []
        while True:
            op = self.op()
            if op in ("=", "<>", "<", "<=", ">", ">=", "=~"):
                self.at += 1
                right = self.sum()
                parts.append((op, e, right))
                e = right
            elif op == "<-":  # a < -b
                self.at += 1
                right = ("neg", self.product())
                parts.append(("<", e, right))
                e = right
            elif self.take_word("contains"):
                parts.append(("contains", e, self.sum()))
            elif self.take_word("starts", "with"):
                parts.append(("starts", e, self.sum()))
            elif self.take_word("ends", "with"):
                parts.append(("ends", e, self.sum()))
            elif self.take_word("in"):
                parts.append(("in", e, self.sum()))
            elif self.take_word("is", "not", "null"):
                parts.append(("not", ("null", e)))
            elif self.take_word("is", "null"):
                parts.append(("null", e))
            else:
                return reduce(lambda a, b: ("and", a, b), parts) if parts else e

    def sum(self) -> tuple:
        e = self.product()
        while self.op() in ("+", "-"):
            op = self.op()
            self.at += 1
            e = (op, e, self.product())
        return e

    def product(self) -> tuple:
        e = self.unary()
        while self.op() in ("*", "/", "%"):
            op = self.op()
            self.at += 1
            e = (op, e, self.unary())
        return e

    def unary(self) -> tuple:
        if self.take("-"):
            return ("neg", self.unary())
        self.take("+")
        return self.postfix()

    def postfix(self) -> tuple:
        e = self.atom()
        while True:
            if self.take("."):
                e = ("property", e, self.identifier())
            elif self.take("["):
                e = ("index", e, self.expression())
                self.need("]")
            elif self.op() == ":" and e[0] == "name":
                e = ("labelled", e, self.labels())
            else:
                return e

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            self.fail("expected an expression")
        kind, text = self.tokens[self.at]
        if kind == "string":
            self.at += 1
            return ("value", _unquote(text))
        if kind == "number":
            self.at += 1
            return ("value", int(text) if text.isdigit() else float(text))
        if kind == "op":
            if text == "(":
                if (path := self.pattern()) is not None:
                    return ("pattern", path)
                self.at += 1
                e = self.expression()
                self.need(")")
                return e
            if self.take("["):
                items = []
                while not self.take("]"):
                    items.append(self.expression())
                    if not self.take(",") and self.op() != "]":
                        self.fail("expected ',' or ']'")
                return ("list", *items)
            self.fail(f"unexpected {text!r}")
        word = text.lower()
        if word in ("true", "false", "null"):
            self.at += 1
            return ("value", {"true": True, "false": False, "null": None}[word])
        if word == "case":
            return self.case()
        name = self.identifier()
        if name.lower() == "exists" and self.op() == "(":
            self.at += 1
            if (path := self.pattern()) is not None:
                self.need(")")
                return ("pattern", path)
            e = self.expression()
            self.need(")")
            return ("not", ("null", e))
        if self.take("("):
            distinct = self.take_word("distinct")
            if self.take("*"):
                self.need(")")
                return ("call", name.lower(), distinct, ("star",))
            args = []
            while not self.take(")"):
                args.append(self.expression())
                if not self.take(",") and self.op() != ")":
                    self.fail("expected ',' or ')'")
            return ("call", name.lower(), distinct, *args)
        return ("name", name)

    def pattern(self) -> Path | None:
        """A path with an edge, if one stands here; else nothing is read."""
        before = self.at
        try:
            path = self.path()
        except CypherError:
            path = None
        if path is None or not path.edges or path.name:
            self.at = before
            return None
        return path

    def case(self) -> tuple:
        self.take_word("case")
        subject = None if self.word() == "when" else self.expression()
        branches = []
        while self.take_word("when"):
            test = self.expression()
            if not self.take_word("then"):
                self.fail("expected THEN")
            branches.append((test if subject is None else ("=", subject, test), self.expression()))
        other = self.expression() if self.take_word("else") else ("value", None)
        if not self.take_word("end"):
            self.fail("expected END")
        return ("case", branches, other)


def parse(text: str) -> Query:
    return Parser(text).query()


# --- tree to DataFrame --------------------------------------------------------------------

_PROPERTIES = {
    "File": ["path", "language", "hash", "line_count", "last_indexed"],
    "Module": ["name", "is_external"],
    "Metadata": ["key", "value"],
    "": ["id", "name", "file_path", "start_line", "end_line", "signature", "visibility", "is_async", "docstring", "language"],
}
_TYPES = {"line_count": "bigint", "last_indexed": "bigint", "start_line": "bigint", "end_line": "bigint", "is_async": "boolean", "is_external": "boolean", "call_site_line": "bigint", "line": "bigint"}
NODE_PROPERTIES = sorted({p for group in _PROPERTIES.values() for p in group})
EDGE_TABLES = {"CONTAINS": "contains", "CALLS": "calls", "IMPORTS": "imports", "INHERITS": "inherits"}
EDGE_PROPERTIES = ["alias", "call_site_line", "items", "line"]


def _typed(df: DataFrame, columns: list[str]) -> list[Column]:
    return [(F.col(c) if c in df.columns else F.lit(None)).cast(_TYPES.get(c, "string")).alias(c) for c in columns]


class Tables:
    """Nodes and edges of a graph, each in one shape."""

    def __init__(self, graph: Graph, metadata: DataFrame | None = None):
        self.graph, self.metadata = graph, metadata

    def nodes(self, labels: list[str]) -> DataFrame:
        """Nodes of any of the labels (none: all), with _key, _label and every property."""
        g = self.graph
        parts = [
            ("File", g.files.withColumns({"_key": F.concat(F.lit("File|"), "path"), "_label": F.lit("File")})),
            ("Module", g.modules.withColumns({"_key": F.concat(F.lit("Module|"), "name"), "_label": F.lit("Module")})),
        ]
        if self.metadata is not None:
            parts.append(("Metadata", self.metadata.withColumns({"_key": F.concat(F.lit("Metadata|"), "key"), "_label": F.lit("Metadata")})))
        others = [x for x in labels if x not in _PROPERTIES]
        chosen = [df for label, df in parts if not labels or label in labels]
        if others or not labels:
            symbols = g.symbols.withColumnsRenamed({"node_key": "_key", "label": "_label"})
            chosen.append(symbols.where(F.col("_label").isin(others)) if others else symbols)
        if not chosen:
            chosen = [parts[0][1].limit(0)]
        return reduce(DataFrame.unionByName, [df.select("_key", "_label", *_typed(df, NODE_PROPERTIES)) for df in chosen])

    def edges(self, types: list[str]) -> DataFrame:
        """Edges of any of the types (none: all), with _src, _dst, _type and every property."""
        chosen = []
        for name, table in EDGE_TABLES.items():
            if not types or name in types:
                df = getattr(self.graph, table)
                chosen.append(df.select(F.col("src_key").alias("_src"), F.col("dst_key").alias("_dst"), F.lit(name).alias("_type"), *_typed(df, EDGE_PROPERTIES)))
        if not chosen:
            return self.edges(["CALLS"]).limit(0)
        return reduce(DataFrame.unionByName, chosen)


class Lowering:
    """One query over tables.  A variable's columns are its name, two underscores, and a property."""

    def __init__(self, tables: Tables):
        self.tables, self.kinds, self.frame = tables, {}, None

    # - patterns -

    def _columns(self, df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{name}__{c}") for c in df.columns])

    def _node(self, n: Node) -> DataFrame:
        df = self.tables.nodes(n.labels)
        for key, e in n.properties.items():
            df = df.where(F.col(key) == self._constant(e) if key in NODE_PROPERTIES else F.lit(None).cast("boolean"))
        return self._columns(df, n.name)

    def _constant(self, e: tuple) -> Column:
        if e[0] == "value":
            return F.lit(e[1])
        if e[0] == "neg" and e[1][0] == "value":
            return F.lit(-e[1][1])
        raise UnsupportedCypher("only constants are supported in property maps")

    def _edge_frame(self, e: Edge) -> DataFrame:
        df = self.tables.edges(e.types)
        for key, value in e.properties.items():
            df = df.where(F.col(key) == self._constant(value) if key in EDGE_PROPERTIES else F.lit(None).cast("boolean"))
        return df

    def _hops(self, e: Edge) -> DataFrame:
        """(_a, _b, columns of the edge) from one end to the other, along or against the arrows."""
        df = self._edge_frame(e)
        out = df.withColumns({"_a": F.col("_src"), "_b": F.col("_dst")})
        back = df.withColumns({"_a": F.col("_dst"), "_b": F.col("_src")})
        if e.direction == "in":
            out = back
        elif e.direction == "any":
            out = out.unionByName(back.where("_src != _dst"))
        identity = F.array(F.concat_ws("\u0001", "_type", "_src", "_dst"))
        return out.withColumn("_ids", identity)

    def _extend(self, df: DataFrame, path: Path, k: int, used: list[str]) -> DataFrame:
        """Join the edge and node that follow node ``k`` of a path."""
        e, left, right = path.edges[k], path.nodes[k], path.nodes[k + 1]
        key, known = f"{left.name}__key_", right.name in self.kinds
        df = df.withColumn(key, F.col(f"{left.name}___key"))
        if e.length is None:
            hops = self._columns(self._hops(e), e.name)
            self.kinds[e.name] = "edge"
            df = df.join(hops, F.col(key) == F.col(f"{e.name}___a"))
            df = df.withColumn(f"{e.name}___length", F.lit(1))
        else:
            df = self._variable(df, e, key)
            self.kinds[e.name] = "edges"
        for other in used:
            df = df.where(~F.arrays_overlap(f"{other}___ids", f"{e.name}___ids"))
        used.append(e.name)
        if known:
            df = df.where(F.col(f"{e.name}___b") == F.col(f"{right.name}___key"))
            return self._filtered(df, right).drop(key)
        df = df.join(self._node(right), F.col(f"{e.name}___b") == F.col(f"{right.name}___key"))
        self.kinds[right.name] = "node"
        return df.drop(key)

    def _variable(self, df: DataFrame, e: Edge, key: str) -> DataFrame:
        low, high = e.length
        if high is None:
            return self._unbounded(df, e, key)
        hops = self._hops(e).select("_a", F.col("_b").alias("_next"), F.col("_ids").alias("_id"))
        base = df.withColumns({f"{e.name}___b": F.col(key), f"{e.name}___ids": F.array().cast("array<string>")})
        levels = [base] if low == 0 else []
        for n in range(1, high + 1):
            step = base.join(hops, F.col(f"{e.name}___b") == F.col("_a"))
            if n > 1:
                step = step.where(~F.arrays_overlap(f"{e.name}___ids", "_id"))
            base = step.withColumns({f"{e.name}___b": F.col("_next"), f"{e.name}___ids": F.concat(f"{e.name}___ids", "_id")}).drop("_a", "_next", "_id")
            if n >= low:
                levels.append(base)
        out = reduce(DataFrame.unionByName, levels) if levels else base.limit(0)
        return out.withColumn(f"{e.name}___length", F.size(f"{e.name}___ids"))

    def _unbounded(self, df: DataFrame, e: Edge, key: str) -> DataFrame:
        """Trails from each start once, a written table for each length, until no trail goes on.

        In a graph with many cycles there are very many trails; a bound keeps them few.
        """
        low, end, ids = e.length[0], f"{e.name}___b", f"{e.name}___ids"
        hops = self._hops(e).select("_a", F.col("_b").alias("_next"), F.col("_ids").alias("_id"))
        level = df.select(F.col(key).alias("_start")).where("_start is not null").distinct()
        level = scratch.kept(level.withColumns({end: F.col("_start"), ids: F.array().cast("array<string>")}), "trails")
        levels = [level] if low == 0 else []
        for n in count(1):
            step = level.join(hops, F.col(end) == F.col("_a")).where(~F.arrays_overlap(ids, "_id"))
            level = scratch.kept(step.select("_start", F.col("_next").alias(end), F.concat(ids, "_id").alias(ids)), "trails")
            if level.isEmpty():
                break
            if n >= low:
                levels.append(level)
        found = reduce(DataFrame.unionByName, levels) if levels else level
        return df.join(found, F.col(key) == F.col("_start")).drop("_start").withColumn(f"{e.name}___length", F.size(ids))

    def _filtered(self, df: DataFrame, n: Node) -> DataFrame:
        """Rows whose known node also has these labels and properties."""
        if n.labels:
            df = df.where(F.col(f"{n.name}___label").isin(n.labels))
        for key, e in n.properties.items():
            df = df.where(F.col(f"{n.name}__{key}") == self._constant(e) if key in NODE_PROPERTIES else F.lit(None).cast("boolean"))
        return df

    def _pattern(self, df: DataFrame | None, paths: list[Path]) -> DataFrame:
        used: list[str] = []
        for path in paths:
            if path.nodes[0].name not in self.kinds and path.nodes[-1].name in self.kinds and path.edges:
                # Begin where something is known.
                turn = {"out": "in", "in": "out", "any": "any"}
                path = Path(path.name, path.nodes[::-1], [Edge(e.name, e.types, e.properties, turn[e.direction], e.length) for e in path.edges[::-1]])
            first = path.nodes[0]
            if first.name in self.kinds:
                df = self._filtered(df, first)
            else:
                start = self._node(first)
                if df is None:
                    df = start
                elif path.edges and any(n.name in self.kinds for n in path.nodes):
                    raise UnsupportedCypher("a path must begin or end at a known node")
                else:
                    df = df.crossJoin(start)  # the query itself asks for all pairs
                self.kinds[first.name] = "node"
            for k in range(len(path.edges)):
                df = self._extend(df, path, k, used)
            if path.name:
                self.kinds[path.name] = "path"
                lengths = [F.col(f"{e.name}___length") for e in path.edges]
                df = df.withColumn(f"{path.name}___length", reduce(lambda a, b: a + b, lengths) if lengths else F.lit(0))
        return df

    def match(self, m: Match) -> None:
        if not m.optional or self.frame is None:
            self.frame = self._pattern(self.frame, m.paths)
            self.frame = self.where(self.frame, m.where)
            return
        # The pattern is matched once for each combination of the known variables that it names.
        named = {n.name for path in m.paths for n in path.nodes} | (_variables(m.where) if m.where is not None else set())
        known = sorted(n for n in named if self.kinds.get(n) == "node")
        if not known or any(self.kinds.get(n) not in (None, "node") for n in named):
            raise UnsupportedCypher("OPTIONAL MATCH must name a known node, and of what is known nodes only")
        keys = [f"{n}___key" for n in known]
        seeds = self.frame.select(*[c for c in self.frame.columns if any(c.startswith(f"{n}__") for n in known)]).dropDuplicates(keys)
        found = self._pattern(seeds, m.paths)
        found = self.where(found, m.where)
        new = [c for c in found.columns if c not in seeds.columns]
        found = found.select(*[F.col(k).alias(f"_found_{k}") for k in keys], *new)
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_found_{k}")) for k in keys])
        self.frame = self.frame.join(found, same, "left").drop(*[f"_found_{k}" for k in keys])

    def where(self, df: DataFrame, e: tuple | None) -> DataFrame:
        """Rows for which a condition holds; patterns in it must stand alone or after NOT."""
        if e is None:
            return df
        if e[0] == "and":
            return self.where(self.where(df, e[1]), e[2])
        if e[0] == "pattern":
            return self._having(df, e[1], "left_semi")
        if e[0] == "not" and e[1][0] == "pattern":
            return self._having(df, e[1][1], "left_anti")
        return df.where(self.column(e))

    def _having(self, df: DataFrame, path: Path, how: str) -> DataFrame:
        """Rows whose known nodes do (or do not) have such a path."""
        known = sorted({n.name for n in path.nodes if self.kinds.get(n.name) == "node"})
        if not known or any(n.name not in known and not n.name.startswith("_") for n in path.nodes):
            raise UnsupportedCypher("a pattern in a condition must name known nodes, and no others")
        kinds, keys = dict(self.kinds), [f"{n}___key" for n in known]
        seeds = df.select(*[c for c in df.columns if any(c.startswith(f"{n}__") for n in known)]).dropDuplicates(keys)
        found = self._pattern(seeds, [path]).select(*[F.col(k).alias(f"_found_{k}") for k in keys]).distinct()
        self.kinds = kinds
        return df.join(found, reduce(lambda x, y: x & y, [F.col(k) == F.col(f"_found_{k}") for k in keys]), how)

    def unwind(self, u: Unwind, spark: SparkSession) -> None:
        df = self.frame if self.frame is not None else spark.range(1).select(F.lit(1).alias("_one"))
        self.frame = df.withColumn(f"{u.name}__value", F.explode(self.column(u.value)))
        self.kinds[u.name] = "value"

    # - expressions -

    def column(self, e: tuple) -> Column:
        op, *a = e
        if op == "value":
            return F.lit(a[0])
        if op == "name":
            return self._whole(a[0])
        if op == "property":
            return self._property(a[0], a[1])
        if op == "labelled":
            return F.col(f"{a[0][1]}___label").isin(a[1])
        if op in ("and", "or"):
            x, y = self.column(a[0]), self.column(a[1])
            return x & y if op == "and" else x | y
        if op == "xor":
            x, y = self.column(a[0]), self.column(a[1])
            return (x & ~y) | (~x & y)
        if op == "not":
            return ~self.column(a[0])
        if op == "null":
            if a[0][0] == "name" and self.kinds.get(a[0][1]) == "node":
                return F.col(f"{a[0][1]}___key").isNull()
            return self.column(a[0]).isNull()
        if op in ("=", "<>") and all(x[0] == "name" and self.kinds.get(x[1]) == "node" for x in a):
            x, y = (F.col(f"{x[1]}___key") for x in a)
            return x == y if op == "=" else x != y
        if op in ("=", "<>", "<", "<=", ">", ">=", "+", "-", "*", "/", "%", "=~", "contains", "starts", "ends"):
            return self._binary(op, a[0], a[1])
        if op == "neg":
            return -self.column(a[0])
        if op == "in":
            if a[1][0] == "list":
                return self.column(a[0]).isin([self.column(x) for x in a[1][1:]]) if a[1][1:] else F.lit(False)
            return F.array_contains(self.column(a[1]), self.column(a[0]))
        if op == "list":
            return F.array(*map(self.column, a))
        if op == "index":
            at = self.column(a[1]).cast("int")
            return F.try_element_at(self.column(a[0]), F.when(at >= 0, at + 1).otherwise(at))
        if op == "case":
            out = None
            for test, value in a[0]:
                out = (F if out is None else out).when(self.column(test), self.column(value))
            return out.otherwise(self.column(a[1]))
        if op == "call":
            return self._call(a[0], a[1], list(a[2:]))
        raise UnsupportedCypher(f"{op} is not supported here")

    def _binary(self, op: str, left: tuple, right: tuple) -> Column:
        x, y = self.column(left), self.column(right)
        if op == "+" and any(e[0] == "value" and isinstance(e[1], str) for e in (left, right)):
            return F.concat(x.cast("string"), y.cast("string"))
        if op == "/" and all(not (e[0] == "value" and isinstance(e[1], float)) for e in (left, right)):
            return F.when(y != 0, F.floor(F.abs(x) / F.abs(y)) * F.signum(x).cast("long") * F.signum(y).cast("long"))
        return {
            "=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y, "+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y,
            "=~": lambda: F.regexp_like(x, F.concat(F.lit("^(?:"), y, F.lit(")$"))), "contains": lambda: F.contains(x, y), "starts": lambda: F.startswith(x, y), "ends": lambda: F.endswith(x, y),
        }[op]()

    def _whole(self, name: str) -> Column:
        kind = self.kinds.get(name)
        if kind == "node":
            properties = F.struct(*[F.col(f"{name}__{p}").alias(p) for p in NODE_PROPERTIES])
            return F.when(F.col(f"{name}___key").isNotNull(), F.struct(F.lit("node").alias("type"), F.col(f"{name}___key").alias("id"), F.array(f"{name}___label").alias("labels"), properties.alias("properties")))
        if kind == "edge":
            properties = F.struct(*[F.col(f"{name}__{p}").alias(p) for p in EDGE_PROPERTIES])
            whole = F.struct(F.lit("edge").alias("type"), F.concat_ws("|", f"{name}___type", f"{name}___src", f"{name}___dst").alias("id"), F.col(f"{name}___type").alias("relationship_type"), F.col(f"{name}___src").alias("src_node"), F.col(f"{name}___dst").alias("dst_node"), properties.alias("properties"))
            return F.when(F.col(f"{name}___src").isNotNull(), whole)
        if kind == "edges":
            return F.col(f"{name}___ids")
        if kind == "path":
            return F.col(f"{name}___length")
        if kind == "value":
            return F.col(f"{name}__value")
        raise CypherError(f"{name} is not defined")

    def _property(self, of: tuple, key: str) -> Column:
        if of[0] != "name":
            raise UnsupportedCypher("properties are read from variables only")
        kind = self.kinds.get(of[1])
        if kind is None:
            raise CypherError(f"{of[1]} is not defined")
        known = {"node": NODE_PROPERTIES, "edge": EDGE_PROPERTIES}.get(kind, [])
        return F.col(f"{of[1]}__{key}") if key in known else F.lit(None).cast("string")

    def _call(self, name: str, distinct: bool, args: list[tuple]) -> Column:
        if name == "count":
            if args == [("star",)]:
                return F.count(F.lit(1))
            x = self._identity(args[0])
            return F.count_distinct(x) if distinct else F.count(x)
        if name == "id":
            return self._identity(args[0])
        if name == "type" and args[0][0] == "name":
            return F.col(f"{args[0][1]}___type")
        if name == "labels":
            return F.array(f"{args[0][1]}___label")
        if name in ("length", "size") and args[0][0] == "name":
            kind = self.kinds.get(args[0][1])
            if kind in ("path", "edges"):
                return F.col(f"{args[0][1]}___length").cast("long")
        if name in ("startnode", "endnode") and args[0][0] == "name" and self.kinds.get(args[0][1]) == "edge":
            return F.col(f"{args[0][1]}___{'src' if name == 'startnode' else 'dst'}")
        if name in ("properties", "keys") and args[0][0] == "name" and self.kinds.get(args[0][1]) in ("node", "edge"):
            own = NODE_PROPERTIES if self.kinds[args[0][1]] == "node" else EDGE_PROPERTIES
            if name == "properties":
                return F.struct(*[F.col(f"{args[0][1]}__{p}").alias(p) for p in own])
            return F.array_compact(F.array(*[F.when(F.col(f"{args[0][1]}__{p}").isNotNull(), F.lit(p)) for p in own]))
        x = [self.column(a) for a in args]
        simple = {
            "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "abs": F.abs, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
            "round": F.round, "floor": F.floor, "ceil": F.ceil, "sqrt": F.sqrt, "sign": F.signum, "reverse": F.reverse,
            "tostring": lambda c: c.cast("string"), "tointeger": lambda c: c.cast("long"), "tofloat": lambda c: c.cast("double"), "head": lambda c: F.try_element_at(c, F.lit(1)), "last": lambda c: F.try_element_at(c, F.lit(-1)),
            "collect": lambda c: F.sort_array(F.collect_set(c) if distinct else F.collect_list(c)), "length": lambda c: F.length(c).cast("long"),
        }
        if name == "size":
            return (F.size(x[0]) if args[0][0] == "list" or args[0][:2] == ("call", "collect") else F.length(x[0])).cast("long")
        if name == "coalesce":
            return F.coalesce(*x)
        if name == "replace":
            return F.replace(*x)
        if name == "split":
            return F.split(x[0], "\\Q" + str(args[1][1]) + "\\E")
        if name == "substring":
            return F.substring(x[0], x[1].cast("int") + 1, x[2].cast("int") if len(x) > 2 else F.lit(1 << 30))
        if name in ("left", "right") and len(x) == 2:
            return getattr(F, name)(x[0], x[1])
        if name == "range":
            return F.sequence(*x)
        if name == "timestamp" and not x:
            return F.unix_millis(F.current_timestamp())
        if name == "sum" and distinct:
            return F.sum_distinct(x[0])
        if name == "avg" and distinct:
            return F.sum_distinct(x[0]) / F.count_distinct(x[0])
        if name in simple and len(x) == 1:
            return simple[name](x[0])
        raise UnsupportedCypher(f"function {name} is not supported")

    def _identity(self, e: tuple) -> Column:
        """What tells a node or edge from others; any other value itself."""
        if e[0] == "name":
            kind = self.kinds.get(e[1])
            if kind == "node":
                return F.col(f"{e[1]}___key")
            if kind == "edge":
                return F.when(F.col(f"{e[1]}___src").isNotNull(), F.concat_ws("|", f"{e[1]}___type", f"{e[1]}___src", f"{e[1]}___dst"))
        return self.column(e)

    # - the query -

    def run(self, q: Query, spark: SparkSession) -> DataFrame:
        for clause in q.clauses[:-1]:
            self.read(clause, spark)
        return self.give(q.clauses[-1], spark)

    def read(self, clause: Match | Unwind | Projection, spark: SparkSession) -> None:
        if isinstance(clause, Match):
            self.match(clause)
        elif isinstance(clause, Unwind):
            self.unwind(clause, spark)
        else:
            self.carry(clause, spark)

    def _items(self, p: Projection) -> list[tuple[tuple, str]]:
        every = [(("name", n), n) for n in self.kinds if not n.startswith("_")]
        return [x for item in p.items for x in (every if item == (("all",), "*") else [item])]

    def carry(self, p: Projection, spark: SparkSession) -> None:
        """WITH: what later clauses know are its items; nodes and edges stay what they are."""
        df = self.frame if self.frame is not None else spark.range(1)
        items = self._items(p)
        groups, measured, kinds = [], [], {}
        for e, name in items:
            kind = self.kinds.get(e[1]) if e[0] == "name" else None
            if kind in ("node", "edge", "edges", "path"):
                old = [c for c in df.columns if c.startswith(f"{e[1]}__")]
                groups += [F.col(c).alias(f"{name}__{c[len(e[1]) + 2:]}") for c in old]
                kinds[name] = kind
            else:
                (measured if _aggregates(e) else groups).append(self.column(e).alias(f"{name}__value"))
                kinds[name] = "value"
        if measured:
            df = df.groupBy(*groups).agg(*measured)
        else:
            df = df.select(*groups)
            df = df.distinct() if p.distinct else df
        self.frame, self.kinds = df, kinds
        if p.order:
            order = [(c.desc_nulls_first() if down else c.asc_nulls_last()) for c, down in ((self.column(_renamed(e, items)), down) for e, down in p.order)]
            self.frame = self.frame.orderBy(*order, *[F.col(c) for c in sorted(self.frame.columns)])
        if p.skip:
            self.frame = self.frame.offset(p.skip)
        if p.limit is not None:
            self.frame = self.frame.limit(p.limit)
        self.frame = self.where(self.frame, p.where)

    def give(self, q: Projection, spark: SparkSession) -> DataFrame:
        if self.frame is None:
            self.frame = spark.range(1)
        items = self._items(q)
        names = _unique([n for _, n in items])
        values = [self.column(e).alias(f"_v{k}") for k, (e, _) in enumerate(items)]
        same = {repr(e): k for k, (e, _) in enumerate(items)} | {repr(("name", n)): k for k, (_, n) in enumerate(items) if n not in self.kinds}
        # What ORDER BY names is one of the items, or else a column of its own.
        extra = [e for e, _ in q.order if repr(e) not in same]
        if any(map(_aggregates, [e for e, _ in items])):
            groups = [k for k, (e, _) in enumerate(items) if not _aggregates(e)]
            if any(not _aggregates(e) for e in extra):
                raise UnsupportedCypher("ORDER BY of a grouped query takes its items and aggregates only")
            measured = [values[k] for k in range(len(items)) if k not in groups] + [self.column(e).alias(f"_o{k}") for k, e in enumerate(extra)]
            rows = self.frame.withColumns({f"_v{k}": values[k] for k in groups}) if groups else self.frame
            rows = rows.groupBy(*[f"_v{k}" for k in groups]).agg(*measured)
        else:
            rows = self.frame.select(*values, *[self.column(e).alias(f"_o{k}") for k, e in enumerate(extra)])
            if q.distinct:
                rows = rows.distinct() if not extra else rows.dropDuplicates([f"_v{k}" for k in range(len(items))])
        if q.order:
            order = []
            for e, down in q.order:
                c = F.col(f"_v{same[repr(e)]}") if repr(e) in same else F.col(f"_o{extra.index(e)}")
                order.append(c.desc_nulls_first() if down else c.asc_nulls_last())
            # Ties are broken by all sortable columns, so a limit gives the same rows each time.
            order += [F.col(f.name).asc_nulls_last() for f in rows.schema.fields if f.dataType.typeName() not in ("map", "void")]
            rows = rows.orderBy(*order)
        if q.skip:
            rows = rows.offset(q.skip)
        if q.limit is not None:
            rows = rows.limit(q.limit)
        return rows.select(*[F.col(f"_v{k}").alias(n) for k, n in enumerate(names)])


def _aggregates(e) -> bool:
    if isinstance(e, tuple) and len(e) > 1 and e[0] == "call" and e[1] in _AGGREGATES:
        return True
    return isinstance(e, tuple | list) and any(_aggregates(x) for x in e if isinstance(x, tuple | list))


def _renamed(e, items: list[tuple[tuple, str]]):
    """An ORDER BY expression in the names that WITH gives."""
    for old, name in items:
        if e == old:
            return ("name", name)
    return tuple(_renamed(x, items) if isinstance(x, tuple) else x for x in e)


def _variables(e) -> set[str]:
    if isinstance(e, tuple) and len(e) == 2 and e[0] == "name":
        return {e[1]}
    return set().union(*map(_variables, e)) if isinstance(e, tuple | list) else set()


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n.lower()] = seen.get(n.lower(), 0) + 1
        out.append(n if seen[n.lower()] == 1 else f"{n}_{seen[n.lower()]}")
    return out


def cypher(graph: Graph, text: str, metadata: DataFrame | None = None) -> DataFrame:
    """The rows of a query over a graph; columns are named by their alias or their text."""
    q, out, spark = parse(text), None, graph.files.sparkSession
    every = True
    while True:
        rows = Lowering(Tables(graph, metadata)).run(q, spark)
        if out is not None:
            if len(out.columns) != len(rows.columns):
                raise CypherError("the parts of a UNION differ in their number of columns")
            out = out.union(rows)
            out = out if every else out.distinct()
        else:
            out = rows
        if q.union is None:
            return out
        q, every = q.union
