"""Cypher that writes: CREATE, MERGE, SET, REMOVE, DELETE and FOREACH over a store.

What the reading clauses find is a table of rows; a clause that writes turns it into new versions
of the tables it touches, by joins, and all of them become one new snapshot.  Nodes are told apart
by label and key (path of File, name of Module, key of Metadata, id of symbols), edges by type and
ends, so

* CREATE needs the key and fails where the node or edge exists; MERGE goes by the key alone;
* the key cannot be set, nor a property that a label does not have;
* of several values for one property the greatest counts, whatever order rows come in;
* with a node its edges go, with DETACH or without;
* FOREACH takes all elements of all rows at once, and rows cannot be returned after it.

Rows in which an optional variable is null change nothing.  Indexing and updating resolve the graph
from the source files, so they undo what was written by hand.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators.build import Graph
from ..sources.store import Store
from .cypher import EDGE_PROPERTIES, EDGE_TABLES, NODE_PROPERTIES, UPDATES, Assign, Create, CypherError, Delete, Edge, Foreach, Lowering, Node, Parser, Projection, Query, Tables, UnsupportedCypher, cypher

#: Table and key of nodes that are no symbols.
KEYED = {"File": ("files", "path"), "Module": ("modules", "name"), "Metadata": ("metadata", "key")}
#: What a node holds that gives no value.
DEFAULTS = {"signature": "", "docstring": ""}


def _place(label: str) -> tuple[str, str]:
    if label in KEYED:
        return KEYED[label]
    if label in names.SYMBOL_LABELS:
        return "symbols", "id"
    raise UnsupportedCypher(f"a graph has no nodes of label {label}")


class Writing(Lowering):
    """A query whose clauses change the tables that it reads."""

    def __init__(self, tables: Tables):
        super().__init__(Tables(replace(tables.graph), tables.metadata))
        self.touched = False

    def _get(self, table: str) -> DataFrame:
        return self.tables.metadata if table == "metadata" else getattr(self.tables.graph, table)

    def _put(self, table: str, df: DataFrame) -> None:
        old = self._get(table)
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema])
        setattr(self.tables if table == "metadata" else self.tables.graph, table, df)
        self.touched = True

    def _keyed(self, table: str) -> DataFrame:
        """A node table with the key of each node."""
        for label, (name, key) in KEYED.items():
            if name == table:
                return self._get(table).withColumn("_key", names.node_key(F.lit(label), F.col(key)))
        return self._get(table).withColumn("_key", F.col("node_key"))

    def apply(self, clause: Assign | Delete | Create | Foreach) -> None:
        if self.frame is None:
            self.frame = self.tables.graph.files.sparkSession.range(1).select(F.lit(1).alias("_one"))
        if isinstance(clause, Assign):
            self.assign(clause, F.lit(True))
        elif isinstance(clause, Delete):
            for name in clause.names:
                self.delete(name)
        elif isinstance(clause, Foreach):
            self.each(clause)
        else:
            self.create(clause)

    def each(self, clause: Foreach) -> None:
        frame, kinds = self.frame, dict(self.kinds)
        self.frame = frame.withColumn(f"{clause.name}__value", F.explode(self.column(clause.value)))
        self.kinds[clause.name] = "value"
        for update in clause.updates:
            self.apply(update)
        self.frame, self.kinds = frame, kinds

    # - values -

    def assign(self, clause: Assign, when: Column) -> None:
        for name, key, e in clause.items:
            kind, value = self.kinds.get(name), self.column(e)
            if kind == "node":
                self._set_node(name, key, value, when)
            elif kind == "edge":
                self._set_edge(name, key, value, when)
            else:
                raise CypherError(f"{name} is no node or edge")
            column = f"{name}__{key}"
            new = F.when(when, value.cast(self.frame.schema[column].dataType)).otherwise(F.col(column))
            self.frame = self.frame.withColumn(column, new)

    def _refuse(self, able: list[str], wrong: DataFrame, key: str) -> None:
        if not able or not wrong.isEmpty():
            raise UnsupportedCypher(f"property {key} cannot be set on these")

    def _set_node(self, name: str, key: str, value: Column, when: Column) -> None:
        places = {label: _place(label) for label in (*KEYED, *names.SYMBOL_LABELS)}
        able = [label for label, (table, own) in places.items() if key != own and key in self._get(table).columns and key in NODE_PROPERTIES]
        rows = self.frame.where(when & F.col(f"{name}___key").isNotNull())
        self._refuse(able, rows.where(~F.col(f"{name}___label").isin(able)), key)
        rows = rows.select(F.col(f"{name}___key").alias("_key"), value.alias("_new")).groupBy("_key").agg(F.max("_new").alias("_new")).withColumn("_hit", F.lit(True))
        for table in sorted({places[label][0] for label in able}):
            old = self._keyed(table)
            self._put(table, old.join(rows, "_key", "left").withColumn(key, F.when(F.col("_hit"), F.col("_new").cast(old.schema[key].dataType)).otherwise(F.col(key))))

    def _set_edge(self, name: str, key: str, value: Column, when: Column) -> None:
        able = [t for t, table in EDGE_TABLES.items() if key in EDGE_PROPERTIES and key in self._get(table).columns]
        rows = self.frame.where(when & F.col(f"{name}___src").isNotNull())
        self._refuse(able, rows.where(~F.col(f"{name}___type").isin(able)), key)
        rows = rows.select(F.col(f"{name}___type").alias("_type"), F.col(f"{name}___src").alias("src_key"), F.col(f"{name}___dst").alias("dst_key"), value.alias("_new"))
        rows = rows.groupBy("_type", "src_key", "dst_key").agg(F.max("_new").alias("_new")).withColumn("_hit", F.lit(True))
        for t in able:
            old = self._get(EDGE_TABLES[t])
            new = old.join(rows.where(F.col("_type") == t), ["src_key", "dst_key"], "left")
            self._put(EDGE_TABLES[t], new.withColumn(key, F.when(F.col("_hit"), F.col("_new").cast(old.schema[key].dataType)).otherwise(F.col(key))))

    # - taking away -

    def delete(self, name: str) -> None:
        kind = self.kinds.get(name)
        if kind == "edge":
            gone = self.frame.select(F.col(f"{name}___type").alias("_type"), F.col(f"{name}___src").alias("src_key"), F.col(f"{name}___dst").alias("dst_key")).distinct()
            for t, table in EDGE_TABLES.items():
                self._put(table, self._get(table).join(gone.where(F.col("_type") == t), ["src_key", "dst_key"], "left_anti"))
            return
        if kind != "node":
            raise UnsupportedCypher(f"{name} is no node or edge")
        gone = self.frame.select(F.col(f"{name}___key").alias("_key")).distinct()
        for table in ("symbols", *[table for table, _ in KEYED.values()]):
            self._put(table, self._keyed(table).join(gone, "_key", "left_anti"))
        for table in EDGE_TABLES.values():
            kept = self._get(table)
            for end in ("src_key", "dst_key"):
                kept = kept.join(gone.withColumnRenamed("_key", end), end, "left_anti")
            self._put(table, kept)

    # - adding -

    def create(self, clause: Create) -> None:
        for path in clause.paths:
            if path.name:
                raise UnsupportedCypher("a path that is created has no name")
            made = []
            for n in path.nodes:
                if n.name in self.kinds:
                    if n.labels or n.properties or self.kinds[n.name] != "node":
                        raise CypherError(f"{n.name} is known already")
                else:
                    made.append(self._add_node(n, clause.merge))
            for k, e in enumerate(path.edges):
                made.append(self._add_edge(e, path.nodes[k], path.nodes[k + 1], clause.merge))
            if clause.made or clause.met:
                if len(made) != 1:
                    raise UnsupportedCypher("ON CREATE and ON MATCH need a MERGE of one node or edge")
                for part, when in ((clause.made, F.col(made[0])), (clause.met, ~F.col(made[0]))):
                    if part is not None:
                        self.assign(part, when)
            self.frame = self.frame.drop(*made)

    def _add_node(self, n: Node, merge: bool) -> str:
        """Add a node for each row; the name of a column that says in which rows it is new."""
        if len(n.labels) != 1:
            raise UnsupportedCypher("a new node has one label")
        label = n.labels[0]
        table, key = _place(label)
        old, flag = self._keyed(table), f"_new_{n.name}"
        if key not in n.properties:
            raise UnsupportedCypher(f"a new {label} needs {key}")
        if merge and len(n.properties) > 1:
            raise UnsupportedCypher(f"MERGE goes by {key}; set other properties ON CREATE or ON MATCH")
        for p in n.properties:
            if p not in old.columns or p not in NODE_PROPERTIES:
                raise UnsupportedCypher(f"a {label} has no property {p}")
        values = {p: self.column(e) for p, e in n.properties.items()}
        identity = names.node_key(F.lit(label), values[key].cast("string"))
        self.frame = self.frame.withColumn("_key", identity).where(values[key].isNotNull())
        wanted = self.frame.select("_key", *[v.cast(old.schema[p].dataType).alias(p) for p, v in values.items()])
        others = [p for p in values if p != key]
        wanted = wanted.groupBy("_key", key).agg(*[F.max(p).alias(p) for p in others]) if others else wanted.distinct()
        known = old.select("_key").distinct().withColumn("_known", F.lit(True))
        if not merge and not wanted.join(known, "_key", "left_semi").isEmpty():
            raise CypherError(f"such a {label} exists")
        fresh = wanted.join(known, "_key", "left_anti")
        given = {**{p: F.lit(v) for p, v in DEFAULTS.items()}, **{p: F.col(p) for p in values}, "node_key": F.col("_key"), "label": F.lit(label)}
        row = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self._get(table).schema]
        self._put(table, self._get(table).unionByName(fresh.select(*row)))
        self.frame = self.frame.join(known, "_key", "left").withColumn(flag, F.col("_known").isNull()).drop("_known")
        nodes = self._columns(self.tables.nodes([label]), n.name)
        self.frame = self.frame.join(nodes, F.col("_key") == F.col(f"{n.name}___key")).drop("_key")
        self.kinds[n.name] = "node"
        return flag

    def _add_edge(self, e: Edge, left: Node, right: Node, merge: bool) -> str:
        if len(e.types) != 1 or e.types[0] not in EDGE_TABLES or e.length is not None or e.direction == "any":
            raise UnsupportedCypher("a new edge has one known type and a direction")
        table, flag = EDGE_TABLES[e.types[0]], f"_new_{e.name}"
        old = self._get(table)
        for p in e.properties:
            if p not in old.columns or p not in EDGE_PROPERTIES:
                raise UnsupportedCypher(f"{e.types[0]} has no property {p}")
        src, dst = (F.col(f"{n.name}___key") for n in ((left, right) if e.direction == "out" else (right, left)))
        self.frame = self.frame.withColumns({"src_key": src, "dst_key": dst}).where("src_key is not null and dst_key is not null")
        values = {p: self.column(x) for p, x in e.properties.items()}
        wanted = self.frame.select("src_key", "dst_key", *[v.cast(old.schema[p].dataType).alias(p) for p, v in values.items()])
        wanted = wanted.groupBy("src_key", "dst_key").agg(*[F.max(p).alias(p) for p in values]) if values else wanted.distinct()
        known = old.select("src_key", "dst_key").distinct().withColumn("_known", F.lit(True))
        if not merge and not wanted.join(known, ["src_key", "dst_key"], "left_semi").isEmpty():
            raise CypherError(f"such an edge {e.types[0]} exists")
        fresh = wanted.join(known, ["src_key", "dst_key"], "left_anti")
        self._put(table, old.unionByName(fresh, allowMissingColumns=True))
        self.frame = self.frame.join(known, ["src_key", "dst_key"], "left").withColumn(flag, F.col("_known").isNull()).drop("_known")
        hops = self._columns(self._hops(Edge(e.name, e.types, {}, "out", None)), e.name)
        same = (F.col("src_key") == F.col(f"{e.name}___src")) & (F.col("dst_key") == F.col(f"{e.name}___dst"))
        self.frame = self.frame.join(hops, same).drop("src_key", "dst_key").withColumn(f"{e.name}___length", F.lit(1))
        self.kinds[e.name] = "edge"
        return flag


def execute(store: Store, text: str) -> DataFrame:
    """Run a query over a store, whether it reads or writes; its rows (none without RETURN)."""
    q, spark = Parser(text, writing=True).query(), store.spark
    if not any(isinstance(c, UPDATES) for c in q.clauses):
        return cypher(store.load(), text, store.table("metadata"))
    work, rows = _run(q, Tables(store.load(), store.table("metadata")), spark)
    # The old snapshot stays readable, so rows may be computed from it after the new one counts.
    store.write(work.tables.graph, work.tables.metadata)
    return rows


def _run(q: Query, tables: Tables, spark: SparkSession) -> tuple[Writing, DataFrame]:
    """The tables after a query that writes, and its rows; tables it does not touch stay as they are."""
    if q.union is not None:
        raise UnsupportedCypher("the parts of a UNION cannot write")
    if isinstance(q.clauses[-1], Projection) and any(isinstance(c, Foreach) for c in q.clauses):
        raise UnsupportedCypher("RETURN is not supported after FOREACH")
    work = Writing(tables)
    shown = q.clauses.pop() if isinstance(q.clauses[-1], Projection) else None
    for clause in q.clauses:
        if isinstance(clause, UPDATES):
            work.apply(clause)
        else:
            work.read(clause, spark)
    return work, work.give(shown, spark) if shown else spark.createDataFrame([], "nothing string").select()


def changed(graph: Graph, text: str, metadata: DataFrame | None = None) -> Graph:
    """The graph after a query that writes, as tables that are computed when they are read.

    Nothing is stored, so what is derived for a table that nobody reads costs nothing.
    """
    spark = graph.files.sparkSession
    metadata = metadata if metadata is not None else spark.createDataFrame([], "key string, value string")
    work, _ = _run(Parser(text, writing=True).query(), Tables(graph, metadata), spark)
    return work.tables.graph
