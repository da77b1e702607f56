import json
import os
import random
from dataclasses import replace

import pytest
from fixture_repo import FILES, commit, contents, git, write
from pyspark.sql import functions as F

from codeloom import cli
from codeloom.functions import names
from codeloom.operators import build, resolve, search, traverse
from codeloom.operators.extract import registry
from codeloom.plans import index
from codeloom.plans.cypher import CypherError, UnsupportedCypher, cypher
from codeloom.plans.cypher_write import execute
from codeloom.sources import git as git_source
from codeloom.sources import paths
from codeloom.sources.store import LAST_COMMIT, Store


def graph_of(spark, files, compat=False, sequential=False):
    rows = [(p, names.language_of(p), bytearray(t.encode())) for p, t in files.items()]
    extracted = registry.extract(spark.createDataFrame(rows, "path string, language string, content binary"), compat).cache()
    return build.derive(build.raw_tables(extracted), sequential), extracted


@pytest.fixture(scope="module")
def graph(spark):
    g, _ = graph_of(spark, FILES)
    for name, df in g.tables().items():
        setattr(g, name, df.cache())
    return g


def pairs(edges):
    return sorted((r.src_key, r.dst_key) for r in edges.collect())


def test_nodes(graph):
    got = {(r.label, r.name, r.start_line, r.end_line, r.visibility, r.signature) for r in graph.symbols.collect()}
    assert got == {
        ("Function", "ping", 6, 7, "public", "def ping(self)"), ("Function", "__init__", 10, 11, "protected", "def __init__(self)"), ("Function", "helper", 13, 16, "public", "def helper(n)"), ("Function", "inner", 14, 15, "public", "def inner()"),
        ("Class", "Base", 4, 7, "public", "class Base"), ("Method", "ping", 6, 7, "public", "def ping(self)"), ("Class", "Child", 9, 11, "public", "class Child(Base)"), ("Method", "__init__", 10, 11, "protected", "def __init__(self)"),
        ("Function", "run", 8, 8, "private", "func run()"), ("Method", "Speak", 5, 7, "public", "func (a *Animal) Speak() string"), ("Struct", "Animal", 2, 4, "public", "Animal struct {"),
    }
    docs = {r.name: r.docstring for r in graph.symbols.collect()}
    assert docs["Base"] == "Base doc." and docs["run"] == ""
    assert {(r.path, r.line_count, r.language) for r in graph.files.collect()} == {("pkg/a.py", 17, "Python"), ("main.go", 9, "Go")}


def test_edges(spark, graph):
    a = "pkg/a.py"
    assert pairs(graph.calls) == sorted([(f"Function|{a}:ping:6", f"Function|{a}:helper:13"), (f"Method|{a}:ping:6", f"Function|{a}:helper:13"), (f"Function|{a}:helper:13", f"Function|{a}:inner:14"), ("Function|main.go:run:8", f"Function|{a}:helper:13"), ("Method|main.go:Speak:5", f"Function|{a}:helper:13")])
    assert pairs(graph.inherits) == sorted([(f"Class|{a}:Child:9", f"Class|{a}:Base:4"), ("Struct|main.go:Animal:2", f"Class|{a}:Base:4")])
    assert [(r.src_key, r.dst_key, json.loads(r["items"]), r.line) for r in graph.imports.orderBy("line").collect()] == [(f"File|{a}", "Module|os", [], 1), (f"File|{a}", "Module|json", ["dumps", "loads"], 2)]
    assert graph.contains.count() == 16 and ("Struct|main.go:Animal:2", "Method|main.go:Speak:5") in pairs(graph.contains)
    compat, _ = graph_of(spark, FILES, compat=True)
    assert compat.contains.count() == 15
    sequential, _ = graph_of(spark, FILES, sequential=True)
    assert sequential.calls.count() == 3 and sequential.inherits.count() == 1
    assert sorted(r.name for r in graph.modules.collect()) == ["json", "os"]


def test_raw_calls(graph):
    records = resolve.enclosing(graph.raw_calls, graph.raw_symbols)
    assert records.where("file_path = 'pkg/a.py'").count() == 7 and records.where("file_path = 'main.go'").count() == 2


def test_ends_of_edges_exist(graph):
    keys = {r.node_key for r in graph.symbols.collect()} | {f"File|{r.path}" for r in graph.files.collect()} | {f"Module|{r.name}" for r in graph.modules.collect()}
    for edges in (graph.contains, graph.calls, graph.imports, graph.inherits):
        assert {k for p in pairs(edges) for k in p} <= keys and len(pairs(edges)) == len(set(pairs(edges)))


def test_last_write_wins(spark):
    g, _ = graph_of(spark, {"a.py": "import x\nfrom x import b\ndef f():\n    g()\n    g()\ndef g(): pass\n"})
    (r,) = g.imports.collect()
    assert (r.line, r["items"]) == (2, '["b"]')
    (c,) = g.calls.collect()
    assert c.call_site_line == 5


def test_find(graph):
    found = lambda *a, **k: [(r.name, r.kind) for r in search.find(graph.symbols, *a, **k).collect()]
    assert found("*IN*") == [("__init__", "Function"), ("__init__", "Method"), ("inner", "Function"), ("ping", "Function"), ("ping", "Method")]
    assert found("ping", "method") == [("ping", "Method")] and found("PING", "function", "py") == [("ping", "Function")]
    assert found("*ING", language="Python") == [("ping", "Function"), ("ping", "Method")] and found("H*") == [("helper", "Function")]
    assert found("p*g") == [] and found("%") == [] and found("_") == []
    assert len(found("*")) == len(found("")) == len(found("**")) == 11 and len(found("*", limit=4)) == 4
    assert found("ping", language="py", compat=True) == []
    with pytest.raises(names.UnknownName, match="Unknown symbol kind: widget"):
        found("x", "widget")
    assert sum(len(found("*", k.lower())) for k in names.SYMBOL_LABELS) == 11


def test_calls(graph):
    got = lambda f, d, **k: [(r.name, r.distance) for r in search.calls(graph.symbols, graph.calls, f, d, **k).collect()]
    assert got("helper", "callers") == [("ping", 1), ("run", 1)]
    assert got("inner", "callers") == [("helper", 1), ("ping", 2), ("run", 2)]
    assert got("ping", "callees") == [("helper", 1), ("inner", 2)] and got("ping", "callees", depth=1) == [("helper", 1)]
    assert got("nothing", "callers") == [] and got("inner", "callers", limit=1) == [("helper", 1)]
    assert [(r.direction, r.name) for r in search.both_calls(graph.symbols, graph.calls, "helper").collect()] == [("callers", "ping"), ("callers", "run"), ("callees", "inner")]


def test_status(graph):
    row = search.status(graph.files, graph.symbols, graph.calls, graph.imports).first()
    assert row.asDict() == {"files": 2, "functions": 5, "classes": 2, "structs": 1, "calls": 5, "imports": 2}
    assert [tuple(r) for r in search.files_by_language(graph.files).collect()] == [("Go", 1), ("Python", 1)]


def brute_trails(edges, start, depth):
    out = []

    def go(node, path):
        for e in edges:
            if e[0] == node and e not in path:
                out.append((e[1], len(path) + 1))
                if len(path) + 1 < depth:
                    go(e[1], [*path, e])

    go(start, [])
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_trails_and_distances(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(7), rng.randrange(7)) for _ in range(14)} | {(1, seed)})
    frame = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
    starts = spark.createDataFrame([("1",)], "node string")
    want = brute_trails(edges, 1, 4)
    assert sorted((int(r.node), r.distance) for r in traverse.trails(starts, frame, 4).collect()) == want and want
    back = brute_trails([(b, a) for a, b in edges], 1, 3)
    assert sorted((int(r.node), r.distance) for r in traverse.trails(starts, frame, 3, reverse=True).collect()) == back
    least = {}
    for n, d in want:
        least[n] = min(d, least.get(n, d))
    assert {int(r.node): r.distance for r in traverse.distances(starts, frame, 4).collect()} == least
    # callers and callees are two views of the same paths
    all_nodes = spark.createDataFrame([(str(n),) for n in range(7)], "node string")
    there = {(r.start, r.node) for r in traverse.distances(all_nodes, frame, 3).collect()}
    assert there == {(r.node, r.start) for r in traverse.distances(all_nodes, frame, 3, reverse=True).collect()}


def test_cypher(graph):
    rows = lambda text: [tuple(r) for r in cypher(graph, text).collect()]
    assert rows("MATCH (f:File) RETURN count(f)") == [(2,)] and rows("MATCH ()-[r:CALLS]->() RETURN count(r)") == [(5,)]
    assert rows("MATCH (n:Function) RETURN n.name, n.file LIMIT 2") and rows("MATCH (n:Function) WHERE n.file IS NULL RETURN count(*) AS n") == [(5,)]
    assert rows("MATCH (f:File) RETURN f.language, count(f) ORDER BY count(f) DESC, f.language") == [("Go", 1), ("Python", 1)]
    text = "MATCH (s) WHERE (s:Function OR s:Class OR s:Struct OR s:Interface OR s:Method OR s:Trait OR s:Enum) AND toLower(s.name) CONTAINS 'in' RETURN s.name, labels(s)[0], s.file_path, s.start_line ORDER BY s.name LIMIT 20"
    assert [r[:2] for r in rows(text)] == [("__init__", "Function"), ("__init__", "Method"), ("inner", "Function"), ("ping", "Function"), ("ping", "Method")]
    text = "MATCH (target:Function {name: 'inner'}) MATCH path = (caller:Function)-[:CALLS*1..3]->(target) RETURN caller.name, length(path) ORDER BY length(path), caller.name LIMIT 50"
    assert rows(text) == [("helper", 1), ("ping", 2), ("run", 2)]
    assert rows("MATCH (s:Function {name: 'ping'}) MATCH p = (s)-[:CALLS*1..3]->(c:Function) RETURN c.name AS callee, length(p) AS n ORDER BY n") == [("helper", 1), ("inner", 2)]
    assert rows("MATCH (c:Class)-[:INHERITS]->(p:Class) RETURN c.name, p.name") == [("Child", "Base")]
    assert rows("MATCH (p)<-[:INHERITS]-(c) WHERE NOT c:Class RETURN DISTINCT p.name, c.name") == [("Base", "Animal")]
    assert rows("MATCH (f:File {path: 'pkg/a.py'}) OPTIONAL MATCH (f)-[:CONTAINS]->(s:Method) RETURN f.path, count(s)") == [("pkg/a.py", 2)]
    assert rows("MATCH (f:File) OPTIONAL MATCH (f)-[i:IMPORTS]->(m:Module) RETURN f.path, m.name ORDER BY f.path, m.name") == [("main.go", None), ("pkg/a.py", "json"), ("pkg/a.py", "os")]
    assert rows("MATCH (a:Class)-[:CONTAINS]->(m) WHERE m.start_line >= 6 AND m.name <> 'x' AND m.name IN ['ping', 'q'] RETURN collect(DISTINCT labels(m)[0])") == [(["Function", "Method"],)]
    assert sorted(rows("MATCH (s:Function) WHERE s.name STARTS WITH 'h' OR s.name ENDS WITH 'er' RETURN toUpper(s.name), s.end_line - s.start_line + 1")) == [("HELPER", 4), ("INNER", 2)]
    assert rows("MATCH (s:Function) RETURN sum(s.start_line), avg(s.start_line), min(s.name), max(s.name), count(DISTINCT s.file_path)") == [(51, 10.2, "__init__", "run", 2)]
    assert rows("RETURN 1 + 2 * 3 AS x, 'a\\'b' AS s, [1, 2][1] AS i, CASE WHEN 1 < 2 THEN 'y' ELSE 'n' END AS c, 7 / 2 AS d, -7 % 4 AS m") == [(7, "a'b", 2, "y", 3, -3)]
    assert rows("MATCH (a:Function)-[:CALLS]-(b:Function {name: 'helper'}) RETURN a.name ORDER BY a.name DESC SKIP 1 LIMIT 2") == [("ping",), ("inner",)]
    assert rows("MATCH (a:Function {name: 'helper'}), (b:Class {name: 'Base'}) RETURN a.name, b.name") == [("helper", "Base")]
    assert rows("MATCH (a)-[r]->(b:Module {name: 'os'}) RETURN type(r), r.line, a.path") == [("IMPORTS", 1, "pkg/a.py")]
    (node,) = cypher(graph, "MATCH (m:Module {name: 'os'}) RETURN m").first()
    assert node.type == "node" and node.labels == ["Module"] and node.properties.is_external is True


def test_cypher_with_unwind_union_and_patterns(graph):
    rows = lambda text: [tuple(r) for r in cypher(graph, text).collect()]
    assert rows("MATCH (f:Function) WHERE NOT ()-[:CALLS]->(f) RETURN f.name ORDER BY f.name") == [("__init__",), ("ping",), ("run",)]
    assert rows("MATCH (f:Function) WHERE (f)-[:CALLS]->(:Function {name: 'helper'}) AND f.start_line < 8 RETURN f.name") == [("ping",)]
    assert rows("MATCH (f) WHERE exists((f)-[:CALLS]->()) AND exists(f.name) AND NOT f:Method RETURN f.name ORDER BY f.name") == [("helper",), ("ping",), ("run",)]
    assert rows("MATCH (a:Function), (b:Function) WHERE (a)-[:CALLS]->(b) RETURN a.name, b.name ORDER BY a.name") == [("helper", "inner"), ("ping", "helper"), ("run", "helper")]
    assert rows("MATCH (f:File)-[:CONTAINS]->(s) WITH f, count(s) AS n WHERE n > 3 MATCH (f)-[:IMPORTS]->(m) RETURN f.path, n, m.name ORDER BY m.name") == [("pkg/a.py", 8, "json"), ("pkg/a.py", 8, "os")]
    assert rows("MATCH (s:Function) WITH s.name AS name, s ORDER BY s.name DESC LIMIT 2 RETURN name, s.start_line ORDER BY name") == [("ping", 6), ("run", 8)]
    assert rows("MATCH (s) WITH DISTINCT s.language AS l WHERE l IS NOT NULL RETURN l ORDER BY l") == [("Go",), ("Python",)]
    assert rows("UNWIND [1, 2, 3] AS x WITH x * 2 AS y RETURN sum(y) AS s") == [(12,)]
    assert rows("MATCH (s:Function) WITH collect(s.name) AS names UNWIND names AS n RETURN n ORDER BY n LIMIT 2") == [("__init__",), ("helper",)]
    assert sorted(rows("MATCH (f:File) RETURN f.language AS l UNION MATCH (s:Symbol) RETURN s.name AS l UNION MATCH (s:Class) RETURN s.language AS l")) == [("Go",), ("Python",)]
    assert len(rows("MATCH (f:File) RETURN f.language AS l UNION ALL MATCH (s:Class) RETURN s.language")) == 4
    assert rows("MATCH (a)-[r:CALLS]->(b) WITH r, startNode(r) AS s WHERE s STARTS WITH 'Function|main' RETURN endNode(r), keys(r)") == [("Function|pkg/a.py:helper:13", ["call_site_line"])]
    assert rows("MATCH (m:Module {name: 'os'}) WITH * RETURN *")[0][0].labels == ["Module"]
    with pytest.raises(CypherError):
        cypher(graph, "MATCH (f:File) RETURN f.path UNION MATCH (f:File) RETURN f.path, f.language")
    with pytest.raises(CypherError):
        cypher(graph, "MATCH (f:File) WITH f.path RETURN 1")
    with pytest.raises(UnsupportedCypher):
        cypher(graph, "MATCH (f:File) WHERE (f)-[:CONTAINS]->(s) OR f.path = 'x' RETURN f")


def test_paths_without_a_bound(spark, graph):
    rows = lambda text: sorted(tuple(r) for r in cypher(chain, text).collect())
    nodes = [(f"Function|f{k}", "Function", f"f{k}", f"f{k}") for k in range(16)]
    symbols = spark.createDataFrame(nodes, "node_key string, label string, id string, name string")
    symbols = symbols.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in graph.symbols.schema if f.name not in symbols.columns])
    calls = spark.createDataFrame([(f"Function|f{k}", f"Function|f{(k + 1) % 15}", k) for k in range(15)], graph.calls.schema)
    chain = replace(graph, symbols=symbols, calls=calls)
    # A ring of 15: one trail of each length, and the longest leads back to its start.
    assert rows("MATCH (a:Function {name: 'f0'})-[r:CALLS*]->(b) RETURN b.name, size(r)") == sorted((f"f{k % 15}", k) for k in range(1, 16))
    assert len(rows("MATCH (a:Function {name: 'f0'})-[r:CALLS*13..]->(b) RETURN b.name")) == 3
    assert rows("MATCH (a:Function {name: 'f0'})-[:CALLS*0..]->(b:Function {name: 'f0'}) RETURN a.name") == [("f0",)] * 2
    assert rows("MATCH (a:Function {name: 'f15'})-[:CALLS*]->(b) RETURN b.name") == []
    assert len(rows("MATCH (a:Function)<-[:CALLS*]-(b) RETURN a.name, b.name")) == 225


def test_cypher_writes(spark, graph, tmp_path):
    store = Store(spark, str(tmp_path / "graphs"))
    store.write(graph)
    run = lambda text: [tuple(r) for r in execute(store, text).collect()]
    assert run("MATCH (f:Function {name: 'helper'}) RETURN count(*)") == [(1,)]
    edges = run("MATCH ()-[r:CALLS]->() RETURN count(r)")[0][0]
    # SET, REMOVE
    assert run("MATCH (f:Function {name: 'helper'}) SET f.docstring = 'doc of ' + f.name, f.start_line = 99 RETURN f.docstring, f.start_line") == [("doc of helper", 99)]
    assert run("MATCH (f) WHERE f.start_line = 99 RETURN f.name, f.docstring") == [("helper", "doc of helper")]
    assert run("MATCH (f:Function {name: 'helper'}) REMOVE f.docstring SET f += {visibility: 'odd'}") == []
    assert run("MATCH (f:Function {name: 'helper'}) RETURN f.docstring, f.visibility") == [(None, "odd")]
    assert run("MATCH (f:File) SET f.line_count = f.line_count + 1") == [] and run("MATCH (f:File) RETURN f.line_count ORDER BY f.path") == [(10,), (18,)]
    run("MATCH (a)-[r:CALLS]->(b) SET r.call_site_line = 7")
    assert run("MATCH ()-[r:CALLS]->() RETURN DISTINCT r.call_site_line") == [(7,)]
    # CREATE
    assert run("CREATE (n:Function {id: 'x:1', name: 'made'}) RETURN n.name, n.docstring, n.language") == [("made", "", None)]
    run("MATCH (n:Function {name: 'made'}), (h:Function {name: 'helper'}) CREATE (n)-[:CALLS {call_site_line: 3}]->(h), (m:Module {name: 'own', is_external: false})<-[:IMPORTS]-(h)")
    assert run("MATCH (n:Function {name: 'made'})-[r:CALLS]->(h)-[:IMPORTS]->(m) RETURN h.name, r.call_site_line, m.name, m.is_external") == [("helper", 3, "own", False)]
    run("UNWIND ['p', 'q', 'q'] AS x MERGE (m:Module {name: x}) ON CREATE SET m.is_external = true")
    assert run("MATCH (m:Module) WHERE m.name IN ['p', 'q'] RETURN m.name, m.is_external ORDER BY m.name") == [("p", True), ("q", True)]
    run("MATCH (f:File) FOREACH (x IN CASE WHEN f.language = 'Go' THEN ['g1', 'g2'] ELSE [] END | MERGE (m:Module {name: x}) MERGE (f)-[:IMPORTS]->(m))")
    assert run("MATCH (f:File)-[:IMPORTS]->(m:Module) WHERE m.name STARTS WITH 'g' RETURN f.path, m.name ORDER BY m.name") == [("main.go", "g1"), ("main.go", "g2")]
    # MERGE
    merge = "MATCH (n:Function {name: 'made'}) MERGE (m:Module {name: 'own'}) ON CREATE SET m.is_external = true ON MATCH SET n.docstring = 'met' MERGE (n)-[r:IMPORTS]->(m) ON CREATE SET r.line = 5 ON MATCH SET r.line = 6 RETURN n.docstring, m.is_external, r.line"
    assert [run(merge), run(merge)] == [[("met", False, 5)], [("met", False, 6)]]
    # DELETE
    run("MATCH (:Function {name: 'made'})-[r:CALLS]->() DELETE r")
    assert run("MATCH ()-[r:CALLS]->() RETURN count(r)") == [(edges,)]
    run("MATCH (n:Function {name: 'made'}) OPTIONAL MATCH (n)-[:CALLS]->(h) DETACH DELETE n, h")
    assert run("MATCH (n) WHERE n.name = 'made' RETURN n") == [] and run("MATCH ()-[r:IMPORTS]->(m:Module {name: 'own'}) RETURN count(r)") == [(1,)]
    before = store.current()
    for text in ("CREATE (n)", "CREATE (n:Widget {id: 'x'})", "CREATE (n:Function {name: 'x'})", "CREATE (m:Module {name: 'own'})", "MATCH (f:File) SET f.path = 'x'", "MATCH (f:File) SET f.nosuch = 1", "MATCH (f:File) SET f.signature = 'x'", "MATCH (f:File) SET f:Module", "MERGE (m:Module {name: 'z', is_external: true})", "MATCH (a:File), (b:Module) CREATE (a)-[:KNOWS]->(b)", "MATCH (n:File) DELETE n MATCH (m) RETURN m", "FOREACH (x IN [1] | CREATE (n))", "FOREACH (x IN ['a'] | MERGE (m:Module {name: x})) RETURN 1", "FOREACH (x IN ['a'] | RETURN x)", "DELETE n"):
        with pytest.raises(CypherError):
            execute(store, text)
    assert store.current() == before
    run("MATCH (n) DELETE n")
    assert all(df.count() == 0 for name, df in store.load().tables().items() if not name.startswith("raw_"))


def test_cypher_errors(graph):
    for text in ("MATCH (n) DELETE n", "CREATE (n:X)", "MERGE (f:File {path: 'x'})", "MATCH (n) SET n.a = 1 RETURN n", "MATCH (n:File) RETURN nosuch(n.path)"):
        with pytest.raises(UnsupportedCypher):
            cypher(graph, text)
    for text in ("", "MATCH (n RETURN n", "MATCH (n) RETURN", "MATCH (n) RETURN m.x", "MATCH (n) RETURN n LIMIT x", "§"):
        with pytest.raises(CypherError):
            cypher(graph, text)


# --- index, update, store, commands -------------------------------------------------------


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    git(root, "init", "-q")
    write(root, FILES | {"node_modules/x.js": "function no() {}", "build/y.py": "def no(): pass", ".hidden/z.py": "def no(): pass", "ignored.py": "def no(): pass", ".gitignore": "ignored.py\n", "notes.txt": "x"})
    commit(root)
    return root


def test_crawl(spark, repo, tmp_path):
    assert paths.list_paths(str(repo)) == ["main.go", "pkg/a.py"] and paths.list_paths(str(repo), ["Go"]) == ["main.go"]
    assert paths.list_paths(str(repo), compat=True) == ["build/y.py", "main.go", "node_modules/x.js", "pkg/a.py"]
    plain = tmp_path / "plain"
    write(plain, {"a.PY": "x", "b.cjs": "", "c.jsx": "", "sub/d.hpp": "", "sub/.gitignore": "e*\n!eb.ts\n/only/\n", "sub/ea.ts": "", "sub/eb.ts": "", "sub/only/f.go": "", "vendor/g.go": "", "sub/k/target/h.rs": ""})
    assert paths.list_paths(str(plain)) == ["a.PY", "b.cjs", "sub/d.hpp", "sub/eb.ts"]
    rows = paths.count_by_language(paths.crawl(spark, str(plain))).collect()
    assert {r.language: r["count"] for r in rows} == {"Python": 1, "JavaScript": 1, "C++": 1, "TypeScript": 1}
    assert paths.crawl(spark, f"file://{plain}").count() == 4
    with pytest.raises(paths.NotADirectory):
        paths.crawl(spark, str(tmp_path / "none"))


def test_other_stores_are_crawled_and_read_alike(spark, tmp_path, monkeypatch):
    plain = tmp_path / "plain"
    found = {"a.PY": "x", "pkg/__init__.py": "y = 1", "pkg/_own/_a.py": "z", "pkg/_own/b.py": "w", "pkg/_k=v.py": "", "o [1]{2},*?/p q.go": "package p", "n=1/m.rs": "", "sub/.gitignore": "e*\n", "deep/er/é.ts": "é"}
    write(plain, found | {"sub/ea.ts": "no", "node_modules/x.js": "no", ".h/z.py": "no", "pkg/b.txt": "no"})
    want = sorted((p, content.encode()) for p, content in found.items() if p != "sub/.gitignore")
    contents_of = lambda root: sorted((r.path, bytes(r.content)) for r in paths.read(paths.crawl(spark, root), root).collect())
    assert contents_of(str(plain)) == want
    monkeypatch.setattr(paths, "local_root", lambda root: None)
    monkeypatch.setattr(paths, "BLOCK_BYTES", 8)
    assert contents_of(f"file://{plain}") == want
    assert paths.crawl(spark, f"file://{plain}", ["Go", "Rust"]).count() == 2
    assert paths.crawl(spark, f"file://{plain}", compat=True).count() == len(want) + 1
    assert contents_of(f"file://{plain}/pkg/_own") == [("_a.py", b"z"), ("b.py", b"w")]
    (tmp_path / "empty").mkdir()
    assert contents_of(f"file://{tmp_path}/empty") == []
    with pytest.raises(paths.NotADirectory):
        paths.crawl(spark, f"file://{tmp_path}/none")


def test_index_and_update_equal_indexing_anew(spark, repo, tmp_path):
    store = Store(spark, str(tmp_path / "graphs"), "g")
    assert store.current() is None and store.load().symbols.count() == 0
    with pytest.raises(git_source.InvalidReference, match="No previous index"):
        index.update(spark, str(repo), store)
    stats = index.full_index(spark, str(repo), store)
    assert (stats.files_discovered, stats.files_parsed, stats.files_failed, stats.symbols_written) == (2, 2, 0, 11)
    assert store.get_metadata(LAST_COMMIT) == git(repo, "rev-parse", "HEAD")
    once = contents(store.load())
    index.full_index(spark, str(repo), store)
    assert contents(store.load()) == once

    def check(change, expected):
        change()
        dry = index.update(spark, str(repo), store, dry_run=True)
        before = store.current()
        assert sorted((p, k) for p, _, k in dry.changes) == expected and store.current() == before
        got = index.update(spark, str(repo), store)
        assert got.files_discovered == len(expected)
        other = Store(spark, str(tmp_path / "graphs"), "fresh")
        index.full_index(spark, str(repo), other)
        assert contents(store.load()) == contents(other.load())
        store.set_metadata(LAST_COMMIT, commit(repo))

    check(lambda: None, [])
    check(lambda: write(repo, {"pkg/a.py": "# shifted\n" + FILES["pkg/a.py"], "new/deep/n.rs": "fn helper() { inner() }\n", "new/u.md": ""}), [("new/deep/n.rs", "Added"), ("pkg/a.py", "Modified")])

    def move():
        os.remove(repo / "main.go")
        os.rename(repo / "pkg/a.py", repo / "pkg/b.py")

    check(move, [("main.go", "Deleted"), ("pkg/a.py", "Deleted"), ("pkg/b.py", "Added")])


def test_update_skips_what_is_stored(spark, repo, tmp_path):
    store = Store(spark, str(tmp_path / "graphs"))
    first = git(repo, "rev-parse", "HEAD")
    write(repo, {"new.py": "def n(): pass\n"})
    index.full_index(spark, str(repo), store)
    stats = index.update(spark, str(repo), store, since=first)
    assert (stats.files_discovered, stats.files_skipped, stats.files_parsed) == (1, 1, 0)


def test_paths_are_relative_to_the_repository(spark, repo, tmp_path):
    store = Store(spark, str(tmp_path / "graphs"))
    index.full_index(spark, str(repo / "pkg"), store)
    assert [r.path for r in store.load().files.collect()] == ["pkg/a.py"]
    write(repo, {"pkg/a.py": "def only(): pass\n"})
    index.update(spark, str(repo / "pkg"), store)
    assert [r.name for r in store.load().symbols.collect()] == ["only"]
    index.full_index(spark, str(repo / "pkg"), store, compat=True)
    assert [r.path for r in store.load().files.collect()] == ["a.py"]


def test_no_clear_delete_and_metadata(spark, repo, tmp_path):
    store = Store(spark, str(tmp_path / "graphs"))
    index.full_index(spark, str(repo), store, languages=["Go"])
    index.full_index(spark, str(repo), store, languages=["Python"], clear=False)
    assert sorted(r.path for r in store.load().files.collect()) == ["main.go", "pkg/a.py"]
    store.set_metadata("k", "one")
    store.set_metadata("k", "two")
    assert store.get_metadata("k") == "two" and store.get_metadata("none") is None
    index.delete_file(store, "pkg/a.py")
    g = store.load()
    assert {r.file_path for r in g.symbols.collect()} == {"main.go"} and g.calls.count() == 0 and g.modules.count() == 2
    folders = lambda: [x for x in os.listdir(store.path) if not x.startswith(".") and x != "CURRENT"]
    before = folders()
    store.vacuum()  # all are of today
    assert folders() == before
    store.vacuum(older_than=0)
    assert len(folders()) == 1
    store.clear()
    assert store.load().files.count() == 0 and store.get_metadata("k") is None and store.name == "codeloom"


def test_partitions_are_pruned(spark, repo, tmp_path):
    store = Store(spark, str(tmp_path / "graphs"))
    index.full_index(spark, str(repo), store)
    plan = search.find(store.load().symbols, "*", "method")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(label" in plan and "docstring" not in plan


def test_git(spark, repo):
    r = git_source.Repository(str(repo / "pkg"))
    assert os.path.samefile(r.root, repo)
    first = r.head()
    write(repo, {"pkg/a.py": "x = 1\n", "été.py": "", "d/e/f.py": ""})
    assert sorted(r.since(first)) == [("d/e/f.py", None, "Added"), ("pkg/a.py", None, "Modified"), ("été.py", None, "Added")]
    assert ("d/e/f.py", None, "Added") not in r.since(first, compat=True)
    assert sorted(r.uncommitted()) == [("d/e/f.py", None, "Added"), ("pkg/a.py", None, "Modified"), ("été.py", None, "Added")]
    assert r.is_tracked("pkg/a.py") and r.is_tracked("été.py") and not r.is_tracked("ignored.py") and not r.is_tracked("none.py")
    git(repo, "rm", "-q", "--cached", "main.go")
    os.remove(repo / "main.go")
    second = commit(repo)
    assert sorted(r.between(first, second)) == [("d/e/f.py", None, "Added"), ("main.go", None, "Deleted"), ("pkg/a.py", None, "Modified"), ("été.py", None, "Added")]
    assert git_source.with_extensions([("a.py", None, "Added"), ("b.PY", None, "Added"), ("c", None, "Added")], ["py"]) == [("a.py", None, "Added")]
    rows = git_source.supported(git_source.frame(spark, [("a.PY", None, "Added"), ("b.txt", None, "Added"), ("c.go", None, "Added")]), ["Python"])
    assert [x.path for x in rows.collect()] == ["a.PY"]
    with pytest.raises(git_source.InvalidReference):
        r.since("nosuch")
    with pytest.raises(git_source.NotARepository):
        git_source.Repository("/")


def test_snapshot_diff_and_renames(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", None)], "path string, hash string")
    new = spark.createDataFrame([("b", "3"), ("c", None), ("d", "4"), ("e", "5")], "path string, hash string")
    assert sorted((r.path, r.kind) for r in git_source.snapshot_diff(old, new).collect()) == [("a", "Deleted"), ("b", "Modified"), ("d", "Added"), ("e", "Modified")]
    gone, wanted = git_source.split_changes(git_source.frame(spark, [("n", "o", "Renamed"), ("d", None, "Deleted"), ("m", None, "Modified")]))
    assert sorted(r.path for r in gone.collect()) == ["d", "m", "n", "o"] and sorted(r.path for r in wanted.collect()) == ["m", "n"]


def test_commands(spark, repo, tmp_path, capsys):
    run = lambda *a: cli.main(["--store", str(tmp_path / "graphs"), *a])
    stop = spark.stop
    assert run("index", str(repo)) == 0
    assert "Files parsed:     2" in capsys.readouterr().out
    assert run("status", "--files") == 0
    out = capsys.readouterr().out
    assert "  Functions: 5" in out and "Total: 2 files" in out and f"Last indexed commit: {git(repo, 'rev-parse', 'HEAD')}" in out and "  Python       1" in out
    assert run("find", "*IN*", "--limit", "2") == 0
    out = capsys.readouterr().out
    assert out.splitlines()[2].startswith("__init__                       Function     pkg/a.py") and "Found 2 symbol(s)." in out
    assert run("find", "zzz") == 0 and "No symbols found matching 'zzz'" in capsys.readouterr().out
    assert run("calls", "inner") == 0
    out = capsys.readouterr().out
    assert "=== Callers (functions that call inner) ===" in out and "  ping " in out and "No callees found for 'inner'" in out
    assert run("query", "MATCH (f:File) RETURN f.path, f.line_count ORDER BY f.path", "--format", "json") == 0
    assert json.loads(capsys.readouterr().out) == [["main.go", 9], ["pkg/a.py", 17]]
    assert run("query", "MATCH (m:Module) RETURN m ORDER BY m.name") == 0
    assert '"labels": ["Module"]' in capsys.readouterr().out
    assert run("update", str(repo), "--dry-run") == 0 and "Dry run" in capsys.readouterr().out
    for bad in (["find", "x", "-k", "widget"], ["index", str(repo), "-l", "cobol"], ["query", "CREATE (n)"], ["update", str(tmp_path)], ["index", str(tmp_path / "none")]):
        assert run(*bad) == 1 and "Error:" in capsys.readouterr().err
    assert spark.stop == stop


def test_stream(spark, tmp_path):
    from codeloom.streaming import updates

    store, source = Store(spark, str(tmp_path / "graphs")), str(tmp_path / "in")
    rows = lambda *r: spark.createDataFrame(list(r), updates.SCHEMA).coalesce(1).write.mode("append").parquet(source)
    go = lambda: updates.follow(spark.readStream.schema(updates.SCHEMA).parquet(source), store, str(tmp_path / "check")).awaitTermination(120)
    rows(("pkg/a.py", bytearray(b"old"), 1), ("pkg/a.py", bytearray(FILES["pkg/a.py"].encode()), 2), ("main.go", bytearray(b"package x"), 3), ("x.txt", bytearray(b""), 4))
    go()
    rows(("main.go", bytearray(FILES["main.go"].encode()), 5), ("gone.rs", bytearray(b"fn a() {}"), 6))
    go()
    rows(("gone.rs", None, 7))
    go()
    want, _ = graph_of(spark, FILES)
    assert contents(store.load()) == contents(want)


def test_names(spark):
    assert [names.language_of(p) for p in ("a.py", "a.rs", "a.js", "a.ts", "a.go", "a.cpp", "a.txt", "d.py/x", "A.H", ".py")] == ["Python", "Rust", "JavaScript", "TypeScript", "Go", "C++", None, None, "C++", None]
    assert names.parse_languages("rs, py") == ["Rust", "Python"] and names.parse_languages(None) is None and names.parse_language("C++") == "C++"
    with pytest.raises(names.UnknownName, match="Unknown language: zz"):
        names.parse_languages("rs,zz")
    got = spark.createDataFrame([("x/a.PY",), ("b.c++",), ("no",), (".py",)], "p string").select(names.language_column(F.col("p")).alias("l")).collect()
    assert [r.l for r in got] == ["Python", "C++", None, None]
