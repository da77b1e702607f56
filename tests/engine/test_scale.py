"""What grows faster than the input: plans and numbers of passes, on small tables."""

import sys

import pytest

from codeloom.operators import build, resolve
from codeloom.operators.extract import lexer, registry
from codeloom.plans import sources
from codeloom.sources.store import Store

_NODES = "node_key string, label string, id string, name string, file_path string"


def _nodes(spark):
    return spark.createDataFrame(
        [("Function|a", "Function", "a", "f", "p1"), ("Method|a", "Method", "a", "f", "p1"), ("Function|b", "Function", "b", "g", "p2"), ("Function|c", "Function", "c", "g", "p3"), ("Class|d", "Class", "d", "g", "p2")], _NODES
    )


def _joins_last(df) -> bool:
    """Whether the last thing done is a join, with no aggregate over its rows."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return 0 <= plan.find("Join") < plan.find("Aggregate")


def test_records_are_distinct_before_names_are_expanded(spark):
    records = spark.createDataFrame([("a", "g", 4, "p1", 0, 0), ("a", "g", 7, "p2", 0, 1), ("b", "f", 1, "p2", 0, 0)], "caller_id string, callee_name string, call_site_line int, file_path string, symbol_ord int, ord int")
    edges = resolve.call_edges(records, _nodes(spark))
    both = sorted((s, f"Function|{d}", 7) for s in ("Function|a", "Method|a") for d in "bc")
    assert sorted(map(tuple, edges.collect())) == sorted([*both, ("Function|b", "Function|a", 1)]) and _joins_last(edges)
    some = resolve.call_edges(records, _nodes(spark), sequential=True)
    assert sorted(map(tuple, some.collect())) == sorted([(s, "Function|b", 7) for s in ("Function|a", "Method|a")] + [("Function|b", "Function|a", 1)])
    inherits = resolve.inherit_edges(records.withColumnsRenamed({"caller_id": "child_id", "callee_name": "parent_name"}), _nodes(spark))
    assert sorted(map(tuple, inherits.collect())) == [("Function|a", "Class|d"), ("Method|a", "Class|d")] and _joins_last(inherits)


SF = "/root/testdata/sf0.001"


def test_parts_are_dealt_to_all_cores(spark):
    for languages in ((), ("C++",)):
        files = sources.sources(spark, SF, *languages)
        assert files.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
        assert files.count() == spark.read.parquet(f"{SF}/part.parquet").count() * (len(languages) or 6)


@pytest.mark.parametrize("name", ["graph_symbols", "graph_contains", "graph_calls", "graph_inherits", "update_deletes_files", "update_replaces_files"])
def test_files_are_extracted_once(spark, name):
    plan = sources.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_names_are_resolved_without_the_driver(spark):
    graph = build.derive(build.raw_tables(registry.extract(sources.sources(spark, SF))))
    for table in ("symbols", "contains", "calls", "inherits"):
        assert "BroadcastHashJoin" not in getattr(graph, table)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("language", [x for x in sources.TEMPLATES if x != "Python"])
def test_words_are_looked_up_by_place(language):
    """Each clause looks at the tokens with its words, not at all of them."""
    text = "".join(sources.TEMPLATES[language][1].replace("{k}", str(k)) for k in range(20))
    typed = "script" if language in ("JavaScript", "TypeScript") else {"C++": "cpp"}.get(language, language.lower())
    seen = 0

    def count(frame, event, _):
        nonlocal seen
        seen += event == "call" and frame.f_code is lexer.Code.is_.__code__

    sys.setprofile(count)
    try:
        registry.EXTRACTORS[language](text, False)
    finally:
        sys.setprofile(None)
    assert seen < 5 * len(lexer.Code(text, typed).tokens)


def test_only_symbols_without_a_parent_are_shuffled(spark):
    schema = "file_path string, language string, ord int, id string, name string, kind string, signature string, parent_id string, parent_name string"
    rows = [("p", "Rust", 0, "s", "S", "Struct", "x", None, None), ("p", "Rust", 1, "m", "f", "Method", "x", None, "S"), ("p", "Rust", 2, "n", "g", "Method", "x", None, "T"), ("p", "C++", 3, "o", "h", "Method", "x", "s", "S"), ("p", "Go", 4, "q", "E", "Enum", "x", None, None), ("q", "Go", 0, "r", "k", "Method", "x", None, "E")]
    got = resolve.parents(spark.createDataFrame(rows, schema))
    assert {r.id: r.parent_id for r in got.collect()} == {"s": None, "m": "s", "n": None, "o": "s", "q": None, "r": None}
    assert got._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("Union")


@pytest.mark.parametrize("language", [x for x in sources.TEMPLATES if x != "Python"])
def test_plain_texts_are_cut_in_one_go(language, monkeypatch):
    """No match object for each token, and the same tokens as those of the scan."""
    typed = "script" if language in ("JavaScript", "TypeScript") else {"C++": "cpp"}.get(language, language.lower())
    texts = [sources.TEMPLATES[language][1], "a 'b' \"c\\\"d\n // e\n/* f\n */ \x1c#x 1.5 ..<", "  #define A \\\n 1\n#if u8\"s\" L'c' 'a b'\n'", ""]
    hard = lexer._HARD[typed]
    wanted = []
    for text in texts:
        code = lexer.Code.__new__(lexer.Code)
        code.text, code.tokens, code.comments, code.directives = text, [], [], []
        code._scan(0, len(text), typed, False)
        wanted.append((code.tokens, code.comments, code.directives))
    monkeypatch.setattr(lexer.Code, "_scan", None)
    for text, want in zip(texts, wanted, strict=True):
        if not (hard and hard(text)):
            code = lexer.Code(text, typed)
            assert (code.tokens, code.comments, code.directives) == want


def test_statistics_take_numbers_only(spark):
    files = sources.sources(spark, SF).unionByName(spark.createDataFrame([("x", "Cobol", b"x"), ("y", "Go", None)], "path string, language string, content binary"))
    counted = registry.counts(files)
    assert "array" not in counted.schema.simpleString()
    assert build.statistics(counted).collect() == build.statistics(registry.extract(files)).collect()
    plan = sources.QUERIES["index_statistics"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "content_hash" not in plan


def test_records_that_are_not_wanted_are_not_sent(spark):
    some, every = registry.extract(sources.sources(spark, SF, "Go"), columns=("calls",)), registry.extract(sources.sources(spark, SF, "Go"))
    assert some.columns == ["path", "language", "content_hash", "line_count", "error", "calls"]
    assert sorted(map(repr, some.collect())) == sorted(map(repr, every.select(*some.columns).collect()))


def test_nodes_are_sorted_once(spark):
    schema = "file_path string, language string, ord int, id string, name string, kind string, start_line int, end_line int, signature string, visibility string, is_async boolean, docstring string, parent_id string, parent_name string"
    row = lambda path, k, end: (path, "Go", k, "p:f:1", "f", "Function", 1, end, None, "public", False, None, None, None)
    rows = [row("p", 0, 5), row("p", 2, 7), row("p", 1, 9), row("o", 4, 3)]
    got = resolve.nodes(spark.createDataFrame(rows, schema))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Sort [") == 1
    assert [r.end_line for r in got.collect()] == [7]
    few = resolve.nodes(spark.createDataFrame(rows, schema), {"node_key", "end_line"})
    assert set(few.columns) == {"node_key", "file_path", "end_line"} and few.first().end_line == 7


@pytest.mark.parametrize("name", ["cypher_unbounded", "cypher_set", "cypher_delete", "cypher_merge"])
def test_tables_that_nobody_reads_are_not_written(spark, name, monkeypatch):
    def refuse(*_):
        raise AssertionError("the whole graph is written")

    monkeypatch.setattr(Store, "_write", refuse)
    assert sources.QUERIES[name](spark, SF).count() > 0
