"""The engine's operators over tables that hold no source code.

Parts stand for symbols, their kinds and brands for labels and files; order lines for calls from
one part to another; documents for files; pages for files with imports.  Each query runs an
operator of this package over whole tables; the SQL beside it says the same for another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import build, resolve, search, traverse, upsert
from ..sources import git, paths
from .cypher import cypher

LABEL_OF = {"STANDARD": "Function", "LARGE": "Class", "MEDIUM": "Struct", "ECONOMY": "Method", "PROMO": "Trait", "SMALL": "Enum"}
#: The part whose callers and callees are followed, and how far.
TARGET, DEPTH = 5, 3

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- views --------------------------------------------------------------------------------

_SYM = (
    "sym AS (SELECT p_partkey, CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_OF.items()) + " END AS label, "
    "'part:' || p_partkey AS id, p_name AS name, 'src/' || p_brand || '.x' AS file_path, p_size AS start_line, p_size + 10 AS end_line, "
    "CASE p_partkey % 6 WHEN 0 THEN 'Python' WHEN 1 THEN 'Rust' WHEN 2 THEN 'JavaScript' WHEN 3 THEN 'TypeScript' WHEN 4 THEN 'Go' ELSE 'C++' END AS language FROM part), "
    "nodes AS (SELECT *, label || '|' || id AS node_key FROM sym)"
)


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in the shape of symbol nodes."""
    label = F.create_map(*[F.lit(x) for kv in LABEL_OF.items() for x in kv])[F.col("p_type")]
    language = F.element_at(F.array(*map(F.lit, names.LANGUAGES)), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = _t(spark, sf, "part").select(label.alias("label"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.concat(F.lit("src/"), "p_brand", F.lit(".x")).alias("file_path"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"), language.alias("language"))
    return rows.select(names.node_key(F.col("label"), F.col("id")).alias("node_key"), "*")


_PAIRS = "pairs AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem)"
_EDGES = f"{_PAIRS}, edges AS (SELECT x.node_key AS src_key, y.node_key AS dst_key FROM pairs JOIN nodes x ON x.p_partkey = a JOIN nodes y ON y.p_partkey = b)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _symbols(spark, sf).select("node_key", F.split_part("id", F.lit(":"), F.lit(2)).cast("long").alias("p"))
    src, dst = nodes.select(F.col("p").alias("src"), F.col("node_key").alias("src_key")), nodes.select(F.col("p").alias("dst"), F.col("node_key").alias("dst_key"))
    return _pairs(spark, sf).join(src, "src").join(dst, "dst").select("src_key", "dst_key")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("lang").alias("language"), text.content_hash(F.col("text")).alias("hash"), text.line_count(F.col("text")).alias("line_count"))


_FILES = "files AS (SELECT 'doc/' || doc_id AS path, lang AS language, sha256(text) AS hash, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS line_count FROM documents)"


def _raw_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Links of pages as import records."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    rows = _t(spark, sf, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("file_path"), F.posexplode(links).alias("ord", "target"))
    return rows.select("file_path", "ord", "target", F.lit(None).cast("string").alias("alias"), F.array(F.col("target")).alias("items"), (F.col("ord") + 1).alias("line"))


_IMPORTS = """raw AS (SELECT 'page/' || page_id AS file_path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target,
  unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS ord FROM pages)"""

# --- search -------------------------------------------------------------------------------


def _find_sql(condition: str, limit: int = search.FIND_LIMIT) -> str:
    return f"WITH {_SYM} SELECT name, label AS kind, file_path, start_line FROM nodes WHERE {condition} ORDER BY name, file_path, start_line, kind LIMIT {limit}"


@query(_find_sql("contains(lower(name), 'widget')"))
def find_contains(spark, sf):
    return search.find(_symbols(spark, sf), "*Widget*")


@query(_find_sql("starts_with(lower(name), 'red')", 500))
def find_prefix(spark, sf):
    return search.find(_symbols(spark, sf), "RED*", limit=500)


@query(_find_sql("ends_with(lower(name), 'ring')", 500))
def find_suffix(spark, sf):
    return search.find(_symbols(spark, sf), "*ring", limit=500)


@query(_find_sql("lower(name) = 'small ring'", 500))
def find_exact(spark, sf):
    return search.find(_symbols(spark, sf), "Small Ring", limit=500)


@query(_find_sql("true", 100))
def find_all(spark, sf):
    return search.find(_symbols(spark, sf), "**", limit=100)


@query(_find_sql("label = 'Method' AND language = 'Rust' AND ends_with(lower(name), 'widget')", 500))
def find_kind_language(spark, sf):
    return search.find(_symbols(spark, sf), "*widget", "method", "rs", 500)


@query(f"WITH {_SYM}, hits AS (SELECT name, label AS kind, file_path, start_line FROM nodes WHERE contains(lower(name), 'e') ORDER BY name, file_path, start_line, kind LIMIT 50) SELECT rpad(name, 30, ' ') || ' ' || rpad(kind, 12, ' ') || ' ' || rpad(file_path, 40, ' ') || ' ' || rpad(CAST(start_line AS VARCHAR), 6, ' ') AS line FROM hits")
def find_rendered(spark, sf):
    return search.rendered_find(search.find(_symbols(spark, sf), "*e*", limit=50))


# --- counts and upserts -------------------------------------------------------------------


@query(f"WITH {_SYM}, {_EDGES}, {_FILES}, {_IMPORTS} SELECT (SELECT count(*) FROM files) AS files, count(*) FILTER (label = 'Function') AS functions, count(*) FILTER (label = 'Class') AS classes, count(*) FILTER (label = 'Struct') AS structs, (SELECT count(*) FROM edges) AS calls, (SELECT count(*) FROM (SELECT DISTINCT file_path, target FROM raw)) AS imports FROM nodes")
def status_counts(spark, sf):
    return search.status(_files(spark, sf), _symbols(spark, sf), _calls(spark, sf), resolve.import_edges(_raw_imports(spark, sf)))


@query(f'WITH {_FILES} SELECT language, count(*) AS "count" FROM files GROUP BY language ORDER BY count(*) DESC, language')
def files_by_language(spark, sf):
    return search.files_by_language(_files(spark, sf))


@query('SELECT source AS language, count(*) AS "count" FROM documents GROUP BY source')
def count_by_language(spark, sf):
    return paths.count_by_language(_t(spark, sf, "documents").withColumnRenamed("lang", "l").withColumnRenamed("source", "language"))


@query(f"WITH {_FILES} SELECT path, language, line_count FROM files ORDER BY path")
def file_list(spark, sf):
    return search.file_list(_files(spark, sf))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(props, event_id) AS props, max(event_id) AS event_id FROM events GROUP BY user_id")
def merge_last_wins(spark, sf):
    return upsert.last_wins(_t(spark, sf, "events").select("user_id", "event_type", "props", "event_id"), ["user_id"], ["event_id"])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1 - c_custkey, 'NEW' FROM customer WHERE c_acctbal < 0")
def upsert_nodes(spark, sf):
    customers = _t(spark, sf, "customer")
    changed = customers.where("c_acctbal < 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"))
    new = changed.unionByName(changed.withColumn("c_custkey", -1 - F.col("c_custkey")))
    return upsert.upsert(customers.select("c_custkey", "c_mktsegment"), new, ["c_custkey"])


@query("SELECT DISTINCT l_orderkey AS src_key, l_suppkey AS dst_key FROM lineitem")
def distinct_edges(spark, sf):
    return upsert.distinct_edges(_t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src_key"), F.col("l_suppkey").alias("dst_key")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def delete_file(spark, sf):
    gone = _t(spark, sf, "customer").where("c_nationkey = 3")
    return upsert.without(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey")


@query("SELECT event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY 1")
def metadata_set(spark, sf):
    rows = _t(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), "event_id")
    return upsert.last_wins(rows, ["key"], ["event_id"]).drop("event_id")


# --- scalars ------------------------------------------------------------------------------


@query(f"WITH {_FILES} SELECT path, hash, line_count, path || ':' || language || ':' || line_count AS id FROM files")
def file_scalars(spark, sf):
    return _files(spark, sf).select("path", "hash", "line_count", names.symbol_id(F.col("path"), F.col("language"), F.col("line_count")).alias("id"))


@query("SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 37) || '...' END AS cut, substr(text, 1, 3) AS short FROM documents")
def render_truncate(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.truncate(F.col("text"), 40).alias("cut"), text.truncate(F.col("text"), 3).alias("short"))


@query("SELECT page_id, CASE WHEN contains(html, '{') THEN trim(split_part(html, '{', 1), ' ') ELSE split_part(html, chr(10), 1) END AS signature FROM pages")
def signature_to_brace(spark, sf):
    return _t(spark, sf, "pages").select("page_id", text.signature_to_brace(F.col("html")).alias("signature"))


@query("SELECT doc_id, regexp_replace(regexp_replace(split_part(text, chr(10), 1), '\\r$', ''), '[.]+$', '') AS head FROM (SELECT doc_id, replace(text, ':', '.') AS text FROM documents)")
def signature_of_block(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.signature_of_block(F.replace("text", F.lit("."), F.lit(":"))).alias("head")).withColumn("head", F.replace("head", F.lit(":"), F.lit(".")))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace('/////! ' || text, '^(///)+', ''), '^(//!)+', ''), ' ') AS doc FROM documents")
def trim_doc(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.trim_doc(F.concat(F.lit("/////! "), "text")).alias("doc"))


_NAME_OF_CONV = "CASE conv_id % 4 WHEN 0 THEN '__' WHEN 1 THEN '_' ELSE '' END || role || CASE WHEN turn % 2 = 0 THEN '__' ELSE '' END"


@query(f"SELECT conv_id, turn, {_NAME_OF_CONV} AS name, CASE WHEN starts_with({_NAME_OF_CONV}, '__') AND NOT ends_with({_NAME_OF_CONV}, '__') THEN 'private' WHEN starts_with({_NAME_OF_CONV}, '_') THEN 'protected' ELSE 'public' END AS visibility FROM conversations")
def visibility_rules(spark, sf):
    before = F.when(F.col("conv_id") % 4 == 0, "__").when(F.col("conv_id") % 4 == 1, "_").otherwise("")
    name = F.concat(before, "role", F.when(F.col("turn") % 2 == 0, "__").otherwise(""))
    return _t(spark, sf, "conversations").select("conv_id", "turn", name.alias("name"), text.python_visibility(name).alias("visibility"))


@query("SELECT doc_id, CASE WHEN upper(substr(text, 1, 1)) = substr(text, 1, 1) AND lower(substr(text, 1, 1)) <> substr(text, 1, 1) THEN 'public' ELSE 'private' END AS visibility FROM documents")
def visibility_by_case(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.case_visibility(F.col("text")).alias("visibility"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS access FROM conversations")
def access_specifier_running(spark, sf):
    from pyspark.sql import Window

    running = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(running).alias("access"))


@query("""SELECT n_nationkey, '["' || n_name || '","x"]' AS items, '{"type":"node","labels":["' || n_name || '"],"line":' || n_regionkey || '}' AS node FROM nation""")
def json_rows(spark, sf):
    node = F.struct(F.lit("node").alias("type"), F.array("n_name").alias("labels"), F.col("n_regionkey").alias("line"))
    return _t(spark, sf, "nation").select("n_nationkey", text.items_json(F.array("n_name", F.lit("x"))).alias("items"), F.to_json(node).alias("node"))


_EXT = "CASE doc_id % 8 WHEN 0 THEN 'py' WHEN 1 THEN 'RS' WHEN 2 THEN 'mjs' WHEN 3 THEN 'tsx' WHEN 4 THEN 'go' WHEN 5 THEN 'h' WHEN 6 THEN 'txt' ELSE 'c++' END"


@query(f"SELECT source || '/f' || doc_id || '.' || {_EXT} AS path, CASE doc_id % 8 WHEN 0 THEN 'Python' WHEN 1 THEN 'Rust' WHEN 2 THEN 'JavaScript' WHEN 3 THEN 'TypeScript' WHEN 4 THEN 'Go' WHEN 5 THEN 'C++' WHEN 7 THEN 'C++' END AS language, CASE doc_id % 8 WHEN 1 THEN 'rs' ELSE {_EXT} END AS ext FROM documents")
def language_detection(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, ("py", "RS", "mjs", "tsx", "go", "h", "txt", "c++"))), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return _t(spark, sf, "documents").select(path.alias("path"), names.language_column(path).alias("language"), names.extension_column(path).alias("ext"))


@query("SELECT doc_id, CASE source WHEN 'src1' THEN 'b/' || doc_id ELSE 'a/' || source || '/' || doc_id END AS path, substr(sha256(text), 1, 12) AS commit FROM documents")
def relative_paths(spark, sf):
    full = F.concat(F.lit("/r/"), F.when(F.col("source") == "src1", "b/").otherwise(F.concat(F.lit("a/"), "source", F.lit("/"))), F.col("doc_id").cast("string"))
    return _t(spark, sf, "documents").select("doc_id", text.relative_path(full, "/r").alias("path"), text.short_commit(F.sha2("text", 256)).alias("commit"))


# --- joins --------------------------------------------------------------------------------


def _sites(spark, sf):
    """Order lines as call sites within the customer's file, by the day of shipping."""
    orders = _t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("file_path"))
    lines = _t(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ord"), F.col("l_partkey").cast("string").alias("callee_name"), F.datediff("l_shipdate", F.lit("1990-01-01")).alias("line"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("file_path", "ord", "callee_name", "line")


@query("""WITH f AS (SELECT CAST(o_custkey AS VARCHAR) AS file_path, CAST(o_orderkey AS VARCHAR) AS caller_id, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS a FROM orders),
s AS (SELECT CAST(o_custkey AS VARCHAR) AS file_path, CAST(l_linenumber AS INTEGER) AS ord, CAST(l_partkey AS VARCHAR) AS callee_name, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT f.file_path, caller_id, s.ord, callee_name, CAST(line AS INTEGER) AS call_site_line FROM f JOIN s ON f.file_path = s.file_path AND line BETWEEN a AND a + 30""")
def call_containment(spark, sf):
    first = F.datediff("o_orderdate", F.lit("1990-01-01"))
    symbols = _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("file_path"), F.lit(0).alias("ord"), F.col("o_orderkey").cast("string").alias("id"), F.lit("Function").alias("kind"), first.alias("start_line"), (first + 30).alias("end_line"))
    return resolve.enclosing(_sites(spark, sf), symbols).drop("symbol_ord")


# Names with their size are told apart by more, so a name has few definitions.
_SIZED = "sized AS (SELECT node_key, label, id, file_path, name || ' ' || start_line AS name FROM nodes)"
_RECORDS = "rec AS (SELECT 'part:' || l_partkey AS caller_id, s.p_name || ' ' || s.p_size AS callee_name, l_linenumber AS line, 'src/' || q.p_brand || '.x' AS file_path, l_orderkey AS o, l_linenumber AS n FROM lineitem JOIN part s ON s.p_partkey = l_suppkey JOIN part q ON q.p_partkey = l_partkey)"


def _sized(spark, sf):
    return _symbols(spark, sf).withColumn("name", F.concat_ws(" ", "name", F.col("start_line").cast("string"))).distinct()


def _records(spark, sf):
    """Call records: from a part, by the name of the part that its supplier's number stands for."""
    part = _t(spark, sf, "part")
    callee = part.select(F.col("p_partkey").alias("l_suppkey"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("callee_name"))
    caller = part.select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("src/"), "p_brand", F.lit(".x")).alias("file_path"))
    lines = _t(spark, sf, "lineitem").join(callee, "l_suppkey").join(caller, "l_partkey")
    return lines.select(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("caller_id"), "callee_name", F.col("l_linenumber").alias("call_site_line"), "file_path", F.col("l_orderkey").alias("symbol_ord"), F.col("l_linenumber").alias("ord"))


def _resolution_sql(more: str = "") -> str:
    return f"""WITH {_SYM}, {_SIZED}, {_RECORDS}, joined AS (SELECT x.node_key AS src_key, y.node_key AS dst_key, line, rec.file_path, o, n FROM rec JOIN nodes x ON x.id = caller_id JOIN sized y ON y.name = callee_name AND y.label = 'Function' {more})
SELECT src_key, dst_key, arg_max(line, (file_path, o, n)) AS call_site_line FROM joined GROUP BY src_key, dst_key"""


@query(_resolution_sql())
def call_resolution(spark, sf):
    return resolve.call_edges(_records(spark, sf), _sized(spark, sf))


@query(_resolution_sql("WHERE y.file_path <= rec.file_path"))
def sequential_resolution(spark, sf):
    return resolve.call_edges(_records(spark, sf), _sized(spark, sf), sequential=True)


@query(f"WITH {_SYM}, {_SIZED}, {_RECORDS} SELECT DISTINCT x.node_key AS src_key, y.node_key AS dst_key FROM rec JOIN nodes x ON x.id = caller_id JOIN sized y ON y.name = callee_name AND y.label IN ('Class', 'Struct', 'Interface', 'Trait')")
def inheritance_resolution(spark, sf):
    records = _records(spark, sf).withColumnsRenamed({"caller_id": "child_id", "callee_name": "parent_name"})
    return resolve.inherit_edges(records, _sized(spark, sf))


@query(f"WITH {_SYM} SELECT 'File|' || file_path AS src_key, node_key AS dst_key FROM nodes UNION SELECT x.node_key, y.node_key FROM nodes y JOIN nodes x ON x.id = 'part:' || (y.p_partkey // 10) WHERE y.label = 'Method'")
def parent_containment(spark, sf):
    nodes = _symbols(spark, sf)
    number = F.split_part("id", F.lit(":"), F.lit(2)).cast("long")
    children = nodes.where("label = 'Method'").select(F.concat(F.lit("part:"), F.expr("cast(split_part(id, ':', 2) as bigint) div 10").cast("string")).alias("parent_id"), "id", number.alias("n")).drop("n")
    return resolve.contain_edges(children, nodes)


@query(f"WITH {_SYM}, m AS (SELECT name, file_path, arg_min(id, p_partkey) AS found_id FROM nodes WHERE label IN ('Class', 'Struct') GROUP BY name, file_path) SELECT DISTINCT n.file_path, n.name, found_id FROM nodes n JOIN m ON n.name = m.name AND n.file_path = m.file_path WHERE n.label = 'Method'")
def first_match(spark, sf):
    nodes = _symbols(spark, sf).withColumn("ord", F.split_part("id", F.lit(":"), F.lit(2)).cast("long")).withColumn("kind", F.col("label"))
    wanted = nodes.where("label = 'Method'").select("file_path", "name", F.array(F.lit("Class"), F.lit("Struct")).alias("kinds")).distinct()
    return resolve.first_match(wanted, nodes).drop("kinds")


@query(f"""WITH {_IMPORTS} SELECT 'File|' || file_path AS src_key, 'Module|' || target AS dst_key, '' AS alias, '["' || replace(replace(target, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"]' AS items, CAST(max(ord) + 1 AS INTEGER) AS line FROM raw GROUP BY file_path, target""")
def module_imports(spark, sf):
    return resolve.import_edges(_raw_imports(spark, sf))


@query(f"WITH {_IMPORTS} SELECT DISTINCT target AS name, true AS is_external FROM raw")
def modules(spark, sf):
    return resolve.modules(_raw_imports(spark, sf))


_SNAPSHOTS = "a AS (SELECT 'f' || doc_id * 2 AS path, sha256(lang) AS h FROM documents), b AS (SELECT 'f' || page_id * 3 AS path, sha256(substr(html, 33, 2)) AS h FROM pages)"


@query(f"WITH {_SNAPSHOTS} SELECT coalesce(a.path, b.path) AS path, CAST(NULL AS VARCHAR) AS old_path, CASE WHEN a.path IS NULL THEN 'Added' WHEN b.path IS NULL THEN 'Deleted' ELSE 'Modified' END AS kind FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h")
def snapshot_diff(spark, sf):
    old = _t(spark, sf, "documents").select(F.concat(F.lit("f"), (F.col("doc_id") * 2).cast("string")).alias("path"), F.sha2("lang", 256).alias("hash"))
    new = _t(spark, sf, "pages").select(F.concat(F.lit("f"), (F.col("page_id") * 3).cast("string")).alias("path"), F.sha2(F.substring("html", 33, 2), 256).alias("hash"))
    return git.snapshot_diff(old, new)


@query("SELECT DISTINCT path FROM (SELECT 'o' || o_orderkey AS path FROM orders UNION ALL SELECT 'old' || o_custkey FROM orders WHERE o_orderstatus = 'P')")
def change_dispatch_delete(spark, sf):
    return git.split_changes(_changes(spark, sf))[0]


@query("SELECT 'o' || o_orderkey AS path FROM orders WHERE o_orderstatus <> 'F'")
def change_dispatch_parse(spark, sf):
    return git.split_changes(_changes(spark, sf))[1]


def _changes(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", "Deleted").when(F.col("o_orderstatus") == "P", "Renamed").otherwise("Modified")
    old = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("old"), F.col("o_custkey").cast("string")))
    return _t(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), old.alias("old_path"), kind.alias("kind"))


# --- paths --------------------------------------------------------------------------------


def _trails_sql(reverse: bool, select: str) -> str:
    a, b = ("b", "a") if reverse else ("a", "b")
    return f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT {a} AS x, {b} AS y, a || '>' || b AS id FROM pairs),
walk AS (SELECT y AS node, 1 AS distance, [id] AS path FROM e WHERE x = {TARGET} UNION ALL
  SELECT e.y, distance + 1, list_append(path, e.id) FROM walk JOIN e ON e.x = walk.node WHERE distance < {DEPTH} AND NOT list_contains(path, e.id))
{select}"""


def _start(spark):
    return spark.createDataFrame([(TARGET,)], "node bigint")


@query(_trails_sql(True, "SELECT node, distance, count(*) AS paths FROM walk GROUP BY node, distance"))
def callers_k(spark, sf):
    found = traverse.trails(_start(spark), _pairs(spark, sf), DEPTH, reverse=True)
    return found.groupBy("node", "distance").agg(F.count("*").alias("paths"))


@query(_trails_sql(False, "SELECT node, distance, count(*) AS paths FROM walk GROUP BY node, distance"))
def callees_k(spark, sf):
    found = traverse.trails(_start(spark), _pairs(spark, sf), DEPTH)
    return found.groupBy("node", "distance").agg(F.count("*").alias("paths"))


@query(_trails_sql(True, "SELECT node, min(distance) AS distance FROM walk GROUP BY node"))
def reach_min_distance(spark, sf):
    return traverse.distances(_start(spark), _pairs(spark, sf), DEPTH, reverse=True).drop("start")


_FUNCTION_WALK = f"""WITH RECURSIVE {_SYM}, {_EDGES}, walk AS (SELECT src_key AS node, 1 AS distance, [src_key || '>' || dst_key] AS path FROM edges WHERE dst_key IN (SELECT node_key FROM nodes WHERE label = 'Function' AND name = 'new ring') UNION ALL
  SELECT e.src_key, distance + 1, list_append(path, e.src_key || '>' || e.dst_key) FROM walk JOIN edges e ON e.dst_key = walk.node WHERE distance < 2 AND NOT list_contains(path, e.src_key || '>' || e.dst_key))"""


@query(f"{_FUNCTION_WALK} SELECT name, file_path, CAST(distance AS BIGINT) AS distance FROM walk JOIN nodes ON node = node_key AND label = 'Function' ORDER BY distance, name, file_path LIMIT {search.CALLS_LIMIT}")
def calls_callers(spark, sf):
    return search.calls(_symbols(spark, sf), _calls(spark, sf), "new ring", "callers", depth=2)


@query(f"{_FUNCTION_WALK} SELECT name, file_path, CAST(min(distance) AS BIGINT) AS distance FROM walk JOIN nodes ON node = node_key AND label = 'Function' GROUP BY node_key, name, file_path")
def calls_callers_distinct(spark, sf):
    return search.calls(_symbols(spark, sf), _calls(spark, sf), "new ring", "callers", depth=2, limit=None, distinct=True)


# --- the query language -------------------------------------------------------------------


def _graph(spark, sf) -> build.Graph:
    nodes = _symbols(spark, sf)
    symbols = nodes.withColumns({"signature": F.lit(""), "visibility": F.lit("public"), "is_async": F.lit(False), "docstring": F.lit(""), "ord": F.lit(0)})
    files = nodes.select(F.col("file_path").alias("path")).distinct().withColumns({"language": F.lit("X"), "hash": F.lit(""), "line_count": F.lit(1), "last_indexed": F.lit(0).cast("long")})
    imports = resolve.import_edges(_raw_imports(spark, sf))
    calls = _calls(spark, sf).withColumn("call_site_line", F.lit(1))
    contains = nodes.select(names.node_key(F.lit("File"), F.col("file_path")).alias("src_key"), F.col("node_key").alias("dst_key"))
    empty = nodes.limit(0)
    return build.Graph(files, empty, empty, empty, empty, symbols, resolve.modules(_raw_imports(spark, sf)), contains, calls, imports, contains.limit(0))


@query(f"WITH {_SYM} SELECT label AS kind, count(*) AS n, min(start_line) AS low, max(name) AS last FROM nodes WHERE (label = 'Function' OR label = 'Class') AND starts_with(lower(name), 's') GROUP BY label")
def cypher_aggregate(spark, sf):
    return cypher(_graph(spark, sf), "MATCH (s) WHERE (s:Function OR s:Class) AND toLower(s.name) STARTS WITH 's' RETURN labels(s)[0] AS kind, count(s) AS n, min(s.start_line) AS low, max(s.name) AS last")


@query(f"WITH {_SYM}, {_EDGES} SELECT x.name AS caller, y.name AS callee, count(*) AS n FROM edges JOIN nodes x ON x.node_key = src_key JOIN nodes y ON y.node_key = dst_key WHERE x.label = 'Function' AND y.label = 'Class' GROUP BY 1, 2")
def cypher_join(spark, sf):
    return cypher(_graph(spark, sf), "MATCH (a:Function)-[:CALLS]->(b:Class) RETURN a.name AS caller, b.name AS callee, count(*) AS n")


@query(f"{_FUNCTION_WALK} SELECT name, CAST(distance AS BIGINT) AS d, id FROM walk JOIN nodes ON node = node_key AND label = 'Function' ORDER BY d, name, id LIMIT 40")
def cypher_paths(spark, sf):
    return cypher(_graph(spark, sf), "MATCH (t:Function {name: 'new ring'}) MATCH p = (c:Function)-[:CALLS*1..2]->(t) RETURN c.name AS name, length(p) AS d, c.id AS id ORDER BY length(p), c.name, c.id LIMIT 40")


@query(f"WITH {_SYM} SELECT f.file_path AS path, count(m.node_key) AS methods FROM (SELECT DISTINCT file_path FROM nodes) f LEFT JOIN nodes m ON m.file_path = f.file_path AND m.label = 'Method' AND m.start_line < 5 GROUP BY 1")
def cypher_optional(spark, sf):
    return cypher(_graph(spark, sf), "MATCH (f:File) OPTIONAL MATCH (f)-[:CONTAINS]->(m:Method) WHERE m.start_line < 5 RETURN f.path AS path, count(m) AS methods")
