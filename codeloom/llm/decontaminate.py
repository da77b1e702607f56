"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are cut into windows of ten normalised words; an item with fewer words is one
window.  The automaton's letters are whole words: each word of the benchmark is one code point,
any other word is UNKNOWN, so a window has at most ten nodes however long its words are.  It
scans each text once; a match marks the words that it covers, and word numbers lead back to
places in the original text.

A benchmark of more than SHARD_BYTES is dealt to several such automata, pieces of long items
too; each of them scans all texts, and what they hit is put together by row.  The result is the
same for any number of them.

Cases: null and empty texts have no words and no hits; very long texts take time in proportion
and long items are cut into pieces that overlap by nine words; ties do not arise; a null item id
is shown as an empty text; repeated items count once for each id, repeated documents each get a
row; an empty benchmark hits nothing, an empty table gives no rows; extra columns are ignored,
and those in ``keep`` may have any names but those of the result.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW = 10
#: Bytes of benchmark text that one automaton holds (about 0.12 GB in each worker).
SHARD_BYTES = 2 << 20
#: Words of an item that are kept together, besides the nine that the next piece begins with.
PIECE = 4096
#: Stands for all words that no window holds; words of windows have the code points from 1 on.
UNKNOWN = "\0"

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if (b | 0x20 if 0x41 <= b <= 0x5A else b) in _KEEP else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    """Lower-case words; letters beyond ASCII stay as they are."""
    return (text or b"").translate(_TABLE).split()


def windows(text: bytes | None, size: int = WINDOW) -> list[bytes]:
    w = words(text)
    return [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def places(text: str, numbers: list[int]) -> list[tuple[int, int]]:
    """Start and end, in code points of the original text, of runs of hit words."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out: list[tuple[int, int]] = []
    last = -2
    for n in numbers:
        if n == last + 1:
            out[-1] = (out[-1][0], spans[n][1])
        else:
            out.append(spans[n])
        last = n
    return out


def pieces(text: bytes | None, size: int = WINDOW, step: int = PIECE) -> list[bytes]:
    """Runs of an item's words, joined by spaces, that hold each of its windows once."""
    w = words(text)
    return [b" ".join(w[i : i + step + size - 1]) for i in range(0, max(1, len(w) - size + 1), step)] if w else []


class Scanner:
    """The automaton over windows; ``scan`` gives the number of words, hit word numbers, item ids."""

    def __init__(self, items: tuple[tuple[str, bytes], ...], size: int = WINDOW):
        import ahocorasick

        self.letter: dict[bytes, str] = {}
        self.owners: list[tuple[str, ...]] = []
        owners: dict[str, tuple[str, ...]] = {}
        for item, text in items:
            w = words(text)
            shown = "".join(map(self._letter_of, w))
            for i in range(max(1, len(w) - size + 1) if w else 0):
                window = shown[i : i + size]
                known = owners.get(window, ())
                if item not in known:
                    owners[window] = (*known, item)
        number: dict[tuple[str, ...], int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.size = size
        for window, ids in owners.items():
            self.automaton.add_word(window, number.setdefault(ids, len(number)) * size + len(window) - 1)
        self.owners = list(number)
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def _letter_of(self, word: bytes) -> str:
        if word not in self.letter:
            n = len(self.letter) + 1
            self.letter[word] = chr(n if n < 0xD800 else n + 0x800)  # no surrogates
        return self.letter[word]

    def scan(self, text: bytes | None) -> tuple[int, list[int], set[str]]:
        w = words(text)
        if self.empty or not w:
            return len(w), [], set()
        get = self.letter.get
        marks, found = None, set()
        for last, value in self.automaton.iter("".join([get(x, UNKNOWN) for x in w])):
            if marks is None:
                marks = bytearray(len(w))
            owner, n = divmod(value, self.size)
            marks[last - n : last + 1] = b"\x01" * (n + 1)
            found.add(owner)
        if marks is None:
            return len(w), [], set()
        return len(w), [i for i, hit in enumerate(marks) if hit], {x for k in found for x in self.owners[k]}


@lru_cache(maxsize=1)
def _scanner(items: tuple[tuple[str, bytes], ...], size: int) -> Scanner:
    return Scanner(items, size)


def digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_RESULT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("places", pa.list_(pa.list_(pa.int32())))])
_RESULT_SQL = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, places array<array<int>>"


def _row(text: bytes | None, n: int, hit: list[int], ids) -> tuple:
    return n, len(hit), len(ids), digest(ids), bool(hit), [list(p) for p in places(text.decode(), hit)] if hit else []


def by_automaton(docs: DataFrame, items: tuple[tuple[str, bytes], ...], keep: list[str], text: str = "text", size: int = WINDOW) -> DataFrame:
    """One scan of each text.  ``places`` are hit passages in the original, as [start, end)."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def make():
        scan = _scanner(shared.value, size).scan

        def run(texts):
            rows = [_row(t, *scan(t)) for t in texts]
            return dict(zip(_RESULT.names, zip(*rows, strict=True), strict=True))

        return run

    return common.map_texts(docs, keep, text, make, _RESULT, _RESULT_SQL)


def hits(docs: DataFrame, items: tuple[tuple[str, bytes], ...], size: int = WINDOW) -> DataFrame:
    """(_row, hit, ids) of the texts that hold a window of ``items``, from ``_row`` and ``text``."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        scan = _scanner(shared.value, size).scan
        for batch in batches:
            out = [(row, hit, sorted(ids)) for row, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for _, hit, ids in [scan(t.as_py().encode() if t.is_valid else None)] if hit]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())), strict=True)], names=["_row", "hit", "ids"])

    return docs.select("_row", "text").mapInArrow(run, "_row bigint, hit array<int>, ids array<string>")


def by_shards(docs: DataFrame, shards: list[DataFrame], keep: list[str], text: str = "text", size: int = WINDOW) -> DataFrame:
    """The result of one automaton over all items, from a scan for each shard of (item, words)."""
    # What the caller keeps is one column, so that none of its names meets those made here.
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*(keep or [F.lit(0)])).alias("kept"), F.col(text).alias("text"))
    numbered = common.written(numbered, "scan")
    found = None
    for shard in shards:
        one = common.written(hits(numbered, tuple(sorted((r.item, bytes(r.words)) for r in shard.collect())), size), "hits")
        found = one if found is None else found.unionByName(one)
    both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    joined = numbered.join(found.groupBy("_row").agg(both("hit"), both("ids")), "_row", "left")

    def run(batches):
        for batch in batches:
            texts, hit, ids = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "hit", "ids"))
            rows = [_row(raw, len(words(raw)), n.as_py() or [], i.as_py() or []) for t, n, i in zip(texts, hit, ids, strict=True) for raw in [t.as_py().encode() if t.is_valid else None]]
            columns = list(zip(*rows, strict=True)) or [[] for _ in _RESULT]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("kept")), *(pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True))], names=["kept", *_RESULT.names])

    made = T.StructType([joined.schema["kept"], *T._parse_datatype_string(_RESULT_SQL).fields])
    out = joined.mapInArrow(run, made)
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], *_RESULT.names)


def _pieces(benchmark: DataFrame) -> DataFrame:
    """(item, words): the items' words in pieces."""
    common.ship(benchmark.sparkSession)

    def run(batches):
        for batch in batches:
            out = [(item, p) for item, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for p in pieces(t.as_py().encode())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary())], names=["item", "words"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    return items.mapInArrow(run, "item string, words binary")


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """``keep``, n_words, n_hit, n_items, items_sha256, contaminated and places, for each text."""
    items = common.written(_pieces(benchmark), "items")
    held = items.agg(F.sum(F.length("words") + F.octet_length("item") + 16)).first()[0] or 0
    count = max(1, -(-held // max(1, limit)))
    if count == 1:
        return by_automaton(docs, tuple(sorted((r.item, bytes(r.words)) for r in items.collect())), keep, text)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(count)))
    return by_shards(docs, [dealt.where(F.col("shard") == k).select("item", "words") for k in range(count)], keep, text)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.documents(spark, sf_dir, "doc_id", "text"), common.table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS g FROM p),
lengths AS (SELECT DISTINCT n FROM g),
spots AS (SELECT rid, n, unnest(range(len(w) - n + 1)) AS i, w FROM d JOIN lengths ON len(w) >= n),
hit AS (SELECT rid, i, o.n, item FROM (SELECT rid, i, n, array_to_string(w[i + 1 : i + n], ' ') AS t FROM spots) AS o
        JOIN g ON g.n = o.n AND g.g = o.t),
marks AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hit) GROUP BY rid),
owned AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks USING (rid) LEFT JOIN owned USING (rid)
"""
