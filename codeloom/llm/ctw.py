"""Scores of a language model by context-tree weighting, beside those of a word model.

Each byte is eight binary decisions; each decision has a tree of contexts of up to ORDER bytes.
A node's Krichevsky-Trofimov estimate is mixed with what the deeper contexts say, weighted by
how well either has coded the training texts.  The statistics are then frozen, so every
(context, byte) has one code length.  Counts cover all training texts, and each context that
occurs in them is a node: the tree grows with the corpus, so no machine holds all of it.  It is
cut by the last TOP bytes of contexts into shards; the levels above them (at most 256^TOP
binary nodes) are mixed on the driver.  Scored texts are held in chunks, whose distinct grams
go to the shards and come back with their code lengths.

Words are counted in a shuffle.  Words that hold at least HEAD of all tokens (at most 1 / HEAD
words) are sent to every task; the others meet the documents that have them in a join.

Cases: a null text is an empty one, which still has its end; unseen words and bytes keep some
probability; nothing to learn from: 8 bits a byte, and a base score of 0; repeated rows and ids
each get a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter as Tally

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, contexts

ORDER = 4
#: Bytes of context by which the tree is cut into shards.
TOP = 2
#: Bytes of text whose distinct grams are looked up together.
CHUNK = 16 << 20
#: Bytes of training text for each shard, and the most shards there are.
SHARD, SHARDS = 4 << 20, 1024
#: A word with fewer than this share of the training tokens is joined, not sent out.
HEAD = 2**-18
#: Distinct words that a task counts before it passes them on.
WORDS_HELD = 400_000


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of gamma for x >= 0.5, by Stirling's series eight places on."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Model:
    """Code lengths of every byte in every kept context, from counted grams, on one machine.

    ``keys[d]`` and ``counts[d]`` are grams of d context bytes and one more; a context of d bytes
    is a node if it is among ``nodes[d]``, which hold with each context its suffixes.
    """

    def __init__(self, nodes: list[np.ndarray], keys: list[np.ndarray], counts: list[np.ndarray]):
        self.tree = tree = contexts.Tree(nodes)
        place = []
        for d, k in enumerate(keys):
            k = np.asarray(k, np.uint64)
            place.append(tree.find(d, k >> np.uint64(8)) * 256 + (k & np.uint64(255)).astype(np.int64))
        place, flat = np.concatenate(place), np.concatenate(counts).astype(np.float64)
        order = np.argsort(place)
        place, total = place[order], np.concatenate(([0.0], np.cumsum(flat[order])))
        rows = np.arange(tree.size, dtype=np.int64) * 256
        upto = lambda byte: total[np.searchsorted(place, rows + byte)]
        has_child = np.zeros(tree.size, bool)
        has_child[tree.parent[1:]] = True
        bits = np.zeros((tree.size, 256))
        for level in range(8):
            wide = 256 >> level
            for low in range(0, 256, wide):
                a, b, c = upto(low), upto(low + wide // 2), upto(low + wide)
                p1 = self._decide(b - a, c - b, has_child)
                bits[:, low : low + wide // 2] -= np.log2(1 - p1)[:, None]
                bits[:, low + wide // 2 : low + wide] -= np.log2(p1)[:, None]
        self.table = bits.ravel()
        self.symbol = np.arange(256, dtype=np.int64)

    def _decide(self, n0: np.ndarray, n1: np.ndarray, has_child: np.ndarray) -> np.ndarray:
        """Probability of a one in every state, for one binary decision."""
        tree = self.tree
        own, mixed = kt_log(n0, n1), np.zeros(tree.size)
        below = np.zeros(tree.size)  # sum of the children's mixed logs
        left0, left1 = n0.copy(), n1.copy()  # what no child that is a node holds
        for d in range(tree.depth, -1, -1):
            s = slice(tree.base[d], tree.base[d + 1])
            inner = below[s] + kt_log(np.maximum(left0[s], 0), np.maximum(left1[s], 0))
            mixed[s] = np.where(has_child[s], math.log(0.5) + np.logaddexp(own[s], inner), own[s])
            below[s] = inner
            if d:
                np.add.at(below, tree.parent[s], mixed[s])
                np.subtract.at(left0, tree.parent[s], n0[s])
                np.subtract.at(left1, tree.parent[s], n1[s])
        kt = (n1 + 0.5) / (n0 + n1 + 1)
        weight = np.where(has_child, 1 / (1 + np.exp(np.clip(below - own, -700, 700))), 1.0)
        got, rest = np.zeros(tree.size), np.ones(tree.size)
        for d in range(tree.depth + 1):
            s = slice(tree.base[d], tree.base[d + 1])
            if d:
                got[s], rest[s] = got[tree.parent[s]], rest[tree.parent[s]]
            got[s] += rest[s] * weight[s] * kt[s]
            rest[s] *= 1 - weight[s]
        # A state with children is looked up for the bytes that none of them holds.
        return np.clip(got + rest * (np.maximum(left1, 0) + 0.5) / (np.maximum(left0 + left1, 0) + 1), 1e-12, 1 - 1e-12)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text with its end."""
        return contexts.costs(self.tree, self.table, self.symbol, 256, texts, True)[:, 0]


def from_texts(texts: list[bytes], order: int = ORDER, share: float = 0.0) -> Model:
    """The model of a few texts, on this machine; nodes hold at least ``share`` of the bytes."""
    keys, counts = contexts.grams(texts, order, True)
    return from_grams(keys, counts, order, share)


def from_grams(keys: np.ndarray, counts: np.ndarray, order: int, share: float) -> Model:
    total = counts.sum()
    nodes, parts = [np.zeros(1, np.uint64)], []
    for d in range(order + 1):
        k, n = contexts.merge([(keys & np.uint64((1 << 8 * (d + 1)) - 1), counts)])
        context, m = contexts.merge([(k >> np.uint64(8), n)])
        if d:
            nodes.append(context[m >= share * total])
        keep = np.isin(k >> np.uint64(8), nodes[d])
        parts.append((k[keep], n[keep]))
    return Model(nodes, [p[0] for p in parts], [p[1] for p in parts])


def binary_nodes(keys: np.ndarray, counts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids (context, then the node of a byte's decisions) of one level, zeros and ones seen.

    ``keys`` are sorted grams of one depth.  A node that saw nothing has no id: its estimate
    and all below it are one half.
    """
    ids, one = _ids(keys, level), (keys >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.zeros(0, np.int64)
    total = lambda n: np.add.reduceat(n.astype(np.float64), first) if len(first) else np.zeros(0)
    return ids[first], total(np.where(one, 0, counts)), total(np.where(one, counts, 0))


def _ids(keys: np.ndarray, level: int) -> np.ndarray:
    byte = keys & np.uint64(255)
    return keys - byte | np.uint64(1 << level) | byte >> np.uint64(8 - level)


def _weighed(n0, n1, below) -> tuple[np.ndarray, np.ndarray]:
    """Log of a node's mixture and the weight of its own estimate; ``below`` is None at a leaf."""
    own = kt_log(n0, n1)
    if below is None:
        return own, np.ones(len(own))
    return math.log(0.5) + np.logaddexp(own, below), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


class Shard:
    """All nodes below some contexts of TOP bytes, from grams with those contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        grams = {d: contexts.merge([(keys & np.uint64((1 << 8 * (d + 1)) - 1), counts)]) for d in range(TOP, order + 1)}
        self.levels = []
        for level in range(8):
            below, tables = None, {}
            for d in range(order, TOP - 1, -1):
                ids, n0, n1 = binary_nodes(*grams[d], level)
                if d < order:
                    up = tables[d + 1]
                    below = np.bincount(np.searchsorted(ids, up[0] & np.uint64((1 << 8 * (d + 1)) - 1)), up[3], len(ids))
                tables[d] = (ids, n0, n1, *_weighed(n0, n1, below))
            self.levels.append(tables)

    def roots(self) -> tuple[np.ndarray, ...]:
        """Ids one byte of context above the shard: zeros, ones, sum of the mixtures' logs."""
        ids, n0, n1, mixed = (np.concatenate([t[TOP][k] for t in self.levels]) for k in range(4))
        above, at = np.unique(ids & np.uint64((1 << 8 * TOP) - 1), return_inverse=True)
        return above, *(np.bincount(at, x, len(above)) for x in (n0, n1, mixed))

    def bits(self, queries: np.ndarray, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Code lengths of sorted grams; ``top`` is what ``upper`` gives."""
        out = np.zeros(len(queries))
        for level, tables in enumerate(self.levels):
            wanted = _ids(queries, level)
            begin = wanted & np.uint64((1 << 8 * TOP) - 1)
            p = top[0][begin] + top[1][begin] / 2
            got, rest = top
            for d in range(TOP, self.order + 1):
                ids, n0, n1, _, weight = tables[d]
                if not len(ids):
                    break
                above = ids & np.uint64((1 << 8 * d) - 1)
                above = above.astype(np.int64) if d == TOP else np.searchsorted(tables[d - 1][0], above)
                got, rest = got[above] + rest[above] * weight * (n1 + 0.5) / (n0 + n1 + 1), rest[above] * (1 - weight)
                mine = wanted & np.uint64((1 << 8 * (d + 1)) - 1)
                at = np.minimum(np.searchsorted(ids, mine), len(ids) - 1)
                p = np.where(ids[at] == mine, (got + rest / 2)[at], p)
            one = (queries >> np.uint64(7 - level) & np.uint64(1)).astype(bool)
            p = np.clip(p, 1e-12, 1 - 1e-12)
            out -= np.log2(np.where(one, p, 1 - p))
        return out


def upper(ids: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every id of TOP - 1 context bytes: probability of a one from the contexts up to there,
    and the weight that is left to deeper ones."""
    mask = lambda d: np.uint64((1 << 8 * (d + 1)) - 1)
    tables = []
    for d in range(TOP - 1, -1, -1):
        mixed, weight = _weighed(n0, n1, below)
        tables.append((ids, weight, (n1 + 0.5) / (n0 + n1 + 1)))
        if d:
            above, at = np.unique(ids & mask(d - 1), return_inverse=True)
            n0, n1, below, ids = (*(np.bincount(at, x, len(above)) for x in (n0, n1, mixed)), above)
    got, rest = np.zeros(1), np.ones(1)
    for d, (ids, weight, kt) in enumerate(reversed(tables)):
        place = np.arange(256 ** (d + 1)) & (256**d - 1 if d > 1 else 255)
        got, rest = (got[place], rest[place]) if d else (np.zeros(256), np.ones(256))
        got[ids] += rest[ids] * weight * kt
        rest[ids] *= 1 - weight
    return got, rest


def _dealt(keys: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, places of its grams in ``keys``)."""
    suffix = keys >> np.uint64(8) & np.uint64((1 << 8 * TOP) - 1)
    shard = ((suffix * np.uint64(40503) & np.uint64(0xFFFF)) * np.uint64(shards) >> np.uint64(16)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    return [(s, order[a:b]) for s, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers as eight planes of bytes, which a codec makes small."""
    return numbers.view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8).reshape(8, -1).T.copy().view(kind).ravel() for x in column]


def _lower(texts: pa.Array) -> list[bytes]:
    return [(t or b"").lower() for t in texts.cast(pa.binary()).to_pylist()]


def count_grams(docs: DataFrame, shards: int, text: str = "text", order: int = ORDER) -> DataFrame:
    """(shard, keys, counts): grams of all texts, lower-cased, packed as 64-bit numbers; parts of
    a count may be in several rows."""
    common.ship(docs.sparkSession)

    def run(batches):
        counter = contexts.Counter(order, True)

        def out():
            keys, counts = counter.take()
            parts = _dealt(keys, shards)
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int64()), pa.array([_packed(keys[i]) for _, i in parts], pa.binary()), pa.array([_packed(counts[i].astype(np.int64)) for _, i in parts], pa.binary())], names=["shard", "keys", "counts"])

        for batch in batches:
            texts = batch.column(0)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for a, b in common.cut(sizes):
                counter.add(_lower(texts.slice(a, b - a)))
                if counter.full:
                    yield out()
        yield out()

    return docs.select(text).mapInArrow(run, "shard bigint, keys binary, counts binary")


def _shard(table: pa.Table, order: int) -> Shard:
    keys, counts = _numbers(table.column("keys"), np.uint64), _numbers(table.column("counts"), np.int64)
    return Shard(*contexts.merge(list(zip(keys, counts, strict=True))), order)


def learn(grams: DataFrame, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The levels above the shards, from (shard, keys, counts)."""
    common.ship(grams.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        ids, n0, n1, mixed = _shard(table, order).roots()
        return pa.table({"id": pa.array(ids.astype(np.int64)), "n0": n0, "n1": n1, "mixed": mixed})

    roots = grams.groupBy("shard").applyInArrow(run, "id bigint, n0 double, n1 double, mixed double")
    # Sorted, so that the sum is the same in every run.
    total = F.aggregate(F.array_sort(F.collect_list("mixed")), F.lit(0.0), lambda a, x: a + x)
    got = roots.groupBy("id").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), total.alias("below")).orderBy("id").toArrow()
    ids, n0, n1, below = (got.column(c).to_numpy() for c in ("id", "n0", "n1", "below"))
    return upper(ids.astype(np.uint64), n0, n1, below)


def chunked(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` (with ``_row``) with ``_chunk``: the number of the first row of about CHUNK bytes."""
    common.ship(docs.sparkSession)

    def run(batches):
        first, held = None, 0
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
            out = []
            for row, n in zip(batch.column("_row").to_pylist(), sizes, strict=True):
                if first is None or held + n > CHUNK:
                    first, held = row, 0
                held += n
                out.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "_chunk"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("_chunk", T.LongType())]))


def text_bits(docs: DataFrame, grams: DataFrame, top: tuple[np.ndarray, np.ndarray], shards: int, text: str = "text", order: int = ORDER) -> DataFrame:
    """(_row, bits): code length of each text with its end, from ``_row``, ``_chunk`` and text."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(top)

    def ask(batches):
        chunk, counter = None, contexts.Counter(order, True)

        def out():
            keys, _ = counter.take()
            parts = _dealt(keys, shards)
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int64()), pa.array([chunk] * len(parts), pa.int64()), pa.array([_packed(keys[i]) for _, i in parts], pa.binary())], names=["shard", "chunk", "wanted"])

        for batch in batches:
            chunks, texts = batch.column("_chunk").to_numpy(), batch.column(text)
            edges = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)] if len(chunks) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if chunk is not None and chunk != chunks[a]:
                    yield out()
                chunk = int(chunks[a])
                part = texts.slice(a, b - a)
                sizes = pa.compute.fill_null(pa.compute.binary_length(part), 0).to_pylist()
                for i, j in common.cut(sizes):
                    counter.add(_lower(part.slice(i, j - i)))
        if chunk is not None:
            yield out()

    def answer(table: pa.Table, asked: pa.Table) -> pa.Table:
        wanted = _numbers(asked.column("wanted"), np.uint64)
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *wanted]))
        bits = _shard(table, order).bits(keys, shared.value) if len(keys) else keys
        return pa.table({"chunk": asked.column("chunk"), "wanted": asked.column("wanted"), "bits": pa.array([_packed(bits[np.searchsorted(keys, w)]) for w in wanted], pa.binary())})

    def add(texts: pa.Table, known: pa.Table) -> pa.Table:
        keys = np.concatenate([np.zeros(0, np.uint64), *_numbers(known.column("wanted"), np.uint64)])
        bits = np.concatenate([np.zeros(0), *_numbers(known.column("bits"), np.float64)])
        keys, first = np.unique(keys, return_index=True)
        bits, sums = bits[first], []
        column = texts.column(text).combine_chunks()
        for a, b in common.cut(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()):
            sums.append(contexts.sums(keys, bits, _lower(column.slice(a, b - a)), order))
        return pa.table({"_row": texts.column("_row"), "bits": np.concatenate([np.zeros(0), *sums])})

    asked = docs.select("_chunk", text).mapInArrow(ask, "shard bigint, chunk bigint, wanted binary")
    found = grams.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answer, "chunk bigint, wanted binary, bits binary")
    return docs.select("_row", "_chunk", text).groupBy("_chunk").cogroup(found.groupBy("chunk")).applyInArrow(add, "_row bigint, bits double")


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): distinct words of all texts and how often they occur."""
    common.ship(docs.sparkSession)

    def run(batches):
        tally: Tally = Tally()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                tally.update(words(t.as_py()))
                if len(tally) > WORDS_HELD:
                    yield out()
                    tally.clear()
        yield out()

    return docs.select(text).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def score(docs: DataFrame, keep: list[str], training: DataFrame, text: str = "text", order: int = ORDER, head: float = HEAD) -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    spark = docs.sparkSession
    with common.scratch(spark):
        return _score(docs, keep, training, text, order, head)


def _score(docs: DataFrame, keep: list[str], training: DataFrame, text: str, order: int, head: float) -> DataFrame:
    spark = docs.sparkSession
    size = training.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = min(max(size // SHARD, 8), SHARDS)
    grams = common.written(count_grams(training, shards, text, order), "grams")
    top = learn(grams, order)
    packed = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_row"))
    packed = common.written(chunked(packed, "text"), "chunks")
    # Written at once, so that the texts' shuffle is over before anything else takes room.
    coded = common.written(text_bits(packed, grams, top, shards, "text", order), "coded", stays=True)
    counted = common.written(count_words(training, text), "words", stays=True)
    ends = training.count()
    tokens, kinds = counted.agg(F.sum("c"), F.count("*")).first()
    tokens, kinds = (tokens or 0) + ends, kinds + bool(ends)
    below = tokens + 0.5 * (kinds + 1)
    value = lambda c: math.log10((c + 0.5) / below)
    frequent = counted.where(F.col("c") >= F.lit(head * tokens))  # at most 1 / head words
    known = {bytes(r.word): value(r.c) for r in frequent.toLocalIterator()}
    shared = spark.sparkContext.broadcast((known, value(ends)))

    def make():
        known, end = shared.value
        get = known.get

        def run(texts):
            lower = [(t or b"").lower() for t in texts]
            n_tokens, n_head, sums, sizes, ends, flat, counts = [], [], [], [], [0], [], []
            for t in lower:
                tokens = t.split()
                values = list(map(get, tokens))
                missing = values.count(None)
                if missing:
                    tail = Tally(w for w, v in zip(tokens, values, strict=True) if v is None)
                    flat.extend(tail)
                    counts.extend(tail.values())
                n_tokens.append(len(tokens) + 1)
                n_head.append(len(tokens) - missing)
                sums.append(math.fsum(filter(None, values)) + end)
                sizes.append(len(t) + 1)
                ends.append(len(flat))
            tails = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat, pa.binary()), pa.array(counts, pa.int64())], ["word", "n"]))
            return {"n_tokens": n_tokens, "n_head": n_head, "head_sum": sums, "n_bytes": sizes, "tail": tails}

        return run

    tail = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
    schema = pa.schema([("n_tokens", pa.int64()), ("n_head", pa.int64()), ("head_sum", pa.float64()), ("n_bytes", pa.int64()), ("tail", tail)])
    found = common.map_texts(packed, ["_row", "kept"], "text", make, schema, "n_tokens bigint, n_head bigint, head_sum double, n_bytes bigint, tail array<struct<word: binary, n: bigint>>")
    found = common.written(found, "scored", stays=True)
    rest = found.select("_row", F.explode("tail").alias("t")).select("_row", "t.word", "t.n").join(counted, "word", "left")
    rest = rest.groupBy("_row").agg(F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(below))).alias("tail_sum"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("n_tail"))
    whole = found.drop("tail").join(coded, "_row").join(rest, "_row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return whole.select(*[F.col("kept").getField(c).alias(c) for c in keep], "n_tokens", (F.col("n_head") + zero("n_tail") + F.lit(int(ends > 0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("head_sum") + zero("tail_sum")).alias("base_score"), (F.col("bits") * F.lit(-math.log10(2))).alias("score"), (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"))


def op8_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    found = score(docs.withColumn("held_out", common.remainder() == 1), ["doc_id", "held_out"], docs.where(common.remainder() != 1).select("text"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
