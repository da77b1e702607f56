"""SimHash fingerprints and near copies by covering locality-sensitive hashing.

For a radius r, 2^(r+1)-1 masks are drawn from one random map of the 64 bits to vectors of r+1
bits (Pagh, 2016): mask v keeps the bits whose vector has odd product with v.  Any two
fingerprints that differ in at most r bits agree on some mask, so no pair is missed.

A table's bucket with many fingerprints is covered again over the bits its mask left free,
until buckets are small; a bucket gives a spanning forest of its links, never all pairs.

Cases: a null text or one without words has fingerprint zero, linked like any other; fewer
words than a shingle: the whole sequence is the one shingle; ties of a bit give 0; repeated
rows each give a row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints that one bucket compares with each other; larger buckets are covered again.
BUCKET = 128


def shingle_hashes(text: bytes | None, words: int = WORDS) -> list[int]:
    """XXH64 with seed 42 of every word shingle, repeats included."""
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return []
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return [h(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [h(joined[a:b], SEED) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    return majority(shingle_hashes(text, words))


def majority(hashes: list[int]) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed long."""

    def make():
        def run(texts):
            values = [fingerprint(t, words) for t in texts]
            return {"fp": list(map(_signed, values))}

        return run

    return common.map_texts(docs, keep, text, make, pa.schema([("fp", pa.int64())]), "fp bigint")


def masks(bits: list[int], radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """Covering masks over the given bit places: 2^(radius+1)-1 of them."""
    rng = random.Random(seed * 1_000_003 + len(bits) + sum(1 << b for b in bits) % 1_000_033)
    vector = {b: rng.getrandbits(radius + 1) for b in bits}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that span the components of ``values`` under the radius, in blocks of rows."""
    values = np.unique(values.astype(np.int64)).view(np.uint64)
    n = len(values)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((int(values[i].view(np.int64)), int(values[j].view(np.int64))))
    return out


def _links_of_buckets(buckets: DataFrame, radius: int) -> DataFrame:
    common.ship(buckets.sparkSession)

    def run(batches):
        for batch in batches:
            lists = batch.column("fps")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            links = []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if b - a == 2:
                    x, y = int(flat[a]), int(flat[b - 1])
                    if ((x ^ y) & (1 << 64) - 1).bit_count() <= radius:
                        links.append((x, y))
                else:
                    links += forest(flat[a:b], radius)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a bigint, b bigint")


def near(values: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that span all pairs of distinct fingerprints ``fp`` within the radius."""
    if bucket < 1 << radius:
        raise ValueError("a bucket must hold all fingerprints that differ in the last free bits")
    table = masks(list(range(64)), radius)
    # free: bits not fixed yet; key: a hash of the fixed bits and of which they are.
    level = values.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in table])).alias("t", "mask"))
    level = level.select("fp", F.bitwise_not("mask").alias("free"), F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    found, depth = None, 0
    while True:
        level = common.written(level, "buckets")
        sizes = level.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sizes = common.written(sizes, "sizes")
        hot = sizes.where(F.col("n") > bucket).select("key")
        small = level.join(sizes.where(F.col("n") <= bucket).select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"))
        links = _links_of_buckets(small, radius).distinct()
        found = links if found is None else found.unionByName(links)
        if hot.isEmpty():
            return found
        depth += 1
        level = _again(level.join(hot, "key"), radius, depth).distinct()


def _again(level: DataFrame, radius: int, depth: int) -> DataFrame:
    """Cover the free bits of hot buckets once more; all bits are fixed after some rounds."""
    common.ship(level.sparkSession)

    def run(batches):
        known: dict[int, list[int]] = {}
        for batch in batches:
            fps, frees, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "free", "key"))
            for free in np.unique(frees).tolist():
                rows = np.flatnonzero(frees == free)
                if free not in known:
                    bits = [b for b in range(64) if free >> b & 1]
                    # With few bits left, each mask of all but `radius` of them would do no less; fix them all.
                    known[free] = masks(bits, radius, SEED + depth) if len(bits) > radius else []
                if not known[free]:
                    continue
                for t, m in enumerate(known[free]):
                    m &= free & (1 << 64) - 1
                    part = pa.RecordBatch.from_arrays([pa.array(fps[rows]), pa.array(np.full(len(rows), _signed(free & ~m & (1 << 64) - 1))), pa.array(keys[rows]), pa.array(np.full(len(rows), t, np.int32)), pa.array(fps[rows] & _signed(m))], names=["fp", "free", "key", "t", "part"])
                    yield part

    out = level.select("fp", "free", "key").mapInArrow(run, "fp bigint, free bigint, key bigint, t int, part bigint")
    return out.select("fp", "free", F.xxhash64("key", "t", "part").alias("key"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row; the component is the least id reachable."""
    rows = common.written(fingerprints(docs, [doc_id], text, words), "fingerprints")
    least = common.written(rows.groupBy("fp").agg(F.min(doc_id).alias("least")), "least")
    member = components(near(least.select("fp"), radius), "a", "b")
    named = least.join(member, least.fp == member.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = common.written(named, "named")
    head = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(head, "root").select("fp", "component_id"), "fp").select(doc_id, "fp", "component_id")


# --- one document of each group ------------------------------------------------------------
#
# Three bits of 64 are few: of the pairs that share 0.8 or more of their five-word shingles most
# differ in 4 to 14.  The stage therefore joins, beside fingerprints, documents that agree on
# one of BANDS rows of least hashes, once their shingles have been compared in full.

STAGE_WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 4
#: Rounds of comparison by pivots across the groups that still meet in a bucket, after the first
#: one; then all pairs of different groups are compared.
ROUNDS = 1
#: Members of a bucket whose pairs are rows; the shingles of larger ones meet in blocks.
FEW = 32
#: Shingles that one block holds, unless one set has more.
BLOCK = 1 << 18
_LEAST = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) << np.uint64(1)
_LEAST[0] |= np.uint64(1)


def sketch(text: bytes | None, words: int = STAGE_WORDS) -> tuple[int, bytes, list[int]]:
    """Fingerprint, digest of the set of shingles, and band keys."""
    import xxhash

    hashes = shingle_hashes(text, words)
    distinct = np.unique(np.array(hashes, np.uint64))
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(distinct), 4096):
        least = np.minimum(least, (distinct[None, k : k + 4096] * _LEAST[0][:, None] + _LEAST[1][:, None]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)] if len(distinct) else []
    return majority(hashes), xxhash.xxh3_128_digest(distinct.tobytes()), keys


def located(docs: DataFrame) -> DataFrame:
    """``_row`` (the whole row), doc_id, text, and ``_at``: file and row, which stay as they are."""

    def place(df: DataFrame) -> DataFrame:
        file = df.metadataColumn("_metadata")
        return df.select(F.struct("*").alias("_row"), "doc_id", "text", F.struct(file.file_path.alias("file"), file.row_index.alias("row")).alias("_at"))

    try:
        return place(docs)
    except AnalysisException:  # not a table of files
        return place(common.written(docs, "documents"))


def _sketches(placed: DataFrame) -> DataFrame:
    def make():
        def run(texts):
            made = [sketch(t) for t in texts]
            return {"fp": [_signed(m[0]) for m in made], "sid": [m[1] for m in made], "bands": [list(map(_signed, m[2])) for m in made]}

        return run

    schema = pa.schema([("fp", pa.int64()), ("sid", pa.binary()), ("bands", pa.list_(pa.int64()))])
    return common.map_texts(placed, ["_at", "doc_id"], "text", make, schema, "fp bigint, sid binary, bands array<bigint>")


def _shingles(placed: DataFrame) -> DataFrame:
    """sid and the set of shingles, as 32-bit numbers."""

    def make():
        def run(texts):
            sets = [np.unique((np.array(shingle_hashes(t, STAGE_WORDS), np.uint64) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in texts]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            return {"shingles": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *sets])))}

        return run

    return common.map_texts(placed, ["sid"], "text", make, pa.schema([("shingles", pa.list_(pa.int32()))]), "shingles array<int>")


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) from ``sid`` and the sets ``others`` that it is compared with."""
    pairs = rows.select("sid", F.explode(F.array_distinct("others")).alias("other")).where("sid != other")
    return pairs.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()


def first_pairs(shared: DataFrame) -> DataFrame:
    """Each bucket's members with its pivots: the set that meets most others, and two by hash.

    ``shared``: sid, key and n, the members of the bucket.  Pairs grow with the members of
    buckets and not with their square.
    """
    central = shared.groupBy("sid").agg(F.sum(F.col("n") - 1).alias("meets"))
    ranked = common.written(shared.join(central.hint("merge"), "sid"), "ranked")
    order = lambda k: F.xxhash64(F.lit(k), "sid")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("meets", order(0).alias("h"), "sid")).alias("p0"), F.min(F.struct(order(1).alias("h"), "sid")).alias("p1"), F.min(F.struct(order(2).alias("h"), "sid")).alias("p2"))
    pivots = common.written(pivots.select("key", F.array("p0.sid", "p1.sid", "p2.sid").alias("others")), "pivots")
    return _pairs(ranked.select("sid", "key").join(pivots.hint("merge"), "key"))


def _grouped(shared: DataFrame, member: DataFrame) -> DataFrame:
    rows = shared.select("sid", "key").join(member.select(F.col("node").alias("sid"), "root").hint("merge"), "sid", "left").select("sid", "key", F.coalesce("root", "sid").alias("root"))
    return common.written(rows, "grouped")


def more_pairs(shared: DataFrame, member: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Pairs across the groups that still meet in a bucket: members outside its largest group
    with one of that group, and all outside another group with one of that.  Also the buckets
    (sid, key) in which groups meet; the others need no further look."""
    rows = _grouped(shared, member)
    groups = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(turn), "sid").alias("h"), "sid")).alias("one"))
    groups = groups.select("key", "root", "n", F.col("one.sid").alias("pivot"))
    largest = groups.groupBy("key").agg(F.count("*").alias("groups"), F.max(F.struct("n", "root", "pivot")).alias("big")).where("groups > 1").select("key", "big")
    others = groups.join(largest, "key").where("root != big.root").groupBy("key").agg(F.first("big").alias("big"), F.min(F.struct(F.xxhash64(F.lit(turn), "root").alias("h"), "root", "pivot")).alias("small"))
    others = common.written(others.select("key", F.struct("big.root", "big.pivot").alias("big"), F.struct("small.root", "small.pivot").alias("small")), "others")
    outside = F.filter(F.array("big", "small"), lambda x: x.root != F.col("root"))
    met = common.written(rows.join(others.hint("merge"), "key").select("sid", "key", F.transform(outside, lambda x: x.pivot).alias("others")), "met")
    return _pairs(met), met.select("sid", "key")


def similar(pairs: DataFrame, shingles: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """Those pairs whose sets share enough of what either has."""
    left = pairs.join(shingles.withColumnsRenamed({"sid": "a", "shingles": "x"}), "a")
    both = left.join(shingles.withColumnsRenamed({"sid": "b", "shingles": "y"}), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select(F.col("a").alias("x"), F.col("b").alias("y"))


def other_links(shared: DataFrame, member: DataFrame, compared: DataFrame, shingles: DataFrame, similarity: float = SIMILAR) -> DataFrame:
    """Links (x, y) of all similar pairs that share a bucket and are in different groups.

    At least one link joins any two groups that have such a pair.  ``compared`` pairs are known
    not to be one.
    """
    rows = _grouped(shared, member)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key", "n")
    rows = common.written(rows.join(common.written(sizes, "sizes").hint("merge"), "key"), "open")
    small = rows.where(F.col("n") <= FEW)
    lists = small.groupBy("key").agg(F.collect_list(F.struct("sid", "root")).alias("all"))
    pairs = small.join(lists, "key").select(F.col("sid").alias("a"), F.explode(F.filter("all", lambda x: (x.root != F.col("root")) & (x.sid > F.col("sid")))).alias("x")).select("a", F.col("x.sid").alias("b")).distinct()
    pairs = common.written(pairs.join(compared, ["a", "b"], "left_anti"), "pairs")
    return similar(pairs, shingles, similarity).unionByName(_block_links(rows.where(F.col("n") > FEW), shingles, similarity))


def _block_links(rows: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """Links in large buckets: members are dealt to blocks, and any two blocks meet in one task."""
    common.ship(rows.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        sids, roots, x, y = table.column("sid").to_pylist(), table.column("root").to_pylist(), [], []
        lists = table.column("shingles").combine_chunks()
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        distinct, flat = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        group = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)[1]
        mark, largest = np.zeros(len(distinct), np.int64), int(np.bincount(group).argmax())
        for i in np.flatnonzero(group != largest).tolist():
            if group[i] == largest:  # joined meanwhile
                continue
            mine = flat[ends[i] - sizes[i] : ends[i]]
            mark[mine] = 1
            shared = np.add.reduceat(mark[flat], ends - sizes)
            mark[mine] = 0
            for j in np.flatnonzero((shared >= similarity * (sizes + sizes[i] - shared)) & (group != group[i])).tolist():
                if group[j] != group[i]:
                    x.append(sids[i])
                    y.append(sids[j])
                    group[group == (group[i] if group[j] == largest else group[j])] = largest if group[j] == largest else group[i]
        return pa.table({"x": pa.array(x, pa.binary()), "y": pa.array(y, pa.binary())})

    sized = rows.join(shingles.select("sid", F.size("shingles").alias("size")), "sid")
    blocks = sized.groupBy("key").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    dealt = sized.join(blocks, "key").withColumn("i", F.expr("cast(pmod(xxhash64(sid), blocks) as int)"))
    dealt = dealt.select("sid", "root", "key", "i", F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"))
    dealt = dealt.select("sid", "root", "key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    return dealt.join(shingles, "sid").groupBy("key", "lo", "hi").applyInArrow(run, "x binary, y binary")


def groups_of_sets(placed: DataFrame, sets: DataFrame, links: DataFrame, similarity: float = SIMILAR, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) of the groups that ``links`` and similar sets of shingles form.

    ``sets`` has sid, bands and the place of one document with that set; its text is read again
    if the set meets another in a bucket.
    """
    buckets = common.written(sets.select("sid", F.explode("bands").alias("key")), "bands")
    sizes = common.written(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = common.written(buckets.join(sizes.hint("merge"), "key"), "shared")
    wanted = sets.select("sid", "least._at").join(shared.select("sid").distinct().hint("merge"), "sid").select("sid", F.col("_at").alias("_place"))
    texts = placed.select("_at", "text").join(wanted.hint("merge"), F.col("_at") == F.col("_place")).select("sid", "text")
    shingles = common.written(_shingles(texts), "shingles")
    compared = common.written(first_pairs(shared), "pairs")
    links = links.unionByName(similar(compared, shingles, similarity))
    member = components(links, "x", "y")
    known = member.unionByName(shared.select(F.col("sid").alias("node")).distinct().withColumn("root", F.col("node")), allowMissingColumns=True)
    member = common.written(known.groupBy("node").agg(F.min("root").alias("root")), "members")
    for turn in range(rounds):
        pairs, shared = more_pairs(shared, member, turn)
        pairs = common.written(pairs, "pairs")
        compared = compared.unionByName(pairs)
        member = _joined(member, similar(pairs, shingles, similarity))
    return _joined(member, other_links(shared, member, compared, shingles, similarity))


def _joined(member: DataFrame, links: DataFrame) -> DataFrame:
    """Groups after more links (x, y), written: whole groups are joined, not their members again."""
    of = lambda c, name: member.select(F.col("node").alias(c), F.col("root").alias(name))
    between = links.join(of("x", "rx"), "x").join(of("y", "ry"), "y").select("rx", "ry")
    moved = components(between, "rx", "ry").select(F.col("node").alias("root"), F.col("root").alias("_new"))
    if moved.isEmpty():
        return member
    return common.written(member.join(moved, "root", "left").select("node", F.coalesce("_new", "root").alias("root")), "members")


def one_of_each(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILAR) -> DataFrame:
    """``docs`` without the documents that have a near copy with a lesser id (or place).

    Groups are reached through fingerprints of five-word shingles within the radius and through
    sets of such shingles that are similar.  Documents without words are copies of each other.
    Texts meet what was decided on them in sort-merge joins, whatever the size of either side.
    """
    placed = located(docs)
    with common.scratch(docs.sparkSession):
        kept = _kept(placed, radius, similarity)
    return placed.select("_row", "_at").join(kept.hint("merge"), F.col("_at") == F.col("_kept"), "left_semi").select("_row.*")


def _kept(placed: DataFrame, radius: int, similarity: float) -> DataFrame:
    """``_kept``: the place of the first document of each group."""
    rows = common.written(_sketches(placed), "sketches")
    sets = rows.groupBy("sid").agg(F.first("bands").alias("bands"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_at")).alias("least"))
    sets = common.written(sets, "sets")
    # A set of shingles has a fingerprint for each way of repeating them.
    prints = rows.select("sid", "fp").distinct()
    heads = common.written(rows.groupBy("fp").agg(F.min("sid").alias("head")), "heads")
    close = near(heads.select("fp"), radius)
    close = close.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b").select("x", "y")
    same = prints.join(heads, "fp").select(F.col("sid").alias("x"), F.col("head").alias("y")).where("x != y")
    member = groups_of_sets(placed, sets, close.unionByName(same), similarity)
    named = sets.select("sid", "least").join(member, sets.sid == member.node, "left").select("least", F.coalesce("root", "sid").alias("root"))
    return common.written(named.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first._at").alias("_kept")), "kept", stays=True)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(common.documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
