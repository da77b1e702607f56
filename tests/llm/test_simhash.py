import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import common, simhash
from codeloom.llm.components import components


def brute_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(n, linked):
    group = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b) and group[a] != group[b]:
                new, old = sorted((group[a], group[b]))
                group = [new if g == old else g for g in group]
    return group


def near_values(rng, n):
    """Fingerprints of which many differ in a few bits."""
    out = []
    for _ in range(n):
        base = rng.choice(out) if out and rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            base ^= 1 << b
        out.append(base)
    return out


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 40_000):
        text = " ".join(rng.choice(["The", "cat", "é", "runs\tfar", "x"]) for _ in range(n))
        if n < 100:
            assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    many = [rng.getrandbits(64) for _ in range(40_001)]
    assert simhash.majority(many) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in many) > len(many))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_the_radius(radius):
    rng, table = random.Random(2), simhash.masks(list(range(64)), radius)
    assert len(table) == 2 ** (radius + 1) - 1
    for _ in range(5000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not x & m for m in table)


@pytest.mark.parametrize("bucket", [8, 128])
def test_near_finds_every_component(spark, bucket):
    values = near_values(random.Random(bucket), 250)
    distinct = sorted(set(values))
    frame = spark.createDataFrame([(simhash._signed(v),) for v in distinct], "fp long")
    links = [(r.a, r.b) for r in simhash.near(frame, bucket=bucket).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)
    found = {simhash._signed(v): i for i, v in enumerate(distinct)}
    want = brute_groups(len(distinct), lambda a, b: (distinct[a] ^ distinct[b]).bit_count() <= 3)
    direct = {frozenset((found[a], found[b])) for a, b in links}
    assert brute_groups(len(distinct), lambda a, b: frozenset((a, b)) in direct) == want


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)]
    frame = spark.createDataFrame(links, "x long, y long")
    got = {r.node: r.root for r in components(frame, "x", "y").collect()}
    direct = {frozenset(p) for p in links}
    want = brute_groups(560, lambda a, b: frozenset((a, b)) in direct)
    assert all(got[n] == want[n] for n in got) and set(got) == {n for p in links if p[0] != p[1] for n in p}


def copies(rng, n):
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3) * (len(w) > 60)):
                w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([1, 4, 30, 90, 150]))]
        texts.append(" ".join(w))
    return texts


def test_query(spark, make_tables):
    texts = [*copies(random.Random(4), 120), None, "", "  ", " ", "Same Text here", "same text HERE"]
    rows = [(i * 3, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op5_simhash(spark, make_tables(documents=rows)).collect()}
    prints = [brute_fingerprint(r[1]) for r in rows]
    groups = brute_groups(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert got == {(r[0], f"{p:016x}", min(x[0] for x, h in zip(rows, groups, strict=True) if h == g)) for r, p, g in zip(rows, prints, groups, strict=True)}


def test_empty(spark, make_tables):
    sf = make_tables()
    assert simhash.op5_simhash(spark, sf).collect() == []
    assert simhash.one_of_each(common.documents(spark, sf)).collect() == []


def jaccard(a, b):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("files", [True, False])
def test_one_of_each(spark, make_tables, files):
    texts = [*copies(random.Random(5), 150), None, "", "A b", "a B"]
    rows = [(i + 10, t, "en", "s", 1) for i, t in enumerate(texts)] + [(10, texts[0], "en", "s", 1), (None, texts[1], "en", "s", 1), (None, "new alone", "en", "s", 1), (10, "another text", "en", "s", 1)]
    docs = common.documents(spark, make_tables(documents=rows)) if files else spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"sid": F.lit(1), "_at": F.lit("x"), "least": F.lit(None).cast("string")})
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    prints = [brute_fingerprint(r[1], 5) for r in rows]
    groups = brute_groups(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 or jaccard(rows[a][1], rows[b][1]) >= 0.8)
    want = []
    for g in set(groups):
        mine = [r for r, h in zip(rows, groups, strict=True) if h == g]
        want.append(min((r[0] is None, r[0] or 0) for r in mine))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(want)
    assert 20 < len(want) < len(rows)


def test_copies_of_one_original_meet(spark):
    """Copies that are similar to their original, and to each other less than that."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(160):
        w = list(base)
        for at in rng.sample(range(200), rng.randint(2, 5)):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    kept = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    prints = [brute_fingerprint(t, 5) for t in texts]
    groups = brute_groups(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 or jaccard(texts[a], texts[b]) >= 0.8)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))
    assert sum(jaccard(texts[0], t) < 0.8 for t in texts) > 30


def test_forest_spans_components():
    rng = random.Random(6)
    values = near_values(rng, 200)
    links = simhash.forest(np.array([simhash._signed(v) for v in values]))
    assert len(links) == len(set(values)) - len(set(brute_groups(len(values), lambda a, b: (values[a] ^ values[b]).bit_count() <= 3)))


@pytest.mark.parametrize("n", [26, 120])
def test_groups_that_meet_in_one_bucket_are_all_compared(spark, monkeypatch, n):
    """Many small groups in one bucket; with 120 members their shingles are dealt to blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 2000, raising=False)
    rng = random.Random(n)
    texts = []
    for _ in range(n // 2):
        w = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join(w), " ".join([*w[:-1], "end"])]
    order = rng.sample(range(n), n)
    placed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_at int, text string")
    sets = spark.createDataFrame([(bytes([order[i]]), [7], (i,)) for i in range(n)], "sid binary, bands array<bigint>, least struct<_at: int>")
    none = spark.createDataFrame([], "x binary, y binary")
    got = {bytes(r.node): bytes(r.root) for r in simhash.groups_of_sets(placed, sets, none).collect()}
    assert got == {bytes([order[i]]): min(bytes([order[i]]), bytes([order[i ^ 1]])) for i in range(n)}


def test_every_fingerprint_of_a_set_links(spark):
    """Texts of one set of shingles differ in repeats; a third text is near the second alone."""
    rng = random.Random(27)
    base = [f"w{rng.randrange(1000)}" for _ in range(8)]
    tail = [f"t{rng.randrange(1000)}" for _ in range(6)]
    texts = [" ".join(base * 2), " ".join(base * 40), " ".join(base * 40 + tail)]
    a, b, c = (brute_fingerprint(t, 5) for t in texts)
    assert (b ^ c).bit_count() <= 3 < (a ^ c).bit_count() and jaccard(texts[0], texts[1]) == 1 and jaccard(texts[1], texts[2]) < 0.8
    for order in (texts, texts[1::-1] + texts[2:]):
        frame = spark.createDataFrame(list(enumerate(order)), "doc_id long, text string").coalesce(1)
        assert [r.doc_id for r in simhash.one_of_each(frame).collect()] == [0]
