import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from codeloom.llm import common, decontaminate


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, size=10):
    """(doc_id, n_words, n_hit, n_items, digest) by comparing every place with every window."""
    windows = [(str(i) if i is not None else "", tuple(w[k : k + size])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - size + 1))]
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add(item)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ß", "日本"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 4, 10, 11, 14, 25, 10])]
    items += [(7, None), (8, ""), (9, "..."), (None, items[2][1]), (2, items[2][1]), (10, items[3][1].upper())]
    docs = []
    for d in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            part = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(part) - 3))
            k = rng.randint(0, len(w))
            w[k:k] = part[a : a + rng.choice([9, 10, 30])]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in w)))
    return [*docs, (160, None), (161, ""), (162, "?!"), (160, items[5][1]), (None, items[5][1] + " and " + items[0][1])], items


@pytest.mark.parametrize("limit", [400, 1 << 20])
def test_against_brute_force(spark, limit):
    docs, items = fixture(limit)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item": F.lit(1), "n_hit": F.lit("x"), "w": F.lit(2)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = decontaminate.scan(d, b, ["doc_id"], limit=limit).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)
    assert 10 < sum(r.contaminated for r in got) < len(docs)


def test_query_and_empty_tables(spark, make_tables):
    docs, items = fixture(5)
    rows = [(i, t, "en", "s", 1) for i, t in docs]
    got = decontaminate.op10_decontamination(spark, make_tables(documents=rows, benchmark=items)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)
    assert {r.contaminated for r in decontaminate.op10_decontamination(spark, make_tables(documents=rows)).collect()} == {False}
    assert decontaminate.op10_decontamination(spark, make_tables(benchmark=items)).collect() == []


def test_places_lead_back_to_the_original(spark):
    passage = "one two three four five six seven eight nine ten"
    text = f"Ünrelated – start; {passage.upper().replace(' ', ', ')}! the end"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (r,) = decontaminate.by_automaton(frame, (("0", passage.encode()),), ["doc_id"]).collect()
    ((a, b),) = r.places
    assert text[a:b].lower().replace(",", "") == passage


def test_long_text():
    scan = decontaminate.Scanner((("a", b"x y z"),)).scan
    n, hit, items = scan(b"q " * 500_000 + b"x y z")
    assert (n, hit, items) == (500_003, [500_000, 500_001, 500_002], {"a"})
    assert common.cut([1, 2, 3]).__next__() == (0, 3)


def test_any_number_of_automata_keep_any_columns_and_give_places(spark):
    docs, items = fixture(3)
    names = ("_row", "row", "kept", "hit", "places", "doc")
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    b = spark.createDataFrame(items, "item_id long, text string")
    keep = ["doc_id", "text", "_row", "row", "kept", "hit", "doc"]
    one, other = (decontaminate.scan(d, b, keep, limit=n) for n in (1 << 20, 500))
    assert one.columns == other.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))
    assert other.select("_row", "doc").distinct().collect() == [("_row", "doc")]
    assert other.where("size(places) > 0").count() > 10


def test_pieces_hold_each_window_once():
    rng = random.Random(1)
    for n in [*range(0, 40), 200]:
        text = " ".join(str(rng.randint(0, 5)) for _ in range(n)).encode()
        assert [w for p in decontaminate.pieces(text, step=7) for w in decontaminate.windows(p)] == decontaminate.windows(text)


def test_a_benchmark_of_two_megabytes(spark):
    rng = random.Random(2)
    items = [(k, " ".join(f"v{rng.randrange(40_000)}" for _ in range(120_000 if k == 0 else 60))) for k in range(4_000)]
    assert sum(len(t) for _, t in items) > 2 << 20
    docs = [(k, "alpha " * 5 + " ".join(items[k][1].split()[20 : 20 + 9 + k % 2]) + " omega") for k in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, some = (decontaminate.scan(d, b, ["doc_id"], limit=n).orderBy("doc_id").collect() for n in (1 << 30, 1 << 20))
    assert one == some == decontaminate.scan(d, b, ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.contaminated, r.n_hit) for r in one] == [(bool(k % 2), 10 * (k % 2)) for k in range(60)]
