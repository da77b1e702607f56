import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import toxicity

CLEAN = "the cat dog house tree river walks runs sees finds green small today often".split()


def corpus(seed, n=600, group_rate=0.0):
    """(words, label) where toxic rows have insults, and mention a group more often."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 6 == 0
        w = set(rng.sample(CLEAN, 6)) | {f"w{rng.randrange(4000)}x".replace("0", "a")}
        if toxic:
            w |= set(rng.sample(["idiot", "moron", "scum"], rng.randint(1, 2)))
        if rng.random() < (group_rate if toxic else 0.01):
            w |= {rng.choice(["muslim", "jewish"])}
        rows.append((w, int(toxic)))
    return rows


def test_learns_words():
    model = toxicity.fit([(w, y, 1.0) for w, y in corpus(1)])
    right = [(model.score(w) >= 0.5) == bool(y) for w, y in corpus(2)]
    assert sum(right) / len(right) > 0.98
    assert model.score({"the", "cat"}) < 0.1 and 0 <= model.score(set()) < 0.5


def test_counterfactuals_spare_neutral_mentions():
    rows = [(w - {"idiot", "moron", "scum"} if k % 12 else w, y, 1.0) for k, (w, y) in enumerate(corpus(3, 1200, 0.7))]
    neutral = {"the", "muslim", "house", "river"}
    plain, spared = toxicity.fit(rows, counterfactual=0.0), toxicity.fit(rows)
    assert spared.score(neutral) < 0.2 < plain.score(neutral)
    assert abs(spared.score(neutral) - spared.score(neutral - {"muslim"})) < 0.1
    assert spared.score({"the", "moron", "scum"}) > 0.5


def test_swaps():
    rng = random.Random(0)
    assert toxicity.swapped({"a", "b"}, rng) == []
    first, *others = toxicity.swapped({"a", "muslim"}, rng)
    assert first == {"a"} and len(others) == toxicity.SWAPS
    assert all(len(o) == 2 and "muslim" not in o and o & toxicity.TERMS for o in others)


def test_terms_in_four_languages():
    assert {"woman", "femme", "frau", "mujer", "juif", "jude", "judío", "jewish"} <= toxicity.TERMS
    assert toxicity.features("muslim") == ["muslim"] and toxicity.features("trasher") == ["trasher", "tras*", "trash*"]
    for t in sorted(toxicity.TERMS):
        assert toxicity.words(t) == {t} and toxicity._OTHERS[t]


def small_problem(seed=7):
    rows = [(w - {"idiot", "moron", "scum"} if k % 12 else w, y, 1.0 + y) for k, (w, y) in enumerate(corpus(seed, 240, 0.7))]
    known = np.union1d(toxicity.keys(sorted({f for w, *_ in rows for x in w for f in toxicity.features(x)})), toxicity._TERM_KEYS)
    kept = [(toxicity.keys([f for x in sorted(w) for f in toxicity.features(x)]), y, n) for w, y, n in rows]
    return rows, toxicity.problem(kept, [(k, sorted(w & toxicity.TERMS)) for k, (w, *_) in enumerate(rows) if w & toxicity.TERMS], known)


def test_the_penalised_optimum():
    """Against accelerated proximal steps over all features, on the whole loss."""
    rows, p = small_problem()
    assert len(p.change) > 20
    w, b = p.solve(near=1e-4)
    x = np.zeros((len(p.y), p.columns))
    np.add.at(x, (p.row, p.column), 1)
    swaps = np.zeros((len(p.change), p.columns))
    np.add.at(swaps, (slice(None), p.terms), p.change)

    def loss(w, b):
        m = x @ w + b
        return p.weight @ (np.logaddexp(0, m) - p.y * m) + p.counterfactual * np.mean((swaps @ w) ** 2) + p.lasso * np.abs(w).sum()

    design = np.column_stack((x, np.ones(len(x))))
    step = 1 / (np.linalg.norm(design * np.sqrt(p.weight)[:, None], 2) ** 2 / 4 + 2 * p.counterfactual / len(swaps) * np.linalg.norm(swaps, 2) ** 2)
    at = ahead = np.zeros(p.columns + 1)
    for k in range(40_000):
        g = design.T @ (p.weight * (1 / (1 + np.exp(-(design @ ahead))) - p.y))
        g[:-1] += 2 * p.counterfactual / len(swaps) * (swaps.T @ (swaps @ ahead[:-1]))
        new = ahead - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * p.lasso, 0)
        at, ahead = new, new + (k % 500) / (k % 500 + 3) * (new - at)
    v, c = at[:-1], at[-1]
    assert abs(loss(w, b) - loss(v, c)) < 1e-4 and loss(w, b) <= loss(v, c) + 1e-6
    np.testing.assert_allclose(x @ w + b, x @ v + c, atol=0.1)


def test_features_that_are_left_out_have_no_weight():
    rows, p = small_problem()
    w, b = p.solve(near=1e-4)
    heavy = np.bincount(p.column, p.weight[p.row], p.columns) >= p.lasso
    assert not w[~heavy & ~np.isin(np.arange(p.columns), p.terms)].any()
    model = toxicity.fit(rows)
    every = toxicity.fitted([(toxicity.keys([f for x in sorted(f_) for f in toxicity.features(x)]), y, n) for f_, y, n in rows], [(k, sorted(f_ & toxicity.TERMS)) for k, (f_, *_) in enumerate(rows) if f_ & toxicity.TERMS], np.union1d(toxicity.keys(sorted({f for r in rows for x in r[0] for f in toxicity.features(x)})), toxicity._TERM_KEYS))
    for found, _, _ in rows:
        assert abs(model.score(found) - every.score(found)) < 0.01


def test_only_equal_rows_are_one(spark):
    near = "idiot the cat dog house tree river walks runs sees finds green".split()
    docs = [(i, " ".join([*near, f"w{'abcdefghij'[i % 10]}x"])) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("y", "keys", "terms", "digest", "key")})
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    plain = toxicity.fitted
    try:
        toxicity.fitted = lambda rows, *more: seen.append(rows) or plain(rows, *more)
        toxicity.learn(d, labels)
    finally:
        toxicity.fitted = plain
    want = {(i % 10, i % 2) for i in range(40) if zlib.crc32(str(i).encode()) % 5}
    assert len(seen[0]) == len(want)


def test_ids_that_many_documents_have(spark):
    docs = [(1, f"w{i % 40} a cat") for i in range(300)] + [(2, "the idiot and moron"), (3, "the house")]
    d, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    drawn, sizes = toxicity.labelled.sample(d, labels, "toxic", rows=5)
    folds = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5]
    assert sum(sizes.values()) == len(folds) and drawn.where("y = 0").count() <= 20


def test_edge_models():
    assert toxicity.fit([]).score({"a"}) == 0.0
    only = toxicity.fit([({"a"}, 1, 1.0), ({"b"}, 1, 1.0)])
    assert only.score({"zzz"}) > 0.9


def test_query(spark, make_tables):
    rows = corpus(4, 400)
    docs = [(i, " ".join(sorted(w)), "en", "s", 1) for i, (w, _) in enumerate(rows)]
    docs += [(1000, None, "en", "s", 1), (1001, "", None, None, None), (1002, "The MORON and scum, idiot! " + "word " * 50_000, "en", "s", 1), (None, "plain house", "en", "s", 1), (1002, "a cat", "en", "s", 1)]
    labels = [(i, 1, y) for i, (_, y) in enumerate(rows)] + [(1000, None, None), (None, 1, 1), (9999, 1, 1)]
    found = toxicity.op3_toxicity(spark, make_tables(documents=docs, labels=labels)).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by = {r.doc_id: r for r in found if r.doc_id is not None and r.doc_id < 1000}
    held = [i for i in by if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (i in held) for i in by)
    assert sum(by[i].predicted == rows[i][1] for i in held) / len(held) > 0.95
    assert {r.predicted for r in found if r.doc_id in (1000, 1001)} == {0}
    assert sorted(r.predicted for r in found if r.doc_id == 1002) == [0, 1]


def test_nothing_to_learn_from(spark, make_tables):
    assert toxicity.op3_toxicity(spark, make_tables()).collect() == []
    (r,) = toxicity.op3_toxicity(spark, make_tables(documents=[(1, "x", "en", "s", 1)])).collect()
    assert (r.score, r.predicted) == (0.0, 0)
