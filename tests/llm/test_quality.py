import random
import zlib

import numpy as np

from codeloom.llm import quality

WORDS = "the and of to in a house tree river walk small green often found came with".split()


def text(rng, good):
    words = [rng.choice(WORDS) + rng.choice(["", "er", "ing"]) for _ in range(rng.randint(30, 90))]
    if good:
        return ". ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "."
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + "$$$" for w in words)
    if kind == 1:
        return " ".join(words).upper() + "!!"
    return " ".join(["spam"] * len(words))


def test_statistics():
    s = dict(zip(quality.STATISTICS, quality.statistics("Ab the 12.\nAb the 12.\n".encode()), strict=True))
    assert (s["bytes"], s["words"], s["lines"], s["longest_word"]) == (22, 6, 2, 3)
    assert (s["distinct"], s["repeated_lines"], s["sentence"]) == (0.5, 0.5, 1.0)
    assert abs(s["digit"] - 4 / 22) < 1e-12 and abs(s["function"] - 2 / 6) < 1e-12
    assert quality.statistics(None) == quality.statistics(b"") and sum(quality.statistics(b"")) == 0


def test_rules_separate_classes_and_compile(spark):
    rng = random.Random(1)
    texts = [(text(rng, i % 4 > 0), int(i % 4 > 0)) for i in range(600)]
    x, y = np.array([quality.statistics(t.encode()) for t, _ in texts]), np.array([q for _, q in texts])
    model = quality.fit(x[:400], y[:400], np.ones(400))
    assert 0 < len(model.rules) < 120 and all(r for r, _ in model.rules)
    assert ((model.score(x[400:]) >= quality.KEEP) == y[400:]).mean() > 0.97
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[400:]], ", ".join(f"{s} double" for s in quality.STATISTICS))
    np.testing.assert_allclose([r[0] for r in frame.select(model.column()).collect()], model.score(x[400:]), rtol=1e-9)
    assert model.rules == quality.fit(x[:400][::-1], y[:400][::-1], np.ones(400)).rules
    assert len(model.text()) == len(model.rules)


def test_lasso_is_optimal():
    rng = np.random.default_rng(0)
    z = rng.integers(0, 2, (300, 6)).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * z[:, 0] - 1)))).astype(float)
    b, w = quality.lasso_logistic(z, y, np.ones(300), 0.02, 3000)
    g = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / 300
    assert w[0] > 0.5 and (w[1:] == 0).any()
    assert np.all(np.abs(g[w == 0]) <= 0.02 + 1e-6) and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-5)


def test_edge_models():
    x = np.zeros((3, len(quality.STATISTICS)))
    assert quality.fit(x[:0], np.zeros(0), np.zeros(0)).score(x).tolist() == [0.5] * 3
    assert (quality.fit(x, np.ones(3), np.ones(3)).score(x) > 0.9).all()


def test_query(spark, make_tables):
    rng = random.Random(2)
    good = [i % 5 > 0 for i in range(500)]
    docs = [(i, text(rng, g), "en", "s", 1) for i, g in enumerate(good)]
    docs += [(1000, None, "en", "s", 1), (1001, "", None, None, None), (1002, text(rng, True) * 300, "en", "s", 1), (None, "plain", "en", "s", 1), (1002, text(rng, False), "en", "s", 1)]
    labels = [(i, int(g), 0) for i, g in enumerate(good)] + [(1000, None, None), (None, 1, 1), (9999, 1, 1)]
    found = quality.op6_quality_rules(spark, make_tables(documents=docs, labels=labels)).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 500 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id or "").encode() if r.doc_id is not None else b"") % 5 == 0) for r in found if r.doc_id != 0)
    assert sum(r.predicted == good[r.doc_id] for r in held) / len(held) > 0.95
    assert sorted(r.predicted for r in found if r.doc_id == 1002) == [0, 1]


def test_nothing_to_learn_from(spark, make_tables):
    assert quality.op6_quality_rules(spark, make_tables()).collect() == []
    (r,) = quality.op6_quality_rules(spark, make_tables(documents=[(1, "x", "en", "s", 1)])).collect()
    assert (r.score, r.predicted) == (0.5, 1)
