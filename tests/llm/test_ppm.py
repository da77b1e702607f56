from collections import Counter, defaultdict

import numpy as np
import pytest

from codeloom.llm import contexts, ppm


def brute(text: bytes, texts: list[bytes], order: int) -> float:
    """Code length by the definition, one byte after the other."""
    seen = defaultdict(Counter)
    for t in texts:
        s = b"\xff" * order + t.lower()
        for i in range(order, len(s)):
            for d in range(order + 1):
                seen[s[i - d : i]][s[i]] += 1

    def row(c, d):
        if d < 0:
            return np.full(256, 1 / 256)
        low, counts = row(c, d - 1), seen.get(c[len(c) - d :] if d else b"")
        if not counts:
            return low
        n, q = counts.total(), len(counts)
        out = low * (q / (n + q)) / (1 - low[list(counts)].sum())
        for b, k in counts.items():
            out[b] = k / (n + q)
        return out

    s = b"\xff" * order + text.lower()
    return -sum(np.log2(row(s[i - order : i], order)[s[i]]) for i in range(order, len(s)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_code_lengths(order):
    texts = {"en": [b"hello world the cat", "the dog é".encode()], "fr": ["le chat été là".encode()]}
    model = ppm.Model.of(texts, order)
    for t in ["the cats €", "été", "a", "zzzz the", "\x00\x01"]:
        got = model.bits([t.encode(), b"other", t.encode()])
        np.testing.assert_allclose(got[0], [brute(t.encode(), texts[x], order) for x in model.languages], rtol=1e-5)
        assert (got[0] == got[2]).all()


def test_pieces_do_not_matter(monkeypatch):
    model = ppm.Model.of({"a": [b"abcabc" * 30], "b": [b"cba" * 50]})
    texts = [b"abcab" * 40, b"", b"cab" * 100]
    whole = model.bits(texts)
    monkeypatch.setattr(contexts, "STEP", 1 << 5)
    parts = [sum(len(p[2]) - 3 * len(p[0]) for p in contexts.pieces(texts, 3, False, 32))]
    assert parts == [500]
    np.testing.assert_allclose(model.bits(texts), whole)


def test_query(spark, make_tables):
    words = {"en": "the cat and the dog with this", "de": "der hund und die katze mit das", "fr": "le chat et la souris avec cette"}
    rows = [(i, " ".join(w.split()[(i + k) % 7] for k in range(6)), lang, "s", 1) for i in range(60) for lang, w in words.items()]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    rows += [(900, None, "en", "s", 1), (901, "", "en", "s", 1), (902, "123 ½ $$", "de", "s", 1), (903, "die katze " * 20_000, None, None, None), (None, "the cat and the dog", None, "s", 1), (903, "die katze " * 20_000, None, None, None)]
    found = ppm.op1_language_id(spark, make_tables(documents=rows)).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert [by[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "de", "en"]
    assert sum(by[r[0]].lang_pred == r[2] for r in rows[:180]) >= 178
    assert all(0 <= r.score <= 1 for r in found)


def test_learns_whole_texts_of_different_rows(spark):
    long = " ".join(f"w{i}" for i in range(9_000)) + " zebra"
    rows = [(1, long, "a"), (2, "plain words", "b"), (2, "plain words", "b"), (3, "other", "b"), (4, None, "b"), (5, "none", None)]
    got = ppm.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    want = ppm.Model.of({"a": [long.encode()], "b": [b"plain words", b"other"]})
    assert got.languages == want.languages and (got.table == want.table).all()
    few = ppm.learn(spark.createDataFrame([(i, f"text {i}", "a") for i in range(300)], "doc_id long, text string, lang string"), sample=10)
    assert int(np.exp2(-few.bits([b"text"])[0, 0]) * 1e9) > 0


def test_nothing_to_learn_from(spark, make_tables):
    assert ppm.op1_language_id(spark, make_tables()).collect() == []
    got = ppm.op1_language_id(spark, make_tables(documents=[(1, "abc", None, "s", 1)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
