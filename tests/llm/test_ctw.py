import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from codeloom.llm import contexts, ctw


def pe(a: int, b: int) -> float:
    out = 1.0
    for k in range(a + b):
        out *= ((k if k < a else k - a) + 0.5) / (k + 1)
    return out


class Brute:
    """Context-tree weighting by its recursion, one tree for each node of a byte's decisions."""

    def __init__(self, order):
        self.order, self.counts = order, defaultdict(lambda: [0, 0])

    def steps(self, text):
        s = b"\xff" * self.order + text.lower() + b"\xff"
        for i in range(self.order, len(s)):
            node = 1
            for k in range(7, -1, -1):
                bit = s[i] >> k & 1
                yield node, s[i - self.order : i], bit
                node = node * 2 + bit

    def add(self, node, context, bit, n=1):
        for d in range(self.order + 1):
            self.counts[node, context[self.order - d :]][bit] += n

    def mixed(self, node, context):
        a, b = self.counts.get((node, context), (0, 0))
        own = pe(a, b)
        if a + b == 0 or len(context) == self.order:
            return own
        below = math.prod(self.mixed(*k) for k in [k for k in self.counts if k[0] == node and len(k[1]) == len(context) + 1 and k[1].endswith(context)])
        return 0.5 * own + 0.5 * below

    def bits(self, text):
        out = 0.0
        for node, context, bit in self.steps(text):
            before = self.mixed(node, b"")
            self.add(node, context, bit)
            out -= math.log2(self.mixed(node, b"") / before)
            self.add(node, context, bit, -1)
        return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_code_length(order):
    texts = [b"abab aab", b"", b"Abba", "é".encode()]
    brute = Brute(order)
    for t in texts:
        for step in brute.steps(t):
            brute.add(*step)
    model = ctw.from_texts([t.lower() for t in texts], order, 0.0)
    for t in [b"abba", b"", b"zz", "éa".encode(), b"ab"]:
        np.testing.assert_allclose(model.bits([b"x", t.lower()])[1], brute.bits(t), rtol=1e-5)


def test_probabilities_sum_to_one():
    model = ctw.from_texts([b"the cat sat on the mat " * 20, b"a dog"], 3, 2**-6)
    rows = np.exp2(-model.table.reshape(-1, 256).astype(np.float64))
    np.testing.assert_allclose(rows.sum(1), 1, rtol=1e-4)
    assert model.tree.size <= 3 * 2**6 + 1


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 10, 1e6])
    np.testing.assert_allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)


def test_gram_counts(monkeypatch):
    monkeypatch.setattr(contexts, "HELD", 20)
    counter, texts = contexts.Counter(2, True), [b"", b"abc", b"ab", b"\x00", b"abcabc"] * 3
    parts = []
    for t in texts:
        counter.add([t])
        if counter.full:
            parts.append(counter.take())
    got = dict(zip(*[x.tolist() for x in contexts.merge([*parts, counter.take()])], strict=True))
    want: Counter = Counter()
    for t in texts:
        s = b"\xff\xff" + t + b"\xff"
        want.update(int.from_bytes(s[i - 2 : i + 1], "big") for i in range(2, len(s)))
    assert got == want


def test_query(spark, make_tables, monkeypatch):
    texts = ["the cat and the dog", "The CAT\tsat\x0bon the mat", None, "", "é  x new", "rare words here", "the " * 3000] + [f"doc {i} the cat w{i % 4}" for i in range(40)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "the cat", None, None, None), (3, "", "en", "s", 1)]
    sf = make_tables(documents=rows)
    test = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    split = lambda t: (t or "").encode().lower().split() + [None]
    count: Counter = Counter()
    for i, t, *_ in rows:
        if not test(i):
            count.update(split(t))
    n, v = count.total(), len(count)
    model = ctw.from_texts([(t or "").encode().lower() for i, t, *_ in rows if not test(i)])
    want = sorted((i or -1, test(i), len(split(t)), sum(count[w] > 0 for w in split(t)), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t)), 6), round(-model.bits([(t or "").encode().lower()])[0] * math.log10(2), 4)) for i, t, *_ in rows)
    for head in (2**-18, 0.02, 1.0):
        monkeypatch.setattr(ctw.score, "__defaults__", (*ctw.score.__defaults__[:-1], head))
        got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)) for r in ctw.op8_ctw(spark, sf).collect())
        assert got == want


def test_nothing_to_learn_from(spark, make_tables):
    assert ctw.op8_ctw(spark, make_tables()).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = ctw.op8_ctw(spark, make_tables(documents=[(alone, "ab", "en", "s", 1)])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (2, 0, 0, 0) and abs(r.score + 24 * math.log10(2)) < 1e-4


def test_rare_contexts_are_nodes_and_the_tree_is_not_sent_out(spark, make_tables, monkeypatch):
    monkeypatch.setattr(ctw, "CHUNK", 3000)
    rng = np.random.default_rng(4)
    common_text = ["".join(rng.choice(list("abcdefgh "), 4000)) for _ in range(40)]
    rare = "qzxv" * 4
    rows = [(i, t if i else t + " " + rare + " " + rare, "en", "s", 1) for i, t in enumerate(common_text)] + [(100 + i, f"{rare} once{i} éß{i}", "en", "s", 1) for i in range(12)]
    test = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    model = ctw.from_texts([t.encode() for i, t, *_ in rows if not test(i)], 4, 0.0)
    got = {r.doc_id: r.score for r in ctw.op8_ctw(spark, make_tables(documents=rows)).collect()}
    want = -model.bits([t.encode() for _, t, *_ in rows]) * math.log10(2)
    np.testing.assert_allclose([got[i] for i, *_ in rows], want, rtol=1e-9)
    assert model.tree.size > 5000


def test_shards_agree_with_one_tree():
    texts = [b"the cat sat on the mat", b"", b"a dog \x00 and \xc3\xa9"]
    keys, counts = contexts.grams(texts, 4, True)
    shards = [ctw.Shard(keys[i], counts[i]) for _, i in ctw._dealt(keys, 16)]
    assert len(shards) > 8
    ids, n0, n1, mixed = (np.concatenate(x) for x in zip(*[s.roots() for s in shards], strict=True))
    above, at = np.unique(ids, return_inverse=True)
    top = ctw.upper(above, *(np.bincount(at, x) for x in (n0, n1, mixed)))
    asked = [b"the dog", b"zzzz", b"", b"a cat \xc3"]
    wanted, _ = contexts.grams(asked, 4, True)
    known = {s: ctw.Shard(keys[i], counts[i]) for s, i in ctw._dealt(keys, 16)}
    bits = np.zeros(len(wanted))
    none = ctw.Shard(keys[:0], counts[:0])
    for s, i in ctw._dealt(wanted, 16):
        bits[i] = known.get(s, none).bits(wanted[i], top)
    np.testing.assert_allclose(contexts.sums(wanted, bits, asked, 4), ctw.from_texts(texts, 4, 0.0).bits(asked), rtol=1e-9)
