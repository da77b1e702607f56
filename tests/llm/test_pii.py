import hashlib
import random
import re

import numpy as np
import pytest

from codeloom.llm import pii


def brute(text):
    """The patterns of the contract, as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return out


@pytest.mark.parametrize("alphabet", ["a@.-1 ", "0123 -.", "+12 ().-", "aé@.٣1\n", "1. ", "@.a"])
def test_base_spans(alphabet):
    rng = random.Random(alphabet)
    for n in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute(text), text


def test_known_values():
    text = "x 4111 1111 1111 1111, 4111111111111112; +1 (743) 555-3824 a.b@c-d.example.com. 1.2.3.256 1.2.3.4.5.6.7.8"
    assert pii.show(pii.base_spans(text)) == "email:59:78,ip:90:97,ip:98:105,card:2:21,phone:41:58"


def added(text):
    ((base, spans),) = pii.find([text])
    assert set(base) <= set(spans)
    return [text[a:b] for k, a, b in spans if (k, a, b) not in base]


def test_added_spans():
    for text, more in [
        ("call +1 (743) 555-3824 soon. then 743-555-3824 and 212-555-9999", ["743-555-3824"]),
        ("only 743-555-3824 here", []),
        ("please call 743-555-3824 now", ["743-555-3824"]),
        ("version 3.0 of 2024-01-02, order 5927243074273351 5927243074273351, x@y", []),
        ("5927243074273351 4111111111111111 and 4111111111111111.", ["4111111111111111"]),
        ("at +1 (826) 555-4081 190.137.223.1 too", ["+1 (826) 555-4081"]),
    ]:
        assert added(text) == more


@pytest.mark.parametrize("between", [" ", " and ", ". Then "])
@pytest.mark.parametrize("copies", [1, 2, 3, 10, 300])
def test_every_copy_is_labelled(copies, between):
    """Copies do not weaken each other, and do not make something of nothing."""
    assert added("+1 (743) 555-3824 soon. Then " + between.join(["743-555-3824"] * copies) + ".") == ["743-555-3824"] * copies
    assert added("see " + between.join(["743-555-3824"] * copies)) == []
    assert added("see " + between.join(["5927243074273351"] * copies)) == []


def marginals(graph, unary, pair):
    """By the sum over all labels of all variables."""
    n = len(graph.active)
    axis = lambda x, *at: x.reshape([pii.LABELS if i in at else 1 for i in range(n)])
    joint = np.zeros((pii.LABELS,) * n)
    for i, (features, label) in enumerate(zip(graph.active, graph.label, strict=True)):
        own = unary[features].sum(0)
        joint = joint + axis(own if label <= 0 else np.where(np.arange(pii.LABELS) == label, 0, -50.0), i)
    for i, j, k in graph.edges:
        joint = joint + axis(pair[k] if i < j else pair[k].T, i, j)
    joint = np.exp(joint - joint.max())
    return [joint.sum(tuple(j for j in range(n) if j != i)) / joint.sum() for i in range(n)]


@pytest.mark.parametrize("text, kinds", [
    ("12 34 56 78901", {pii.CHAIN}),
    ("9 743-555-3824 and 743-555-3824 and 743-555-3824 7", {pii.CHAIN, pii.EQUAL}),
    ("+1 (743) 555-3824 or 743-555-3824, 743-555-3824", {pii.CHAIN, pii.EQUAL, pii.SIMILAR}),
])
def test_messages_are_exact_without_loops(text, kinds):
    graph = pii.Graph()
    graph.add(0, text, pii.base_spans(text))
    assert {k for *_, k in graph.edges} == kinds and len(graph.active) <= 9
    rng = np.random.default_rng(3)
    weights = [pii.weights(), (rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(3, pii.LABELS, pii.LABELS)))]
    for unary, pair in weights:
        np.testing.assert_allclose(pii.beliefs(graph, (unary, pair), rounds=500), marginals(graph, unary, pair), atol=2e-3)


def test_messages_are_near_where_there_is_a_loop():
    text = "743-555-3824 5 743-555-3824"
    graph = pii.Graph()
    graph.add(0, text, [])
    assert len(graph.edges) == len(graph.active)  # two chain edges, two skip edges, four variables
    unary, pair = pii.weights()
    got, want = pii.beliefs(graph, (unary, pair), rounds=500), marginals(graph, unary, pair)
    np.testing.assert_allclose(got, want, atol=0.1)
    assert (got.argmax(1) == np.argmax(want, 1)).all()


def test_parts_of_long_tokens_count():
    long = "q" * 5000 + "743-555-3824"
    graph = pii.Graph()
    graph.add(0, f"555-3824 {long}", [])
    assert pii.SIMILAR in {k for *_, k in graph.edges}


def test_long_texts_take_time_in_proportion():
    for text in ["a" * 300_000, "1" * 300_000, "@" * 100_000, "+1" * 100_000, "1 " * 100_000, "1.1." * 50_000, "+1" + " " * 300_000]:
        pii.find([text])


def test_query(spark, make_tables):
    texts = ["mail a@b.co or 10.0.0.1", None, "", "é +1 (743) 555-3824", "plain", "mail a@b.co or 10.0.0.1"]
    rows = {r.doc_id: r for r in pii.op4_pii(spark, make_tables(documents=[(i, t, "en", "s", 1) for i, t in enumerate(texts)])).collect()}
    assert len(rows) == 6
    for i, t in enumerate(texts):
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t or ""))
        assert rows[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest() and rows[i].spans == shown
    assert rows[0][1:5] == (1, 1, 0, 0) and rows[3][1:5] == (0, 0, 0, 1) and rows[0][1:] == rows[5][1:]


def test_redaction():
    assert pii.redacted("a 1.2.3.4 b", [(1, 2, 9)]) == "a [IP] b"
    assert pii.redacted("abcdef", [(0, 1, 4), (3, 2, 5)]) == "a[EMAIL]f"
