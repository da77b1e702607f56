"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail and IP addresses, payment cards and international telephone numbers; those
base spans stay.  The field labels tokens that hold a digit or an at sign; all other tokens are
outside by definition.  Neighbours share chain potentials.  All equal tokens of a document,
however many and however far apart, share a variable for their form, which holds what the form
itself says, so that copies do not count as evidence once more; forms of the same last seven
digits share another variable.  Tokens in base spans are observed; loopy sum-product messages
carry labels along chain and skip edges, and tokens whose belief in a kind reaches CERTAIN
become further spans, whether or not the document has base spans.

The weights are fitted to generated documents (``examples``) by the gradient of the conditional
likelihood of all labels given those tokens that patterns find, with expectations from the same
messages; no document is needed to learn from.

Cases: a null text is an empty one and has no spans; offsets are code points, end exclusive;
texts and tokens of any length take time in proportion; spans of different kinds may overlap and
all are given; ties in belief go to the kind listed first; repeated rows give equal results; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Belief from which a token outside base spans becomes a span.
CERTAIN = 0.7
ROUNDS, DAMPING = 60, 0.2
SEED, DOCUMENTS, STEPS = 7, 400, 140

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits is tried once: from its middle it would fail in the same place.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SIGN = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
Span = tuple[int, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign outwards."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        if (m := _DOMAIN.match(text, at + 1)) is not None:
            start = at
            while start > done and _LOCAL.match(text[start - 1]):
                start -= 1
            if start < at:
                out.append((start, m.end()))
                done = m.end()
                at = text.find("@", done)
                continue
        # No match holds this sign; a later local part begins behind it.
        done = max(done, at + 1)
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = (ord(c) - 48) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of what the patterns find, by kind and start."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)]
    if not _SIGN.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def show(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# --- tokens and features ------------------------------------------------------------------

_OPEN, _CLOSE = "\"'([{<,;:!?*#$%&|=", "\"')]}>.,;:!?*#$%&|="


def tokens(text: str) -> list[tuple[int, int]]:
    """Places of words that hold a digit or an at sign, without the marks around them."""
    out, done = [], 0
    m = _SIGN.search(text)
    while m:
        a = m.start()
        while a > done and not text[a - 1].isspace():
            a -= 1
        end = _SPACE.search(text, m.end())
        b = done = end.start() if end else len(text)
        while a < b and text[a] in _OPEN:
            a += 1
        while b > a and text[b - 1] in _CLOSE:
            b -= 1
        out.append((a, b))
        m = _SIGN.search(text, done)
    return out


# Words before a token that speak for a kind; fixed values.
_CUES = {"email": 0, "mail": 0, "e-mail": 0, "ip": 1, "address": 1, "host": 1, "card": 2, "visa": 2, "account": 2, "phone": 3, "tel": 3, "call": 3, "fax": 3}
FEATURES = 48
#: Tokens of fewer characters have no form of their own to share.
LEAST_FORM = 7


def shape(word: str) -> list[int]:
    """Features of what a token looks like, wherever it stands; all are below FEATURES."""
    digits = sum(map(len, _DIGITS.findall(word)))
    letters = sum(map(str.isalpha, word))
    f = [0, 1 + min(digits, 20), 22 + min(word.count("@"), 2), 25 + min(word.count("."), 4), 30 + min(word.count("-"), 3)]
    f.append(34 if letters == 0 else 35 if letters < len(word) else 36)
    if word.startswith("+"):
        f.append(37)
    if "@" in word and _DOMAIN.fullmatch(word.rpartition("@")[2]):
        f.append(39)
    parts = word.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts):
        f.append(40)
    if 13 <= digits <= 19:
        f.append(41 if luhn(_digits(word)) else 42)
    if letters and digits and "@" not in word:
        f.append(47)
    return f


def context(text: str, a: int, gap: str) -> list[int]:
    """Features of what stands before a token; ``gap`` is the text since the one before."""
    f = [38] if a and text[a - 1] == "(" else []
    for word in gap.split()[-2:]:
        cue = _CUES.get(word.strip(_OPEN + _CLOSE).lower())
        if cue is not None:
            f.append(43 + cue)
    return f


CHAIN, EQUAL, SIMILAR = 0, 1, 2


class Graph:
    """Variables of several texts and their edges.

    A token's variable has features of its context; its shape is there too if the token is short,
    else at the variable of its form, once for all equal tokens.  EQUAL edges join tokens to
    their form, SIMILAR ones join forms to their last seven digits, CHAIN ones join neighbours.
    """

    def __init__(self) -> None:
        self.active: list[list[int]] = []
        self.label: list[int] = []  # -1 unknown, 0 outside, else kind + 1
        self.edges: list[tuple[int, int, int]] = []
        self.tokens: list[tuple[int, int, int, int, bool]] = []  # variable, text, start, end, has a form

    def _variable(self, features: list[int], label: int = -1) -> int:
        self.active.append(features)
        self.label.append(label)
        return len(self.active) - 1

    def add(self, row: int, text: str, spans: list[Span], given: bool = False) -> None:
        """Tokens in ``spans`` have their kind; the others are outside if ``given``, else unknown."""
        ordered, k, around = sorted(spans, key=lambda s: s[1]), 0, []
        forms: dict[str, int] = {}
        last, before, whole = 0, -1, False
        for a, b in tokens(text):
            while k < len(ordered) and ordered[k][1] < b:
                around.append(ordered[k])
                k += 1
            around = [s for s in around if s[2] > a]
            gap, word = text[last:a], text[a:b]
            named = len(word) >= LEAST_FORM
            me = self._variable(context(text, a, gap) + ([] if named else shape(word)), around[0][0] + 1 if around else 0 if given else -1)
            self.tokens.append((me, row, a, b, named))
            if before >= 0 and not (whole and named) and len(gap) <= 3 and "\n" not in gap and not any(map(str.isalnum, gap)):
                self.edges.append((before, me, CHAIN))
            if named:
                key = word.casefold()
                if key not in forms:
                    forms[key] = self._variable(shape(word))
                self.edges.append((me, forms[key], EQUAL))
            last, before, whole = b, me, named
        alike: dict[str, list[int]] = {}
        for word, form in forms.items():
            digits = _digits(word)
            if len(digits) >= 7:
                alike.setdefault(digits[-7:], []).append(form)
        for several in alike.values():
            if len(several) > 1:
                hub = self._variable([])
                self.edges += [(form, hub, SIMILAR) for form in several]


LABELS = len(KINDS) + 1


class Messages:
    """Loopy sum-product messages along all edges of a graph at once."""

    def __init__(self, graph: Graph):
        self.owner = np.repeat(np.arange(len(graph.active)), list(map(len, graph.active)))
        self.feature = np.array([f for fs in graph.active for f in fs], np.int64)
        self.size = len(graph.active)
        e = np.array(graph.edges, np.int64).reshape(-1, 3)
        src, dst, kind = np.concatenate((e[:, 0], e[:, 1])), np.concatenate((e[:, 1], e[:, 0])), np.concatenate((e[:, 2],) * 2)
        # By kind and way; edges of a kind run from neighbour to neighbour, from what shares to what is shared.
        order = np.lexsort((dst, np.repeat((0, 1), len(e)) + 2 * kind))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.src, self.dst = src[order], dst[order]
        self.back = place[(order + len(e)) % max(1, 2 * len(e))]
        self.ends = np.searchsorted((np.repeat((0, 1), len(e)) + 2 * kind)[order], np.arange(7))
        self.message = np.zeros((len(order), LABELS))

    def _sum(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        places = (rows[:, None] * LABELS + np.arange(LABELS)).ravel()
        return np.bincount(places, values.ravel(), self.size * LABELS).reshape(-1, LABELS)

    def local(self, unary: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Log potentials of the variables; those with a label have no other."""
        out = self._sum(self.owner, unary[self.feature])
        known = np.flatnonzero(label >= 0)
        out[known] = -50.0
        out[known, label[known]] = 0.0
        return out

    def run(self, local: np.ndarray, pair: np.ndarray, rounds: int, damping: float = DAMPING, enough: float = 1e-4) -> np.ndarray:
        """Beliefs after at most so many rounds, from the messages there are."""
        tables = [t for x in np.exp(pair) for t in (x, x.T)]
        for _ in range(rounds if len(self.src) else 0):
            total = local + self._sum(self.dst, self.message)
            out = total[self.src] - self.message[self.back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.concatenate([out[a:b] @ tables[k] for k, (a, b) in enumerate(zip(self.ends[:-1], self.ends[1:], strict=True))])
            new = np.log(new / new.sum(1, keepdims=True))
            step = damping * self.message + (1 - damping) * new
            done = np.abs(step - self.message).max() < enough
            self.message = step
            if done:
                break
        self.total = local + self._sum(self.dst, self.message)
        p = np.exp(self.total - self.total.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def pairs(self, pair: np.ndarray) -> np.ndarray:
        """Sum over the edges of a kind of their beliefs in pairs of labels."""
        out = np.zeros((3, LABELS, LABELS))
        near = self.total[self.src] - self.message[self.back]
        for k, (a, b) in enumerate(zip(self.ends[:-1:2], self.ends[1::2], strict=True)):
            p = near[a:b, :, None] + near[self.back[a:b], None, :] + pair[k]
            p = np.exp(p - p.max((1, 2), keepdims=True))
            out[k] = (p / p.sum((1, 2), keepdims=True)).sum(0)
        return out

    def features(self, beliefs: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.feature, beliefs[self.owner, k], FEATURES) for k in range(LABELS)], axis=1)


def beliefs(graph: Graph, weights: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
    """Marginal beliefs of all variables; labels above 0 are observed."""
    messages, label = Messages(graph), np.array(graph.label)
    return messages.run(messages.local(weights[0], np.where(label > 0, label, -1)), weights[1], rounds, damping)


def edge_weights(raw: np.ndarray) -> np.ndarray:
    """What shares a variable has, for each label of that, probabilities of labels as potentials:
    so a token of which nothing else is known tells its form nothing, nor do many."""
    out = raw.copy()
    out[1:] -= np.logaddexp.reduce(raw[1:], axis=1, keepdims=True)
    return out


def fit(graph: Graph, seen: np.ndarray, steps: int = STEPS, ridge: float = 0.003) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features (FEATURES, LABELS) and of edges (3, LABELS, LABELS).

    ``graph`` has all labels of tokens; where ``seen``, patterns find them.  Each step compares
    what is expected with all labels and with those that are seen.
    """
    label = np.array(graph.label)
    fixed, free = Messages(graph), Messages(graph)
    n, edges = max(1, int((label >= 0).sum())), np.maximum(1, np.diff(free.ends)[::2])[:, None, None]
    unary, raw = np.zeros((FEATURES, LABELS)), np.zeros((3, LABELS, LABELS))
    raw[1:] += 3 * np.eye(LABELS)
    moments = [np.zeros_like(x) for x in (unary, unary, raw, raw)]
    for t in range(1, steps + 1):
        pair = edge_weights(raw)
        p = fixed.run(fixed.local(unary, label), pair, 2, 0.0)
        q = free.run(free.local(unary, np.where(seen, label, -1)), pair, 3)
        change = (free.pairs(pair) - fixed.pairs(pair)) / edges
        change[1:] -= np.exp(pair[1:]) * change[1:].sum(1, keepdims=True)
        gradients = ((free.features(q) - fixed.features(p)) / n + ridge * unary / n**0.5, change + ridge * raw / n**0.5)
        for k, g in enumerate(gradients):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            (unary, raw)[k][...] -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return unary, edge_weights(raw)


# --- what the weights are fitted to -------------------------------------------------------


def examples(seed: int = SEED, count: int = DOCUMENTS) -> tuple[Graph, np.ndarray]:
    """Generated documents with all labels, and which of their variables the patterns find."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        d = number(15)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def decoy() -> str:
        d = number(15)
        return d + next(c for c in rng.sample("0123456789", 10) if not luhn(d + c))

    def plain() -> str:
        return rng.choice([
            lambda: f"{rng.randint(1, 12)}.{rng.randint(0, 9)}", lambda: f"20{number(2)}-0{rng.randint(1, 9)}-1{number(1)}", lambda: f"{number(2)}:{number(2)}",
            lambda: "@" + word(), lambda: f"${number(3)}.{number(2)}", lambda: number(rng.randint(1, 8)), lambda: number(rng.choice((10, 11, 12, 20))), decoy, decoy,
            lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: word() + number(2), lambda: f"{number(3)}-{number(4)}", lambda: f"v{number(1)}.{number(1)}.{number(2)}",
            lambda: f"{word()}@{word()}", lambda: f"{number(3)}.{number(3)}.{number(3)}", lambda: f"{number(3)}-{number(3)}-{number(4)}",
        ])()

    graph, seen = Graph(), []
    for row in range(count):
        text, spans = "", []

        def put(piece: str, kind: int | None = None, close: bool = False) -> None:
            nonlocal text
            text += " " if text else ""
            if kind is not None:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + ("" if close else rng.choice(["", "", "", ",", "."]))

        for _ in range(rng.randint(1, 3)):
            kind = rng.choice((0, 1, 2, 3, 3, None, None))
            a, b, c = number(3), number(3), number(4)
            d = card()
            name, host = f"{word()}.{number(2)}", f"{word()}.example.com"
            octets = [str(rng.randint(0, 255)) for _ in range(4)]
            full = (f"{name}@{host}", ".".join(octets), rng.choice((d, "-".join(d[i : i + 4] for i in (0, 4, 8, 12)), " ".join(d[i : i + 4] for i in (0, 4, 8, 12)))), f"+1 ({a}) {b}-{c}")
            again = (f"{name}@{host}".upper(), ".".join(octets) + ":80", d, rng.choice((f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{a}{b}{c}")))
            for _ in range(rng.randint(1, 5)):
                put(plain() if rng.random() < 0.4 else word())
            if kind is None:
                repeated = plain()  # what is repeated need not be anything
                for _ in range(rng.choice((1, 1, 2, 3, 8))):
                    put(repeated)
                    put(word())
                continue
            way = rng.random()
            if way < 0.3 and kind == 3:  # without the country's number only a cue tells
                put(rng.choice(("call", "phone", "tel", "fax")))
                put(rng.choice((f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}")), 3)
            elif way < 0.5 and kind in (2, 3):  # digits beside it keep the pattern from finding it
                put(d if kind == 2 else full[3], kind, True)
                other = ".".join(str(rng.randint(0, 255)) for _ in range(4))
                put(decoy()) if kind == 2 or rng.random() < 0.3 else put(other, 1)
            else:
                put(full[kind], kind)
            for _ in range(rng.choice((0, 1, 2, 3, 8))):
                put(word())
                put(rng.choice((full[kind], again[kind], again[kind])), kind)
        put(word())
        graph.add(row, text, spans, True)
        found = Graph()
        found.add(row, text, base_spans(text))
        seen += [x > 0 for x in found.label]
    # Where a pattern finds what is not meant, its label holds for fitting too.
    return graph, np.array(seen) & (np.array(graph.label) > 0)


@lru_cache(maxsize=1)
def weights() -> tuple[np.ndarray, np.ndarray]:
    return fit(*examples())


# --- the operator -------------------------------------------------------------------------


def further(texts: list[str], base: list[list[Span]], fitted: tuple[np.ndarray, np.ndarray], certain: float = CERTAIN) -> list[list[Span]]:
    """Spans that the field adds to those of the patterns."""
    graph = Graph()
    for i, (text, spans) in enumerate(zip(texts, base, strict=True)):
        graph.add(i, text, spans)
    out: list[list[Span]] = [[] for _ in texts]
    if not graph.tokens:
        return out
    p = beliefs(graph, fitted)
    best, sure = p.argmax(1), p.max(1) >= certain
    beside = {(i, j) for i, j, k in graph.edges if k == CHAIN}
    last, last_kind, last_form = -1, -1, False
    for me, row, a, b, form in graph.tokens:
        kind = int(best[me]) - 1
        if kind < 0 or not sure[me] or graph.label[me] > 0 or a >= b:
            last = -1
            continue
        # Parts of one number stand beside each other.
        if kind == last_kind and (last, me) in beside and not (form and last_form):
            out[row][-1] = (kind, out[row][-1][1], b)
            last_form |= form
        else:
            out[row].append((kind, a, b))
            last_form = form
        last, last_kind = me, kind
    return out


def find(texts: list[str], fitted: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans, of each text; either by kind and start."""
    base = [base_spans(t) for t in texts]
    more = further(texts, base, fitted or weights())
    return [(b, sorted(set(b) | set(m))) for b, m in zip(base, more, strict=True)]


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; what overlaps is one span."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def detect(docs: DataFrame, keep: list[str], text: str = "text", with_redacted: bool = False) -> DataFrame:
    """``keep``, counts of base spans, base_sha256, spans, and n_added; also the redacted text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights())
    fields = [("n_email", pa.int64(), "bigint"), ("n_ip", pa.int64(), "bigint"), ("n_card", pa.int64(), "bigint"), ("n_phone", pa.int64(), "bigint"), ("base_sha256", pa.string(), "string"), ("spans", pa.string(), "string"), ("n_added", pa.int64(), "bigint")]
    if with_redacted:
        fields.append(("redacted", pa.string(), "string"))

    def make():
        fitted = shared.value

        def run(raw):
            texts = [(t or b"").decode() for t in raw]
            out: dict[str, list] = {f[0]: [] for f in fields}
            for i, (base, spans) in enumerate(find(texts, fitted)):
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(show(base).encode()).hexdigest())
                out["spans"].append(show(spans))
                out["n_added"].append(len(spans) - len(base))
                if with_redacted:
                    out["redacted"].append(None if raw[i] is None else redacted(texts[i], spans) if spans else texts[i])
            return out

        return run

    return common.map_texts(docs, keep, text, make, pa.schema([f[:2] for f in fields]), ", ".join(f"{n} {s}" for n, _, s in fields), 1 << 20)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(common.documents(spark, sf_dir, "doc_id", "text"), ["doc_id"])
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
