"""Text quality by a sparse rule ensemble.

Boosted trees are grown over statistics of the text; every path from a root to a node is a
conjunctive rule.  A logistic model with lasso weights keeps few of them, and what is left is
compiled into one Spark column expression over the statistics.

Cases: a null text counts as an empty one, whose statistics are 0; nothing to learn from gives
a score of 0.5, and a single class its own share; repeated rows give equal scores; labels of
the same id all count; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

TREES, DEPTH, RATE, BINS, LEAST = 60, 3, 0.2, 24, 20
LASSO = 0.002
SEED = 11
#: A document is kept from this score on.
KEEP = 0.3

# Frequent words of several languages, fixed values.
FUNCTION_WORDS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec ce dans de des du en est et il la le les par pas pour qui que sur un une "
    "als auf das dem den der die ein eine für ist mit nicht sich sind und von zu "
    "al como con del el es esta las los no para por se su una y".split()
)
_WORDS = frozenset(w.encode() for w in FUNCTION_WORDS)

STATISTICS = ("bytes", "words", "lines", "word_length", "longest_word", "upper", "digit", "space", "mark", "symbol", "bar", "bang", "high", "distinct", "top_word", "function", "line_words", "repeated_lines", "sentence", "marked_words", "capital_words", "odd_bytes")

_CLASSES = {"upper": range(0x41, 0x5B), "digit": range(0x30, 0x3A), "space": (9, 10, 11, 12, 13, 32), "mark": b".,;:'\"()-?", "symbol": [b for b in b"#$%&*+/<=>@[\\]^_`{|}~"], "bar": b"|", "bang": b"!", "high": range(0x80, 0x100), "odd_bytes": [*range(9), *range(14, 32), 127]}
_SUMS = np.zeros((256, len(_CLASSES)), np.int64)
for _k, _v in enumerate(_CLASSES.values()):
    _SUMS[list(_v), _k] = 1


def statistics(text: bytes | None) -> list[float]:
    """Values of STATISTICS for one text."""
    text = text or b""
    n = max(1, len(text))
    share = dict(zip(_CLASSES, (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _SUMS).tolist(), strict=True))
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    tally = Counter(words)
    m, k = max(1, len(words)), max(1, len(lines))
    function = sum(c for w, c in tally.items() if w.lower().rstrip(b".,") in _WORDS)
    marked = sum(c for w, c in tally.items() if w[-1:] in b"#$%&*!|" and w[-2:-1] in b"#$%&*!")
    capitals = sum(c for w, c in tally.items() if w.isupper() and len(w) > 1)
    return [
        len(text), len(words), len(lines), sum(map(len, words)) / m, max(map(len, words), default=0), share["upper"] / n, share["digit"] / n, share["space"] / n, share["mark"] / n, share["symbol"] / n, share["bar"] / n,
        share["bang"] / n, share["high"] / n, len(tally) / m, max(tally.values(), default=0) / m, function / m, len(words) / k, 1 - len(set(lines)) / k if lines else 0.0, sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, marked / m, capitals / m, share["odd_bytes"] / n,
    ]


# --- rules --------------------------------------------------------------------------------

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, threshold): all must hold


def _tree(bins: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, weight: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int) -> tuple[list[Rule], np.ndarray]:
    """Rules of a regression tree, and its value for every row of ``bins``."""
    value, rules = np.zeros(len(bins)), []

    def grow(mine: np.ndarray, everyone: np.ndarray, path: Rule) -> None:
        w, t = weight[mine], target[mine]
        value[everyone] = (w @ t) / max(w.sum(), 1e-9)
        if path:
            rules.append(path)
        if len(path) == depth or len(mine) < 2 * LEAST:
            return
        best = (1e-9, -1, -1)
        for f in features:
            b, size = bins[mine, f], len(cuts[f]) + 1
            if size < 2:
                continue
            n, ww, wt = (np.cumsum(np.bincount(b, x, size))[:-1] for x in (None, w, w * t))
            left, right = np.maximum(ww, 1e-9), np.maximum(w.sum() - ww, 1e-9)
            gain = wt**2 / left + ((w @ t) - wt) ** 2 / right - (w @ t) ** 2 / max(w.sum(), 1e-9)
            gain[(n < LEAST) | (len(mine) - n < LEAST)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(f), k)
        _, f, k = best
        if f < 0:
            return
        for above in (False, True):
            grow(mine[(bins[mine, f] > k) == above], everyone[(bins[everyone, f] > k) == above], (*path, (f, above, float(cuts[f][k]))))

    grow(rows, np.arange(len(bins)), ())
    return rules, value


def _simple(rule: Rule) -> Rule:
    """One bound of either kind for each statistic."""
    low: dict[int, float] = {}
    high: dict[int, float] = {}
    for f, above, cut in rule:
        if above:
            low[f] = max(cut, low.get(f, cut))
        else:
            high[f] = min(cut, high.get(f, cut))
    return tuple(sorted([(f, True, c) for f, c in low.items()] + [(f, False, c) for f, c in high.items()]))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept is free."""
    weight = weight / weight.sum()
    z1 = np.concatenate((np.ones((len(z), 1)), z), axis=1)
    step = 4 / max(1e-9, np.linalg.norm(z1 * np.sqrt(weight)[:, None], 2) ** 2)
    w = v = np.zeros(z1.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z1 @ v, -40, 40)))
        new = v - step * (z1.T @ (weight * (p - y)))
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


@dataclass
class Ensemble:
    """An intercept and weighted rules over named statistics."""

    intercept: float
    rules: list[tuple[Rule, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            s += w * holds(rule, x)
        return 1 / (1 + np.exp(-s))

    def column(self, statistic=lambda f: F.col(STATISTICS[f])) -> Column:
        """The score as one expression."""
        s: Column = F.lit(self.intercept)
        for rule, w in self.rules:
            test: Column = F.lit(True)
            for f, above, cut in rule:
                test = test & ((statistic(f) > cut) if above else (statistic(f) <= cut))
            s = s + F.when(test, w).otherwise(0.0)
        return 1 / (1 + F.exp(-s))

    def text(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{STATISTICS[f]} {'>' if a else '<='} {c:.4g}" for f, a, c in rule) for rule, w in self.rules]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, penalty: float = LASSO, seed: int = SEED) -> Ensemble:
    """Grow trees on halves of the rows, take their paths as rules, keep those the lasso wants."""
    if not len(y):
        return Ensemble(0.0, [])
    prior = float(np.clip((weight @ y) / weight.sum(), 1e-3, 1 - 1e-3))
    base = math.log(prior / (1 - prior))
    if len(set(y.tolist())) < 2:
        return Ensemble(base, [])
    order = np.lexsort(x.T[::-1])  # the order in which rows came does not matter
    x, y, weight = x[order], y[order], weight[order]
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    s, rules = np.full(len(y), base), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-s))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        features = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False))
        found, value = _tree(bins, cuts, y - p, weight, rows, features, depth)
        s = s + RATE * 4 * value
        for r in found:
            rules.setdefault(_simple(r), None)
    kept, columns, known = [], [], set()
    for r in rules:
        c = holds(r, x)
        if LEAST <= c.sum() <= len(c) - LEAST and (code := c.tobytes()) not in known:
            known.add(code)
            kept.append(r)
            columns.append(c)
    if not kept:
        return Ensemble(base, [])
    intercept, w = lasso_logistic(np.stack(columns, axis=1).astype(np.float64), y.astype(np.float64), weight, penalty)
    return Ensemble(intercept, [(r, float(v)) for r, v in zip(kept, w, strict=True) if abs(v) > 1e-6])


# --- the operator -------------------------------------------------------------------------


def with_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and a double column for each statistic."""

    def make():
        def run(texts):
            rows = [statistics(t) for t in texts]
            return {name: [float(r[k]) for r in rows] for k, name in enumerate(STATISTICS)}

        return run

    return common.map_texts(docs, keep, text, make, pa.schema([(s, pa.float64()) for s in STATISTICS]), ", ".join(f"{s} double" for s in STATISTICS))


def learn(docs: DataFrame, labels: DataFrame) -> Ensemble:
    drawn, sizes = labelled.sample(docs, labels, "quality")
    rows = with_statistics(drawn, ["doc_id", "y"]).toArrow()
    y = rows.column("y").to_numpy()
    x = np.stack([rows.column(s).to_numpy() for s in STATISTICS], axis=1) if len(y) else np.zeros((0, len(STATISTICS)))
    # Each class weighs what it does among all labels.
    weights = {k: sizes[k] / n for k, n in zip(*np.unique(y, return_counts=True), strict=True)}
    return fit(x, y, np.array([weights[v] for v in y], np.float64))


def score(docs: DataFrame, model: Ensemble, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, score and predicted."""
    found = with_statistics(docs, keep, text).select(*keep, model.column().alias("score"))
    return found.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", common.remainder() == 0), model, ["doc_id", "held_out"])
