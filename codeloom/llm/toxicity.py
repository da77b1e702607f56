"""Toxicity by a classifier that is regularised with counterfactuals.

A logistic model over the distinct words of a text, and their beginnings, is fitted to labelled
rows.  Wherever a row mentions a group, terms are swapped for those of other groups, or left out,
and changes of the score are penalised; so a mention of a group is no evidence by itself.  A
lasso chooses among all words: what it must set to zero, whatever the other weights, is left out
beforehand, so the model is that of all words.

Cases: a null text counts as an empty one, which has a score like any other; very long texts are
their distinct words; nothing to learn from gives 0.5 less than any doubt (score 0); a single
class gives its share; a score of 0.5 is predicted 1; rows with the same words and label count
once, labels of the same id all count; repeated rows give equal scores; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, labelled

LASSO, COUNTERFACTUAL, SWAPS, SEED = 1e-3, 2.0, 3, 5
#: Letters of the beginnings that longer words share.
STEMS = (4, 5)
#: Words whose weights a worker remembers.
CACHE_WORDS = 400_000

# Terms that name groups of people, by what they have in common; fixed values.
GROUPS = tuple(
    frozenset(g.split())
    for g in (
        "woman women man men girl girls boy boys female male nonbinary",
        "gay lesbian bisexual straight queer trans transgender homosexual heterosexual lgbt",
        "black white asian african european latino latina hispanic arab indian chinese mexican american native",
        "muslim muslims islam jewish jew jews judaism christian christians catholic catholics hindu hindus buddhist buddhists atheist atheists",
        "immigrant immigrants refugee refugees foreigner foreigners migrant migrants",
        "disabled deaf blind autistic",
        "old young elderly teenager teenagers",
        "femme femmes homme hommes fille filles garçon garçons",
        "homosexuel homosexuelle homosexuels lesbienne lesbiennes bisexuel bisexuelle transgenre hétérosexuel",
        "noir noire noirs blanc blanche blancs asiatique asiatiques africain africaine africains européen arabe arabes indien chinois mexicain américain",
        "musulman musulmane musulmans juif juive juifs chrétien chrétienne chrétiens catholique catholiques hindou hindous bouddhiste athée athées",
        "immigré immigrée immigrés réfugié réfugiée réfugiés étranger étrangère étrangers migrant migrante",
        "handicapé handicapée handicapés sourd sourde aveugle aveugles autiste autistes",
        "frau frauen mann männer mädchen junge jungen",
        "schwul schwule schwuler lesbisch lesbe lesben bisexuell transgender homosexuell heterosexuell",
        "schwarze schwarzer schwarzen weiße weißer asiate asiaten afrikaner europäer araber inder chinese chinesen mexikaner amerikaner",
        "muslim muslime muslima jude jüdin juden christ christin christen katholik katholiken hindu hindus buddhist atheist atheisten",
        "einwanderer flüchtling flüchtlinge ausländer ausländerin ausländern migrant migranten",
        "behindert behinderte behinderter gehörlos taub blind autistisch",
        "mujer mujeres hombre hombres niña niñas niño niños chica chicas chico chicos",
        "gay gays lesbiana lesbianas bisexual transgénero homosexual homosexuales heterosexual",
        "negro negra negros blanco blanca blancos asiático asiática africano africana europeo árabe árabes indio chino mexicano americano",
        "musulmán musulmana musulmanes judío judía judíos cristiano cristiana cristianos católico católica católicos hindú budista ateo ateos",
        "inmigrante inmigrantes refugiado refugiada refugiados extranjero extranjera extranjeros migrante migrantes",
        "discapacitado discapacitada sordo sorda ciego ciega autista autistas",
    )
)
TERMS = frozenset().union(*GROUPS)
#: What a term may be swapped for: the others of the groups it is in.
_OTHERS = {t: sorted(frozenset().union(*(g for g in GROUPS if t in g)) - {t}) for t in sorted(TERMS)}
_find = re.compile(r"[^\W\d_]+").findall


def words(text: str) -> set[str]:
    return set(_find(text.lower()))


def swapped(found: set[str], rng: random.Random, count: int = SWAPS) -> list[set[str]]:
    """The words with the terms for groups exchanged within their kind, and with them left out."""
    terms = sorted(found & TERMS)
    if not terms:
        return []
    return [found - TERMS] + [(found - TERMS) | {rng.choice(_OTHERS[term]) for term in terms} for _ in range(count)]


def features(word: str) -> list[str]:
    """A word and its beginnings; a term for a group has none, so that it can be swapped alone."""
    return [word] if word in TERMS else [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def keys(feature: list[str]) -> np.ndarray:
    """64-bit numbers of features."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(f.encode(), SEED) for f in feature], np.uint64).view(np.int64)


_TERM_NAMES = sorted(TERMS)
_TERM_KEYS = keys(_TERM_NAMES)


@dataclass
class Model:
    """Weights of features and an intercept; ``known`` False when there was nothing to learn from."""

    intercept: float
    weights: dict[int, float]
    known: bool = True
    cache: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def weight(self, word: str) -> float:
        return math.fsum(self.weights.get(k, 0.0) for k in keys(features(word)).tolist())

    def score(self, found: set[str]) -> float:
        if not self.known:
            return 0.0
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in found:
            if w not in cache:
                cache[w] = self.weight(w)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.intercept + math.fsum(map(cache.__getitem__, found))))))


@dataclass
class Problem:
    """Rows as places (row, column) that may repeat; ``change`` has a row for each counterfactual."""

    row: np.ndarray
    column: np.ndarray
    y: np.ndarray
    weight: np.ndarray  # sums to 1
    change: np.ndarray  # over the columns ``terms``
    terms: np.ndarray
    columns: int
    lasso: float = LASSO
    counterfactual: float = COUNTERFACTUAL

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], len(self.y))

    def slopes(self, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        """Of the smooth part, in the weights and in the intercept."""
        d = self.weight * (1 / (1 + np.exp(-np.clip(self.margins(w) + b, -30, 30))) - self.y)
        g = np.bincount(self.column, d[self.row], self.columns)
        if len(self.change):
            g[self.terms] += 2 * self.counterfactual / len(self.change) * (self.change.T @ (self.change @ w[self.terms]))
        return g, float(d.sum())

    def excess(self, w: np.ndarray, g: np.ndarray, lasso: float) -> np.ndarray:
        """How far each weight is from its condition for the optimum."""
        return np.where(w == 0, np.maximum(np.abs(g) - lasso, 0), np.abs(g + lasso * np.sign(w)))

    def loss(self, w: np.ndarray, b: float, lasso: float) -> float:
        m = self.margins(w) + b
        swaps = np.square(self.change @ w[self.terms]).mean() if len(self.change) else 0.0
        return float(self.weight @ (np.logaddexp(0, m) - self.y * m) + self.counterfactual * swaps + lasso * np.abs(w).sum())

    def newton(self, w: np.ndarray, b: float, chosen: np.ndarray, lasso: float) -> tuple[np.ndarray, float]:
        """A step in the chosen weights and the intercept: coordinate descent on the quadratic
        that agrees with the loss here, and as much of it as lowers the loss."""
        place = np.full(self.columns, -1)
        place[chosen] = np.arange(len(chosen))
        keep = place[self.column] >= 0
        x = np.zeros((len(self.y), len(chosen) + 1))
        np.add.at(x, (self.row[keep], place[self.column[keep]]), 1)
        x[:, -1] = 1
        p = 1 / (1 + np.exp(-np.clip(x[:, :-1] @ w[chosen] + b, -30, 30)))
        h = x.T @ (x * (self.weight * np.maximum(p * (1 - p), 1e-5))[:, None])
        g = x.T @ (self.weight * (p - self.y))
        if len(self.change):
            mine = np.flatnonzero(place[self.terms] >= 0)
            at = place[self.terms[mine]]
            swaps = 2 * self.counterfactual / len(self.change) * (self.change.T @ self.change)
            h[np.ix_(at, at)] += swaps[np.ix_(mine, mine)]
            g[at] += swaps[mine] @ w[self.terms]
        old = np.append(w[chosen], b)
        new, slope, bound = old.copy(), g.copy(), np.append(np.full(len(chosen), lasso), 0.0)
        for _ in range(60):
            most = 0.0
            for j in range(len(new)):
                want = new[j] - slope[j] / h[j, j]
                want = np.sign(want) * max(abs(want) - bound[j] / h[j, j], 0.0)
                if (d := want - new[j]) != 0.0:
                    slope += h[j] * d
                    new[j] = want
                    most = max(most, abs(d) * h[j, j])
            if most < 1e-3 * lasso:
                break
        new[:-1][np.abs(new[:-1]) < 1e-9] = 0  # what is left of a difference
        before, share = self.loss(w, b, lasso), 1.0
        while share > 1e-4:
            mixed, after = old + share * (new - old), w.copy()
            after[chosen] = mixed[:-1]
            if self.loss(after, mixed[-1], lasso) <= before:
                return after, float(mixed[-1])
            share /= 2
        return w, b

    def solve(self, near: float = 0.01, turns: int = 40, at_once: int = 100) -> tuple[np.ndarray, float]:
        """Weights and intercept, from the largest lasso with any weight down to the one wanted.

        The weights in use and those that want to be are fitted, until all others want to stay
        at zero; so the optimum is that over all features.
        """
        prior = float(np.clip(self.weight @ self.y, 1e-3, 1 - 1e-3))
        w, b = np.zeros(self.columns), math.log(prior / (1 - prior))
        lasso = max(float(np.abs(self.slopes(w, b)[0]).max(initial=0.0)), self.lasso)
        while True:
            for _ in range(turns):
                g, slope = self.slopes(w, b)
                excess = self.excess(w, g, lasso)
                if max(excess.max(initial=0.0), abs(slope)) <= near * lasso:
                    break
                wanting = np.flatnonzero((w == 0) & (excess > 0))
                wanting = wanting[np.argsort(-excess[wanting], kind="stable")[:at_once]]
                w, b = self.newton(w, b, np.union1d(np.flatnonzero(w), wanting), lasso)
            if lasso <= self.lasso:
                return w, b
            lasso = max(lasso / 2, self.lasso)


def problem(rows: list[tuple[np.ndarray, int, float]], mentions: list[tuple[int, list[str]]], known: np.ndarray, counterfactual: float = COUNTERFACTUAL, lasso: float = LASSO, seed: int = SEED) -> Problem:
    """From (keys, label, weight) of rows and the terms that some of them mention.

    ``known`` are sorted keys; keys beyond them are not looked at.
    """
    y, weight = np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows], np.float64)
    flat = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in rows)])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    there = known[place] == flat
    rng, change = random.Random(seed), []
    at = {t: k for k, t in enumerate(_TERM_NAMES)}
    for _, terms in mentions:
        for other in swapped(set(terms), rng):
            change.append([(at[t], 1.0) for t in sorted(other - set(terms))] + [(at[t], -1.0) for t in sorted(set(terms) - other)])
    dense = np.zeros((len(change), len(_TERM_NAMES)))
    for k, c in enumerate(change):
        for i, v in c:
            dense[k, i] = v
    return Problem(row[there], place[there], y, weight / weight.sum(), dense, np.searchsorted(known, _TERM_KEYS), len(known), lasso, counterfactual)


def fitted(rows: list[tuple[np.ndarray, int, float]], mentions: list[tuple[int, list[str]]], known: np.ndarray, counterfactual: float = COUNTERFACTUAL) -> Model:
    if not rows:
        return Model(0.0, {}, False)
    p = problem(rows, mentions, known, counterfactual)
    if p.y.min() == p.y.max():
        prior = float(np.clip(p.y.mean(), 1e-3, 1 - 1e-3))
        return Model(math.log(prior / (1 - prior)), {})
    w, b = p.solve()
    return Model(b, {int(known[k]): float(w[k]) for k in np.flatnonzero(w)})


def fit(kept: list[tuple[set[str], int, float]], counterfactual: float = COUNTERFACTUAL) -> Model:
    """Fit to (words, label, weight)."""
    rows = [(keys([f for w in sorted(found) for f in features(w)]), y, weight) for found, y, weight in kept]
    total, count = sum(r[2] for r in rows), Counter()
    for k, _, weight in rows:
        for x in k.tolist():
            count[x] += weight / total
    known = np.array(sorted({x for x, n in count.items() if n >= LASSO} | set(_TERM_KEYS.tolist())), np.int64)
    return fitted(rows, [(k, sorted(found & TERMS)) for k, (found, _, _) in enumerate(kept) if found & TERMS], known, counterfactual)


def _measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, the keys of features (one for each word that has it), terms, and a digest of the words."""

    def make():
        known: dict[str, list[int]] = {}

        def run(texts):
            out: dict[str, list] = {"keys": [], "terms": [], "digest": []}
            if len(known) > CACHE_WORDS:
                known.clear()
            for t in texts:
                found = words((t or b"").decode())
                ordered = sorted(found)
                for w in ordered:
                    if w not in known:
                        known[w] = keys(features(w)).tolist()
                out["keys"].append(np.fromiter(chain.from_iterable(map(known.__getitem__, ordered)), np.int64))
                out["terms"].append(sorted(found & TERMS))
                out["digest"].append(hashlib.blake2b(" ".join(ordered).encode(), digest_size=16).digest())
            return out

        return run

    schema = pa.schema([("keys", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("digest", pa.binary())])
    return common.map_texts(docs, keep, "text", make, schema, "keys array<bigint>, terms array<string>, digest binary")


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit to a sample of labelled rows; those with the same words and label count once.

    A feature whose rows weigh less than LASSO has weight zero in any optimum: it is left out
    where the rows are, and the driver gets the others of each row.
    """
    spark = docs.sparkSession
    drawn, sizes = labelled.sample(docs, labels, "toxic")
    with common.scratch(spark):
        rows = common.written(_measured(drawn, ["y"]), "words")
        rows = common.written(rows.groupBy("digest", "y").agg(F.first("keys").alias("keys"), F.first("terms").alias("terms")), "rows")
        counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return Model(0.0, {}, False)
        # Each class weighs what it does among all labels, however many of its rows are drawn or equal.
        total = sum(sizes.values())
        each = {y: sizes[y] / total / n for y, n in counts.items()}
        share = sum(each[y] * n for y, n in counts.items())
        weight = F.sum(F.when(F.col("y") == 1, F.lit(each.get(1, 0.0) / share)).otherwise(F.lit(each.get(0, 0.0) / share)))
        heavy = rows.select("y", F.explode("keys").alias("key")).groupBy("key").agg(weight.alias("w")).where(F.col("w") >= LASSO * (1 - 1e-9))
        known = np.union1d(heavy.select("key").toArrow().column(0).to_numpy(), _TERM_KEYS)
        shared = spark.sparkContext.broadcast(known)

        def run(batches):
            known = shared.value
            for batch in batches:
                lists = batch.column(2)
                made = []
                for i in range(batch.num_rows):
                    k = lists[i].values.to_numpy()
                    at = np.minimum(np.searchsorted(known, k), len(known) - 1)
                    made.append(at[known[at] == k].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int32())), batch.column(3)], names=["digest", "y", "places", "terms"])

        got = rows.select("digest", "y", "keys", "terms").mapInArrow(run, "digest binary, y int, places array<int>, terms array<string>").toArrow().sort_by([("y", "ascending"), ("digest", "ascending")])
    ys = got.column("y").to_pylist()
    kept = [(known[k.values.to_numpy()], y, each[y]) for k, y in zip(got.column("places"), ys, strict=True)]
    mentions = [(i, t) for i, t in enumerate(got.column("terms").to_pylist()) if t]
    return fitted(kept, mentions, known)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def run(texts):
            return {"score": [model.score(words((t or b"").decode())) for t in texts]}

        return run

    found = common.map_texts(docs, keep, text, make, pa.schema([("score", pa.float64())]), "score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text")
    model = learn(docs, common.table(spark, sf_dir, "labels"))
    return score(docs.withColumn("held_out", common.remainder() == 0), model, ["doc_id", "held_out"])
