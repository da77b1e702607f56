"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ORDER bytes is counted from a bounded sample
of labelled rows, whole; a byte's probability is its share in the longest context that has it,
times the escape probabilities (method C) of the longer ones, with what those have excluded.  The
statistics are frozen, so a text's code length under every language is a sum of table entries.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text when there
is nothing to learn from; very long texts are counted and coded whole; rows without a language
teach nothing, equal rows teach once; ties go to the first language in order; repeated rows give
equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .contexts import Counter, Tree, costs, grams, merge

ORDER = 3
#: Different rows of each language to learn from at most.
SAMPLE_ROWS = 400
UNKNOWN = "und"


class Model:
    """Frozen statistics of several languages over one set of contexts."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """From each language's distinct grams of ``order`` bytes of context, and their counts."""
        self.languages = sorted(counts)
        counted = [counts[name] for name in self.languages]
        everything = np.unique(np.concatenate([c[0] for c in counted] or [np.zeros(0, np.uint64)]))
        contexts = everything >> np.uint64(8)
        self.tree = Tree([np.unique(contexts & np.uint64((1 << 8 * d) - 1)) if d else np.zeros(1, np.uint64) for d in range(order + 1)])
        seen = np.unique(everything & np.uint64(255)).astype(np.int64)
        self.width = len(seen) + 1  # the last column is any one byte that was never seen
        self.symbol = np.full(256, self.width - 1, np.int64)
        self.symbol[seen] = np.arange(len(seen))
        self.table = np.stack([self._code_lengths(*c) for c in counted], axis=1) if counted else np.zeros((self.tree.size * self.width, 0), np.float32)

    def _code_lengths(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Bits of each (state, byte) for one language."""
        tree, w = self.tree, self.width
        p = np.empty((tree.size, w))
        above = np.full((1, w), 1 / 256)
        for d in range(tree.depth + 1):
            a, b = tree.base[d], tree.base[d + 1]
            rows = tree.find(d, (keys >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)) - a
            n = np.bincount(rows * w + self.symbol[(keys & np.uint64(255)).astype(np.int64)], counts, (b - a) * w).reshape(b - a, w)
            prior = p[tree.parent[a:b]] if d else above
            total, kinds, known = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True), n > 0
            rest = 1 - np.where(known, prior, 0).sum(1, keepdims=True)
            escape = kinds / np.maximum(total + kinds, 1)
            p[a:b] = np.where(total == 0, prior, np.where(known, n / np.maximum(total + kinds, 1), escape * prior / np.maximum(rest, 1e-12)))
        return (-np.log2(np.maximum(p, 1e-30))).astype(np.float32).ravel()

    @classmethod
    def of(cls, texts: dict[str, list[bytes]], order: int = ORDER) -> Model:
        return cls({name: grams((t.lower() for t in own), order, False) for name, own in texts.items()}, order)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        return costs(self.tree, self.table, self.symbol, self.width, [t.lower() for t in texts], False)

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        lettered = [t is not None and has_letter(t.decode()) for t in texts]
        found = iter(self.bits([t for t, ok in zip(texts, lettered, strict=True) if ok]) if self.languages else ())
        out = []
        for ok in lettered:
            if not ok or not self.languages:
                out.append((UNKNOWN, 0.0))
                continue
            bits = next(found)
            best = int(bits.argmin())
            out.append((self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())))
        return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _counted(rows: DataFrame, order: int) -> DataFrame:
    """(lang, keys, counts): grams of whole texts, packed; parts of a count may be in several rows."""
    common.ship(rows.sparkSession)

    def run(batches):
        counters: dict[str, Counter] = {}
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                counters.setdefault(lang, Counter(order, False)).add([text.as_py().lower()])
        parts = [(lang, *c.take()) for lang, c in counters.items()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.string()), pa.array([p[1].tobytes() for p in parts], pa.binary()), pa.array([p[2].astype(np.int64).tobytes() for p in parts], pa.binary())], names=["lang", "keys", "counts"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, keys binary, counts binary")


def learn(rows: DataFrame, order: int = ORDER, sample: int = SAMPLE_ROWS) -> Model:
    """Learn from ``doc_id``, ``text`` and ``lang``: rows of each language drawn by a hash.

    Texts are counted where they are; the driver gets hashes of the drawn rows, and counts.
    """
    rows = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share: Column = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, -(-2 * sample * (1 << 20) // n)))).otherwise(share)
    drawn = rows.withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod("h", F.lit(1 << 20)) < share)
    with common.scratch(rows.sparkSession):
        drawn = common.written(drawn, "drawn").dropDuplicates(["lang", "h"])
        hashes: dict[str, list[int]] = {}
        for r in drawn.select("lang", "h").collect():
            hashes.setdefault(r.lang, []).append(r.h)
        last: Column = F.lit(None)
        for lang, h in hashes.items():
            last = F.when(F.col("lang") == lang, F.lit(sorted(h)[:sample][-1])).otherwise(last)
        parts: dict[str, list] = {}
        if hashes:
            for r in _counted(drawn.where(F.col("h") <= last), order).toLocalIterator():
                parts.setdefault(r.lang, []).append((np.frombuffer(r.keys, np.uint64), np.frombuffer(r.counts, np.int64)))
    return Model({lang: merge(p) for lang, p in parts.items()}, order)


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, lang_pred and score, the share of the language among all by likelihood."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = shared.value.predict

        def run(texts):
            found = predict(texts)
            return {"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

        return run

    return common.map_texts(docs, keep, text, make, pa.schema([("lang_pred", pa.string()), ("score", pa.float64())]), "lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir, "doc_id", "text", "lang")
    model = learn(docs.where(common.remainder() != 0))
    found = identify(docs.withColumn("held_out", common.remainder() == 0), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")
