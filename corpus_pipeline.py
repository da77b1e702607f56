"""From raw documents to token ids: filter, deduplicate, decontaminate, redact, encode.

Each stage gets the documents that its predecessor kept, takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again for the next one.  All but the last return
the columns of documents; other columns of the input stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, common, decontaminate, pii, quality, simhash
from codeloom.plans.shipping import ship


def _packed(docs: DataFrame) -> DataFrame:
    """The whole row as one column, so that no column of it can clash with a new one."""
    return docs.select(F.struct("*").alias("_row"), F.col("text"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, learnt from these documents' labels, do not reject."""
    ship(spark)
    model = quality.learn(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return quality.score(_packed(docs), model, ["_row"]).where("predicted = 1").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    ship(spark)
    return simhash.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    ship(spark)
    found = decontaminate.scan(_packed(docs), common.table(spark, sf_dir, "benchmark"), ["_row"])
    return found.where("not contaminated").select("_row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` is counted anew."""
    ship(spark)
    found = pii.detect(_packed(docs), ["_row"], with_redacted=True)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("redacted").alias(c))
        elif c == "n_chars":
            changed = F.length("redacted").cast(docs.schema[c].dataType)
            columns.append(F.when(F.col("spans") == "", F.col("_row.n_chars")).otherwise(changed).alias(c))
        else:
            columns.append(F.col("_row").getField(c).alias(c))
    return found.select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of what they decode to."""
    ship(spark)
    return bpe.encode(docs.select("doc_id", "text"), ["doc_id"])


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", redact),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier and the random field have no form in SQL; a brute-force version checks them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
