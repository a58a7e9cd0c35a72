"""The training-data pipeline: each stage reads what its predecessor wrote.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``: the classifier drops what it rejects, of near-duplicates one document stays,
benchmark passages are cut out (or the document goes if they are most of it), secrets are masked, and the last
stage packs what is left into training sequences. Each stage keeps null and odd rows as its operator defines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitlapse.llm import decontaminate, near_dedup, packing, quality_classifier, scan, secrets
from transitlapse.llm.queries import table, tokenizer_file
from transitlapse.session import shared_folder

#: Sequential model training and hashing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    weights = quality_classifier.train(docs, quality_classifier.learnable(table(spark, sf_dir, "labels")))
    plain, names, text = scan.numbered_columns(docs)
    scored = quality_classifier.score(plain, weights, names, text)
    good = scored.where(F.col("score") >= quality_classifier.THRESHOLD)
    return good.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", cut_benchmark),
    ("secret scans", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet in the shared folder and read again."""
    folder, docs = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
