"""A training-corpus pipeline: quality filter, near-duplicate removal, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

Cases, for every stage: a null text is an empty one; an empty text has a quality score like any other, is a duplicate of
every other empty text, holds no benchmark words and is packed as its end id alone; rows without a ``doc_id`` are never
dropped as duplicates; repeated rows stay if the row that they repeat stays; texts are taken whole, however long; equal
scores and equal lengths are settled by ``doc_id`` or not at all; an empty table gives an empty table; further columns are
dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hushframe.llm import neardup, packing, quality, wumanber
from hushframe.llm.queries import tokenizer_file
from hushframe.llm.store import mark, new_path, release
from hushframe.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.reject(docs, labels).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity of 0.8 or more."""
    ship(spark)
    return neardup.deduplicate(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten benchmark words."""
    items = ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return wumanber.contamination(docs.select(*COLUMNS), items, window=10).where(F.size("spans") == 0).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    ship(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), 1, 4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]
#: Learned weights, fingerprints and tokenizers are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what a stage wrote on its way is deleted once its result is stored."""
    begun = mark()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, keep=path, since=begun)
        docs = spark.read.parquet(path)
    return docs
