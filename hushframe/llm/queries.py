"""One query for each operator of this subpackage, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import digest, divergence, hilbert, ledger, licenses, packing, pfor, pst, quality, resample, simhash, warc, wumanber
from .sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where the vocabulary file lies; it is a parameter of the operators and no part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents under a suffix tree learned from six of seven of them."""
    learns = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return pst.score(_table(spark, sf_dir, "documents"), learns)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in patched frame-of-reference files, read back."""
    manifest = pfor.write_token_files(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 2)
    return pfor.read_token_files(pfor.stored(manifest))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of links at four or fewer differing bits."""
    return simhash.near_groups(_table(spark, sf_dir, "documents"), size=4, limit=4)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back through the index."""
    records = warc.read_records(warc.write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents, each a file in a folder of its source and language."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.inherit(licenses.scan(docs, path))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten benchmark words in every document."""
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return wumanber.hit_columns(wumanber.contamination(docs.select("doc_id", "text"), items, window=10))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 1, 4096)


def op8_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of all documents and of their edited texts."""
    return digest.edits(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from labels outside the held-out third."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    learns = quality.learns(F.col("doc_id"))
    scored = quality.scored(docs.select("doc_id", "text"), quality.fit(docs, labels, "quality", learns))
    return scored.select("doc_id", F.coalesce(~learns, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards along a Hilbert curve."""
    return hilbert.sharded(_table(spark, sf_dir, "documents"), 8)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language stand apart, over all documents."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, each different text scanned once."""
    return ledger.secrets(_table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents of 20 words or more, drawn towards the benchmark."""
    return resample.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_token_files": op2_token_files,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_licenses": op5_licenses,
    "op6_decontaminate": op6_decontaminate,
    "op7_pack": op7_pack,
    "op8_digest": op8_digest,
    "op9_quality": op9_quality,
    "op10_hilbert": op10_hilbert,
    "op11_divergence": op11_divergence,
    "op12_secrets": op12_secrets,
    "op13_resample": op13_resample,
}

__all__ = ["ORACLES", "QUERIES", "tokenizer_file"]
