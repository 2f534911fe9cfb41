"""SimHash fingerprints of word shingles and near-duplicate groups.

A fingerprint bit is set if it is set in more than half of the XXH64 values of a text's shingles, repeats counted.
Links come from :mod:`gph`; groups are their connected components.

Cases: a null or wordless text has fingerprint zero and is linked like any other; a text of fewer words than a shingle is
one shingle; equal texts share a fingerprint and so a group; a null ``doc_id`` never names a group unless it is alone in it (then
the group has no name and its rows are kept); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .gph import components, links
from .store import written
from .tokens import runs

SEED = 42
_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The majority bits of consecutive runs of hashes; a run of none gives zero.

    Eight bits of each hash at a time are spread over the bytes of a word; bytes count up to 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    own = counts[full]
    segments = -(-own // 255)
    owner = np.repeat(np.arange(len(full)), segments)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
    starts = (np.cumsum(own) - own)[owner] + 255 * nth
    first = np.flatnonzero(nth == 0)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        bits = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (2 * bits[:, byte] > own).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def mixed(hashes: np.ndarray) -> np.ndarray:
    """A second hash of the same shingles, from the first."""
    with np.errstate(over="ignore"):
        x = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text one after another, and the number of shingles of each text."""
    words: list[bytes] = []
    n = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = words_of(text)
        n[i] = len(own)
        words += own
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    many = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    base = np.repeat(np.cumsum(n) - n, many)
    first = base + np.arange(len(base)) - np.repeat(np.cumsum(many) - many, many)
    last = np.minimum(first + size, base + np.repeat(n, many)) - 1
    parts = map(line.__getitem__, map(slice, starts[first].tolist(), ends[last].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(first)), many


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp (64 bits as a long)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for a, b in runs(texts, 500_000):
                prints = majority(*shingle_hashes(texts[a:b], size)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(prints)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, fp long")


def groups(prints: DataFrame, limit: int, parts: int | None = None) -> DataFrame:
    """Per distinct fingerprint of ``prints`` (doc_id, fp): component_id, the smallest doc_id of its group."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    of = components(links(distinct, limit, parts=parts).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")))
    named = distinct.join(of, distinct["fp"] == of["node"], "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return written(named.join(least, "component").select("fp", "component_id"), "groups")


def near_groups(docs: DataFrame, size: int = 4, limit: int = 4, parts: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    prints = written(fingerprints(docs, size), "fingerprints")
    of = groups(prints, limit, parts=parts)
    return prints.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
