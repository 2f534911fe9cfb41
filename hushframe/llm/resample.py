"""Importance resampling towards a target distribution, with an exact distributed draw without replacement.

Features are runs of words, hashed into buckets.  A bucket's gain is the log ratio of its smoothed shares in the target and
in the documents; a document's weight is the floored mean of the gains of its features, read from one array.  Its score adds
Gumbel noise that its id decides, so the highest scores are a draw in proportion to the weights.

The k-th highest score is found by radix selection: the composite key (score down, id up, features up) is read in digits
of ``DIGIT`` bits; each pass counts one digit of the rows that share all digits so far, and follows the count that holds
the k-th.  Rows up to that key alone are sorted by ranges and ranked; the others pass by.

Cases: a null text has no words; a document without features has weight 0; a null id is seeded as an empty one and comes
after all others at equal scores; rows of equal score and id are drawn with fewer features first, and which of entirely
equal rows is drawn makes no difference to the result; a target or a table without rows gives gains by the smoothing alone;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import partitions, written
from .wumanber import words_of

BUCKETS = 10_000
SEED = 2024
#: Bits of a digit of the radix selection: a pass brings at most so many counts (2**DIGIT) to the driver.
DIGIT = 12
#: Different features whose values a task remembers.
MEMORY = 300_000


def features(text: str | None, longest: int = 1) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by one blank."""
    words = words_of(text)
    if longest < 2:
        return words
    return list(chain(words, *(map(b" ".join, zip(*(islice(words, k, None) for k in range(n)), strict=False)) for n in range(2, longest + 1))))


class _Buckets(dict):
    """Feature to bucket, worked out once a feature; forgets all when full."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[feature] = found = crc32(feature) % self.buckets
        return found


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = 1) -> list[int]:
    """How many features of all ``texts`` fall into each bucket: one number a bucket reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, of = [0] * buckets, _Buckets(buckets)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for bucket, n in Counter(map(of.__getitem__, features(text, longest))).items():
                    found[bucket] += n
        own = [(b, n) for b, n in enumerate(found) if n]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in own], pa.int32()), pa.array([n for _, n in own], pa.int64())], ["bucket", "n"])

    sums = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in sums.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    n = len(source)
    s_all, t_all = float(sum(source) + n), float(sum(target) + n)
    return [math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(source, target, strict=True)]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """floor(1000 Gumbel) that the id decides."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, of_bucket: list[int], longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every row."""
    table = docs.sparkSession.sparkContext.broadcast(of_bucket)  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, of = table.value, _Buckets(len(table.value))
        for batch in batches:
            ids, counts, words, weights, scores = batch.column("doc_id").to_pylist(), [], [], [], []
            for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                own = features(text, longest)
                counts.append(len(own))
                words.append(len(own) if longest < 2 else len(words_of(text)))
                weights.append(sum(map(gain.__getitem__, map(of.__getitem__, own))) // len(own) if own else 0)
                scores.append(weights[-1] + noise(doc_id, seed))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, counts, words, weights, scores)], ["doc_id", "n_features", "n_words", "weight", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(weigh, "doc_id long, n_features long, n_words long, weight long, score long")


def keys() -> list[Column]:
    """The composite key of a row, to be taken in ascending order; a null id is the greatest."""
    return [F.bitwise_not("score"), F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("n_features")]


def kth(rows: DataFrame, parts: list[Column], k: int) -> list[int]:
    """The ``k``-th smallest composite key (``k`` from 1) of ``rows``, found digit by digit; exact for any longs.

    Every part is 64 bits; a pass reads the key columns of the rows that are left, and brings 2**DIGIT counts at most.
    """
    found: list[int] = []
    for part in parts:
        low, bits = 0, 64  # the part, moved to start at 0, is low plus a number of so many bits
        while bits:
            step = min(DIGIT, bits)
            bits -= step
            digit = F.shiftrightunsigned(part.bitwiseXOR(F.lit(-(1 << 63))), bits).bitwiseAND(F.lit((1 << step) - 1))
            left = rows
            for p, v in zip(parts, found, strict=False):
                left = left.where(p == F.lit(v))
            # a range of the part itself, which the scan can skip by
            if low or bits + step < 64:
                left = left.where(part.between(F.lit(low - (1 << 63)), F.lit(low + (1 << bits + step) - 1 - (1 << 63))))
            for value, n in sorted(tuple(r) for r in left.groupBy(digit.alias("digit")).count().collect()):
                if k <= n:
                    low += value << bits
                    break
                k -= n
        found.append(low - (1 << 63))
    return found


def at_most(parts: list[Column], values: list[int]) -> Column:
    """Whether a composite key is ``values`` or less."""
    out = F.lit(True)
    for p, v in reversed(list(zip(parts, values, strict=True))):
        out = (p < F.lit(v)) | ((p == F.lit(v)) & out)
    return out


def drawn(rows: DataFrame, share: int = 10, least_words: int = 20) -> DataFrame:
    """``rows`` with their rank among the floor(share N / 100) first of the N rows of at least ``least_words`` words, else null.

    ``rows`` must be stored: it is read once a digit, and again for the result.
    """
    fit = F.col("n_words") >= least_words
    k = share * rows.where(fit).count() // 100
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    parts = keys()
    last = kth(rows.where(fit), parts, k)
    chosen = fit & at_most(parts, last)
    # ranges of the key follow one another; their sizes are one number a range
    dealt = rows.where(chosen).repartitionByRange(partitions(rows.sparkSession), *parts).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "drawn")
    sizes = dealt.groupBy("range").count()
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(*parts)) + F.col("start")
    ranked = dealt.join(F.broadcast(starts), "range").withColumn("rank", rank.cast("long")).drop("range", "start")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))  # beyond k: rows that equal the last one
    return ranked.unionByName(rows.where(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, share: int = 10, least_words: int = 20, buckets: int = BUCKETS, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) of every row of ``docs``."""
    of_bucket = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = written(weighed(docs, of_bucket, longest, seed), "weighed")
    return drawn(rows, share, least_words).select("doc_id", "n_features", "weight", "score", "rank")
