"""Packing token pieces into sequences by minimum bin slack.

Lengths lie between 1 and the sequence size, so the whole corpus is described by one count per length.  For each bin the
longest piece left is fixed, and a subset-sum over the lengths that are left (a bit set of reachable sums) finds the
fullest combination to go with it; the combination is then taken out as many times as the counts allow.  The table of
combinations is bounded by the sequence size, whatever the corpus; pieces find their place in it by their rank among
the pieces of their length.

Cases: null text is empty (just the end id); an empty table gives an empty result; equal rows are packed one by one;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .store import written
from .tokens import encoder, runs

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``room``; long lengths are preferred among equals.

    Bit s of the set after a step says that s can be reached with the lengths seen so far; the sets kept before each
    step lead back from the best sum to the lengths used.
    """
    reach, steps, limit = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4 ... copies, so that any number up to the count can be made
            take = min(part, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & limit
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    best, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> best & 1:
            best -= length * take
            used[length] = used.get(length, 0) + take
    return used


def combinations(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a bin and how often each, number of such bins), until no piece is left."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        first = max(left)
        left[first] -= 1
        used = fullest({k: v for k, v in left.items() if v}, size - first)
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((used, times))
    return out


def places(made: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Per length and run of ranks: the first rank, the first bin, pieces a bin, and the offset of the run in its bin."""
    rows, seen, bins = [], {}, 0
    for used, times in made:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, seen.get(length, 0), bins, n, offset))
            seen[length] = seen.get(length, 0) + n * times
            offset += n * length
        bins += times
    return pd.DataFrame(rows, columns=["length", "first_rank", "first_bin", "per_bin", "offset"], dtype="int64")


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """The pieces of every document: only documents longer than ``size`` are cut, at multiples of it.

    ``task`` and ``rank`` number the pieces of a length within a task; the table is stored, so the numbers stay.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer, False), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for a, b in runs(texts):
                ids, lengths = encode(texts[a:b], end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                many = -(-lengths // size)
                doc = np.repeat(np.arange(a, b), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * size
                length = np.minimum(np.repeat(lengths, many) - start, size)
                at = np.repeat(np.cumsum(lengths) - lengths, many) + start
                crc = np.fromiter((zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(at))
                order = np.argsort(length, kind="stable")
                ranked, first = np.empty(len(order), np.int64), np.searchsorted(length[order], length[order])
                ranked[order] = np.arange(len(order)) - first
                ranked += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), task, np.int32)), pa.array(ranked)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096) -> DataFrame:
    """Every piece of ``docs`` (doc_id, text) with its sequence and offset there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    table = written(pieces(docs, tokenizer, end_id, size), "pieces")
    by_task = table.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = written(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    # at most one row a length: bounded by the sequence size
    counts = {int(r["length"]): int(r["n"]) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table_of = places(combinations(counts, size)).sort_values(["length", "first_rank"])
    keys = table_of["length"].to_numpy() * (1 << 48) + table_of["first_rank"].to_numpy()
    plan = spark.sparkContext.broadcast((keys, *(table_of[c].to_numpy() for c in ("first_rank", "first_bin", "per_bin", "offset"))))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, bins, per, offset = plan.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            k = rank - first[row]
            own = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(bins[row] + k // per[row]), pa.array(offset[row] + k % per[row] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    # the counts grow with the number of tasks, and their files look smaller than they are: no broadcast
    ranked = table.join(by_task.select("length", "task", "before").hint("merge"), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
