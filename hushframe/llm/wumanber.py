"""Benchmark decontamination by multi-pattern search over words.

The symbols are words.  Patterns are the windows of the benchmark items; all patterns of a set have at least m words and
are searched by their first m.  A table over blocks of two words says how far the search may move on without missing a
pattern (m - 1 where no pattern holds the block); where it may not move, the bucket of that block lists the
patterns that end in it there, and their words are compared directly.

Cases: a null text has no words; items without words are left out; an item of fewer words than a window is one window;
repeated items each count; a null ``item_id`` is in no list of items, but its windows hit; an empty benchmark hits nothing; other columns are kept and may clash with nothing but the
result columns, which replace them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .store import plain_names, written

#: What stands for a byte before the text is split: letters A-Z in lower case, everything that is no word character a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: runs of digits, letters a-z after folding, and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Search:
    """Tables for patterns of at least two words each, or of one word where ``m`` is 1."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list]):
        self.m = m = min(map(len, patterns))
        self.block = block = 2 if m > 1 else 1
        self.most = m - block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[tuple[bytes, ...], list]]] = {}
        for words, items in patterns.items():
            for end in range(block, m + 1):
                key = b" ".join(words[end - block : end])
                self.shift[key] = min(self.shift.get(key, self.most), m - end)
                if end == m:
                    self.bucket.setdefault(key, []).append((words, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list]]:
        """(start, end, items) of every occurrence of every pattern."""
        n, m, block, most, shift = len(words), self.m, self.block, self.most, self.shift.get
        at = m
        while at <= n:
            key = words[at - 2] + b" " + words[at - 1] if block == 2 else words[at - 1]
            step = shift(key, most)
            if step:
                at += step
                continue
            start = at - m
            first = words[start]
            for pattern, items in self.bucket[key]:
                if pattern[0] == first and tuple(words[start : start + len(pattern)]) == pattern:
                    yield start, start + len(pattern), items
            at += 1


def windows(items: list[tuple[object, str | None]], size: int) -> list[dict[tuple[bytes, ...], list]]:
    """The windows of the items with the items that have them, one set for each length: a short set must not slow a long one."""
    sets: dict[int, dict[tuple[bytes, ...], list]] = {}
    for item, text in items:
        words = words_of(text)
        for a in range(max(1, len(words) - size + 1) if words else 0):
            w = tuple(words[a : a + size])
            own = sets.setdefault(len(w), {}).setdefault(w, [])
            if item not in own:
                own.append(item)
    return [sets[k] for k in sorted(sets)]


SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
#: Characters of benchmark items that are searched for in one pass over the documents; their tables take about 80 times that.
BLOCK_BYTES = 1 << 20


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of bounded size; one partition's worth is on the driver at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def _hits(searches: list[Search], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """The spans of all occurrences, and the items that have them."""
    spans, items = [], set()
    for s in searches:
        for a, b, who in s.find(words):
            spans.append((a, b))
            items.update(str(x) for x in who if x is not None)
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["last"]:
            out[-1]["last"] = max(out[-1]["last"], b)
        else:
            out.append({"first": a, "last": b})
    return out


def _later_hits(rows: DataFrame, tables: Broadcast) -> DataFrame:
    """_row, more_spans, more_items of the rows that a further block of the benchmark hits."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans, items = [], [], []
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found, who = _hits(tables.value, words_of(text))
                if found:
                    rows.append(row)
                    spans.append(_merged(found))
                    items.append(sorted(who))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], ["_row", "more_spans", "more_items"])

    return rows.select("_row", "text").mapInArrow(search, "_row long, more_spans array<struct<`first`:long,`last`:long>>, more_items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with n_words, spans (hit ranges of words, merged), items (ids as sorted strings).

    The benchmark is the query set: it is taken in blocks of bounded size, each searched for in all documents.  Where there
    are several blocks, the documents are stored once with a number for each row; what later blocks hit is kept by that
    number, without its text, and joined in the end.
    """
    spark = docs.sparkSession
    own = ["n_words", "spans", "items"]
    docs = docs.drop(*own)
    plain = plain_names(docs, taken=[*own, "_row", "more_spans", "more_items"])
    names = plain.columns
    blocks = (spark.sparkContext.broadcast([Search(p) for p in windows(block, window)]) for block in _blocks(benchmark))
    first, second = next(blocks), next(blocks, None)
    rows = plain.withColumn("_row", F.lit(0).cast("long"))
    more = []
    if second is not None:
        rows = written(plain.withColumn("_row", F.monotonically_increasing_id()), "rows")
    for tables in chain([second], blocks) if second is not None else ():
        more.append(written(_later_hits(rows, tables), "hits"))
        tables.unpersist()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, found = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                hits, items = _hits(first.value, words)
                counts.append(len(words))
                spans.append(_merged(hits))
                found.append(sorted(items))
            new = [pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*names, "_row"]), *new], [*names, "_row", *own])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(search, f"{kinds}, `n_words` long, `spans` array<struct<`first`:long,`last`:long>>, `items` array<string>")
    if not more:
        return out.drop("_row").toDF(*docs.columns, *own)
    later = reduce(DataFrame.unionByName, more).groupBy("_row").agg(F.flatten(F.collect_list("more_spans")).alias("more_spans"), F.flatten(F.collect_list("more_items")).alias("more_items"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    kind = "array<struct<first:bigint,last:bigint>>"
    spans = F.array_sort(F.concat("spans", none(F.col("more_spans"), kind)))
    joined = F.aggregate(
        spans, F.array().cast(kind),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["first"] <= F.element_at(acc, -1)["last"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], s["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(s))),
    )
    items = F.array_sort(F.array_distinct(F.concat("items", none(F.col("more_items"), "array<string>"))))
    out = out.join(later, "_row", "left").withColumn("spans", joined).withColumn("items", items)
    return out.select(*names, *own).toDF(*docs.columns, *own)


def hit_columns(found: DataFrame) -> DataFrame:
    """The counts and the digest of :func:`contamination`, as columns."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["last"] - x["first"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    """The digest of a list of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
