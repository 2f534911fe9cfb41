"""Sharding along a Hilbert curve, by DataFrame operations alone.

Four metadata dimensions are quantised to 4 bits each: size and ``doc_id`` by their quantiles over all rows, source and
language by hash.  Rows are ordered by their place on the curve, and runs of the order are cut into shards of equal bytes,
so that a shard, and each file within it, covers a compact region of all four dimensions and its min/max statistics
prune on any of them.  Rows of equal text count as one group: they share the place of the group's first row and stay in
one shard, unless the group alone outweighs a hundredth of a shard.

No step sorts or sums all rows in one task: bytes and rows are summed by curve cell (at most 65,536), then by bucket
within a cell, then within a bucket.

Cases: null text has no bytes (size 1) and groups with empty text; null source, language or ``doc_id`` take slot 0; equal
rows get slots of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import new_path, quoted, range_bucket, range_edges, written

BITS, DIMENSIONS = 4, ("source", "lang", "size", "doc_id")
#: Buckets within a curve cell by text hash, and those by doc_id that a large group is split into.
SPREAD, PIECES = 64, 64


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """The n-dimensional Hilbert curve as a machine: digit and next state by state * 2**n + the coordinates' bits.

    A state is the entry corner and the direction of a cell.  Its children come in Gray-code order; each child's own corner
    and direction follow from its place in that order.
    """
    size, full = 1 << n, (1 << n) - 1

    def turn(x: int, k: int) -> int:
        k %= n
        return ((x << k) | (x >> (n - k))) & full if k else x

    def ones(x: int) -> int:
        k = 0
        while x >> k & 1:
            k += 1
        return k

    def place(gray: int) -> int:
        x, k = gray, 1
        while k < n:
            x ^= x >> k
            k *= 2
        return x

    digits, states = [], []
    for corner in range(size):
        for direction in range(n):
            for child in range(size):
                w = place(turn(child ^ corner, n - (direction + 1) % n))
                first = 0 if w == 0 else (m := 2 * ((w - 1) // 2)) ^ (m >> 1)
                along = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
                digits.append(w)
                states.append((corner ^ turn(first, direction + 1)) * n + (direction + along + 1) % n)
    return digits, states


def curve_index(coordinates: list[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of integer coordinates of ``bits`` bits each."""
    n = len(coordinates)
    digits, states = curve_tables(n)
    digit, state = F.array(*map(F.lit, digits)), F.array(*map(F.lit, states))

    def step(acc: Column, plane: Column) -> Column:
        child = sum((F.call_function("shiftright", c, plane).bitwiseAND(F.lit(1)) * F.lit(1 << j) for j, c in enumerate(coordinates)), F.lit(0))
        at = acc["s"] * F.lit(1 << n) + child
        return F.struct(F.get(state, at).alias("s"), (acc["h"] * F.lit(1 << n) + F.get(digit, at)).alias("h"))

    planes = F.array(*(F.lit(b) for b in range(bits - 1, -1, -1)))
    return F.aggregate(planes, F.struct(F.lit(0).alias("s"), F.lit(0).alias("h")), step, lambda acc: acc["h"])


def first_bytes(text: Column) -> Column:
    """The first seven bytes of a string as a number of the same order, so that ranges of it are ranges of strings."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, cell (place on the curve), shard, slot of every row of ``docs`` (doc_id, text, lang, source)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("same"),
    )
    rows = written(rows, "rows")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    groups = rows.groupBy("same", "size").agg(F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("doc_id").alias("first"), F.sum("size").alias("weight"))
    slots = 1 << BITS
    named = rows.select(*(first_bytes(F.col(c)).alias(c) for c in ("source", "lang")))
    place = curve_index([
        range_bucket(first_bytes(F.col("source")), range_edges(named, "source", slots)),
        range_bucket(first_bytes(F.col("lang")), range_edges(named, "lang", slots)),
        range_bucket(F.col("size"), range_edges(rows, "size", slots)),
        range_bucket(F.col("first"), range_edges(rows, "doc_id", slots)),
    ])
    groups = groups.select("same", "size", "weight", place.alias("cell"), (F.col("weight") * F.lit(100 * shards) > F.lit(total)).alias("large"))
    own = F.when(F.col("large"), range_bucket(F.col("doc_id"), range_edges(rows, "doc_id", PIECES))).otherwise(F.lit(0))
    placed = rows.join(groups, ["same", "size"]).withColumn("part", own).withColumn("bucket", F.pmod("same", F.lit(SPREAD)).cast("int"))
    placed = written(placed.select("doc_id", "size", "text_crc32", "same", "weight", "large", "cell", "bucket", "part"), "placed")

    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda df, *by: df.groupBy(*by).agg(F.sum("b").alias("b"), F.sum("r").alias("r"))
    key = ["cell", "bucket", "part"]
    buckets = placed.groupBy(*key).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r"))
    inner = before(Window.partitionBy("cell").orderBy("bucket", "part"))
    outer = before(Window.orderBy("cell"))  # one row a cell: at most 2**16
    cells = sums(buckets, "cell").select("cell", *(F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"{c}0") for c in "br"))
    starts = buckets.select(*key, *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"{c}1") for c in "br")).join(cells, "cell")
    starts = starts.select(*key, (F.col("b0") + F.col("b1")).alias("b"), (F.col("r0") + F.col("r1")).alias("r"))

    each = Window.partitionBy(*key).orderBy("same", "size", "doc_id", "text_crc32")
    whole = Window.partitionBy(*key).orderBy("same", "size")  # its frame takes in all rows of the group
    ranked = placed.join(starts, key)
    ranked = ranked.withColumn("nth", F.row_number().over(each)).withColumn("alone", F.sum("size").over(each.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size") / 2)
    ranked = ranked.withColumn("together", F.sum("size").over(whole) - F.col("weight") / 2)
    middle = F.col("b") + F.when(F.col("large"), F.col("alone")).otherwise(F.col("together"))
    number = F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(max(total, 1))).cast("int"))
    ranked = written(ranked.select("doc_id", "size", "text_crc32", "cell", number.alias("shard"), (F.col("r") + F.col("nth") - 1).alias("at")), "ranked")
    first = ranked.groupBy("shard").agg(F.min("at").alias("from"))  # one row a shard
    return ranked.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "cell", "shard", (F.col("at") - F.col("from")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, folder: str | None = None, files: int = 64) -> str:
    """``docs`` written as one folder a shard (in_shard), in about ``files`` files of runs of the curve, whose statistics prune.

    Returns the folder.
    """
    folder = folder or new_path(docs.sparkSession, "shards")
    # rows of one doc_id, size and text are the same row as often as they are there: they are paired by a number
    twin = ["_id", "_size", "_crc"]
    number = F.row_number().over(Window.partitionBy(*twin).orderBy(F.lit(0))).alias("_nth")
    text = F.coalesce("text", F.lit(""))
    left = docs.select("*", F.struct("doc_id").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc")).select("*", number)
    right = placed.select(F.struct("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).select("*", number)
    out = left.join(right, [*twin, "_nth"]).select(*quoted(docs), F.col("_shard").alias("in_shard"), "_slot")
    out = out.repartitionByRange(max(1, files), "in_shard", "_slot").sortWithinPartitions("in_shard", "_slot").drop("_slot")
    out.write.partitionBy("in_shard").parquet(folder)
    return folder


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """:func:`shard` with the law that holds and the (absent) shard after growth."""
    return shard(docs, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")
