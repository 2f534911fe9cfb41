"""Spans under edits: shifting, dropping, inserting, and the ranges that must be scanned again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OVERLAP = 64
#: Places in a block of running sums.
BLOCK = 65_536
#: Rows of a task where spans meet edits: its sorts take some 2 kB for each.
ROWS = 100_000


def parts(*frames: DataFrame) -> int:
    """Partitions that hold ``ROWS`` rows of these frames each, and as many as the session asks for at least.

    Spans are small in a shuffle and large in a sort, so partitions by bytes, or a fixed number, would give tasks that grow.
    """
    n = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, sum(df.count() for df in frames) // ROWS + 1)


def running(rows: DataFrame, key: str, place: str, order: list[str], sums: list[str], n: int | None = None) -> DataFrame:
    """``rows`` with the columns ``sums`` as running sums within a key by ``place`` and then ``order``, each row's own included.

    Sums run within blocks of ``BLOCK`` places side by side, and over the totals of the blocks before, so one key, however
    long, is not one task.  Keys and places are not null.  ``n``: partitions of the blocks, where the session's are too few.
    """
    block = F.floor(F.col(place) / BLOCK).alias("_block")
    rows = rows.select("*", block)
    if n:
        rows = rows.repartition(n, key, "_block")
    total = rows.groupBy(key, "_block").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    within = Window.partitionBy(key, "_block").orderBy(place, *order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select(*(F.sum(c).over(within).alias(c) if c in sums else c for c in rows.columns))
    own = own.join(total, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_of")))
    return own.select(*((F.col(c) + F.col(f"_{c}")).alias(c) if c in sums else c for c in rows.columns if c != "_block"))


def with_shift(edits: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Edits (key, start, end, inserted) with the shift that those before them cause."""
    delta = F.col("inserted") - (F.col("end") - F.col("start"))
    order = ["end", *(["nth"] if "nth" in edits.columns else [])]
    return running(edits.withColumn("shift", delta), key, "start", order, ["shift"], n).withColumn("shift", (F.col("shift") - delta).cast("long"))


def propagate(spans: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Spans (key, start, end, ...) after non-overlapping edits; those that an edit cuts into are gone.

    An insertion at the end of a span leaves it, one at its start moves it, one inside ends it.  The edits of a key are a
    map that is constant between them: places of spans and edits are sorted together, and what lies before a place is a
    running sum.  A span is cut if more edits begin before its end than end at its start; otherwise those that begin before
    its end move it.  Spans meet the map by place, so the work is that of sorting, and a key with many of either is
    spread out.  Spans of a null key have no edits.
    """
    n = parts(spans, edits)
    delta = F.col("inserted") - (F.col("end") - F.col("start"))
    zero = F.lit(0).cast("long")
    row = lambda at, tag, begun, moved, ended: F.struct(at.cast("long").alias("_at"), F.lit(tag).alias("_tag"), begun.alias("begun"), moved.alias("moved"), ended.alias("ended"))
    one = F.lit(1).cast("long")
    edge = edits.where(F.col(key).isNotNull()).select(key, F.explode(F.array(row(F.col("end"), 0, zero, zero, one), row(F.col("start"), 2, one, delta.cast("long"), zero))).alias("x")).select(key, "x.*")
    edge = edge.groupBy(key, "_at", "_tag").agg(*(F.sum(c).alias(c) for c in ("begun", "moved", "ended")))
    ask = spans.where(F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()).select(key, F.explode(F.array(F.col("start").cast("long"), F.col("end").cast("long"))).alias("_at")).distinct()
    ask = ask.select(key, "_at", F.lit(1).alias("_tag"), *(zero.alias(c) for c in ("begun", "moved", "ended")))
    place = running(edge.union(ask), key, "_at", ["_tag"], ["begun", "moved", "ended"], 2 * n).where("_tag = 1")
    at_start = place.select(F.col(key).alias("_k0"), F.col("_at").alias("_p0"), F.col("ended").alias("_ended")).repartition(n, "_k0", "_p0")
    at_end = place.select(F.col(key).alias("_k1"), F.col("_at").alias("_p1"), F.col("begun").alias("_begun"), F.col("moved").alias("_moved")).repartition(n, "_k1", "_p1")
    place_of = lambda c: F.col(c).cast("long").alias(f"_{c}")
    rows = spans.select("*", place_of("start"), place_of("end")).repartition(n, key, "_start")
    rows = rows.join(at_start, (F.col(key) == F.col("_k0")) & (F.col("_start") == F.col("_p0")), "left").repartition(n, key, "_end").join(at_end, (F.col(key) == F.col("_k1")) & (F.col("_end") == F.col("_p1")), "left")
    whole = F.coalesce(F.col("_begun") <= F.col("_ended"), F.lit(True))
    moved = F.coalesce("_moved", zero)
    return rows.where(whole).select(*((F.col(c) + moved).alias(c) if c in ("start", "end") else F.col("`" + c.replace("`", "``") + "`") for c in spans.columns))


def merged_ranges(ranges: DataFrame, key: str, limit: Column) -> DataFrame:
    """Ranges clamped to 0 .. limit, those that touch joined: key, start, end."""
    inside = lambda c: F.greatest(F.lit(0), F.least(limit, F.col(c)))
    rows = ranges.withColumn("start", inside("start")).withColumn("end", inside("end")).where("end >= start")
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def rescan_ranges(edits: DataFrame, key: str, length: str, overlap: int = OVERLAP, n: int | None = None) -> DataFrame:
    """Where the text after the edits (key, start, end, inserted, <length>) must be scanned again, in ``n`` partitions."""
    shifted = with_shift(edits, key, n)
    if n:
        shifted = shifted.repartition(n, key)
    at = F.col("start") + F.col("shift")
    total = edits.groupBy(key).agg(F.sum(F.col("inserted") - (F.col("end") - F.col("start"))).alias("_total"))
    rows = shifted.join(total, key).select(key, (at - overlap).alias("start"), (at + F.col("inserted") + overlap).alias("end"), (F.col(length) + F.col("_total")).alias("_next"))
    return merged_ranges(rows, key, F.col("_next"))


# ---- boxes: arrays of x0, y0, x1, y1


def box_union(boxes: Column) -> Column:
    side = lambda i, pick: pick(F.transform(boxes, lambda b: F.get(b, i)))
    return F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))


def box_scale(box: Column, scale: Column) -> Column:
    at = lambda i: F.get(box, i) * scale
    return F.array(F.floor(at(0)), F.floor(at(1)), F.ceil(at(2)), F.ceil(at(3)))


def box_clamp(box: Column, width: Column, height: Column) -> Column:
    low = lambda i, size: F.greatest(F.lit(0), F.least(size - 1, F.floor(F.get(box, i))))
    x0, y0 = low(0, width), low(1, height)
    high = lambda i, size, first: F.greatest(first + 1, F.least(size, F.ceil(F.get(box, i))))
    return F.array(x0, y0, high(2, width, x0), high(3, height, y0))


def box_overlap(a: Column, b: Column) -> Column:
    """Shared area over the smaller area."""
    g = F.get
    across = F.greatest(F.lit(0), F.least(g(a, 2), g(b, 2)) - F.greatest(g(a, 0), g(b, 0)))
    down = F.greatest(F.lit(0), F.least(g(a, 3), g(b, 3)) - F.greatest(g(a, 1), g(b, 1)))
    area = lambda x: F.greatest(F.lit(1), (g(x, 2) - g(x, 0)) * (g(x, 3) - g(x, 1)))
    return across * down / F.least(area(a), area(b))
