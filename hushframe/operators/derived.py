"""Privacy plans of files after committed mutations, from the plans before them and the geometry of the edits alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored
from .geometry import OVERLAP, parts, propagate, rescan_ranges, running, with_shift

SPAN = ["start", "end", "classification", "reference"]


def _broken(condition: Column) -> Column:
    """Whether any row of a group breaks a rule; nulls do."""
    return F.max(F.coalesce(condition, F.lit(True))).alias("broken")


def _after_previous(rows: DataFrame, keys: list[str], nth: str, start: str, end: Column, n: int) -> DataFrame:
    """``rows`` with ``_after``: whether each begins no earlier than the one before it, numbered from 0 without a gap, ends."""
    before = rows.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col(nth) + 1).alias("_follows"), end.alias("_ended")).groupBy(*(f"_{k}" for k in keys), "_follows").agg(F.max("_ended").alias("_ended"))
    rows, before = rows.repartition(n, nth, *keys), before.repartition(n, "_follows", *(f"_{k}" for k in keys))
    same = F.col(nth) == F.col("_follows")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    after = F.when(F.col(nth) == 0, True).otherwise(F.col(start) >= F.col("_ended"))
    return rows.join(before, same, "left").select(*rows.columns, F.coalesce(after, F.lit(False)).alias("_after"))


def derived_plans(mutations: DataFrame, edits: DataFrame, insertions: DataFrame, plans: DataFrame, spans: DataFrame, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is known of the plans of mutated files: outcomes, spans and the ranges that must still be scanned.

    ``mutations`` have mutation_id, status, operation_type, source_length, next_length, expected_content_hash and
    next_content_hash; ``edits`` mutation_id, nth (0, 1, ...), start, end, inserted, by source positions; ``insertions``
    mutation_id, nth (of the edit), place (0, 1, ... in it), offset, length, classification, reference: what is known of
    inserted texts; ``plans`` content_hash and policy_fingerprint; ``spans`` those and start, end, classification, reference.

    Outcomes have one row for each mutation and each plan of its old content (one of a null policy if there is none):
    mutation_id, policy_fingerprint, status, reason, content_hash, next_length.  Spans have mutation_id,
    policy_fingerprint, start, end, classification, reference; ranges mutation_id, start, end, for mutations with a derived
    outcome.

    Cases: a mutation is ``unavailable`` if it is not committed (mutation_not_committed), if it writes a whole file of
    unknown lengths (full_write_lengths_unknown) or one whose source has no length (source_length_unknown); it is
    ``invalid`` if its id is null or comes again (mutation_repeated), edits are out of order, overlap or leave the source
    (edits_invalid), known insertions do or leave the inserted text (insertions_invalid), or a plan's spans leave the source
    (spans_invalid, this plan only).  A mutation without edits moves nothing; edits and insertions of no mutation are left out.
    """
    # joins with edits and with spans are in partitions of so many rows, not of so many bytes
    n, m = parts(edits), parts(spans)
    columns = ["mutation_id", "status", "operation_type", "source_length", "next_length", "expected_content_hash", "next_content_hash"]
    each = mutations.select(*columns)
    again = each.groupBy("mutation_id").count().where("count > 1").select(F.col("mutation_id").alias("_repeated"), F.lit(True).alias("again"))
    length = each.where("mutation_id is not null").groupBy("mutation_id").agg(F.max("source_length").alias("source_length"))
    place = edits.select("mutation_id", "nth", "start", "end", "inserted").where("mutation_id is not null")

    at = _after_previous(place, ["mutation_id"], "nth", "start", F.col("end"), n).join(length, "mutation_id")
    fine = F.col("_after") & (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("inserted") >= 0) & (F.col("end") <= F.col("source_length"))
    tally = at.groupBy("mutation_id").agg(_broken(~fine), F.count(F.lit(1)).alias("n"), F.max("nth").alias("last"), F.sum(F.col("inserted") - (F.col("end") - F.col("start"))).alias("grown"))
    tally = tally.select("mutation_id", (F.col("broken") | (F.col("n") != F.col("last") + 1)).alias("bad_edits"), "grown")

    own = insertions.select("mutation_id", "nth", "place", "offset", "length", "classification", "reference").where("mutation_id is not null")
    room = place.groupBy("mutation_id", "nth").agg(F.max("inserted").alias("_room"))
    put = _after_previous(own, ["mutation_id", "nth"], "place", "offset", F.col("offset") + F.col("length"), n).join(room, ["mutation_id", "nth"], "left")
    within = F.col("_after") & (F.col("offset") >= 0) & (F.col("length") >= 0) & (F.col("offset") + F.col("length") <= F.col("_room")) & F.col("reference").isNotNull()
    put = put.groupBy("mutation_id").agg(_broken(~within)).select("mutation_id", F.col("broken").alias("bad_insertions"))

    old = plans.select(F.col("content_hash").alias("expected_content_hash"), "policy_fingerprint").distinct()
    planned = each.join(old, "expected_content_hash", "left")
    held = spans.select(F.col("content_hash").alias("expected_content_hash"), "policy_fingerprint", *SPAN).repartition(m, "expected_content_hash").join(each.where("mutation_id is not null").select("mutation_id", "expected_content_hash", "source_length"), "expected_content_hash")
    held = held.join(old.select("expected_content_hash", F.col("policy_fingerprint").alias("_policy")).distinct(), ["expected_content_hash"]).where(F.col("policy_fingerprint").eqNullSafe(F.col("_policy"))).drop("_policy")
    inside = (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.col("source_length")) & F.col("reference").isNotNull()
    out_of = held.groupBy("mutation_id", "policy_fingerprint").agg(_broken(~inside)).where("broken").select(F.col("mutation_id").alias("_m"), F.col("policy_fingerprint").alias("_p"), F.lit(True).alias("bad_spans"))

    rows = planned.join(again, F.col("mutation_id").eqNullSafe(F.col("_repeated")), "left")
    rows = rows.join(tally, "mutation_id", "left").join(put, "mutation_id", "left").join(out_of, (F.col("mutation_id") == F.col("_m")) & F.col("policy_fingerprint").eqNullSafe(F.col("_p")), "left")
    unknown = F.col("source_length").isNull() | (F.col("operation_type") == "write_file") & F.col("next_length").isNull()
    reason = (
        F.when(F.col("again") | F.col("mutation_id").isNull(), "mutation_repeated")
        .when(F.coalesce(F.col("status"), F.lit("")) != "committed", "mutation_not_committed")
        .when((F.col("operation_type") == "write_file") & unknown, "full_write_lengths_unknown")
        .when(F.col("source_length").isNull(), "source_length_unknown")
        .when(F.col("bad_edits"), "edits_invalid")
        .when(F.col("bad_insertions"), "insertions_invalid")
        .when(F.col("bad_spans"), "spans_invalid")
    )
    rows = rows.withColumn("reason", reason)
    state = F.when(F.col("reason").isNull(), "derived").when(F.col("reason").endswith("_invalid") | (F.col("reason") == "mutation_repeated"), "invalid").otherwise("unavailable")
    derived = F.col("reason").isNull()
    # outcomes, and what they admit, are each used several times below
    outcomes = rows.select("mutation_id", "policy_fingerprint", state.alias("status"), "reason", F.when(derived, F.col("next_content_hash")).alias("content_hash"), F.when(derived, F.col("source_length") + F.coalesce("grown", F.lit(0))).cast("long").alias("next_length"))
    outcomes = stored(outcomes)

    good = outcomes.where("status = 'derived'").select("mutation_id", "policy_fingerprint")
    ids = good.select("mutation_id").distinct()
    sound = stored(place.join(ids, "mutation_id", "left_semi"))
    policy = [F.coalesce("policy_fingerprint", F.lit("")).alias("_policy"), F.isnull("policy_fingerprint").alias("_none")]
    of_good = ["mutation_id", "_policy", "_none"]
    kept = held.select("*", *policy).repartition(m, *of_good).join(good.select("mutation_id", *policy).repartition(m, *of_good), of_good, "left_semi")
    kept = stored(kept.select("mutation_id", "policy_fingerprint", *SPAN))
    moved = propagate(kept, sound, "mutation_id")
    shifted = with_shift(sound, "mutation_id", n).select("mutation_id", "nth", (F.col("start") + F.col("shift")).alias("_at")).repartition(n, "mutation_id", "nth")
    start = F.col("_at") + F.col("offset")
    new = own.repartition(n, "mutation_id", "nth").join(shifted, ["mutation_id", "nth"]).repartition(n, "mutation_id").join(good, "mutation_id").select("mutation_id", "policy_fingerprint", start.alias("start"), (start + F.col("length")).alias("end"), "classification", "reference")
    ranges = rescan_ranges(sound.join(length, "mutation_id"), "mutation_id", "source_length", overlap, n)
    return outcomes, moved.union(new), ranges.select("mutation_id", "start", "end")


def composed(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The edits (key, start, end, inserted) that do at once what ``first`` and then ``second`` do.

    ``first`` has positions of the source, ``second`` those of the text between; both do not overlap.  In the text between,
    what either touches is joined into islands; an island's range in the source is what the first edits before and in it
    leave of its bounds, and its new length is its own with what the second edits add.  Edits that meet become one.
    """
    delta = (F.col("inserted") - (F.col("end") - F.col("start"))).cast("long")
    zero = F.lit(0).cast("long")
    one = with_shift(first, key)
    at = F.col("start") + F.col("shift")
    touched = one.select(key, at.alias("start"), (at + F.col("inserted")).alias("end"), delta.alias("_d1"), zero.alias("_d2")).union(second.select(key, F.col("start").cast("long"), F.col("end").cast("long"), zero, delta))
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = touched.withColumn("_new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(key, "_island").agg(F.min("start").alias("_a"), F.max("end").alias("_b"), F.sum("_d1").alias("_d1"), F.sum("_d2").alias("_d2")).withColumn("_sum", F.col("_d1"))
    islands = running(islands, key, "_a", ["_b"], ["_sum"])
    before = F.col("_sum") - F.col("_d1")
    return islands.select(key, (F.col("_a") - before).alias("start"), (F.col("_b") - F.col("_sum")).alias("end"), (F.col("_b") - F.col("_a") + F.col("_d2")).alias("inserted"))
