"""The append-only lineage log: validation, registries, traversals and recorders."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stored

# Event types.
EVENT_TYPES = [
    "session_created",
    "value_protected",
    "value_derived",
    "placeholder_assigned",
    "transformation",
    "provider_request",
    "provider_response",
    "cache_hit",
    "cache_miss",
    "cache_write",
    "restoration",
    "reveal",
]
# Why an event came about.
REASONS = [
    "session_start", "session_resume", "session_fork", "policy_match", "detector_match", "derived_value", "transformation_output", "identity_assigned", "identity_reused", "policy_application", "sanitization",
    "redaction", "image_masking", "cache_lookup", "cache_write", "cache_refresh", "provider_dispatch", "provider_retry", "provider_completion", "provider_failure", "local_restoration", "response_restore", "explicit_reveal",
]
# Metadata that may be kept, whole numbers and flags.
METADATA_INTS = ["attempt", "byteLength", "durationMs", "itemCount", "restoredCount", "retryCount"]
METADATA_FLAGS = ["cacheHit", "partial", "streaming", "success"]
# The forms of ids and tokens.
IDENTITY = r"\A[a-z][a-z0-9_-]{0,31}:(?:[0-9a-f]{32,128}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[A-Za-z0-9_-]{43,172})\z"
TOKEN = r"\A[A-Za-z0-9][A-Za-z0-9._:/-]{0,127}\z"
IDS = ["parent_event_id", "parent_value_id", "value_id", "placeholder_id", "policy_ref", "transformation_ref", "request_ref", "response_ref", "restoration_ref", "cache_ref"]
TOKENS = ["provider", "operation", "model", "artifact_type", "phase", "transformation"]
# What each type of event must have, must not have, and of what it must have one.
REQUIRED = {
    "value_protected": ["value_id"],
    "value_derived": ["value_id", "parent_value_id", "transformation"],
    "placeholder_assigned": ["value_id", "placeholder_id", "placeholder"],
    "transformation": ["value_id", "transformation"],
    "provider_request": ["provider", "operation", "request_ref"],
    "provider_response": ["provider", "request_ref", "response_ref"],
    "cache_hit": ["cache_ref", "operation"],
    "cache_miss": ["cache_ref", "operation"],
    "cache_write": ["cache_ref", "operation"],
    "restoration": ["restoration_ref"],
    "reveal": ["restoration_ref"],
}
FORBIDDEN = {"session_created": ["value_id", "parent_value_id", "placeholder_id", "placeholder"], "value_protected": ["parent_value_id"]}
EITHER = {"value_protected": ["policy_ref", "transformation"], "restoration": ["value_id", "placeholder_id"], "reveal": ["value_id", "placeholder_id"]}
OPAQUE = r"^[A-Za-z0-9:._-]{8,256}$"
LIMIT, MOST = 10_000, 100_000


def event_error(event_type: Column, event_id: Column, parent: Column, occurred_at: Column) -> Column:
    """Why an event is not accepted, or null."""
    return (
        F.when(event_type.isNull() | ~event_type.isin(EVENT_TYPES), "INVALID_EVENT_TYPE")
        .when(event_id.isNull() | ~event_id.rlike(OPAQUE), "INVALID_EVENT_ID")
        .when((event_type != "session_created") & parent.isNull(), "PARENT_REQUIRED")
        .when(parent == event_id, "SELF_PARENT")
        .when(occurred_at.isNull() | (occurred_at < 0), "INVALID_TIME")
    )


def normal_metadata(metadata: Column) -> Column:
    """A JSON object of metadata with its keys in order, or null where it may not be kept; none at all is the empty object.

    Whole numbers are at least zero and exact in a double; numbers as text count as numbers and null as zero; flags are true
    or false; no other key may be there.
    """
    text = F.coalesce(metadata, F.lit("{}"))
    value = F.try_parse_json(text)
    keys = F.json_object_keys(text)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant"))
    number = lambda k: F.when(kind(k) == "VOID", 0.0).otherwise(F.try_variant_get(value, f"$.{k}", "double"))
    there = lambda k: F.array_contains(keys, k)
    right = F.startswith(F.schema_of_variant(value), F.lit("OBJECT")) & (F.size(F.array_except(keys, F.array(*map(F.lit, METADATA_INTS + METADATA_FLAGS)))) == 0)
    for k in METADATA_INTS:
        n = number(k)
        right = right & (~there(k) | F.coalesce((n >= 0) & (n == F.floor(n)) & (n <= 2**53 - 1), F.lit(False)))
    for k in METADATA_FLAGS:
        right = right & (~there(k) | F.coalesce(kind(k) == "BOOLEAN", F.lit(False)))
    fields = {k: F.when(there(k), number(k).cast("long")) for k in METADATA_INTS} | {k: F.try_variant_get(value, f"$.{k}", "boolean") for k in METADATA_FLAGS}
    return F.when(right, F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))))


def shape_error(events: DataFrame, diagnostics: str = "HUSHFRAME_") -> Column:
    """Why an event of ``events`` is not accepted by itself, or null: the first of its form, its type's fields, its placeholder.

    ``diagnostics`` is what diagnostic codes begin with.  Columns that ``events`` lacks count as null.  Codes name the column: INVALID_..., PARENT_REQUIRED, FORBIDDEN_...,
    MISSING_..., and MISSING_..._OR_... where one of two must be there.
    """
    have = set(events.columns)
    field = lambda c: F.col(f"`{c}`") if c in have else F.lit(None).cast("string")
    kind, at, shown = field("event_type"), field("occurred_at"), field("placeholder")
    rules = [
        (kind.isNull() | ~kind.isin(EVENT_TYPES), "INVALID_EVENT_TYPE"),
        *((field(c).isNull() | ~field(c).rlike(IDENTITY), f"INVALID_{c.upper()}") for c in ("event_id", "session_id")),
        (at.isNull() | (at < 0) | (at > 2**53 - 1), "INVALID_OCCURRED_AT"),
        *((~field(c).rlike(IDENTITY), f"INVALID_{c.upper()}") for c in IDS),
        ((shown == "") | (F.octet_length(shown) > 256) | shown.rlike(r"[\x00-\x1f\x7f]"), "INVALID_PLACEHOLDER"),
        *((~field(c).rlike(TOKEN), f"INVALID_{c.upper()}") for c in TOKENS),
        (field("reason_code").isNull() | ~field("reason_code").isin(REASONS), "INVALID_REASON_CODE"),
        (~field("diagnostic_code").rlike(rf"\A{re.escape(diagnostics)}[A-Z0-9_]{{1,96}}\z"), "INVALID_DIAGNOSTIC_CODE"),
        (normal_metadata(field("metadata")).isNull(), "INVALID_METADATA"),
        ((kind != "session_created") & field("parent_event_id").isNull(), "PARENT_REQUIRED"),
        *(((kind == t) & field(c).isNull(), f"MISSING_{c.upper()}") for t, own in REQUIRED.items() for c in own),
        *(((kind == t) & field(c).isNotNull(), f"FORBIDDEN_{c.upper()}") for t, own in FORBIDDEN.items() for c in own),
        *(((kind == t) & field(a).isNull() & field(b).isNull(), f"MISSING_{a.upper()}_OR_{b.upper()}") for t, (a, b) in EITHER.items()),
        (shown.isNotNull() & field("placeholder_id").isNull(), "MISSING_PLACEHOLDER_ID"),
    ]
    return F.coalesce(*(F.when(broken, code) for broken, code in rules))


def recorded(events: DataFrame, session: str = "session_id") -> DataFrame:
    """Events with a recording time that strictly rises within a session, never before the event's own time.

    max(time, last + 1) over an order is a running maximum of time minus place, plus place.
    """
    order = Window.partitionBy(session).orderBy("occurred_at", "event_id")
    n = F.row_number().over(order)
    rows = events.withColumn("_n", n)
    top = F.max(F.col("occurred_at") - F.col("_n")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("recorded_at", top + F.col("_n")).drop("_n")


def first_seen(events: DataFrame, key: str) -> DataFrame:
    """The registry of a kind of id: the first event of each."""
    own = events.where(F.col(key).isNotNull())
    return own.groupBy(key).agg(F.min(F.struct("occurred_at", "event_id", "session_id")).alias("x")).select(key, F.col("x.event_id").alias("origin_event_id"), F.col("x.session_id").alias("session_id"), F.col("x.occurred_at").alias("created_at"))


def causal_path(events: DataFrame, starts: DataFrame) -> DataFrame:
    """Each start event's ancestors up to its root: start_id, event_id, parent_event_id, depth, error_code.

    Ancestors 1, 2, 4, ... levels up are found by joining the log with itself, so the number of joins is the logarithm of
    the longest path.  A start above which an event is missing (PARENT_NOT_FOUND), or whose path runs in a circle
    (CAUSAL_CYCLE), or that is not in the log (EVENT_NOT_FOUND) has one row with that code instead of a path.  Repeated
    event ids count once.
    """
    log = events.groupBy("event_id").agg(F.min("parent_event_id").alias("parent_event_id"))
    known = log.select(F.col("event_id").alias("parent_event_id"), F.lit(True).alias("_there"))
    log = stored(log.join(known, "parent_event_id", "left").select("event_id", "parent_event_id", (F.col("parent_event_id").isNotNull() & F.col("_there").isNull()).alias("lost")))
    up = stored(log.where("parent_event_id is not null and not lost").select("event_id", F.col("parent_event_id").alias("above")))
    most, steps, hops = log.count(), 1, [up]
    while steps < most and not hops[-1].isEmpty():
        last = hops[-1]
        hops.append(stored(last.join(last.select(F.col("event_id").alias("above"), F.col("above").alias("_next")), "above").select("event_id", F.col("_next").alias("above"))))
        steps *= 2
    # who still has an ancestor as many levels up as there are events goes round in a circle
    circling = hops[-1].select("event_id").distinct() if steps >= most else up.where("false").select("event_id")
    begun = starts.select("event_id").distinct()
    path = begun.join(circling, "event_id", "left_anti").select(F.col("event_id").alias("start_id"), "event_id", F.lit(0).alias("depth"))
    for k in reversed(range(len(hops))):
        further = path.join(hops[k], "event_id").select("start_id", F.col("above").alias("event_id"), (F.col("depth") + (1 << k)).alias("depth"))
        path = stored(path.union(further))
    found = path.join(log, "event_id")
    cut = found.where("lost").select("start_id", F.lit("PARENT_NOT_FOUND").alias("error_code"))
    absent = begun.join(log, "event_id", "left_anti").select(F.col("event_id").alias("start_id"), F.lit("EVENT_NOT_FOUND").alias("error_code"))
    round_ = begun.join(circling, "event_id", "left_semi").select(F.col("event_id").alias("start_id"), F.lit("CAUSAL_CYCLE").alias("error_code"))
    errors = stored(cut.union(absent).union(round_).distinct())
    good = found.join(errors.select("start_id"), "start_id", "left_anti").select("start_id", "event_id", "parent_event_id", "depth", F.lit(None).cast("string").alias("error_code"))
    none = F.lit(None)
    bad = errors.select("start_id", none.cast("string").alias("event_id"), none.cast("string").alias("parent_event_id"), none.cast("int").alias("depth"), "error_code")
    return good.union(bad)
