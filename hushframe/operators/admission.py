"""Admission of a batch of events to the lineage log, with the result of admitting them one at a time in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stored
from .lineage import shape_error

# The types of events by which a value comes to be known.
ORIGINS = ["value_protected", "value_derived"]

FIELDS = ["event_type", "event_id", "session_id", "parent_event_id", "parent_value_id", "value_id", "placeholder_id"]


def _offers(rows: DataFrame) -> DataFrame:
    """The ids that events make known: kind, key, n and the value that a placeholder stands for."""
    kind, none = F.col("event_type"), F.lit(None).cast("string")
    offer = lambda name, when, key, value=none: F.when(when & key.isNotNull(), F.struct(F.lit(name).alias("kind"), key.alias("key"), value.alias("value")))
    c = F.col
    made = F.array(
        offer("event", F.lit(True), c("event_id")),
        offer("session", kind == "session_created", c("session_id")),
        offer("value", kind.isin(ORIGINS), c("value_id")),
        offer("placeholder", kind == "placeholder_assigned", c("placeholder_id"), c("value_id")),
    )
    return rows.select("n", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("n", "x.*")


def _needs(rows: DataFrame) -> DataFrame:
    """The ids that events look up: n, role, kind, key."""
    need = lambda role, kind, key: F.when(F.col(key).isNotNull(), F.struct(F.lit(role).alias("role"), F.lit(kind).alias("kind"), F.col(key).alias("key")))
    made = F.array(
        need("self", "event", "event_id"),
        need("parent", "event", "parent_event_id"),
        need("session", "session", "session_id"),
        need("parent_value", "value", "parent_value_id"),
        need("value", "value", "value_id"),
        need("placeholder", "placeholder", "placeholder_id"),
    )
    return rows.select("n", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("n", "x.*")


def _judged(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Why each row is refused beside the ids known before it, or null: n, code.  The first rule that is broken counts."""
    seen = lambda role: F.coalesce(F.max(F.col("role") == role), F.lit(False)).alias(f"has_{role}")
    roles = ["self", "parent", "session", "parent_value", "value", "placeholder"]
    known = answers.groupBy("n").agg(*map(seen, roles), F.max(F.when(F.col("role") == "placeholder", F.col("value"))).alias("stands_for"))
    own = rows.join(known, "n", "left")
    has = lambda role: F.coalesce(F.col(f"has_{role}"), F.lit(False))
    given = lambda c: F.col(c).isNotNull()
    kind = F.col("event_type")
    rules: list[tuple[Column, str]] = [
        (has("self"), "DUPLICATE_EVENT"),
        (given("parent_event_id") & ~has("parent"), "INVALID_PARENT"),
        ((kind == "session_created") & has("session"), "DUPLICATE_SESSION"),
        ((kind != "session_created") & ~has("session"), "MISSING_SESSION"),
        (given("parent_value_id") & ~has("parent_value"), "INVALID_PARENT"),
        (kind.isin(ORIGINS) & has("value"), "DUPLICATE_VALUE"),
        (~kind.isin(ORIGINS) & given("value_id") & ~has("value"), "MISSING_VALUE"),
        ((kind == "placeholder_assigned") & has("placeholder"), "DUPLICATE_PLACEHOLDER"),
        ((kind != "placeholder_assigned") & given("placeholder_id") & ~has("placeholder"), "MISSING_PLACEHOLDER"),
        (has("placeholder") & given("value_id") & (F.col("stands_for") != F.col("value_id")), "PLACEHOLDER_VALUE_MISMATCH"),
    ]
    return own.select("n", F.coalesce(*(F.when(broken, code) for broken, code in rules)).alias("code"))


def _hops(edges: DataFrame) -> list[DataFrame]:
    """From each row 1, 2, 4, ... links up (n, above), while any row has so many above it."""
    out = [stored(edges)]
    while not out[-1].isEmpty():
        last = out[-1]
        out.append(stored(last.join(last.select(F.col("n").alias("above"), F.col("above").alias("_next")), "above").select("n", F.col("_next").alias("above"))))
    return out[:-1]


def _below(refused: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """``refused`` and every row that has one of them above it, at any distance."""
    for hop in hops:
        refused = stored(refused.union(hop.join(refused.select(F.col("n").alias("above")), "above", "left_semi").select("n")).distinct())
    return refused


def admitted(events: DataFrame, log: DataFrame | None = None, position: str = "position", diagnostics: str = "HUSHFRAME_") -> DataFrame:
    """``events`` with ``error_code``: null for those that the log takes, when each is offered in the order of ``position``.

    An event is refused by its form (:func:`lineage.shape_error`), or because, among what ``log`` holds and what was taken
    before it, its id is there already; its parent, its session or a value or placeholder that it names is not; a session,
    value or placeholder that it creates is; or its placeholder stands for another value.  A refused event makes nothing
    known, so a chain loses its tail, and an id that a refused event claimed may be claimed again.

    All events are judged side by side against the first taken claim of each id, and those below a refused event by its
    parent or parent value fall with it at once, whatever the length of the chain; this is repeated until nothing changes.
    What an event needs lies before it, so there is one result, the sequential one, and the number of rounds is that of
    refusals that depend on refusals other than through such chains.  Ids that many events look up (a session, a common
    value) are dealt over all partitions.

    Cases: a null or repeated position is INVALID_POSITION; columns that ``events`` lacks are null; an ``error_code`` that
    is there is replaced; other columns stay, whatever their names; an empty batch is an empty result; ``log`` is taken
    as it is, in any order.
    """
    spark = events.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    field = lambda df, c: F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
    at = F.col(f"`{position}`").cast("long")
    again = events.where(at.isNotNull()).groupBy(at.alias("n")).count().where("count > 1").select("n", F.lit(True).alias("again"))
    whole = events.select(at.alias("n"), *(field(events, c).alias(c) for c in FIELDS), shape_error(events, diagnostics).alias("shape"))
    whole = whole.where("n is not null").join(again, "n", "left").where("again is null").drop("again")
    whole = stored(whole)
    rows = whole.where("shape is null").drop("shape")
    known = None if log is None else stored(_offers(log.select(F.lit(-(2**63)).cast("long").alias("n"), *(field(log, c).alias(c) for c in FIELDS))).distinct())

    needs = _needs(rows)
    load = needs.groupBy("kind", "key").count()
    share = load.agg(F.sum("count")).first()[0] or 0
    # fewer than ``width`` keys can have more than an even share of all look-ups
    hot = F.broadcast(stored(load.where(F.col("count") * width > share).select("kind", "key", F.lit(True).alias("hot"))))
    needs = stored(needs.join(hot, ["kind", "key"], "left").withColumn("deal", F.when(F.col("hot"), F.pmod(F.xxhash64("n"), F.lit(width))).otherwise(0).cast("int")).drop("hot"))

    def answered(taken: DataFrame) -> DataFrame:
        claims = _offers(taken) if known is None else _offers(taken).union(known)
        first = claims.groupBy("kind", "key").agg(F.min(F.struct("n", "value")).alias("first")).join(hot, ["kind", "key"], "left")
        deals = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(width - 1))).otherwise(F.array(F.lit(0)))
        first = first.select("kind", "key", F.explode(deals).alias("deal"), F.col("first.n").alias("since"), F.col("first.value").alias("value"))
        return needs.join(first, ["kind", "key", "deal"]).where("since < n").select("n", "role", "value")

    chains: list[list[DataFrame]] | None = None
    taken, before, gone = rows, rows.where("false").select("n"), 0
    while True:
        judged = stored(_judged(rows, answered(taken)))
        refused = judged.where("code is not null").select("n")
        now = refused.count()
        # what falls with the same refusals is the same again
        if now == gone and (now == 0 or refused.join(before, "n", "left_anti").isEmpty()):
            break
        if chains is None:
            claims = _offers(rows) if known is None else _offers(rows).union(known)
            sole = claims.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("claims"), F.min("n").alias("above")).where("claims = 1").drop("claims")
            link = lambda role: needs.where(F.col("role") == role).join(sole, ["kind", "key"]).where(F.col("above").between(-(2**63) + 1, F.col("n") - 1)).select("n", "above")
            chains = [_hops(link(role)) for role in ("parent", "parent_value")]
        fallen = refused
        for hops in chains:
            fallen = _below(fallen, hops)
        taken, before, gone = rows.join(fallen, "n", "left_anti"), refused, now

    codes = judged.select("n", "code").union(whole.where("shape is not null").select("n", F.col("shape").alias("code")))
    codes = codes.select(F.col("n").alias("_admitted_n"), F.col("code").alias("_admitted_code"), F.lit(True).alias("_admitted_there"))
    kept = [c for c in events.columns if c.lower() != "error_code"]
    out = events.join(codes, F.col(f"`{position}`").cast("long") == F.col("_admitted_n"), "left")
    code = F.when(F.col("_admitted_there"), F.col("_admitted_code")).otherwise("INVALID_POSITION")
    return out.select(*(F.col("`" + c.replace("`", "``") + "`") for c in kept), code.alias("error_code"))
