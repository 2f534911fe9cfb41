"""Relational operators of bounded, expiring stores over immutable tables.

A store is a log of writes and touches; its state is a view of the log.  Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Limits of the stores.
LIMITS = {"verified_items": 10_000, "thread_items": 50_000, "threads": 10_000, "ledger": 100_000}
MAX_AGE_MS = 30 * 24 * 3_600_000


def upsert(log: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """The last write of each key; the first write's time and the number of writes are kept."""
    last = F.max_by(F.struct(*values), F.struct(at, *values)).alias("v")
    return log.groupBy(*keys).agg(F.min(at).alias("created_at"), F.max(at).alias("last_used_at"), F.count(F.lit(1)).alias("writes"), last).select(*keys, "created_at", "last_used_at", "writes", "v.*")


def touched(items: DataFrame, reads: DataFrame, key: str, at: str) -> DataFrame:
    """Items with their reads counted and their last use moved on."""
    used = reads.groupBy(key).agg(F.count(F.lit(1)).alias("hits"), F.max(at).alias("used"))
    out = items.join(used, key, "left")
    return out.withColumn("hit_count", F.coalesce("hits", F.lit(0)).cast("long")).withColumn("last_used_at", F.greatest("last_used_at", "used")).drop("hits", "used")


def unexpired(items: DataFrame, now: Column, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    """Items used within the maximum age."""
    return items.where(F.col("last_used_at") >= now - F.lit(max_age_ms))


def most_recent(items: DataFrame, limit: int, key: str) -> DataFrame:
    """The ``limit`` most recently used items; keys break ties.  A bounded top-k, not a sort of everything."""
    return items.orderBy(F.desc("last_used_at"), F.asc(key)).limit(limit)


def most_recent_per(items: DataFrame, group: str, limit: int, key: str) -> DataFrame:
    """The most recently used items of each group."""
    order = Window.partitionBy(group).orderBy(F.desc("last_used_at"), F.asc(key))
    return items.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def lookup(requests: DataFrame, items: DataFrame, key: str, policy: str, now: Column, max_age_ms: int = MAX_AGE_MS) -> DataFrame:
    """Requests with their cached item, if one of the same key and policy is young enough: adds ``hit``."""
    fresh = unexpired(items, now, max_age_ms).select(key, F.col(policy).alias("_policy"), F.lit(True).alias("_hit"))
    out = requests.join(fresh, key, "left")
    return out.withColumn("hit", F.coalesce(F.col("_hit") & (F.col(policy) == F.col("_policy")), F.lit(False))).drop("_hit", "_policy")


def incomplete(parents: DataFrame, children: DataFrame, targets: DataFrame, key: str, target: str) -> DataFrame:
    """Parents with a child whose target is gone."""
    orphans = children.join(targets, target, "left_anti").select(key).distinct()
    return parents.join(orphans, key, "left_semi")


def without_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """What a cascading delete leaves: children whose parent is still there."""
    return children.join(parents, key, "left_semi")


def fingerprint(entries: DataFrame, group: str, parts: list[str]) -> DataFrame:
    """A digest of each group's rows, whatever their order: of their number and the sums of four 15-digit parts of their digests.

    Sums are added up before the shuffle, so a group of any size is one row a task.
    """
    row = F.sha2(F.concat_ws("\u0000", *parts), 256)
    part = lambda k: F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    sums = [F.sum(part(k)).alias(f"_s{k}") for k in range(4)]
    rows = entries.groupBy(group).agg(*sums, F.count(F.lit(1)).alias("n_entries"))
    line = F.concat_ws(":", F.col("n_entries").cast("string"), *(F.col(f"_s{k}").cast("string") for k in range(4)))
    return rows.select(group, F.sha2(line, 256).alias("fingerprint"), "n_entries")


def mutation_states(log: DataFrame, key: str = "mutation_id") -> DataFrame:
    """The state of each mutation after its operations in order: stage, commit, rollback.

    A pending mutation commits only if the content is as planned, else it is counted as a mismatch; a committed one never
    changes; a rolled back one may be staged again.  ``log``: key, seq, op, planned, actual.
    """
    steps = F.array_sort(F.collect_list(F.struct("seq", "op", "planned", "actual")))

    def step(s: Column, x: Column) -> Column:
        state, op = s["state"], x["op"]
        free = state.isin("missing", "rolled_back")
        fits = x["actual"] == s["planned"]
        new = (
            F.when((op == "stage") & free, "pending")
            .when((op == "commit") & (state == "pending") & fits, "committed")
            .when((op == "rollback") & (state == "pending"), "rolled_back")
            .otherwise(state)
        )
        planned = F.when((op == "stage") & free, x["planned"]).otherwise(s["planned"])
        conflict = (
            ((op == "stage") & state.isin("pending", "committed") & (x["planned"] != s["planned"]))
            | ((op == "commit") & state.isin("pending", "committed") & ~fits)
            | ((op == "rollback") & (state == "committed"))
        )
        return F.struct(new.alias("state"), planned.alias("planned"), (s["conflicts"] + conflict.cast("int")).alias("conflicts"))

    start = F.struct(F.lit("missing").alias("state"), F.lit(None).cast(dict(log.dtypes)["planned"]).alias("planned"), F.lit(0).alias("conflicts"))
    folded = log.groupBy(key).agg(F.aggregate(steps, start, step).alias("s"))
    return folded.select(key, "s.state", "s.conflicts")
