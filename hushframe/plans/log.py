"""Queries of batches that are admitted to the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import admission as A
from .registry import Tables, query

# Events by turn: what a session of each kind of event looks like.
_KINDS = ["session_created", "value_protected", "placeholder_assigned", "provider_request", "value_derived", "restoration", "transformation", "reveal"]

_ADMITTED_SQL = f"""WITH RECURSIVE c AS (SELECT conv_id AS c, turn AS t, conv_id * 1000 + turn AS n, {_KINDS!r}[turn % 8 + 1] AS kind FROM conversations),
    x AS (SELECT n, c, t, c // 4 AS g, row_number() OVER (PARTITION BY c // 4 ORDER BY n) AS k, kind, 'event:' || md5(CASE WHEN c % 9 = 4 AND t = 4 THEN c || '/3' ELSE c || '/' || t END) AS eid, CASE WHEN t > 0 THEN 'event:' || md5(c || '/' || (t - 1)) END AS pid, 'session:' || md5(c::VARCHAR) AS sid,
        CASE WHEN kind IN ('value_protected', 'placeholder_assigned', 'provider_request', 'restoration') THEN 'value:' || md5('v' || c // 2) WHEN kind IN ('value_derived', 'transformation', 'reveal') THEN 'value:' || md5('d' || c) END AS vid,
        CASE WHEN kind = 'value_derived' THEN 'value:' || md5('v' || c // 2) END AS above, CASE WHEN kind IN ('placeholder_assigned', 'restoration', 'reveal') THEN 'placeholder:' || md5('p' || c // 4) END AS hid,
        CASE WHEN c % 5 = 1 AND t = 2 THEN 'INVALID_OPERATION' WHEN c % 11 = 5 AND t = 0 THEN 'INVALID_REASON_CODE' END AS shape FROM c),
    f(g, k, n, eid, code, es, ss, vs, hs) AS (
      SELECT DISTINCT g, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], MAP([]::VARCHAR[], []::VARCHAR[]) FROM x
      UNION ALL
      SELECT g, k, n, eid, code, CASE WHEN code IS NULL THEN list_append(es, eid) ELSE es END, CASE WHEN code IS NULL AND kind = 'session_created' THEN list_append(ss, sid) ELSE ss END,
        CASE WHEN code IS NULL AND kind IN ('value_protected', 'value_derived') THEN list_append(vs, vid) ELSE vs END, CASE WHEN code IS NULL AND kind = 'placeholder_assigned' THEN map_concat(hs, MAP([hid], [vid])) ELSE hs END
      FROM (SELECT x.*, f.es, f.ss, f.vs, f.hs, CASE WHEN shape IS NOT NULL THEN shape WHEN list_contains(es, x.eid) THEN 'DUPLICATE_EVENT' WHEN pid IS NOT NULL AND NOT list_contains(es, pid) THEN 'INVALID_PARENT'
          WHEN kind = 'session_created' AND list_contains(ss, sid) THEN 'DUPLICATE_SESSION' WHEN kind <> 'session_created' AND NOT list_contains(ss, sid) THEN 'MISSING_SESSION' WHEN above IS NOT NULL AND NOT list_contains(vs, above) THEN 'INVALID_PARENT'
          WHEN kind IN ('value_protected', 'value_derived') AND list_contains(vs, vid) THEN 'DUPLICATE_VALUE' WHEN kind NOT IN ('value_protected', 'value_derived') AND vid IS NOT NULL AND NOT list_contains(vs, vid) THEN 'MISSING_VALUE'
          WHEN kind = 'placeholder_assigned' AND list_contains(map_keys(hs), hid) THEN 'DUPLICATE_PLACEHOLDER' WHEN kind <> 'placeholder_assigned' AND hid IS NOT NULL AND NOT list_contains(map_keys(hs), hid) THEN 'MISSING_PLACEHOLDER'
          WHEN hid IS NOT NULL AND list_contains(map_keys(hs), hid) AND vid IS NOT NULL AND hs[hid] <> vid THEN 'PLACEHOLDER_VALUE_MISMATCH' END AS code FROM f JOIN x ON x.g = f.g AND x.k = f.k + 1))
    SELECT n AS position, eid AS event_id, code AS error_code FROM f WHERE k > 0"""


@query("lineage_admitted", _ADMITTED_SQL)
def lineage_admitted(t: Tables) -> DataFrame:
    """Turns as events, offered in order: values are shared by two conversations and placeholders by four, some are spoilt."""
    c, n = F.col("conv_id"), F.col("turn")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (n % 8 + 1).cast("int"))
    ref = lambda name, *of: F.concat(F.lit(f"{name}:"), F.md5(F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in of))))
    value, derived = ref("value", "v", F.floor(c / 2)), ref("value", "d", c)
    first = F.when(kind.isin("value_protected", "placeholder_assigned", "provider_request", "restoration"), value)
    ev = t.conversations.select(
        (c * 1000 + n).alias("position"), (c * 1000 + n).alias("occurred_at"), kind.alias("event_type"), F.when((c % 9 == 4) & (n == 4), ref("event", c, "/3")).otherwise(ref("event", c, "/", n)).alias("event_id"),
        ref("session", c).alias("session_id"), F.when(n > 0, ref("event", c, "/", n - 1)).alias("parent_event_id"), F.when(kind.isin("value_derived", "transformation", "reveal"), derived).otherwise(first).alias("value_id"),
        F.when(kind == "value_derived", value).alias("parent_value_id"), F.when(kind.isin("placeholder_assigned", "restoration", "reveal"), ref("placeholder", "p", F.floor(c / 4))).alias("placeholder_id"),
        F.when(kind == "placeholder_assigned", "[PERSON_1]").alias("placeholder"), F.lit("mask").alias("transformation"), F.lit("local").alias("provider"), F.when((c % 5 == 1) & (n == 2), "a blank").otherwise("chat").alias("operation"),
        *(ref(x, c, "/", n).alias(f"{x}_ref") for x in ("request", "restoration", "policy")), F.when((c % 11 == 5) & (n == 0), "because").otherwise("redaction").alias("reason_code"),
    )
    return A.admitted(ev).select("position", "event_id", "error_code")
