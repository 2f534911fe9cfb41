"""Admission of batches of events against a plain log that takes them one at a time."""

import random

from hushframe.operators import admission as A

NAMES = ["event_type", "event_id", "session_id", "parent_event_id", "parent_value_id", "value_id", "placeholder_id", "placeholder", "policy_ref", "transformation", "request_ref", "restoration_ref", "provider", "operation", "reason_code"]
SCHEMA = "position long, occurred_at long, " + ", ".join(f"{c} string" for c in NAMES) + ", `n.x` string, error_code int"


def oid(kind, i):
    return f"{kind}:{i:032x}"


def event(kind, e, s, parent=None, value=None, placeholder=None, above=None, bad=False):
    out = dict.fromkeys(NAMES) | {"event_type": kind, "event_id": oid("event", e), "session_id": oid("session", s), "reason_code": "because" if bad else "redaction"}
    out |= {"parent_event_id": None if parent is None else oid("event", parent), "value_id": None if value is None else oid("value", value), "parent_value_id": None if above is None else oid("value", above)}
    out |= {"placeholder_id": None if placeholder is None else oid("placeholder", placeholder), "placeholder": "[P_1]" if kind == "placeholder_assigned" else None, "policy_ref": oid("policy", 1)}
    return out | {"transformation": "mask", "request_ref": oid("request", e), "restoration_ref": oid("restoration", e), "provider": "local", "operation": "chat"}


class Plain:
    """The log as dictionaries."""

    def __init__(self):
        self.events, self.sessions, self.values, self.placeholders = set(), set(), set(), {}

    def offer(self, e):
        new, origin, assigns = e["event_type"] == "session_created", e["event_type"] in ("value_protected", "value_derived"), e["event_type"] == "placeholder_assigned"
        if e["reason_code"] == "because":
            return "INVALID_REASON_CODE"
        if e["event_id"] in self.events:
            return "DUPLICATE_EVENT"
        if e["parent_event_id"] and e["parent_event_id"] not in self.events:
            return "INVALID_PARENT"
        if new == (e["session_id"] in self.sessions):
            return "DUPLICATE_SESSION" if new else "MISSING_SESSION"
        if e["parent_value_id"] and e["parent_value_id"] not in self.values:
            return "INVALID_PARENT"
        if e["value_id"] and origin == (e["value_id"] in self.values):
            return "DUPLICATE_VALUE" if origin else "MISSING_VALUE"
        if e["placeholder_id"] and assigns == (e["placeholder_id"] in self.placeholders):
            return "DUPLICATE_PLACEHOLDER" if assigns else "MISSING_PLACEHOLDER"
        if e["placeholder_id"] and not assigns and e["value_id"] not in (None, self.placeholders[e["placeholder_id"]]):
            return "PLACEHOLDER_VALUE_MISMATCH"
        self.events.add(e["event_id"])
        if new:
            self.sessions.add(e["session_id"])
        if origin:
            self.values.add(e["value_id"])
        if assigns:
            self.placeholders[e["placeholder_id"]] = e["value_id"]
        return None


def drawn(seed, many):
    """Random events over few ids, so that every rule is broken often and ids are claimed again and again."""
    r, out, taken, plain = random.Random(seed), [], [0], Plain()
    for i in range(many):
        kind = r.choice(["session_created", "value_protected", "value_derived", "placeholder_assigned", "placeholder_assigned", "transformation", "provider_request", "restoration", "restoration"])
        e, s = (i if r.random() < 0.9 else r.randrange(many)), r.randrange(6)
        parent = None if kind == "session_created" else r.choice(taken) if r.random() < 0.9 else r.randrange(many)
        value = None if kind in ("session_created", "provider_request") else r.randrange(30)
        above = r.randrange(30) if kind == "value_derived" else None
        placeholder = r.randrange(12) if kind in ("placeholder_assigned", "restoration") else None
        out.append(event(kind, e, s, parent, value, placeholder, above, bad=r.random() < 0.05))
        if plain.offer(out[-1]) is None:
            taken.append(e)
    return out


def frame(spark, events, start=0):
    return spark.createDataFrame([(start + i * 3, i, *(e[c] for c in NAMES), "x", i) for i, e in enumerate(events)], SCHEMA)


def codes(df):
    return [r["error_code"] for r in df.orderBy("position").collect()]


def test_random_events_beside_a_log(spark):
    plain, before, batch = Plain(), drawn(1, 120), drawn(2, 260)
    log = [e for e in before if plain.offer(e) is None]
    want = [plain.offer(e) for e in batch]
    got = A.admitted(frame(spark, batch, start=-50), log=frame(spark, log))
    assert got.columns == ["position", "occurred_at", *NAMES, "n.x", "error_code"]
    assert codes(got) == want
    assert {"DUPLICATE_EVENT", "INVALID_PARENT", "DUPLICATE_SESSION", "DUPLICATE_VALUE", "MISSING_VALUE", "DUPLICATE_PLACEHOLDER", "MISSING_PLACEHOLDER", "PLACEHOLDER_VALUE_MISMATCH", None} <= set(want)


def test_chains_with_a_bad_middle_lose_their_tails(spark):
    # both chains of parents and of derived values break once; what claims an id again after the break is taken
    batch = [event("session_created", 0, 0)] + [event("provider_request", i, 0, i - 1, bad=i == 30) for i in range(1, 70)]
    batch += [event("value_protected", 100, 0, 0, 0)] + [event("value_derived", 100 + i, 0, 0, i, above=i - 1, bad=i == 20) for i in range(1, 50)]
    batch += [event("value_protected", 200, 0, 0, 20), event("value_derived", 201, 0, 200, 21, above=20), event("provider_request", 30, 0, 29), event("provider_request", 31, 0, 30), event("provider_request", 300, 1, 0)]
    plain = Plain()
    want = [plain.offer(e) for e in batch]
    assert [want.count("INVALID_PARENT"), want.count("INVALID_REASON_CODE"), want[-5:]] == [39 + 29, 2, [None, None, None, None, "MISSING_SESSION"]]
    assert codes(A.admitted(frame(spark, batch))) == want


def test_positions_and_empty_batches(spark):
    one = frame(spark, [event("session_created", 0, 0), event("provider_request", 1, 0, 0), event("provider_request", 2, 0, 1)])
    odd = one.union(one.where("position = 3")).union(one.where("position = 0").selectExpr("cast(null as long) as position", *(f"`{c}`" for c in one.columns[1:])))
    got = {(r["position"], r["event_id"][-1]): r["error_code"] for r in A.admitted(odd).collect()}
    assert got == {(0, "0"): None, (3, "1"): "INVALID_POSITION", (6, "2"): "INVALID_PARENT", (None, "0"): "INVALID_POSITION"}
    assert A.admitted(one.where("false")).collect() == []
    few = one.select("position", "event_id")
    assert {r["error_code"] for r in A.admitted(few).collect()} == {"INVALID_EVENT_TYPE"}
