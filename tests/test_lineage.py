"""Events by the rules of their types, one rule at a time."""

from hushframe.operators import lineage as L

ID = "event:" + "0" * 32


def whole(kind):
    """An event of a type with nothing but what it must have."""
    out = {"event_type": kind, "event_id": ID, "session_id": ID, "occurred_at": 0, "reason_code": "redaction", "parent_event_id": None if kind == "session_created" else ID}
    for c in [*L.REQUIRED.get(kind, []), *L.EITHER.get(kind, [])[:1]]:
        out[c] = "[P_1]" if c == "placeholder" else ID if c in L.IDS else "x"
    return out


def test_each_rule_of_each_type(spark):
    cases = []
    for kind in L.EVENT_TYPES:
        cases.append((whole(kind), None))
        cases += [({**whole(kind), c: None}, "PARENT_REQUIRED" if c == "parent_event_id" else f"MISSING_{c.upper()}") for c in L.REQUIRED.get(kind, []) if c not in L.EITHER.get(kind, [])]
        cases += [({**whole(kind), c: "[P_1]" if c == "placeholder" else ID}, f"FORBIDDEN_{c.upper()}") for c in L.FORBIDDEN.get(kind, [])]
        if kind != "session_created":
            cases.append(({**whole(kind), "parent_event_id": None}, "PARENT_REQUIRED"))
        if kind in L.EITHER:
            a, b = L.EITHER[kind]
            cases.append(({**whole(kind), a: None}, f"MISSING_{a.upper()}" if a in L.REQUIRED[kind] else f"MISSING_{a.upper()}_OR_{b.upper()}"))
            cases.append(({**whole(kind), b: ID if b in L.IDS else "x"}, None))
    hit = whole("cache_hit")
    cases += [({**hit, c: bad}, f"INVALID_{c.upper()}") for c in ["event_id", "session_id", *L.IDS] for bad in ("x", "Event:" + "0" * 32, "event:" + "0" * 31, ID + "\n")]
    cases += [({**hit, c: bad}, f"INVALID_{c.upper()}") for c in L.TOKENS for bad in ("", "a b", "-a", "a" * 129)]
    cases += [({**hit, "event_type": k}, "INVALID_EVENT_TYPE") for k in (None, "error", "")]
    cases += [({**hit, "occurred_at": k}, "INVALID_OCCURRED_AT") for k in (None, -1, 2**53)]
    cases += [({**hit, "placeholder": k, "placeholder_id": ID}, "INVALID_PLACEHOLDER") for k in ("", "a\tb", "é" * 129)]
    cases += [({**hit, "placeholder": "[P_1]"}, "MISSING_PLACEHOLDER_ID"), ({**hit, "reason_code": "because"}, "INVALID_REASON_CODE"), ({**hit, "reason_code": None}, "INVALID_REASON_CODE")]
    cases += [({**hit, "diagnostic_code": "X"}, "INVALID_DIAGNOSTIC_CODE"), ({**hit, "diagnostic_code": "HUSHFRAME_X1"}, None), ({**hit, "metadata": "[]"}, "INVALID_METADATA")]
    names = ["event_type", "event_id", "session_id", *L.IDS, *L.TOKENS, "placeholder", "reason_code", "diagnostic_code", "metadata", "extra.column"]
    rows = [(i, e.get("occurred_at"), *(e.get(c) for c in names)) for i, (e, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, occurred_at long, " + ", ".join(f"`{c}` string" for c in names))
    got = {r["i"]: r["error"] for r in df.select("i", L.shape_error(df).alias("error")).collect()}
    assert [(i, got[i], cases[i]) for i in got if got[i] != cases[i][1]] == []
    few = df.select("event_type", "event_id")
    assert {r[0] for r in few.select(L.shape_error(few)).collect()} == {"INVALID_EVENT_TYPE", "INVALID_EVENT_ID", "INVALID_SESSION_ID"}


def test_metadata(spark):
    cases = {
        None: "{}", "{}": "{}", '{"success":true,"attempt":3}': '{"attempt":3,"success":true}', '{"attempt":"3"}': '{"attempt":3}', '{"attempt":null}': '{"attempt":0}', '{"attempt":3.0}': '{"attempt":3}',
        '{"attempt":3.5}': None, '{"attempt":-1}': None, '{"attempt":9007199254740992}': None, '{"attempt":"x"}': None, '{"success":"true"}': None, '{"success":1}': None, '{"success":null}': None, '{"note":1}': None, "[]": None, "3": None, "x": None, "": None,
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, m string")
    got = {r["i"]: r["x"] for r in df.select("i", L.normal_metadata(df.m).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
