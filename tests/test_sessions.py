"""Session map rules against small cases and a plain search."""

import random

from pyspark.sql import functions as F

from hushframe.operators import sessions as M

ENTRIES = "k string, ord long, placeholder string, original string"


def frame(spark, rows):
    return spark.createDataFrame(rows, ENTRIES)


def plain_known(text, session):
    """Left to right, the longest value at each place; an exact spelling first, then any, an error if two could be meant."""
    values = [(p, p) for p, _ in session]
    for p, o in session:
        if o not in dict(values):
            values.append((o, p))
    values.sort(key=lambda v: (-len(v[0]), v[0]))
    out, at = "", 0
    while at < len(text):
        here = [(v, p) for v, p in values if text[at : at + len(v)].lower() == v.lower()]
        if not here:
            out, at = out + text[at], at + 1
            continue
        size = len(here[0][0])
        same = [(v, p) for v, p in here if len(v) == size]
        exact = [p for v, p in same if v == text[at : at + size]]
        if not exact and len(same) > 1:
            return None, "AMBIGUOUS_KNOWN_VALUE"
        out, at = out + (exact or [same[0][1]])[0], at + size
    return out, None


def test_known_values_are_put_out_like_a_plain_search():
    rng = random.Random(4)
    for _ in range(400):
        words = ["".join(rng.choice("abAB") for _ in range(rng.randint(1, 3))) for _ in range(4)]
        session = [(f"[W_{i}]", w) for i, w in enumerate(words)]
        text = "".join(rng.choice(["a", "B", "ab", " ", "[W_1]", "[w_2]", "x", words[0].swapcase()]) for _ in range(12))
        assert M.KnownValues(session)(text) == plain_known(text, session)


def test_known_values_of_rows(spark):
    rows = [(1, "Ann met ANN and [X_1]", [("[X_1]", "Ann")]), (2, "JO", [("[A_1]", "Jo"), ("[A_2]", "jO")]), (3, None, [("[A_1]", "Jo")]), (4, "none", None), (5, "a", [("", "a"), ("[B_1]", None)])]
    df = spark.createDataFrame(rows, "id int, text string, session array<struct<placeholder:string,original:string>>")
    got = {r["id"]: (r["sanitized"], r["error_code"]) for r in M.sanitize_known(df, "text", "session").collect()}
    assert got == {1: ("[X_1] met [X_1] and [X_1]", None), 2: (None, "AMBIGUOUS_KNOWN_VALUE"), 3: (None, None), 4: ("none", None), 5: ("a", None)}


def brute_held(text, session):
    """Entries that a text holds whatever their case: count without overlaps, and the first place."""
    low, out = text.lower(), []
    for number, placeholder, original in session:
        if (at := low.find(original.lower())) >= 0:
            out.append((number, placeholder, original, low.count(original.lower()), at))
    return out


def test_rows_beside_their_session(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abAB") for _ in range(n))
    sessions = {k: [(i, f"[W_{i}]", word(rng.randint(1, 4))) for i in range(1, 6)] for k in ["hot", *(f"k{i}" for i in range(12))]}
    rows = [("hot", i, word(20)) for i in range(300)] + [(k, i, word(15)) for k in sessions for i in range(3)] + [("alone", 1, "ab"), (None, 2, "ab"), ("k1", 3, None), ("k1", 4, ""), ("k2", 5, "aB" * 40_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, n int, text string, `a.b` int")
    entries = frame(spark, [(k, *e) for k, own in sessions.items() for e in own] + [("k3", 9, "", "x"), ("k3", 10, "y", "y"), (None, 1, "[N_1]", "ab")])
    out = M.beside_session(df, entries, "k", "text")
    assert out.columns == ["k", "n", "text", "a.b", "sanitized", "error_code", "held", "session_size"]
    got = sorted(((r["k"], r["n"], r["text"], r["sanitized"], r["error_code"], [tuple(h) for h in r["held"]], r["session_size"]) for r in out.collect()), key=str)
    want = []
    for k, n, text in rows:
        own = sessions.get(k, [])
        done = (None, None) if text is None else M.KnownValues([e[1:] for e in own])(text)
        want.append((k, n, text, *done, brute_held(text or "", own), len(own)))
    assert got == sorted(want, key=str) and any(r[4] for r in got)


def test_folding_keeps_places():
    from hushframe.functions.known import fold

    for text in ("İstanbul ΟΔΟΣ straße", "ǅ ﬁ İİ", "plain", ""):
        assert len(fold(text)) == len(text)
    assert M.KnownValues([("[P_1]", "οδος")])("İ ΟΔΟΣ x") == ("İ [P_1] x", None)


def test_rules(spark):
    rows = [
        ("fine", 1, "[A_1]", "x"), ("fine", 2, "[A_2]", "x"), ("fine", 3, "", "y"), ("fine", 4, "z", "z"), ("fine", 5, None, "q"),
        ("unsafe", 1, "Constructor", "x"), ("malformed", 1, "[PAI1_EMAIL_12]", "x"), ("case", 1, "[A_1]", "x"), ("case", 2, "[a_1]", "y"),
        ("two", 1, "[A_1]", "x"), ("two", 2, "[A_1]", "y"), ("self", 1, "[A_1]", "x"), ("self", 2, "[B_1]", "[a_1]"),
    ]
    got = {r["k"]: r["error_code"] for r in M.map_errors(frame(spark, rows), "k").collect()}
    assert got == {"unsafe": M.INVALID, "malformed": M.INVALID, "case": M.AMBIGUOUS, "two": M.AMBIGUOUS, "self": M.AMBIGUOUS}
    assert M.map_errors(frame(spark, []), "k").count() == 0


def test_rebasing(spark):
    have = frame(spark, [("k", 1, "[A_1]", "ann"), ("k", 2, "[A_2]", "bob"), ("bad", 1, "[A_1]", "ann")])
    new = frame(spark, [("k", 1, "[A_1]", "cy"), ("k", 2, "[A_9]", "bob"), ("k", 3, "[a_2]", "dee"), ("k", 4, "[A_3]", "eve"), ("bad", 1, "[B_1]", "[a_1]"), ("new", 1, "[A_1]", "x")])
    got = {(r["k"], r["placeholder"]): (r["target"], r["added"], r["error_code"]) for r in M.rebased(new, have, "k").collect()}
    assert got == {
        ("k", "[A_1]"): ("[A_4]", True, None), ("k", "[A_9]"): ("[A_2]", False, None), ("k", "[a_2]"): ("[A_5]", True, None), ("k", "[A_3]"): ("[A_3]", True, None),
        ("bad", None): (None, None, M.AMBIGUOUS), ("new", "[A_1]"): ("[A_1]", True, None),
    }


def test_inheritance_limits(spark):
    current = frame(spark, [("a", 1, "[A_1]", "ann"), ("b", 1, "[A_1]", "ann"), ("c", 1, "[A_1]", "ann")])
    theirs = frame(spark, [("a", 1, "[A_1]", "ann"), ("a", 2, "[A_2]", "bob"), ("b", 1, "[A_1]", "eve"), ("c", 1, "[A_7]", "ann")])
    new, errors = M.inherited(current, theirs, "k")
    assert [(r["k"], r["placeholder"]) for r in new.collect()] == [("a", "[A_2]")]
    assert {r["k"]: r["error_code"] for r in errors.collect()} == {"b": "PLACEHOLDER_COLLISION", "c": "ALIAS_LIMIT"}
    assert M.inherited(current, theirs, "k", most=2)[0].count() == 2


def test_replies_of_models(spark):
    replies = ['{"spans":[{"value":"Ann","type":"PERSON"},{"value":"Ann","type":"PERSON"}]}', '{"spans":[{"value":"Ann","type":"ANY"}]}', '{"spans":[{"value":"Zed","type":"PERSON"}]}', "no json", '{"spans":[]}', None, '{"spans":[{"type":"PERSON"}]}']
    df = spark.createDataFrame([(i, r, "Ann and Ann") for i, r in enumerate(replies)], "id int, reply string, text string")
    spans = M.model_spans(F.col("reply"), F.col("text"))
    got = {r["id"]: (None if r["s"] is None else len(r["s"]), r["d"]) for r in df.select("id", spans.alias("s"), F.transform(M.model_detections(spans, F.col("text")), lambda d: d["start"]).alias("d")).collect()}
    assert got == {0: (1, [0, 8]), 1: (None, None), 2: (None, None), 3: (None, None), 4: (0, []), 5: (None, None), 6: (None, None)}


def test_rows_beside_every_entry(spark):
    sessions = {"hot": ["ab", "ANN", "zed"], "k": ["Bo"], "no rows": ["x"]}
    rows = [("hot", i, "İ Ann " + "ab" * (i % 2)) for i in range(60)] + [("k", 1, "to BO"), ("k", 2, None), ("k", 3, ""), ("no session", 1, "Bo"), (None, 1, "Bo")]
    entries = frame(spark, [(k, i, f"[W_{i}]", o) for k, own in sessions.items() for i, o in enumerate(own)])
    out = M.beside_every_entry(spark.createDataFrame(rows, "k string, n int, text string"), entries, "k", "text")
    got = sorted((tuple(r[c] for c in ("k", "n", "text", "ord", "original", "at")) for r in out.collect()), key=str)
    assert got == sorted(((k, n, x, i, o, None if x is None else x.lower().replace("i̇", "i").find(o.lower()) + 1) for k, n, x in rows for i, o in enumerate(sessions.get(k, []))), key=str)


def test_every_turn_meets_every_entry_of_its_session(spark, sf):
    """A pair that does not occur is a row of its own, not part of a count."""
    from hushframe.plans.catalog import QUERIES

    words = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0)).alias("w")).collect()
    own, turns = {}, {}
    for r in words:
        own.setdefault(r["conv_id"], set()).update(r["w"] or ())
        turns[r["conv_id"]] = turns.get(r["conv_id"], 0) + 1
    n = sum(len(own[c]) * k for c, k in turns.items())
    for name in ("session_valid_entries", "session_casing"):
        rows = QUERIES[name](spark, sf)
        assert rows.count() == rows.select("conv_id", "turn", "placeholder").where("placeholder is not null").distinct().count() == n > 0


def plain_rebased(new, have):
    """Targets of one key's additions, one after another."""
    keeps = {}
    for _, p, o in have:
        keeps.setdefault(o, p)
    names, originals = {p.lower(): o for _, p, o in reversed(have)}, {o.lower() for _, _, o in have}
    taken, out = {x.lower() for _, p, o in (*have, *new) for x in (p, o)}, []
    for number, p, o in sorted(new):
        target = keeps.get(o, p)
        if o not in keeps and (p.lower() in originals or names.get(p.lower(), o) != o):
            kind, n = p[1:-1].upper().rsplit("_", 1)
            n = int(n) + 1
            while f"[{kind}_{n}]".lower() in taken:
                n += 1
            target = f"[{kind}_{n}]"
        taken.add(target.lower())
        out.append((number, p, o, target, o not in keeps))
    return out


def test_long_sessions_are_rebased_like_a_plain_loop(spark):
    rng = random.Random(3)
    sessions = {}
    for k in ("a", "b"):
        have = [(i, f"[{rng.choice('AB')}_{i}]", f"o{i}") for i in rng.sample(range(1, 60), 30)] + [(99, "[B_70]", "[a_75]")]
        sessions[k] = (sorted(have), [(i, f"[{rng.choice('AaBb')}_{rng.randint(1, 80)}]", rng.choice([f"o{i}", f"n{i}", f"[C_{i}]"])) for i in range(1, 50)])
    # one key with so many additions that a fold over arrays of them would not end
    many = 3000
    sessions["long"] = ([(i, f"[A_{i}]", f"o{i}") for i in range(1, many + 1)], [(i, f"[A_{i}]", f"n{i}") for i in range(1, many + 1)])
    have = frame(spark, [(k, *e) for k, (h, _) in sessions.items() for e in h] + [(None, 1, "[A_1]", "x")])
    new = frame(spark, [(k, *e) for k, (_, n) in sessions.items() for e in n] + [(None, 1, "[A_1]", "y")])
    got = sorted(tuple(r[c] for c in ("k", "ord", "placeholder", "original", "target", "added", "error_code")) for r in M.rebased(new, have, "k").collect())
    assert got == sorted((k, *x, None) for k, (h, n) in sessions.items() for x in plain_rebased(n, h))


def test_held_entries_are_passed_on_in_parts_and_looked_for_again(spark):
    """More held entries than one part has, and what sanitized texts still hold."""
    words = ["".join(w) for w in zip(*[iter("abcdefghijklmnopqrstuvwxyz" * 3)] * 3)][:26]
    entries = frame(spark, [("k", i, "[zz]" if i == 3 else f"[W_{i}]", w) for i, w in enumerate(words)] + [("k", 99, "[Q_1]", "zz")])
    rows = [("k", i, " ".join(words)) for i in range(M.HELD // 13)]
    out = M.beside_session(spark.createDataFrame(rows, "k string, n int, text string").repartition(1), entries, "k", "text", again=True)
    got = out.selectExpr("n", "size(held) as held", "transform(left, e -> e.original) as left", "sanitized").distinct().collect()
    assert len(got) == len(rows) and {(r["held"], tuple(r["left"])) for r in got} == {(len(words), ("zz",))}
    plain = M.beside_session(spark.createDataFrame(rows[:3], "k string, n int, text string"), entries, "k", "text", put=False).collect()
    assert {(r["sanitized"], r["error_code"], len(r["held"])) for r in plain} == {(None, None, len(words))}
