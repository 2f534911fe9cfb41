"""Plans after mutations against plain edits of texts, and against a scan of the whole new text."""

import random
import re

from pyspark.sql import functions as F

from hushframe.operators import derived as D, geometry as G

M = "mutation_id long, status string, operation_type string, source_length long, next_length long, expected_content_hash string, next_content_hash string"
E = "mutation_id long, nth int, start long, end long, inserted long"
I = "mutation_id long, nth int, place int, offset long, length long, classification string, reference string"
S = "content_hash string, policy_fingerprint string, start long, end long, classification string, reference string"
CODE = re.compile(r"#[0-9]{4}#")


def edits_of(r, text):
    """Ordered edits with their new texts; some insert at one place twice, some delete only."""
    out, at = [], 0
    while at < len(text) and len(out) < 12:
        start = min(len(text), at + r.randrange(0, 60))
        end = min(len(text), start + r.choice([0, 0, 3, 15]))
        out.append((start, end, r.choice(["", "ab", "x #1234# y", "#77", "#0001##0002#"])))
        at = end
    return out


def applied(text, edits):
    out, at = [], 0
    for s, e, new in edits:
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:]


def codes(text, a=0, b=None):
    return [(m.start(), m.end()) for m in CODE.finditer(text[: len(text) if b is None else b], a)]


def test_derived_plan_and_scanned_ranges_are_a_scan_of_the_new_text(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["a", " ", "bc", "#4321#", "#12"]) for _ in range(r.choice([0, 5, 200, 600]))) for _ in range(30)]
    changes = [edits_of(r, x) for x in texts]
    after = [applied(x, c) for x, c in zip(texts, changes)]
    muts = [(i, "committed", "replace_in_file", len(x), None, f"old{i}", f"new{i}") for i, x in enumerate(texts)]
    edits = [(i, n, s, e, len(new)) for i, c in enumerate(changes) for n, (s, e, new) in enumerate(c)]
    put = [(i, n, p, a, b - a, "code", f"new{i}") for i, c in enumerate(changes) for n, (_, _, new) in enumerate(c) for p, (a, b) in enumerate(codes(new))]
    spans = [(f"old{i}", "p", a, b, "code", f"old{i}") for i, x in enumerate(texts) for a, b in codes(x)]
    plans = spark.createDataFrame([(f"old{i}", "p") for i in range(30)], "content_hash string, policy_fingerprint string")
    old = G.BLOCK
    G.BLOCK = 64  # so that keys have many blocks
    try:
        outcomes, found, ranges = D.derived_plans(spark.createDataFrame(muts, M), spark.createDataFrame(edits, E), spark.createDataFrame(put, I), plans, spark.createDataFrame(spans, S), overlap=8)
        outcomes, found, ranges = outcomes.collect(), found.collect(), ranges.collect()
    finally:
        G.BLOCK = old
    assert [(x["status"], x["next_length"], x["content_hash"]) for x in sorted(outcomes, key=lambda x: x["mutation_id"])] == [("derived", len(y), f"new{i}") for i, y in enumerate(after)]
    for i, new in enumerate(after):
        kept = {(x["start"], x["end"]) for x in found if x["mutation_id"] == i}
        assert {new[a:b][0] + new[a:b][-1] for a, b in kept} <= {"##"} and all(CODE.fullmatch(new[a:b]) for a, b in kept)
        scanned = {(m.start() + x["start"], m.end() + x["start"]) for x in ranges if x["mutation_id"] == i for m in re.finditer("(?=(#[0-9]{4}#))", new[x["start"] : x["end"]]) for m in [re.compile(CODE.pattern).match(new[x["start"] : x["end"]], m.start())]}
        every = {(m.start(1), m.end(1)) for m in re.finditer("(?=(#[0-9]{4}#))", new)}
        assert set(codes(new)) <= kept | scanned <= every


def test_composed_edits_do_what_two_steps_do(spark):
    r = random.Random(9)
    texts = ["".join(r.choice("abcdefgh") for _ in range(r.choice([0, 3, 80, 300]))) for _ in range(40)]
    one = [edits_of(r, x) for x in texts]
    mid = [applied(x, c) for x, c in zip(texts, one)]
    two = [edits_of(r, x) for x in mid]
    end = [applied(x, c) for x, c in zip(mid, two)]
    rows = lambda changes: spark.createDataFrame([(i, n, s, e, len(new)) for i, c in enumerate(changes) for n, (s, e, new) in enumerate(c)], E.replace("mutation_id", "k"))
    both = D.composed(rows(one), rows(two), "k")
    got = {}
    for x in sorted(both.collect()):
        got.setdefault(x["k"], []).append((x["start"], x["end"], x["inserted"]))
    for i, text in enumerate(texts):
        out, at = [], 0
        for s, e, n in got.get(i, []):
            assert at <= s <= e <= len(text) and n >= 0
            out.append(text[at:s])
            here = sum(map(len, out))
            out.append(end[i][here : here + n])
            at = e
        assert "".join(out) + text[at:] == end[i]
    spans = spark.createDataFrame([(i, a, b) for i, x in enumerate(texts) for a in range(0, len(x), 3) for b in (a + 1, a + 4) if b <= len(x)], "k long, start long, end long").withColumn("a b.c", F.col("start"))
    steps = G.propagate(G.propagate(spans, rows(one), "k"), rows(two), "k")
    once = G.propagate(spans, both, "k")
    assert steps.columns == ["k", "start", "end", "a b.c"]
    assert sorted(map(tuple, steps.collect())) == sorted(map(tuple, once.collect()))


def test_outcomes(spark):
    m = lambda i, status="committed", kind="replace_in_file", length=10, nxt=None: (i, status, kind, length, nxt, "h", "n")
    muts = [m(1), m(2, "pending"), m(3, kind="write_file"), m(4, length=None), m(5), m(6), m(7), m(8), m(8), m(None), m(9, kind="write_file", nxt=4), m(10, status=None), m(11, length=3)]
    edits = [(1, 0, 2, 4, 5), (5, 0, 2, 4, 0), (5, 1, 3, 5, 0), (6, 0, 2, 4, 3), (7, 1, 2, 4, 3), (9, 0, 0, 10, 4), (99, 0, 0, 1, 1), (None, 0, 0, 1, 1)]
    put = [(1, 0, 0, 0, 2, "c", "r1"), (1, 0, 1, 2, 3, "c", "r2"), (6, 0, 0, 2, 2, "c", "r3"), (99, 0, 0, 0, 1, "c", "r")]
    spans = [("h", "p", 0, 2, "c", "a"), ("h", "p", 3, 5, "c", "b"), ("h", "p", 6, 6, "c", "d"), ("h", None, 0, 1, "c", "e")]
    plans = spark.createDataFrame([("h", "p"), ("h", None), ("h", "p")], "content_hash string, policy_fingerprint string")
    outcomes, found, ranges = D.derived_plans(spark.createDataFrame(muts, M), spark.createDataFrame(edits, E), spark.createDataFrame(put, I), plans, spark.createDataFrame(spans, S))
    rows = outcomes.collect()
    got = {(x["mutation_id"], x["policy_fingerprint"]): (x["reason"] or x["next_length"]) for x in rows}
    same = {1: 13, 2: "mutation_not_committed", 3: "full_write_lengths_unknown", 4: "source_length_unknown", 5: "edits_invalid", 6: "insertions_invalid", 7: "edits_invalid", 8: "mutation_repeated", None: "mutation_repeated", 9: 4, 10: "mutation_not_committed"}
    assert got == {(i, p): v for i, v in same.items() for p in ("p", None)} | {(11, "p"): "spans_invalid", (11, None): 3}
    assert sorted((x["mutation_id"], x["policy_fingerprint"] or "", x["start"], x["end"], x["reference"]) for x in found.collect()) == [
        (1, "", 0, 1, "e"), (1, "", 2, 4, "r1"), (1, "", 4, 7, "r2"), (1, "p", 0, 2, "a"), (1, "p", 2, 4, "r1"), (1, "p", 4, 7, "r2"), (1, "p", 9, 9, "d"), (11, "", 0, 1, "e"),
    ]
    assert sorted(map(tuple, ranges.collect())) == [(1, 0, 13), (9, 0, 4)]


def test_partitions_grow_with_the_rows(spark, monkeypatch):
    """Spans that meet edits are dealt by their number, so that a task's sorts do not grow with the table."""
    monkeypatch.setattr(G, "ROWS", 100)
    spans = spark.range(5000).select((F.col("id") % 50).alias("k"), (F.floor(F.col("id") / 50) * 100).alias("start"), (F.floor(F.col("id") / 50) * 100 + 20).alias("end"))
    edits = spans.where("start % 200 = 0").select("k", (F.col("start") + 30).alias("start"), (F.col("start") + 40).alias("end"), F.lit(15).alias("inserted"))
    moved = G.propagate(spans, edits, "k")
    assert moved.rdd.getNumPartitions() >= 75
    assert sorted(map(tuple, moved.collect())) == sorted((k, s + d, s + 20 + d) for k in range(50) for s in range(0, 10_000, 100) for d in [-(-s // 200) * 5])
