"""Nested values through a classifier, against a plain walk over the same values."""

import json
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hushframe.functions.text import estimated_tokens
from hushframe.operators import structured as T
from hushframe.session import kept, release

NAMES = re.compile(r"\b(?:Ann|Bob|Zoe) [A-Z][a-z]+\b")


def finder(pattern):
    """A classifier that finds names; it goes to the workers by value."""

    def names(text):
        found = list(dict.fromkeys(m.group() for m in re.finditer(pattern, text)))
        pairs = [(f"[PERSON_{i}]", v) for i, v in enumerate(found, 1)]
        for p, v in sorted(pairs, key=lambda x: -len(x[1])):
            text = re.sub(re.escape(v), p, text, flags=re.I)
        return text, pairs

    return names


names = finder(NAMES.pattern)


def plain(value, seen):
    """The value with names numbered by their first place in it."""
    if isinstance(value, str):
        for m in NAMES.finditer(value):
            seen.setdefault(m.group().lower(), f"[PERSON_{len(seen) + 1}]")
        return value
    return [plain(x, seen) for x in value] if isinstance(value, list) else {k: plain(x, seen) for k, x in value.items()} if isinstance(value, dict) else value


def put(value, seen):
    if isinstance(value, str):
        for name, to in seen.items():
            value = re.sub(re.escape(name), to, value, flags=re.I)
        return value
    return [put(x, seen) for x in value] if isinstance(value, list) else {k: put(x, seen) for k, x in value.items()} if isinstance(value, dict) else value


VALUES = {
    "a": {"x": ["Ann Lee met Bob Ray", {"deep": "ANN LEE again", "n": 1.5}], "y": None, "Ann Lee": True},
    "b": "Zoe Kay", "c": [], "d": {"long": "filler words here " * 400 + "Bob Ray " + "more words " * 300 + "Zoe Fox"}, "e": ["", "nothing"],
    "f": {"many": [f"Ann {c}{'o' * (i % 5 + 1)}" for i, c in enumerate("ABCDEFGHIJKLMNOP")]}, "g": "é Ann Lee \U0001f600 ann lee",
}


@pytest.mark.parametrize("budget", [T.Budget(), T.Budget(1400, 100_000), T.Budget(4000, 1100)])
def test_values_equal_a_plain_walk(spark, budget):
    rows = [(k, json.dumps(v, ensure_ascii=False)) for k, v in VALUES.items()] + [("broken", "{"), ("null", None)]
    got, found, asked = T.sanitize_values(spark.createDataFrame(rows, "k string, v string"), "k", "v", names, window=budget)
    got = {r["k"]: r for r in got.collect()}
    assert got["broken"]["sanitized"] == "{" and got["null"]["sanitized"] is None and not any(r["error_code"] for r in got.values())
    for k, v in VALUES.items():
        plain(v, seen := {})
        assert json.loads(got[k]["sanitized"]) == put(v, seen) and got[k]["changed"] == bool(seen)
        assert {r["original"].lower(): r["placeholder"] for r in found.where(F.col("k") == k).collect()} == seen
    calls = asked.collect()
    assert all(r["chars"] <= budget.chars and r["error_code"] is None for r in calls) and sum(r["n_units"] for r in calls) >= 23 + (budget.chars < 5000)


def test_known_values_are_shielded(spark):
    session = spark.createDataFrame([("a", 1, "[PERSON_1]", "Ann Lee"), ("a", 2, "[PERSON_2]", "Bob")], "k string, ord long, placeholder string, original string")
    values = spark.createDataFrame([("a", json.dumps(["Ann Lee and Bob Ray, [PERSON_1]", "Zoe Fox"]))], "k string, v string")

    def classify(text):
        assert "Ann" not in text and "[PERSON_1]" not in text
        shielded = re.search(r"__BOUNDARY_4__ Ray", text)
        text2 = text.replace(shielded[0], "[PERSON_1]").replace("Zoe Fox", "[PERSON_2]")
        return text2, [("[PERSON_1]", shielded[0]), ("[PERSON_2]", "Zoe Fox")]

    got, found, _ = T.sanitize_values(values, "k", "v", classify, session)
    # numbered behind what the session has
    assert sorted((r["placeholder"], r["original"]) for r in found.collect()) == [("[PERSON_3]", "Bob Ray"), ("[PERSON_4]", "Zoe Fox")]
    assert json.loads(got.head()["sanitized"]) == ["[PERSON_1] and [PERSON_3], [PERSON_1]", "[PERSON_4]"]


@pytest.mark.parametrize(
    "reply,code",
    [
        (lambda t: (t + "!", []), T.CHANGED), (lambda t: (t.replace("Ann", "[X_1]"), [("[X_1]", "Ann"), ("[X_2]", "a" * 600)]), T.BAD_SPAN),
        (lambda t: (t, [("[X_1]", "not\nthere")]), T.BAD_SPAN), (lambda t: (t.replace("Ann", "__boundary_1__"), [("__boundary_1__", "Ann")]), T.CHANGED),
    ],
)
def test_replies_that_break_a_rule(spark, reply, code):
    values = spark.createDataFrame([("a", '"Ann"'), ("n", "5")], "k string, v string")
    got, found, asked = T.sanitize_values(values, "k", "v", reply)
    assert {r["k"]: (r["sanitized"], r["error_code"]) for r in got.collect()} == {"a": (None, code), "n": ("5", None)} and found.count() == 0
    assert [r["error_code"] for r in asked.collect()] == [code]


def test_windows_that_are_too_small():
    for chars, most in ((1152, 100_000), (200_000, 500)):
        with pytest.raises(ValueError, match=T.TOO_LARGE):
            T.Budget(chars, most)


def test_tokens_are_those_of_the_column(spark):
    texts = ["", "a b  c\n", "Hello12345 wörld!!", "　 x", "é" * 5, " "]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", estimated_tokens(F.col("t")).alias("n")).collect()
    assert all(T.tokens(r["t"]) == r["n"] for r in got)


def test_second_run_asks_nothing(spark):
    slots = [("s1", "message", '{"t":"Ann Lee"}'), ("s2", "message", '{"t":"Ann Lee"}'), ("s3", "tool", '{"t":"Ann Lee"}'), ("s4", "tool", "7"), ("s5", "tool", None), ("s6", "message", '["Zoe Fox"]')]
    df = spark.createDataFrame(slots, "slot_key string, artifact_type string, value string")
    out, cache, asked = T.fan_out(df, names)
    first = {r["slot_key"]: (r["hit"], r["sanitized"]) for r in out.collect()}
    assert first == {**{k: (False, '{"t":"[PERSON_1]"}') for k in ("s1", "s2", "s3")}, "s4": (False, "7"), "s5": (False, None), "s6": (False, '["[PERSON_1]"]')}
    assert cache.count() == 5 and sum(r["n_units"] for r in asked.collect()) == 2

    def fail(text):
        raise AssertionError("asked again")

    out, same, asked = T.fan_out(df, fail, cache)
    assert {r["slot_key"]: (r["hit"], r["sanitized"]) for r in out.collect()} == {k: (True, v) for k, (_, v) in first.items()} and asked.count() == 0 and same.count() == 5
    more = df.unionByName(spark.createDataFrame([("s7", "tool", '"Bob Ray"')], df.schema))
    out, grown, asked = T.fan_out(more, names, cache)
    assert asked.count() == 1 and grown.count() == 6 and out.where("not hit").count() == 1
    bad, kept, _ = T.fan_out(more, lambda t: (t + "!", []), cache)
    assert kept.count() == 5 and [r["error_code"] for r in bad.where("not hit").collect()] == [T.CHANGED]


def on_disk(spark):
    """Bytes in the folders of shuffles, spills and intermediates."""
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shared = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(p.stat().st_size for d in (*local, shared) for p in Path(d).rglob("*") if p.is_file())


def least_on_disk(spark):
    """The same, when executors have had time to delete what they were told to."""
    found = []
    while len(found) < 4:
        time.sleep(0.5)
        found.append(on_disk(spark))
    return min(found)


def test_texts_are_on_disk_once_when_all_is_asked(spark):
    _, _, warm = T.fan_out(spark.createDataFrame([("s", "t", '"Ann Lee"')], "slot_key string, artifact_type string, value string"), names)
    warm.count()
    # texts that hardly compress
    text = F.concat(F.lit('"Ann Lee '), *(F.sha2(F.concat_ws(":", "id", F.lit(i)), 512) for i in range(40)), F.lit('"'))
    slots = spark.range(1000).select(F.col("id").cast("string").alias("slot_key"), (F.col("id") % 3).cast("string").alias("artifact_type"), text.alias("value"))
    size = slots.agg(F.sum(F.length("value"))).head()[0]
    before = on_disk(spark)
    _, cache, _ = T.fan_out(slots, names)
    grown = least_on_disk(spark) - before
    assert grown < 1.2 * size
    assert cache.where("sanitized like '\"[PERSON_1] %'").count() == 1000


def test_copies_are_asked_once_in_the_words_of_their_first_slot(spark):
    rows = [(f"s{i:03}", f"t{i % 3}", '"Zoe Fox"' if i % 2 else None) for i in range(60)] + [("s900", "t0", "null")]
    slots = spark.createDataFrame(rows, "slot_key string, artifact_type string, value string").repartition(7)
    out, cache, asked = T.fan_out(slots, names)
    assert {(r["slot_key"], r["sanitized"]) for r in out.collect()} == {(k, '"[PERSON_1]"' if v and v != "null" else None) for k, _, v in rows}
    assert cache.count() == 6 and sum(r["n_units"] for r in asked.collect()) == 1


def test_kept_tables_leave_no_shuffles(spark):
    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 512).alias("t")).repartition("t")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept(rows.limit(1))
    spark.conf.set(name, "false")
    before = on_disk(spark)
    try:
        table = kept(rows)
        assert spark.conf.get(name) == "false"
    finally:
        spark.conf.unset(name)
    # texts of 128 hexadecimal digits: half is left in the table, the shuffle would have as much again
    assert least_on_disk(spark) - before < 20_000 * 128 * 0.75
    assert table.count() == 20_000 and table.exceptAll(rows).count() == 0
    files = [Path(p.removeprefix("file://")) for p in table.inputFiles()]
    assert files and all(p.exists() for p in files)
    release(spark)
    assert not any(p.exists() for p in files)
