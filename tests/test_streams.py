"""Chunked restoration, windows, edits and formats; streams give what batches give."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushframe.operators import geometry as G, lineage as L, store as S, streams as K, values as B
from hushframe.sources import formats as X
from hushframe.streaming.restore import once_a_window, restore_stream

SESSION = {"[A_1]": "one", "[A_12]": "twelve", "[A": "open"}
TEXT = "x [A_1] y [A_12][A_1 z [A"


def whole(text):
    live = K.Restorer(SESSION)
    return live.push(text) + live.flush()


@pytest.mark.parametrize("cut", range(len(TEXT) + 1))
def test_every_split_restores_alike(cut):
    live = K.Restorer(SESSION)
    assert live.push(TEXT[:cut]) + live.push(TEXT[cut:]) + live.flush() == whole(TEXT)


def test_restored_stream_equals_batch(spark, tmp_path):
    chunks = [(f"k{k}", i, TEXT[i : i + 1], i == len(TEXT) - 1) for k in range(3) for i in range(len(TEXT))]
    df = spark.createDataFrame(chunks, "stream_key string, seq long, chunk string, last boolean")
    df.repartition(1).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    q = restore_stream(source, SESSION).writeStream.format("memory").queryName("restored").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("restored").toPandas().sort_values(["stream_key", "seq"]).groupby("stream_key")["emitted"].sum()
    assert got.to_dict() == {f"k{k}": whole(TEXT) for k in range(3)}


def test_window_stream_equals_batch(spark, tmp_path):
    rows = [(f"d{i % 2}", i, i * 9_000 % 100_000) for i in range(40)]
    df = spark.createDataFrame(rows, "diagnostic_key string, event_id long, at long")
    df.repartition(1).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    q = once_a_window(source).writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["event_id"] for r in spark.table("windowed").collect()}
    want, last = set(), {}
    for key, event, at in sorted(rows, key=lambda r: (r[2], r[1])):
        if key not in last or at - last[key] >= 30_000:
            last[key] = at
            want.add(event)
    assert got == want


@pytest.mark.parametrize(
    "edits,want",
    [
        ([("cat", "dog", None, None, "", "")], ("a dog sat", None)),
        ([("a", "o", 2, None, "", "")], ("a cot sat", None)),
        ([("a", "o", None, True, "", "")], ("o cot sot", None)),
        ([("a", "o", None, None, "s", "t")], ("a cat sot", None)),
        ([("a", "o", None, None, "", "")], (None, "AMBIGUOUS_TEXT_EDIT")),
        ([("zzz", "o", None, None, "", "")], (None, "TEXT_EDIT_NOT_FOUND")),
        ([("a", "o", 9, None, "", "")], (None, "TEXT_EDIT_OCCURRENCE_NOT_FOUND")),
        ([("cat", "x", None, None, "", ""), ("at s", "y", None, None, "", "")], (None, "OVERLAPPING_TEXT_EDITS")),
        ([], ("a cat sat", None)),
    ],
)
def test_edits(edits, want):
    names = ("search", "replace", "occurrence", "all", "before", "after")
    assert B.edit_text("a cat sat", [dict(zip(names, e, strict=True)) for e in edits]) == want


def test_chunks_share_every_short_span():
    text = "".join(chr(97 + i % 26) + (" " if i % 9 == 0 else "") for i in range(9000))
    spans = B.chunk(text, 2000)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for at in range(0, len(text) - B.OVERLAP, 97):
        assert any(a <= at and at + B.OVERLAP <= b for a, b in spans)


def test_packing_in_order(spark):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 5, 1, 20, 3])], "g string, i int, s int")
    got = {r["i"]: r["batch"] for r in B.packed(df, "g", "i", "s", 10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_mutation_states(spark):
    ops = [("a", 1, "stage", 1, None), ("a", 2, "commit", None, 1), ("a", 3, "rollback", None, None), ("b", 1, "stage", 1, None), ("b", 2, "commit", None, 2), ("b", 3, "rollback", None, None), ("b", 4, "stage", 2, None)]
    log = spark.createDataFrame(ops, "mutation_id string, seq int, op string, planned int, actual int")
    got = {r["mutation_id"]: (r["state"], r["conflicts"]) for r in S.mutation_states(log).collect()}
    assert got == {"a": ("committed", 1), "b": ("pending", 1)}


def test_geometry(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 10, 20), (1, 30, 40)], "k int, start long, end long")
    edits = spark.createDataFrame([(1, 5, 5, 3), (1, 12, 14, 0), (1, 30, 30, 2)], "k int, start long, end long, inserted long")
    assert sorted((r["start"], r["end"]) for r in G.propagate(spans, edits, "k").collect()) == [(0, 5), (33, 43)]
    touching = spark.createDataFrame([(1, -5, 3), (1, 3, 6), (1, 8, 99)], "k int, start long, end long")
    assert sorted((r["start"], r["end"]) for r in G.merged_ranges(touching, "k", F.lit(50)).collect()) == [(0, 6), (8, 50)]


def test_env_and_sessions(spark, tmp_path):
    (tmp_path / "e.env").write_text("# c\nA=1\nexport B = 'two words'\nA=3\nbroken\n")
    assert {r["name"]: r["value"] for r in X.read_env(spark, str(tmp_path / "e.env")).collect()} == {"A": "3", "B": "two words"}
    df = spark.createDataFrame([("s1", {"[A_1]": "x"}), ("s2", {})], "session_key string, session map<string,string>")
    X.write_sessions(df, str(tmp_path / "vault"))
    assert {r["session_key"]: r["session"] for r in X.read_sessions(spark, str(tmp_path / "vault")).collect()} == {"s1": {"[A_1]": "x"}, "s2": {}}


def test_json_rewrite(spark):
    df = spark.createDataFrame([(1, '{"a":["x y","x"],"n":1}', {"x": "Z"}), (2, "{broken", {}), (3, None, None)], "id int, j string, m map<string,string>")
    got = {r["id"]: r["out"] for r in B.rewritten(df, "j", "m", "out").collect()}
    assert got == {1: '{"a":["Z y","Z"],"n":1}', 2: None, 3: None}
    assert isinstance(pd.DataFrame(B.strings(df, "j", "id").collect()), pd.DataFrame)


def test_causal_paths_and_their_errors(spark):
    long = [(f"e{i}", f"e{i - 1}" if i else None) for i in range(150)]  # far deeper than any table here
    rows = [*long, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "gone"), ("y", "x"), ("self", "self")]
    ev = spark.createDataFrame(rows, "event_id string, parent_event_id string")
    starts = spark.createDataFrame([(e,) for e in ("e149", "e0", "d", "y", "self", "nowhere")], "event_id string")
    got = L.causal_path(ev, starts).collect()
    path = {(r["start_id"], r["depth"]): r["event_id"] for r in got if r["error_code"] is None}
    assert path == {("e149", k): f"e{149 - k}" for k in range(150)} | {("e0", 0): "e0"}
    assert {r["start_id"]: r["error_code"] for r in got if r["error_code"]} == {"d": "CAUSAL_CYCLE", "self": "CAUSAL_CYCLE", "y": "PARENT_NOT_FOUND", "nowhere": "EVENT_NOT_FOUND"}
    assert L.causal_path(ev.limit(0), starts.limit(0)).count() == 0


def test_coverage_is_that_of_a_plain_search():
    def plain(a, b):
        own, theirs, at, n = a.split(), b.split(), 0, 0
        for token in own:
            if token in theirs[at:]:
                at += theirs[at:].index(token) + 1
                n += 1
        return n / len(own)

    a, b = "the cat saw the dog and the cat ran", "cat the the dog cat cat ran the"
    assert B.coverage(a, b) == plain(a, b) and B.coverage("", "") == 1 and B.coverage("", "x") == 0
    words = "a b c d " * 20_000  # linear: a quadratic search would not end here
    assert B.coverage(words, words) == 1


def test_repeated_and_null_keys_pack_in_order(spark):
    rows = [(g, i, s) for g in ("x", None) for i, s in enumerate([3, 4, None, 9, 20, 1])]
    got = B.packed(spark.createDataFrame(rows, "g string, o int, s int"), "g", "o", "s", 10).collect()
    assert {(r["g"], r["o"]): r["batch"] for r in got} == {(g, i): b for g in ("x", None) for i, b in enumerate([0, 0, 0, 1, 2, 3])}
