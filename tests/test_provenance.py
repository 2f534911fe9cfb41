"""Smallest replacements, patches and private spans against plain versions."""

import random

from hushframe.operators import provenance as E


def test_smallest_replacements_are_those_of_a_plain_scan():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(2))
        got = E.smallest_replacement(a, b)
        if a == b:
            assert got is None
            continue
        start = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        tail = 0
        while tail < min(len(a), len(b)) - start and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        assert got == (start, len(a) - tail, b[start : len(b) - tail])


def test_patches():
    good = "*** Begin Patch\n*** Update File: a/b.txt\n@@\n-x\n+y\n*** Delete File: c\n*** End Patch\n"
    assert E.patch_sections(good) == [{"type": "update", "path": "a/b.txt", "body": ["@@", "-x", "+y"]}, {"type": "delete", "path": "c", "body": []}]
    assert E.patch_sections(good.replace("\n", "\r\n")) == E.patch_sections(good)
    for bad in ("", None, good[4:], good.replace("*** End Patch\n", ""), good.replace("a/b.txt", "/a"), good.replace("a/b.txt", "a/../b"), good.replace("c\n", "a/b.txt\n"), "*** Begin Patch\nx\n*** End Patch", "*** Begin Patch\n*** End Patch"):
        assert E.patch_sections(bad) is None


def test_private_spans(spark):
    rows = [(1, "Ann and ANNA, ann", [("[P_1]", "ann"), ("[P_2]", "Anna")]), (2, None, []), (3, "x", None)]
    df = spark.createDataFrame(rows, "id int, text string, session array<struct<placeholder:string,original:string>>")
    got = {r["id"]: None if r["spans"] is None else [(s["start"], s["end"], s["placeholder"]) for s in r["spans"]] for r in E.private_spans(df, "text", "session").collect()}
    assert got == {1: [(0, 3, "[P_1]"), (8, 12, "[P_2]"), (14, 17, "[P_1]")], 2: None, 3: []}


def test_unsafe_paths_make_no_patch():
    for path in ("C:\\x", "a//b", "./a", "a\\..\\b", "/a", "a/"):
        assert E.patch_sections(f"*** Begin Patch\n*** Delete File: {path}\n*** End Patch") is None
    assert E.patch_sections("*** Begin Patch\n*** Delete File: ~a/b..c\n*** End Patch") == [{"type": "delete", "path": "~a/b..c", "body": []}]


def test_patches_undo_random_changes_of_lines(spark):
    rng, rows, files, want = random.Random(7), [], [], {}
    for k in range(300):
        before = [rng.choice(["alpha", "beta", "gamma", "", "x y"]) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 12))]
        at, more = rng.randrange(len(before)), rng.randint(0, 2)
        new = [f"new{rng.randint(0, 9)}" for _ in range(rng.randint(0, 2))]
        lo, hi = max(0, at - more), min(len(before), at + 1 + more)
        old = before[lo:hi]
        hunk = [f" {x}" for x in before[lo:at]] + [f"-{before[at]}"] + [f"+{x}" for x in new] + [f" {x}" for x in before[at + 1 : hi]]
        text = "".join(x + "\n" for x in before)
        chunk = "".join(x + "\n" for x in old)
        places = sum(1 for i in range(len(text)) if text.startswith(chunk, i))
        rows.append((k, "\n".join(["*** Begin Patch", "*** Update File: f", "@@", *hunk, "*** End Patch"])))
        files.append((k, "f", text))
        want[k] = "".join(x + "\n" for x in [*before[:at], *new, *before[at + 1 :]]) if places == 1 else None
    got = E.apply_patches(spark.createDataFrame(rows, "k int, patch string"), spark.createDataFrame(files, "k int, path string, text string"), "k").collect()
    texts = {k: t for k, _, t in files}
    assert len(got) == 300 and {r["k"] for r in got if r["applied"]} == {k for k, x in want.items() if x is not None}
    for r in got:
        if r["applied"]:
            assert r["next"] == want[r["k"]] and len(r["edits"]) == (r["operation"] == "apply_patch")
            assert r["next_length"] == r["source_length"] + sum(e["inserted_length"] - (e["end"] - e["start"]) for e in r["edits"])
        else:
            assert r["error_code"] == "AMBIGUOUS" and r["next"] is None and texts[r["k"]]


def test_a_patch_applies_as_a_whole_or_not_at_all(spark):
    wrap = lambda body: f"*** Begin Patch\n{body}\n*** End Patch"
    cases = [
        (1, wrap("*** Add File: n\n+a\n+b\n*** Delete File: f"), {"n": ("a\nb\n", None, True), "f": (None, None, True)}),
        (2, wrap("*** Add File: n\n+a\n*** Add File: f\n+b"), {"n": ("a\n", None, False), "f": (None, "EXISTS", False)}),
        (3, wrap("*** Update File: f\n@@\n-one\n+1\n@@\n 1\n-two\n\\ No newline at end of file"), {"f": ("1\n", None, True)}),
        (4, wrap("*** Update File: f\n@@\n+one"), {"f": (None, "EMPTY_SEARCH", False)}),
        (5, wrap("*** Update File: f\n-one"), {"f": (None, "NO_HUNK", False)}),
        (6, wrap("*** Update File: f\n@@\none"), {"f": (None, "BAD_LINE", False)}),
        (7, wrap("*** Update File: g\n@@\n-one"), {"g": (None, "ABSENT", False)}),
        (8, wrap("*** Update File: f\n@@\n one"), {"f": ("one\ntwo\n", None, True)}),
        (9, None, {None: (None, "NOT_A_PATCH", False)}),
        (10, wrap("*** Update File: f\n@@\n-three"), {"f": (None, "NOT_FOUND", False)}),
    ]
    files = [(k, "f", "one\ntwo\n", "z") for k, _, _ in cases]
    patches = spark.createDataFrame([(k, p) for k, p, _ in cases], "k int, patch string")
    got: dict = {}
    for r in E.apply_patches(patches, spark.createDataFrame(files, "k int, path string, text string, patch string"), "k").collect():
        got.setdefault(r["k"], {})[r["path"]] = (r["next"], r["error_code"], r["applied"])
    assert got == {k: want for k, _, want in cases}
    none = E.apply_patches(patches.where("k < 0"), spark.createDataFrame(files, "k int, path string, text string, patch string"), "k")
    assert none.collect() == []


def test_predictions_of_edits(spark):
    e = lambda a, b, every=False: (a, b, every)
    cases = [
        ("aXbX", "write", "new", None, ("new", "write_file", [])),
        (None, "write", "", None, ("", "write_file", [])),
        ("aXbX", "edit", None, [e("X", "yy", True)], ("ayybyy", "replace_in_file", [(1, 2, 2), (3, 4, 2)])),
        ("aXbX", "edit", None, [e("X", "yy")], "AMBIGUOUS"),
        ("aXb", "edit", None, [e("", "yy")], "EMPTY_SEARCH"),
        ("aXb", "edit", None, [e("X", "X")], ("aXb", "replace_in_file", [(1, 2, 1)])),
        ("aXb", "multi_edit", None, [e("X", "Y"), e("Y", "X")], "UNCHANGED"),
        ("aXb", "multi_edit", None, [e("X", "YZ"), e("b", "Z"), e("Z", "", True)], ("aY", "replace_in_file", [(1, 3, 1)])),
        ("aXb", "multi_edit", None, [e("X", "Y"), e("X", "Y")], "NOT_FOUND"),
        (None, "edit", None, [e("X", "Y")], "ABSENT"),
        ("a", "write", None, None, "NO_CONTENT"),
        ("a", "move", None, [e("X", "Y")], "UNSUPPORTED"),
        ("a", "edit", None, [e(None, "Y")], "UNSUPPORTED"),
    ]
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, t string, kind string, content string, edits_ array<struct<old_text:string,new_text:string,every:boolean>>")
    for r in E.predicted(df, "t", "kind", "content", "edits_").collect():
        want = cases[r["i"]][4]
        got = r["error_code"] or (r["next"], r["operation"], [tuple(x) for x in r["edits"]])
        assert got == want
