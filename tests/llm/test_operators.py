"""The training-data operators against brute force, round trips and held-out labels, on the smallest tables."""

import base64
import hashlib
import math
import unicodedata
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hushframe.llm import digest, gph, hilbert, licenses, packing, pfor, pst, quality, simhash, tokens, warc, wumanber
from hushframe.llm.queries import QUERIES, tokenizer_file

SPACED = regex.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(sf):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall())


def run(name, spark, sf):
    return QUERIES[name](spark, sf).toPandas()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, sf, docs):
    got = run("op1_suffix_tree", spark, sf).set_index("doc_id")
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    words = {d: [*SPACED.findall(t.translate(LOW)), None] for d, t in docs.items()}
    count = Counter(w for d in docs if not held[d] for w in words[d])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(docs)
    for d in docs:
        r = got.loc[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(words[d]), sum(count[w] > 0 for w in words[d]), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words[d]), rel_tol=1e-9, abs_tol=1e-9)
        assert r.score < 0


def brute_tree(texts, depth):
    """Counts by dictionary, kept contexts and scores by the definitions."""
    counts = Counter()
    for s in texts:
        full = b"\n" * depth + s
        for i in range(depth, len(full)):
            for d in range(depth + 1):
                counts[full[i - d : i], full[i]] += 1
    totals, contexts = Counter(), {}
    for (c, x), n in counts.items():
        totals[c] += n
        contexts.setdefault(c, {})[x] = n
    kept = {c for c in contexts if len(c) < 2}
    for c, own in contexts.items():
        t, up, ut = totals[c], contexts[c[1:]], totals[c[1:]]
        gain = sum(n * math.log(n / t * ut / up[x]) for x, n in own.items())
        if len(c) > 1 and t >= pst.LEAST and 2 * gain > len(own) + 3 * math.sqrt(2 * len(own)):
            kept |= {c[k:] for k in range(len(c) + 1)}

    def p(c, x):
        while c not in kept:
            c = c[1:]
        below = p(c[1:], x) if c else 1 / 256
        return (contexts.get(c, {}).get(x, 0) + pst.ALPHA * below) / (totals[c] + pst.ALPHA)

    return p, kept


@pytest.mark.parametrize("block", [None, 2000])
def test_suffix_tree_equals_definitions(spark, docs, monkeypatch, block):
    if block:  # several blocks, of which each scores some of the bytes
        monkeypatch.setattr(pst, "BLOCK", block)
    texts = [t for t in docs.values() if t][:25]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in pst.score(df, F.col("doc_id") % 2 == 0).collect()}
    spelled = pst._spell(texts)
    p, kept = brute_tree(spelled[::2], pst.DEPTH)
    assert {len(c) for c in kept} == set(range(pst.DEPTH + 1))
    for i in (0, 1, 2, 7):
        full = b"\n" * pst.DEPTH + spelled[i]
        want = sum(math.log10(p(full[k - pst.DEPTH : k], full[k])) for k in range(pst.DEPTH, len(full)))
        assert math.isclose(got[i], want, rel_tol=1e-9)
    one = sum(p(b"the t", x) for x in range(256))
    assert math.isclose(one, 1, rel_tol=1e-9)


def test_op2(spark, sf, docs):
    got = run("op2_token_files", spark, sf).set_index("doc_id")
    t, start = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")), 0
    for d, x in docs.items():
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        assert tuple(got.loc[d][["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), crc(ids))
        start += len(ids)


ODD = ["", " ", "a  b", " a", "a ", "x\ty", "\n", "a\n\nb", "a\nb c\n d", "he's don't 12 3a,b!?", "é́ x", "<|endoftext|> a", "ΑΣ ΣΑΣ", "a b", "　", "🙂 ok", "a​b", "\x1c a", "word. word, word"]


@pytest.mark.parametrize("name,blank", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_encode_like_the_tokenizer(name, blank, docs, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 500)
    own = tokens.PieceEncoder(tokenizer_file(name), blank)
    texts = ODD + list(docs.values())[:60]
    for batch in (texts, texts[::-1]):
        ids, lengths = own(batch, 7)
        ends = np.cumsum(lengths)
        for i, x in enumerate(batch):
            assert ids[ends[i] - lengths[i] : ends[i]].tolist() == [*own.tokenizer.encode(x, add_special_tokens=False).ids, 7]


TABS = ["a \tb", "a \t b", "\ta", "\t", "a\t", "a \t", "\t\tb", "if x:\n\ty = 1\n \tz", "\n\ta b", "İ", "İstanbul. İ, aİb"]


@pytest.mark.parametrize("name,blank", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_tabs_and_dotted_capitals_encode_like_the_tokenizer(name, blank):
    own = tokens.PieceEncoder(tokenizer_file(name), blank)
    ids, lengths = own(TABS, 7)
    ends = np.cumsum(lengths)
    got = [ids[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)]
    assert got == [[*own.tokenizer.encode(x, add_special_tokens=False).ids, 7] for x in TABS]


@pytest.mark.parametrize("name,blank", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_every_letter_encodes_like_the_tokenizer(name, blank):
    own = tokens.PieceEncoder(tokenizer_file(name), blank)
    codes = [c for c in [*range(1, 0x3400), *range(0xAB30, 0xAC20), *range(0xF900, 0x10000), *range(0x1D100, 0x1D200), *range(0x2F800, 0x2FA20)]]
    texts = [f"x a{c}b y {c} {c}{c}. {c}\n{c}a, q{c}." for c in map(chr, codes) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    ids, lengths = own(texts, 7)
    ends, want = np.cumsum(lengths), own.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, w, e, n in zip(texts, want, ends, lengths, strict=True) if ids[e - n : e].tolist() != [*w.ids, 7]] == []


def test_encoder_forgets_and_learns_again(docs, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 300)
    own = tokens.PieceEncoder(tokenizer_file("byte_bpe_50k.json"), True)
    texts = [*list(docs.values())[:40], "averyveryverylongpieceofletters " * 3, "12345678 1234567890123456 12345678901234567"]
    want = [[*own.tokenizer.encode(x, add_special_tokens=False).ids, 7] for x in texts]
    for batch in (texts, texts[::-1], texts[:5] * 3, texts):
        for x, ids in zip(batch, (own([x], 7)[0].tolist() for x in batch), strict=True):
            assert ids == want[texts.index(x)]
    assert own.n <= 300 + 5000


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 200, 50_256, (1 << 32) - 1])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.random(n) ** 4 * top).astype(np.uint32)
    blocks = pfor.encode_blocks(ids)
    data, starts = b"".join(blocks), np.cumsum([0, *map(len, blocks)])[:-1]
    assert (pfor.decode_blocks(data, starts.astype(np.int64)) == ids).all()


def test_files_are_read_at_any_place(tmp_path):
    out = pfor.Writer(f"file://{tmp_path}/x/a.pfor")
    rng, whole = np.random.default_rng(0), []
    for k in range(20):
        ids = rng.integers(0, 50_000, 700).astype(np.uint32)
        whole.append(ids)
        out.add(np.arange(k, k + 1), ids, np.array([700]))
    out.close()
    whole = np.concatenate(whole)
    reader = pfor.Reader(f"file://{tmp_path}/x/a.pfor")
    for a, b in ((0, 14_000), (0, 0), (1023, 1025), (5000, 5001), (13_999, 14_000)):
        assert (reader.read(a, b) == whole[a:b]).all()
    assert [x[2:] for x in reader.documents(most=1024)] == [(700, zlib.crc32(whole[i : i + 700].astype("<u4").tobytes())) for i in range(0, 14_000, 700)]


def fingerprint(text, size=4):
    w = SPACED.findall(text.translate(LOW))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_op3(spark, sf, docs):
    got = run("op3_simhash", spark, sf).set_index("doc_id")
    ids, prints = list(docs), [fingerprint(t) for t in docs.values()]
    comp = union(len(ids), [(i, j) for i, j in combinations(range(len(ids)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4])
    for i, d in enumerate(ids):
        assert tuple(got.loc[d][["fingerprint", "component_id"]]) == (f"{prints[i]:016x}", ids[comp[i]])


@pytest.mark.parametrize("limit,parts", [(4, None), (4, 2), (4, 3), (10, 4), (12, None)])
def test_links_join_all_near_prints(spark, limit, parts, monkeypatch):
    monkeypatch.setattr(gph, "LARGE", 15)
    monkeypatch.setattr(gph, "SMALL", 4)
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, limit + 3), replace=False)) for b in base for _ in range(12)]
    near = sorted(set(near))
    df = spark.createDataFrame([(i, gph.signed(x)) for i, x in enumerate(near)], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in simhash.groups(df, limit, parts=parts).collect()}
    comp = union(len(near), [(i, j) for i, j in combinations(range(len(near)), 2) if (near[i] ^ near[j]).bit_count() <= limit])
    assert [got[gph.signed(x)] for x in near] == comp


def test_thresholds_fill_the_pigeonholes():
    cost = [[0.0, 1.0, 5.0, 50.0], [0.0, 9.0, 90.0, 900.0], [0.0, 2.0, 3.0, 4.0]]
    for limit in range(8):
        chosen = gph.allocate(cost, limit)
        assert sum(t + 1 for t in chosen) == limit + 1
        best = min(sum(c[k] for c, k in zip(cost, ks, strict=True)) for ks in np.ndindex(4, 4, 4) if sum(ks) == limit + 1)
        assert sum(c[t + 1] for c, t in zip(cost, chosen, strict=True)) == best


def test_op4(spark, sf):
    got = run("op4_warc", spark, sf).set_index("page_id")
    pages, first = duckdb.sql(f"SELECT page_id, html FROM '{sf}/pages.parquet' ORDER BY page_id").fetchall(), {}
    for p, html in pages:
        body, r = (html or "").encode(), got.loc[p]
        f = first.setdefault(body, p)
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert r.record_type == ("response" if f == p else "revisit") and (math.isnan(r.refers_to) if f == p else r.refers_to == f)


def test_warc_cases(spark):
    rows = [(5, "http://a/ b\r\n", "x"), (3, None, "x"), (9, "u", None), (1, "u", ""), (None, "n", "x"), (7, "é", "ü" * 70_000), (7, "é", "ü" * 70_000)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_records(index).collect()]
    want = [(5, "revisit", 3, 1), (3, "response", None, 1), (9, "revisit", 1, 0), (1, "response", None, 0), (None, "revisit", 3, 1), (7, "response", None, 140_000), (7, "response", None, 140_000)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    some = warc.read_records(index.where("page_id = 7")).collect()
    assert [bytes(r["payload"]).decode() for r in some] == ["ü" * 70_000] * 2


def test_licences(spark):
    files = [
        ("r/LICENSE", "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        ("r/a.c", "int x;"),
        ("r/sub/deep/b.c", "int y;"),
        ("r/sub/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("r/own.c", "// Licensed under the Apache License, Version 2.0.\nint z;"),
        ("other/c.c", None),
        (None, "Released under the MIT License."),
        ("r/sub/n.c", ""),
    ]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], "doc_id int, p string, text string")
    got = {r["doc_id"]: (r["effective_licence"], r["basis"], r["from_directory"]) for r in licenses.inherit(licenses.scan(df, F.col("p"))).collect()}
    assert got == {
        0: ("MIT", "own", None), 1: ("MIT", "inherited", "r"), 2: ("GPL-3.0", "inherited", "r/sub"), 3: ("GPL-3.0", "own", None),
        4: ("Apache-2.0", "own", None), 5: (None, None, None), 6: ("MIT", "own", None), 7: ("GPL-3.0", "inherited", "r/sub"),
    }


def brute_templates(texts):
    """A function from a text to its cosine to every template and what it explains of it, from counts over all lines, by plain vectors."""
    lines = [set(licenses.terms(x)) for t in texts for x in (t or "").split("\n")]
    known = {t for _, text in licenses.TEMPLATES for t in licenses.terms(text)}
    df = Counter(t for own in lines for t in own & known)
    idf = lambda t: math.log((1 + len(lines)) / (1 + df[t])) + 1 if t in known else math.log(1 + len(lines)) + 1
    vector = lambda x: {t: n * idf(t) for t, n in licenses.terms(x).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, v, size(v)) for name, text in licenses.TEMPLATES for v in [vector(text)]]

    def look(text):
        own = vector(text)
        long = size(own) or 1
        out = []
        for name, v, n in templates:
            s = sum(x * v.get(t, 0) for t, x in own.items()) / (long * n)
            out.append((s, name, (s * n) ** 2))
        return out

    return look


def test_op5(spark, sf, docs):
    got = run("op5_licenses", spark, sf).set_index("doc_id")
    assert len(got) == len(docs)
    lines = {
        "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary",
    }
    for d, t in docs.items():
        own = {lines[x] for x in t.split("\n") if x in lines}
        assert (got.loc[d].licence in own) if own else got.loc[d].licence is None
    look = brute_templates(docs.values())
    for d in list(got.index[got.licence.notna()])[:8] + list(docs)[:8]:
        text, row = docs[d].split("\n"), got.loc[d]
        single = [max(look(x))[0] for x in text]
        if row.place == "line":
            first = row.licences[[x["first_line"] for x in row.licences].index(row.line)]
            own = look(" ".join(text[first["first_line"] : first["last_line"] + 1]))
            assert math.isclose(row.similarity, max(own)[0], rel_tol=1e-9)
            near = [k for k, s in enumerate(single) if s > 0.2] or [0]
            every = [c for i in near for j in range(i, min(i + 12, len(text))) for c in look(" ".join(text[i : j + 1]))]
            assert math.isclose(max(w for s, _, w in own if s >= licenses.THRESHOLD), max(w for s, _, w in every if s >= licenses.THRESHOLD), rel_tol=1e-9)
        elif row.licence is None:
            assert max(single) < licenses.THRESHOLD and len(row.licences) == 0


def wrapped(text, width, prefix="# "):
    import textwrap

    return "\n".join(prefix + x for x in textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))


def test_licences_wrapped_at_any_width_and_several_of_a_file(spark):
    code = "\n".join(f"value_{k} = compute(step={k}, of=total)  # the rest of the work" for k in range(20))
    whole = [(name, text) for name, text in licenses.TEMPLATES if name != licenses.NOTICE]
    rows, want = [], {}
    for name, text in whole:
        for width in range(30, 101, 10):
            rows.append((f"{len(rows)}/x.py", f"#!/usr/bin/env python\n# Copyright (c) 2021 The Makers\n# All rights reserved.\n#\n{wrapped(text, width)}\n\n{code}"))
            want[rows[-1][0]] = [name]
    long = {name: text for name, text in licenses.TEMPLATES if len(text) > 400}
    for a, b in [("MIT", "BSD-3-Clause"), ("Apache-2.0", "GPL-2.0"), ("ISC", "BSD-2-Clause"), ("LGPL-2.1", "LGPL-3.0")]:
        for gap in ("\n#\n", f"\n{code}\n"):
            rows.append((f"{len(rows)}/x.py", f"{wrapped(long[a], 72)}{gap}{wrapped(long[b], 72)}\n{code}"))
            want[rows[-1][0]] = [a, b]
    rows.append(("n/x.py", f"{code}\n# All rights reserved.\n{code}"))
    want["n/x.py"] = [licenses.NOTICE]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id int, p string, text string")
    got = licenses.scan(df, F.col("p")).collect()
    assert {r["path"]: [x["licence"] for x in r["licences"]] for r in got} == want
    assert all(r["licence"] in want[r["path"]] for r in got)


def test_a_hot_directory_is_looked_up_in_parts(spark):
    rows = [(0, "r/LICENSE", "Released under the MIT License.")] + [(i, "r/hot/x.c" if i % 3 else f"q{i % 7}/y.c", "int x;") for i in range(1, 400)]
    df = spark.createDataFrame([*rows, (5, "r/hot/x.c", "int x;"), (6, None, None)], "doc_id int, p string, text string")
    got = licenses.inherit(licenses.scan(df, F.col("p"))).collect()
    assert len(got) == 402
    assert all(r["from_directory"] == ("r" if (r["path"] or "").startswith("r/hot") else None) for r in got)


def test_wrapped_headers_whole_licences_and_names(spark):
    bsd = next(text for name, text in licenses.TEMPLATES if name == "BSD-3-Clause" and len(text) > 500)
    mit = next(text for name, text in licenses.TEMPLATES if name == "MIT" and len(text) > 500)
    words = licenses._BSD_HEAD.split()
    wrapped = "#!/bin/sh\n" + "\n".join("# " + " ".join(words[k : k + 5]) for k in range(0, len(words), 5)) + "\n" + "\n".join(f"echo step {k} of the job" for k in range(20))
    files = {
        "a/LICENSE": "You may copy the work of this company only with written consent from our office.",
        "b/LICENSE": f"Copyright (c) 2020 Some Person\n\n{mit}",
        "b/x.c": "int x;",
        "c/notes.txt": "\n".join(bsd[k : k + 70] for k in range(0, len(bsd), 70)),
        "d/run.sh": wrapped,
        "e/a.txt": "prose first\nAll rights reserved.\nprose after",
    }
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files.items())], "doc_id int, p string, text string")
    got = {r["path"]: (r["effective_licence"], r["basis"], r["is_file"]) for r in licenses.inherit(licenses.scan(df, F.col("p"))).collect()}
    assert got == {
        "a/LICENSE": (None, None, False), "b/LICENSE": ("MIT", "own", True), "b/x.c": ("MIT", "inherited", False), "c/notes.txt": ("BSD-3-Clause", "own", True),
        "d/run.sh": ("BSD-2-Clause", "own", False), "e/a.txt": ("Proprietary", "own", False),
    }


def brute_hits(text, windows):
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hit, items = set(), set()
    for w, who in windows.items():
        for a in range(len(words) - len(w) + 1):
            if tuple(words[a : a + len(w)]) == w:
                hit |= set(range(a, a + len(w)))
                items |= who
    return len(words), len(hit), sorted(items)


def brute_windows(items):
    out = {}
    for i, t in items:
        w = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        for a in range(max(1, len(w) - 9) if w else 0):
            out.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    return out


def test_op6(spark, sf, docs):
    got = run("op6_decontaminate", spark, sf).set_index("doc_id")
    windows = brute_windows(duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall())
    for d, t in list(docs.items()):
        n, hit, items = brute_hits(t, windows)
        r = got.loc[d]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(items), wumanber.digest(items), hit > 0)


@pytest.mark.parametrize("block", [64 << 20, 30])
def test_decontamination_cases(spark, block, monkeypatch):
    monkeypatch.setattr(wumanber, "BLOCK_BYTES", block)
    items = [(1, "a b c"), (2, "x"), (3, ""), (4, None), (5, "b c"), (6, " ".join(f"w{i}" for i in range(14))), (7, "A-b_C"), (8, "é ü é ü")]
    texts = ["a b c", "B c x! x", "", None, "z " * 50 + " ".join(f"W{i}," for i in range(14)), "aa bb cc", "é ü é ü é ü", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10", "x" * 10_000]
    schema = "doc_id long, text string, spans string, `n.x` int"
    df = spark.createDataFrame([(i, t, "s", None) for i, t in enumerate(texts)], schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in wumanber.hit_columns(wumanber.contamination(df, bench)).collect()}
    windows = brute_windows(items)
    for i, t in enumerate(texts):
        n, hit, who = brute_hits(t, windows)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["items_sha256"]) == (n, hit, len(who), wumanber.digest(who))


def test_op7(spark, sf, docs):
    got = run("op7_pack", spark, sf).sort_values(["doc_id", "piece"])
    t, by, total = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")), dict(list(got.groupby("doc_id"))), 0
    for d, x in docs.items():
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        total += len(ids)
        for i, r in enumerate(by[d].itertuples()):
            part = ids[i * 4096 : (i + 1) * 4096]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (i, i * 4096, len(part), crc(part))
        assert by[d].length.sum() == len(ids)
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *np.cumsum(bin_.length)[:-1]] and bin_.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-total // 4096) + 1


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = dict(Counter(rng.integers(1, 30, rng.integers(1, 9)).tolist()))
        room = int(rng.integers(1, 60))
        sums = {0}
        for x, n in counts.items():
            sums = {s + k * x for s in sums for k in range(n + 1)}
        used = packing.fullest(counts, room)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in used.items())


def canonical(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())


def test_op8(spark, sf, docs):
    got = run("op8_digest", spark, sf).set_index("doc_id")
    ids, texts, names = list(docs), list(docs.values()), {}
    for k, d in enumerate(ids):
        t, nxt = texts[k], texts[(k + 1) % len(ids)]
        half = len(t) // 2
        e, r = t[: len(t) - half] + nxt[:half], got.loc[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canonical(t) == canonical(e)), float(canonical(t) == canonical(nxt)))
        assert names.setdefault(canonical(t), r.fingerprint) == r.fingerprint and names.setdefault(canonical(e), r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(names.values())) == len(names)


def test_digest_cases(spark, monkeypatch):
    texts = ["Ａ  b", "a B\n", "", None, " ", "ﬁ x", "fi X", "other"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    by = lambda rows: [r["fingerprint"] for r in sorted(rows, key=lambda r: r["doc_id"])]
    a = by(digest.fingerprint(df).collect())
    assert a[0] == a[1] and a[2] == a[3] == a[4] and a[5] == a[6] and len(set(a)) == 4
    # digests that all collide: the bytes tell texts apart
    monkeypatch.setattr(digest, "wide_hash", lambda form: [F.lit(1).cast("long") + F.length(form) * 0, F.lit(2).cast("long")])
    b = by(digest.fingerprint(df).collect())
    assert [x == y for x, y in combinations(b, 2)] == [x == y for x, y in combinations(a, 2)]
    rows = {r["doc_id"]: r for r in digest.edits(df).collect()}
    assert rows[0]["near_next"] == 1.0 and rows[1]["near_next"] == 0.0 and rows[0]["fingerprint"] != rows[7]["fingerprint"]


def test_op9(spark, sf, docs):
    got = run("op9_quality", spark, sf).set_index("doc_id")
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").df().set_index("doc_id").join(got)
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert all(got.held_out[d] == (zlib.crc32(str(d).encode()) % 3 == 1) for d in docs)
    held = labels[labels.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9


def test_quality_cases(spark):
    texts = ["good clean words here", "BAD!! BAD!! BAD!!", "", None, "x" * 50_000]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (9, 1), (3, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels, "quality", F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality.scored(df, model).collect()}
    assert got[0] > 0.5 > got[1] and got[2] == got[3] and all(0 <= s <= 1 for s in got.values())
    none = quality.fit(df, labels.where("doc_id > 99"), "quality", F.lit(True))
    assert {r["score"] for r in quality.scored(df, none).collect()} == {0.5}


def test_op10(spark, sf, docs):
    got = run("op10_hilbert", spark, sf).set_index("doc_id")
    for d, t in docs.items():
        assert (got["size"][d], got.text_crc32[d]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sizes = got.groupby("shard")["size"].sum()
    assert set(got.shard) == set(range(8)) and sizes.max() - sizes.min() <= 2 * got["size"].max()
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (4, 2)])
def test_curve_steps_to_neighbours(spark, n, bits):
    points = list(np.ndindex(*[1 << bits] * n))
    df = spark.createDataFrame([tuple(map(int, p)) for p in points], ", ".join(f"c{i} int" for i in range(n)))
    rows = df.withColumn("h", hilbert.curve_index([F.col(f"c{i}") for i in range(n)], bits)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(len(points)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def test_equal_texts_stay_together_unless_heavy(spark):
    rows = [(i, f"t{i % 400}" * 5, "en", "s", 1) for i in range(1200)] + [(i, "hot" * 50, None, None, 1) for i in range(2000, 2600)] + [(5000, None, "en", "s", 1)]
    got = hilbert.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int")).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() < 0.03 * sizes.sum()
    texts = {r[0]: r[1] for r in rows}
    small = got[got.doc_id < 1200]
    assert (small.groupby(small.doc_id.map(texts))["shard"].nunique() == 1).all()


@pytest.mark.parametrize("name", ["op1_suffix_tree", "op2_token_files", "op3_simhash", "op4_warc", "op5_licenses", "op6_decontaminate", "op7_pack", "op8_digest", "op9_quality", "op10_hilbert", "op12_secrets", "op13_resample"])
def test_empty_and_odd_tables(spark, tmp_path, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, `bucket` string, `n.x` int"
    odd = [(None, "a b", None, None, None, 1, "x", 1), (1, None, "en", "s", 0, 1, "x", 1), (1, None, "en", "s", 0, 1, "x", 1), (2, "", None, "s", 0, None, None, None), (2, "same doc_id", "en", "s", 0, 1, "x", 1), (3, "a b " * 30_000, "en", "s", 0, 1, "x", 1)]
    bench = spark.createDataFrame([(None, "a b a b a b a b a b"), (1, None), (1, "q")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, None), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for k, rows in enumerate(([], odd)):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        (bench if rows else bench.limit(0)).write.parquet(f"{folder}/benchmark.parquet")
        (labels if rows else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(r[0], r[6], r[1], r[7], r[7]) for r in rows], "page_id long, url string, html string, payload_bytes int, `n.x` int").write.parquet(f"{folder}/pages.parquet")
        got = run(name, spark, folder)
        if name == "op4_warc":
            first = {}
            for i, html in ((r[0], r[1] or "") for r in rows):
                first[html] = min(first.get(html, i), i, key=lambda x: (x is None, x or 0))
            assert sorted(got.payload_bytes) == sorted(len((r[1] or "").encode()) for r in rows) and set(got.refers_to.dropna()) <= set(first.values())
            assert sum(got.record_type == "response") == len(first) + 1 if rows else not len(got)  # the repeated row is a response again
        elif name == "op7_pack":  # pieces: as many as the ids of each document ask for
            t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
            want = sum(-(-(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1) // 4096) for r in rows)
            assert len(got) == want and got.length.sum() == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
        else:
            assert len(got) == len(rows) and sorted(map(str, got.doc_id.astype("Int64"))) == sorted("<NA>" if r[0] is None else str(r[0]) for r in rows)


def test_benchmark_blocks_give_what_one_block_gives(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(None, "one null item of ten words that hits nothing here")], "item_id long, text string"))
    rows = lambda: sorted(map(tuple, wumanber.hit_columns(wumanber.contamination(docs, items)).collect()))
    one = rows()
    monkeypatch.setattr(wumanber, "BLOCK_BYTES", 2000)
    assert rows() == one and any(r[2] for r in one)


def test_null_benchmark_ids_hit_without_a_name(spark):
    text = "a b c d e f g h i j k"
    got = wumanber.hit_columns(wumanber.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(None, text)], "item_id long, text string"))).head()
    assert (got["n_hit"], got["n_items"], got["items_sha256"]) == (11, 0, hashlib.sha256(b"").hexdigest())


def test_many_rows_without_an_id_stay_linear(spark):
    rows = [(None, "the same text here")] * 3000 + [(None, f"text {i} of many") for i in range(2000)] + [(7, "The  same text here")] * 500
    got = digest.edits(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(got) == len(rows) and got.fingerprint.nunique() == 2001


def test_token_files_roll(spark, sf, docs, monkeypatch):
    monkeypatch.setattr(pfor, "ROLL", 5000)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "5")
    manifest = pfor.stored(pfor.write_token_files(spark.read.parquet(f"{sf}/documents.parquet"), tokenizer_file("byte_bpe_50k.json"), 2))
    spark.conf.set(batch, before)
    assert manifest.count() > 8
    got = pfor.read_token_files(manifest).toPandas().sort_values("doc_id")
    assert list(got.doc_id) == list(docs) and list(got.start) == [0, *np.cumsum(got.n_tokens)[:-1]]


def test_shards_prune_on_every_dimension(spark, sf, tmp_path):
    import pyarrow.dataset as ds

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("bytes", F.octet_length("text"))
    docs = docs.union(docs.limit(3))  # repeated rows are written as often as they are there
    folder = hilbert.write_shards(docs, hilbert.shard(docs), f"{tmp_path}/shards", files=32)
    files = [f.metadata for f in ds.dataset(folder, format="parquet", partitioning="hive").get_fragments()]
    assert sum(m.num_rows for m in files) == docs.count()
    for column, value in (("source", "src7"), ("lang", "fr"), ("bytes", 40_000), ("doc_id", 3)):
        k = files[0].schema.names.index(column)
        spans = [(st.min, st.max) for m in files for st in [m.row_group(0).column(k).statistics]]
        assert sum(a <= value <= b for a, b in spans) < 0.8 * len(files), column


def test_one_step_of_training_is_that_of_the_definition():
    entries, labels = [quality.gathered("good words"), quality.gathered("BAD!!")], np.array([1, 0])
    table = quality.train(entries, labels, seed=3)
    rng = np.random.default_rng(3)
    v = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << quality.BITS, quality.DIM)).astype(np.float32)
    w = rng.uniform(-0.1, 0.1, (quality.DIM, 2)).astype(np.float32)
    done, steps = 0, quality.EPOCHS * 2
    for _ in range(quality.EPOCHS):
        for k in rng.permutation(2):
            at, share = entries[k]
            rate = quality.RATE * (1 - done / steps)
            done += 1
            mean = sum(s * v[a] for a, s in zip(at, share))
            z = np.exp([mean @ w[:, 0], mean @ w[:, 1]])
            miss = z / z.sum() - np.eye(2)[labels[k]]
            back = w @ miss
            w = w - rate * np.outer(mean, miss)
            for a, s in zip(at, share):
                v[a] = v[a] - 0.1 * rate * s / (share @ share) * back
    assert np.allclose(table, v @ (w[:, 1] - w[:, 0]), atol=1e-4)
    for text in ("good words", "BAD!!", ""):
        at, share = quality.gathered(text)
        assert math.isclose(quality.log_odds([text], table)[0], float(share @ table[at]), rel_tol=1e-4, abs_tol=1e-6)


def test_digests_fold_the_case_of_all_scripts(spark):
    same = [["Straße", "STRASSE", "strasse"], ["ΟΔΟΣ", "οδος", "οδοσ"], ["ﬃ", "FFI"], ["İx", "i̇X"], ["Ǆ", "ǆ", "dž"]]
    rows = [(i, t, k) for k, own in enumerate(same) for i, t in enumerate(own, 10 * k)]
    got = {r["doc_id"]: r["fingerprint"] for r in digest.fingerprint(spark.createDataFrame(rows, "doc_id int, text string, k int")).collect()}
    assert len({got[i] for i, _, _ in rows}) == len(same) and all(len({got[i] for i, _, k in rows if k == g}) == 1 for g in range(len(same)))
