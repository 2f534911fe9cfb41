"""The pipeline: what each stage drops, on the smallest tables and on planted cases."""

import random

import duckdb
import pytest

import corpus_pipeline as C
from hushframe.llm import gph, neardup, simhash


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")


def kept(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_and_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == C.COLUMNS


def test_quality_stage_drops_junk_and_keeps_clean(spark, sf):
    left = kept(C.keep_quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf))
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    assert all((d in left) == (q == 1) for d, q in labels.items())


def test_near_duplicates(spark):
    rng = random.Random(5)
    texts = {i: words(rng, 300) for i in range(40)}
    for k in range(10):  # copies, exact and with a few words changed
        own = texts[k].split()
        texts[100 + k] = texts[k]
        for at in rng.sample(range(300), 3):
            own[at] = "changed"
        texts[200 + k] = " ".join(own)
    texts |= {300: "", 301: None, 302: "one", 303: "two words"}
    left = kept(C.drop_near_duplicates(spark, table(spark, texts), ""))
    assert set(range(40)) <= left and not any(100 <= d < 300 for d in left)
    assert {302, 303} <= left and len({300, 301} & left) == 1


def test_near_duplicates_against_brute_force(spark, sf):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall())
    left = kept(C.drop_near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf))
    assert left == exact_kept(docs)


def test_recall_of_near_copies(spark):
    """Links at the threshold and above: at least 0.9 are found, and nothing else is dropped."""
    rng, texts = random.Random(11), {}
    for k in range(400):
        own = words(rng, rng.choice([60, 150, 400])).split()
        texts[2 * k] = " ".join(own)
        share = rng.uniform(0.0, 0.025)
        texts[2 * k + 1] = " ".join("changed" if rng.random() < share else w for w in own)
    left, right = kept(C.drop_near_duplicates(spark, table(spark, texts), "")), exact_kept(texts)
    linked = set(texts) - right
    assert len(linked) > 150 and right <= left
    assert len(linked - left) >= 0.97 * len(linked)


def exact_kept(texts):
    """The smallest id of each component of exact links at a similarity of 0.8, by brute force."""
    ids = sorted(texts)
    sets = {}
    for i in ids:
        w = (texts[i] or "").lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i for i in ids if top(i) == i}


def test_only_links_of_the_stated_similarity_count(spark):
    rng = random.Random(9)
    texts = {}
    for k in range(60):  # pairs of about 0.67 to 0.9, of long and of short texts
        own = words(rng, 24 if k % 3 == 0 else 250).split()
        texts[2 * k] = " ".join(own)
        for at in range(rng.randint(1, 10) if len(own) > 30 else 1):
            own[-1 if len(own) < 30 and k % 2 else at * 20 + 7] = "changed"
        texts[2 * k + 1] = " ".join(own)
    texts |= {500 + k: words(rng, 6) for k in range(60)} | {600: "", 601: None}
    assert kept(C.drop_near_duplicates(spark, table(spark, texts), "")) == exact_kept(texts)


def test_large_groups_are_joined_through_others(spark, monkeypatch):
    monkeypatch.setattr(gph, "LARGE", 30)
    monkeypatch.setattr(gph, "SMALL", 4)
    monkeypatch.setattr(neardup, "TOGETHER", 1000)
    rng = random.Random(3)
    own, texts = words(rng, 200).split(), {}
    for k in range(80):  # edits of one text, in turn farther from it
        if k % 8 == 0:
            own = words(rng, 200).split() if k % 40 == 0 else own
        own = list(own)
        own[rng.randrange(200)] = f"changed{k}"
        texts[k] = " ".join(own)
    assert kept(C.drop_near_duplicates(spark, table(spark, texts), "")) == exact_kept(texts)


def test_decontamination_drops_hits_only(spark, tmp_path):
    rng = random.Random(1)
    item = words(rng, 30)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    part = " ".join(item.split()[5:15])
    docs = table(spark, {0: words(rng, 50), 1: f"{words(rng, 20)} {part.upper()}! {words(rng, 20)}", 2: " ".join(item.split()[5:14]), 3: None})
    assert kept(C.drop_contaminated(spark, docs, str(tmp_path))) == {0, 2, 3}


def test_run_keeps_each_document_once(spark, sf):
    got = C.run(spark, sf).toPandas()
    assert len(got) and not got.duplicated(["doc_id", "piece"]).any()
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    texts = [docs[d] for d in set(got.doc_id)]
    assert len(set(texts)) == len(texts)


@pytest.mark.parametrize("rows", [{}, {1: None, 2: ""}])
def test_empty_and_null_documents(spark, sf, rows):
    docs = table(spark, rows)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() <= len(rows)
    assert simhash.near_groups(table(spark, rows)).count() == len(rows)


def test_near_duplicate_stage_keeps_odd_columns_in_order(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(5, text, 2), (1, text, 1), (1, text, 7), (None, text, 3), (9, "z " * 60_000, 4)], "doc_id long, text string, `n.x` int")
    got = neardup.deduplicate(df.select("`n.x`", "doc_id", "text"))
    assert got.columns == ["n.x", "doc_id", "text"] and sorted(r[0] for r in got.collect()) == [1, 3, 4, 7]
