"""Near-duplicate groups of texts: word shingles of a Jaccard similarity of at least 0.8.

Two SimHash fingerprints of a text's distinct shingles (of two hashes) propose pairs by the generalised pigeonhole principle of
:mod:`gph`: at most ``LIMIT`` differing bits in one of the two and ``WIDE`` in both together.  At a similarity of 0.8
about 15 % of the bits differ, so a pair at the threshold is missed with odds of about 0.03 (binomial), and more alike
pairs hardly ever.  The similarity also bounds the ratio of the sizes of the sets by 1.25, so only texts of the same or
neighbouring bands of size are compared, which loses nothing.  Each proposed pair is then checked by its shingle sets.

A dense cluster has very many pairs, so pairs are no rows: a forest of the proposed pairs gives the clusters, and a task gets
the sets of a cluster once, checks what is proposed between texts that are not joined yet, and returns the links that join.
A cluster of more sets than a task may hold is first joined along its forest; then its largest component needs no check
in itself, and blocks of the rest meet each other and the blocks of that component.  Work grows with the square of what
stays apart within a cluster, never with that of what is alike.  Sets are told by 64-bit hashes of the shingles, equal
texts by 128 bits of their words.

Cases: texts of the same words are one node, wordless and null ones too, and those have no links; a text of fewer words
than a shingle is one shingle; an empty table has no links.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .gph import components, links
from .simhash import majority, mixed, shingle_hashes, words_of
from .store import partitions, written
from .tokens import runs

LIMIT, WIDE = 12, 30
#: A link: NUM / DEN of the shingles of either text are shared.
NUM, DEN = 4, 5
#: Shingles of a block: a task holds two blocks of a cluster's sets.
TOGETHER = 2_000_000
#: Characters whose shingles a worker holds together; a longer text is taken by itself.
RUN = 250_000


def _digest(text: str | None) -> tuple[int, int]:
    """128 bits of the words of a text, as two longs."""
    d = xxhash.xxh3_128_digest(b" ".join(words_of(text)))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sets(hashes: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of consecutive runs, sorted within each, and their numbers."""
    owner = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.bincount(owner[keep], minlength=len(many))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, k1, k2 (the digest of the words), n (distinct shingles), fp, fp2."""
    names = ["doc_id", "k1", "k2", "n", "fp", "fp2"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for a, b in runs(texts, RUN):
                hashes, n = _sets(*shingle_hashes(texts[a:b], size))
                keys = np.array([_digest(t) for t in texts[a:b]], np.int64).reshape(-1, 2)
                prints = [majority(h, n).view(np.int64) for h in (hashes, mixed(hashes))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, (keys[:, 0], keys[:, 1], n.astype(np.int64), *prints))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, ", ".join(f"{c} long" for c in names))


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, hashes (the sorted set) of the texts of the nodes in ``wanted`` (node, doc_id)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for a, b in runs(texts, RUN):
                hashes, n = _sets(*shingle_hashes(texts[a:b], size))
                keys = np.array([_digest(t) for t in texts[a:b]], np.int64).reshape(-1, 2)
                ends = np.cumsum(n)
                raw = [hashes[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(raw, pa.binary())], ["k1", "k2", "hashes"])

    ids = wanted.select("doc_id").distinct()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # texts are dealt by id at every size: a list that is broadcast while it is short would be another plan for small tables
    held = docs.join(ids.hint("merge"), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").mapInArrow(make, "k1 long, k2 long, hashes binary")
    held = held.select(F.struct("k1", "k2").alias("node"), "hashes")
    return held.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


LINKS = "a1 long, a2 long, b1 long, b2 long"


class Block:
    """The sets of some nodes, with what the nodes belong to and what has been joined here."""

    def __init__(self, rows: list[tuple], away: int):
        """``rows``: k1, k2, fp, fp2, o1, o2, hashes; the last ``away`` of them are not compared with each other."""
        self.node = [(r[0], r[1]) for r in rows]
        self.fp, self.fp2 = (np.array([r[k] for r in rows], np.int64).view(np.uint64) for k in (2, 3))
        number: dict[tuple, int] = {}
        self.own = np.array([number.setdefault((r[4], r[5]), len(number)) for r in rows])
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        self.n = np.fromiter(map(len, sets), np.int64, len(sets))
        self.start = np.cumsum(self.n) - self.n
        _, self.shingle = np.unique(np.concatenate(sets), return_inverse=True)
        self.homes = len(rows) - away

    def links(self) -> list[tuple[int, int, int, int]]:
        """Links that join what was apart, by every pair that is proposed and not joined."""
        out, marked = [], np.zeros(int(self.shingle.max()) + 1 if len(self.shingle) else 0, bool)
        for q in range(min(self.homes, len(self.node) - 1)):
            d, e = (np.bitwise_count(x[q + 1 :] ^ x[q]) for x in (self.fp, self.fp2))
            near = ((d <= LIMIT) | (e <= LIMIT)) & (d + e <= WIDE) & (self.own[q + 1 :] != self.own[q])
            near &= DEN * np.minimum(self.n[q + 1 :], self.n[q]) >= NUM * np.maximum(self.n[q + 1 :], self.n[q])
            at = np.flatnonzero(near) + q + 1
            if not len(at):
                continue
            mine = self.shingle[self.start[q] : self.start[q] + self.n[q]]
            marked[mine] = True
            n = self.n[at]
            first = np.cumsum(n) - n
            theirs = self.shingle[np.repeat(self.start[at] - first, n) + np.arange(int(n.sum()))]
            shared = np.add.reduceat(marked[theirs].astype(np.int64), first)
            marked[mine] = False
            for k in at[DEN * shared >= NUM * (n + self.n[q] - shared)].tolist():
                if self.own[k] != self.own[q]:
                    self.own[self.own == self.own[k]] = self.own[q]
                    out.append((*self.node[q], *self.node[k]))
        return out


def closed(rows: DataFrame) -> DataFrame:
    """Links (a1, a2, b1, b2) within each task of ``rows`` (task, away, k1, k2, fp, fp2, o1, o2, hashes)."""
    names = ["task", "away", "k1", "k2", "fp", "fp2", "o1", "o2", "hashes"]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, away, out = None, [], 0, []
        table = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [()] * 4)], ["a1", "a2", "b1", "b2"])
        for batch in batches:
            for t, far, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if t != task:
                    if len(held) > 1:
                        out += Block(held, away).links()
                    task, held, away = t, [], 0
                held.append(row)
                away += far
            if len(out) > 10_000:
                yield table()
                out = []
        if len(held) > 1:
            out += Block(held, away).links()
        yield table()

    dealt = rows.select(*names).repartition(partitions(rows.sparkSession), "task").sortWithinPartitions("task", "away")
    return dealt.mapInArrow(close, LINKS)


def _node(k1: str, k2: str) -> Column:
    return F.struct(F.col(k1).alias("k1"), F.col(k2).alias("k2"))


def _ordered(found: DataFrame) -> DataFrame:
    a, b = _node("a_k1", "a_k2"), _node("b_k1", "b_k2")
    return found.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def _proposed(rows: DataFrame) -> DataFrame:
    """A forest of proposed pairs (a, b) of ``rows`` (fp, fp2, k1, k2, band): by the first fingerprint and by the second one."""
    swapped = rows.select(F.col("fp2").alias("fp"), F.col("fp").alias("fp2"), "k1", "k2", "band")
    found = [links(r, LIMIT, WIDE, ids=("k1", "k2"), band="band") for r in (rows, swapped)]
    return _ordered(found[0].unionByName(found[1]))


def _edges(found: DataFrame) -> DataFrame:
    return found.select(_node("a1", "a2").alias("a"), _node("b1", "b2").alias("b"))


def _apart(sets: DataFrame, forest: DataFrame, big: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows for :func:`closed` of the clusters in ``big`` (cluster), and the links of their forest."""
    own = sets.join(big, "cluster", "left_semi")
    # forest pairs are checked by two: each is a task, and a set travels with its pairs, which are as many as the texts
    pairs = forest.join(own.select(F.col("node").alias("a")), "a", "left_semi").withColumn("task", F.xxhash64("a", "b"))
    ends = pairs.select("task", F.explode(F.array("a", "b")).alias("node"))
    tested = ends.join(own, "node").select("task", F.lit(0).alias("away"), "k1", "k2", "fp", "fp2", F.col("k1").alias("o1"), F.col("k2").alias("o2"), "hashes")
    joined = written(_edges(closed(tested)), "joined")
    now = own.join(components(joined), "node", "left").withColumn("own", F.coalesce("component", "node"))
    now = written(now.drop("component"), "apart")
    sizes = now.groupBy("cluster", "own").agg(F.sum("n").alias("n"))
    whole = sizes.groupBy("cluster").agg(F.max_by("own", F.struct("n", "own")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    whole = whole.where("most < all")  # else one component already
    rows = now.join(whole, "cluster").withColumn("is_main", F.col("own") == F.col("main"))
    blocks = lambda n: F.ceil(n / F.lit(TOGETHER)).cast("int")
    mains, others = blocks(F.col("most")), blocks(F.col("all") - F.col("most"))
    at = F.when(F.col("is_main"), F.pmod(F.xxhash64("node"), mains)).otherwise(F.pmod(F.xxhash64("node"), others)).cast("int")
    rows = rows.withColumn("at", at)
    # a block of the rest meets every block of the rest, and every block of the main component
    every = F.sequence(F.lit(0), others - 1)
    with_rest = F.transform(every, lambda x: F.struct(F.lit(0).alias("kind"), F.least(x, F.col("at")).alias("i"), F.greatest(x, F.col("at")).alias("j"), (x < F.col("at")).cast("int").alias("away")))
    with_main = F.transform(F.sequence(F.lit(0), mains - 1), lambda x: F.struct(F.lit(1).alias("kind"), F.col("at").alias("i"), x.alias("j"), F.lit(0).alias("away")))
    of_main = F.transform(every, lambda x: F.struct(F.lit(1).alias("kind"), x.alias("i"), F.col("at").alias("j"), F.lit(1).alias("away")))
    meets = F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(with_rest, with_main))).alias("x")
    rows = rows.select("cluster", "k1", "k2", "fp", "fp2", F.col("own.k1").alias("o1"), F.col("own.k2").alias("o2"), "hashes", meets)
    return rows.select(F.xxhash64("cluster", "x.kind", "x.i", "x.j").alias("task"), F.col("x.away").alias("away"), "k1", "k2", "fp", "fp2", "o1", "o2", "hashes"), joined


def groups(docs: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """node, component of every node with a link; ``found`` holds the :func:`signatures` of ``docs``."""
    nodes = found.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "fp", "fp2")))
    band = F.floor(F.log(F.col("n").cast("double")) / log(DEN / NUM)).cast("int")
    nodes = written(nodes.select("doc_id", "k1", "k2", "n", "fp", "fp2", band.alias("band")), "nodes")
    forest = written(_proposed(nodes.select("k1", "k2", "fp", "fp2", "band")), "proposed")

    cluster = components(forest).select("node", F.col("component").alias("cluster"))
    # a cluster is named by its smallest node, which components() does not list
    cluster = cluster.union(cluster.select("cluster", "cluster").distinct())
    members = written(nodes.withColumn("node", _node("k1", "k2")).join(cluster, "node"), "members")
    sets = shingle_sets(docs, members.select("node", "doc_id"), size)
    sets = written(members.join(sets, "node"), "sets")
    big = written(sets.groupBy("cluster").agg(F.sum("n").alias("all")).where(F.col("all") > TOGETHER).select("cluster"), "big")
    own = sets.join(big, "cluster", "left_anti")
    rows = own.select(F.xxhash64("cluster").alias("task"), F.lit(0).alias("away"), "k1", "k2", "fp", "fp2", F.col("k1").alias("o1"), F.col("k2").alias("o2"), "hashes")
    edges = _edges(closed(rows))
    if not big.isEmpty():
        rows, joined = _apart(sets, forest, big)
        edges = edges.unionByName(_edges(closed(rows))).unionByName(joined)
    return components(edges)


def deduplicate(docs: DataFrame, size: int = 5) -> DataFrame:
    """``docs`` without all but the document of the smallest ``doc_id`` in each near-duplicate group.

    Rows that share the kept ``doc_id`` all stay, and so do rows without one; other columns are kept.
    """
    found = written(signatures(docs, size), "signatures")
    of = written(groups(docs, found, size), "groups")
    named = found.select("doc_id", _node("k1", "k2").alias("node")).join(of, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    named = written(named, "named")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("m")).where("m > 1")
    keep = named.join(least, "component", "left").where("component_id is null or doc_id = component_id").select("doc_id").distinct()
    # rows of one doc_id may lie in several groups: what any of them keeps stays
    gone = named.select("doc_id").distinct().join(keep, "doc_id", "left_anti").where("doc_id is not null")
    gone = written(gone.withColumnRenamed("doc_id", "_gone"), "gone")
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["_gone"], "left_anti")
