"""Language-model scores from a probabilistic suffix tree over bytes.

A text is its lower-cased words joined by blanks and closed by a line feed, so the bytes spell its tokens one to one.  The
tree's states are byte contexts of up to ``DEPTH`` symbols.  Counts come from all training texts.  A context that occurs
``LEAST`` times or more is kept if its next-symbol distribution diverges from that of its suffix by more than chance would
(a likelihood-ratio test), together with its suffixes; contexts of one symbol always are.  The distribution of a state is
smoothed towards its suffix's, down to even odds for all 256 bytes, so every text has a probability.  A byte is scored in
the longest kept suffix of what stands before it.

The tree grows with the corpus.  Contexts with the same last two symbols and all their suffixes lie in one partition, so
branches are grown by tasks of their own.  The grown tree is sent round in blocks of at most ``BLOCK`` rows, by those two
symbols; each block scores the bytes that are its own, and the sums of all blocks are a text's score.

Cases: a null or wordless text is just the end token; without training text every byte has even odds; repeated rows are
scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .quality import _powers
from .store import partitions, written
from .tokens import runs

#: Symbols of the longest contexts, occurrences from which a context is tested, and the weight of the suffix.
DEPTH, LEAST, ALPHA = 5, 8, 2.0
#: Rows of the tree that a task holds at once: 16 bytes each.
BLOCK = 4_000_000
#: Characters that a worker counts or scores together; a longer text is taken by itself.
RUN = 1_500_000
#: Words with at least this share of all training tokens go to every task (1 / share of them at most); others are joined.
COMMON = 1e-6
_TOP = np.uint64(1 << 63)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _spell(texts: list[str]) -> list[bytes]:
    return [b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) + b"\n" for t in texts]


def _keys(spelled: list[bytes]) -> np.ndarray:
    """For every byte of every text: its DEPTH predecessors and itself as one number; line feeds stand before a text."""
    pad = b"\n" * DEPTH
    buf = np.frombuffer(b"".join(x for s in spelled for x in (pad, s)), np.uint8)
    key = buf.astype(np.uint64)
    for n in range(1, DEPTH + 1):
        key = (key[:-1] << np.uint64(8)) | buf[n:]
    size = np.fromiter(map(len, spelled), np.int64, len(spelled))
    keep = np.ones(len(key), bool)  # keys that end in the padding of the next text go
    starts = np.cumsum(size + DEPTH)[:-1]
    for k in range(DEPTH):
        keep[starts + k - DEPTH] = False
    return key[keep]


def _word_hashes(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A negative 64-bit hash of every token (the end token last), and the number of tokens of each text."""
    buf = np.frombuffer(b"".join(spelled), np.uint8)
    size = np.fromiter(map(len, spelled), np.int64, len(spelled))
    up, down = _powers(len(buf) + 1)
    # words end at a blank or a line feed; the line feed of a wordless text ends no word
    stop = np.flatnonzero((buf == 32) | (buf == 10))
    begin = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((buf + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)])
        h = (sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64)
        h = (h ^ (h >> np.uint64(31))) * _MUL
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) | _TOP
    ends = np.cumsum(size)
    closing = buf[stop] == 10
    real = stop > begin
    many = np.diff(np.concatenate([[0], np.cumsum(real)[np.searchsorted(stop, ends - 1)]])) + 1
    out = np.empty(int(real.sum()) + len(spelled), np.uint64)
    at = np.cumsum(many)
    keep = np.ones(len(out), bool)
    keep[at - 1] = False
    out[keep] = h[real]
    out[at - 1] = END
    del closing
    return out, many


#: The hash that stands for the end token.
END = _TOP


class _Tally:
    """Counts of keys, merged now and then."""

    def __init__(self, most: int = 1_500_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows, self.most = 0, most

    def add(self, keys: np.ndarray) -> None:
        got = np.unique(keys, return_counts=True)
        self.parts.append(got)
        self.rows += len(got[0])
        if self.rows > self.most:
            self.merge()
            self.most = max(self.most, 2 * self.rows)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, np.uint64)
        n = np.concatenate([p[1] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.parts = [(keys[first], np.add.reduceat(n, first) if len(first) else n)]
        self.rows = len(first)
        return self.parts[0]


def count(docs: DataFrame) -> DataFrame:
    """key, n: how often each byte with its context (key >= 0) and each token (key < 0) occurs in all texts of ``docs``."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = _Tally(), _Tally()
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for a, b in runs(texts, RUN):
                spelled = _spell(texts[a:b])
                grams.add(_keys(spelled))
                words.add(_word_hashes(spelled)[0])
        for keys, n in (grams.merge(), words.merge()):
            for a in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 200_000].view(np.int64)), pa.array(n[a : a + 200_000])], ["key", "n"])

    return docs.select("text").mapInArrow(tally, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


class Tree:
    """Kept states by depth: continuations with their log10 probability, contexts with the log10 share of their suffix."""

    def __init__(self, rows: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray]] | None = None):
        """``rows``: keys and values of the contexts (True) and continuations (False) of each depth."""
        none = (np.zeros(0, np.uint64), np.zeros(0))
        self.contexts, self.entries = ([(rows or {}).get((kind, d), none) for d in range(DEPTH + 1)] for kind in (True, False))
        for level in (self.contexts, self.entries):
            for d, (key, value) in enumerate(level):
                order = np.argsort(key)
                level[d] = (key[order], value[order])

    @classmethod
    def grown(cls, keys: np.ndarray, n: np.ndarray, low_keys: np.ndarray, low_n: np.ndarray) -> Tree:
        """From counts: ``low`` of all pairs of a symbol and the next, ``keys`` of the deepest continuations of some branches."""
        levels = []
        for d in range(DEPTH + 1):
            own, count = (low_keys, low_n) if d < 2 else (keys, n)
            own = own & np.uint64((1 << 8 * (d + 1)) - 1)
            order = np.argsort(own)
            own, count = own[order], count[order].astype(np.float64)
            first = _groups(own)
            k, c = own[first], np.add.reduceat(count, first) if len(first) else count
            first = _groups(k >> np.uint64(8))
            total = np.repeat(np.add.reduceat(c, first), np.diff(np.append(first, len(k)))) if len(first) else c
            levels.append((k, c, total))
        kept = [np.unique(k >> np.uint64(8)) for k, _, _ in levels[:2]]
        for d in range(2, DEPTH + 1):
            k, c, t = levels[d]
            own = t >= LEAST
            k, c, t = k[own], c[own], t[own]
            pk, pc, pt = levels[d - 1]
            at = np.searchsorted(pk, k & np.uint64((1 << 8 * d) - 1))  # there: a suffix occurs at least as often
            ctx = k >> np.uint64(8)
            first = _groups(ctx)
            if len(first):
                symbols = np.diff(np.append(first, len(k)))
                gain = np.add.reduceat(c * np.log(c / t * pt[at] / pc[at]), first)
                ctx = ctx[first][2 * gain > symbols + 3 * np.sqrt(2 * symbols)]
            kept.append(ctx)
        for d in range(DEPTH, 2, -1):  # a kept context needs its suffixes
            kept[d - 1] = np.union1d(kept[d - 1], kept[d] & np.uint64((1 << 8 * (d - 1)) - 1))
        tree = cls()
        for d in range(DEPTH + 1):
            k, c, t = levels[d]
            own = np.isin(k >> np.uint64(8), kept[d])
            k, c, t = k[own], c[own], t[own]
            first = _groups(k >> np.uint64(8))
            tree.contexts[d] = ((k >> np.uint64(8))[first], np.log10(ALPHA / (t[first] + ALPHA)))
            below = 10.0 ** tree.log10(k, d - 1) if d and len(k) else np.full(len(k), 1 / 256)
            tree.entries[d] = (k, np.log10((c + ALPHA * below) / (t + ALPHA)))
        return tree

    @staticmethod
    def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return at, sorted_keys[at] == keys

    def log10(self, keys: np.ndarray, deepest: int = DEPTH) -> np.ndarray:
        """log10 of the probability of the last byte of each key after the bytes before it."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        for d in range(deepest, -1, -1):
            own = keys[open_] & np.uint64((1 << 8 * (d + 1)) - 1)
            at, state = self._find(self.contexts[d][0], own >> np.uint64(8))
            where, known = self._find(self.entries[d][0], own)
            known &= state
            out[open_[known]] += self.entries[d][1][where[known]]
            fall = state & ~known
            out[open_[fall]] += self.contexts[d][1][at[fall]]
            open_ = open_[~known]
        out[open_] += np.log10(1 / 256)
        return out


#: Keys whose scores a worker remembers.
MEMORY = 1_000_000


class Scorer:
    """Scores of keys; those of keys seen before are remembered."""

    def __init__(self, tree: Tree):
        self.tree = tree
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        each, back = np.unique(keys, return_inverse=True)
        at, known = Tree._find(self.keys, each)
        value = np.zeros(len(each))
        value[known] = self.values[at[known]]
        new = each[~known]
        if len(new):
            value[~known] = got = self.tree.log10(new)
            if len(self.keys) + len(new) > MEMORY:
                self.keys, self.values = new, got
            else:
                where = np.searchsorted(self.keys, new)
                self.keys, self.values = np.insert(self.keys, where, new), np.insert(self.values, where, got)
        return value[back]


_SCORERS: dict[str, Scorer] = {}


def _scorer(name: str, tree: Tree) -> Scorer:
    """The scorer of this worker for a broadcast tree; only one is kept."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(tree)
    return _SCORERS[name]


def _block(branch: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each branch: the last two symbols of a context."""
    return ((branch * _MUL) >> np.uint64(40)) % np.uint64(blocks)


def build(counts: DataFrame) -> DataFrame:
    """The tree of stored ``counts`` as a table: branch (-1 for contexts of less than two symbols), context, depth, key, value."""
    spark = counts.sparkSession
    grams = counts.where("key >= 0")
    low = grams.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    pairs = spark.sparkContext.broadcast((low.column(0).to_numpy().view(np.uint64), low.column(1).to_numpy()))
    names = ["branch", "context", "depth", "key", "value"]
    schema = "branch long, context boolean, depth int, key long, value double"

    def rows(tree: Tree, depths: range) -> Iterator[pa.RecordBatch]:
        for context, level in ((True, tree.contexts), (False, tree.entries)):
            for d in depths:
                key, value = level[d]
                branch = (key if context else key >> np.uint64(8)) & np.uint64(0xFFFF)
                branch = branch.view(np.int64) if d > 1 else np.full(len(key), -1)
                for a in range(0, len(key), 100_000):
                    n = len(key[a : a + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(branch[a : a + n]), pa.array(np.full(n, context)), pa.array(np.full(n, d, np.int32)), pa.array(key[a : a + n].view(np.int64)), pa.array(value[a : a + n])], names)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("key").to_numpy().view(np.uint64), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if parts:
            keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield from rows(Tree.grown(keys, n, *pairs.value), range(2, DEPTH + 1))

    dealt = grams.select("key", "n").repartition(partitions(spark), F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)))
    branches = written(dealt.mapInArrow(grow, schema), "branches")
    none = np.zeros(0, np.uint64)
    stem = pa.Table.from_batches(rows(Tree.grown(none, none.view(np.int64), *pairs.value), range(2)), schema=pa.schema([("branch", pa.int64()), ("context", pa.bool_()), ("depth", pa.int32()), ("key", pa.int64()), ("value", pa.float64())]))
    return branches.unionByName(spark.createDataFrame(stem))


def _trees(table: DataFrame) -> Iterator[tuple[int, int, Tree]]:
    """(block, blocks, tree) for each block of a tree's table; one is on the driver at a time."""
    blocks = -(-table.count() // BLOCK) or 1
    for block in range(blocks):
        own = table
        if blocks > 1:
            size = table.groupBy("branch").count()  # 65,537 rows at most
            mine = [int(x) for x in size.toArrow().column(0).to_numpy() if x < 0 or _block(np.array([x], np.uint64), blocks)[0] == block]
            own = table.join(F.broadcast(table.sparkSession.createDataFrame([(x,) for x in mine], "branch long")), "branch")
        got = own.select("context", "depth", "key", "value").toArrow()
        context, depth, key, value = (got.column(i).to_numpy() for i in range(4))
        rows = {(kind, d): (key[at].view(np.uint64), value[at]) for kind in (True, False) for d in range(DEPTH + 1) if len(at := np.flatnonzero((context == kind) & (depth == d)))}
        yield block, blocks, Tree(rows)


def _spell_scores(docs: DataFrame, table: DataFrame) -> tuple[Broadcast, DataFrame | None]:
    """The first block of the tree, and the scores (row, score) of all texts by its other blocks, if there are more."""
    spark = docs.sparkSession
    first, more, other = None, [], uuid.uuid4().hex
    for block, blocks, tree in _trees(table):
        model = spark.sparkContext.broadcast((tree, block, blocks))
        if first is None:
            first = model
            continue

        def apply(batches: Iterator[pa.RecordBatch], model=model, block=block) -> Iterator[pa.RecordBatch]:
            row = TaskContext.get().partitionId() << 33
            for batch in batches:
                texts = batch.column("text").fill_null("").to_pylist()
                for a, b in runs(texts, RUN):
                    scores = _sums(_spell(texts[a:b]), model.value, f"{other}-{block}")
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b - a)), pa.array(scores)], ["row", "score"])
                    row += b - a

        more.append(written(docs.select("text").mapInArrow(apply, "row long, score double"), "block-scores"))
    return first, reduce(DataFrame.unionByName, more).groupBy("row").agg(F.sum("score").alias("more_score")) if more else None


def _sums(spelled: list[bytes], model: tuple[Tree, int, int], name: str) -> np.ndarray:
    """What a block of the tree adds to the score of each text."""
    tree, block, blocks = model
    size = np.fromiter(map(len, spelled), np.int64, len(spelled))
    keys = _keys(spelled)
    scorer = _scorer(name, tree)
    if blocks == 1:
        each = scorer(keys)
    else:
        own = _block((keys >> np.uint64(8)) & np.uint64(0xFFFF), blocks) == block
        each = np.zeros(len(keys))
        each[own] = scorer(keys[own])
    return np.add.reduceat(each, np.cumsum(size) - size)


def score(docs: DataFrame, usable: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Rows where ``usable`` holds are learned from.  ``base_score`` is that of a word unigram model with one added to each
    count; ``score`` is the tree's log10 probability of the text's tokens.
    """
    spark = docs.sparkSession
    counts = written(count(docs.where(usable)), "counts")
    words = counts.where("key < 0")
    n_all, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).head()
    common = words.where(F.col("n") >= max(1, int(COMMON * n_all))).orderBy("key").toArrow()
    common_keys = common.column(0).to_numpy().view(np.uint64) if len(common) else np.zeros(0, np.uint64)
    common_n = common.column(1).to_numpy() if len(common) else np.zeros(0, np.int64)
    tree, more_scores = _spell_scores(docs, written(build(counts), "tree"))
    model: Broadcast = spark.sparkContext.broadcast((common_keys, common_n))
    bottom, name = float(np.log10(n_all + distinct + 1)), uuid.uuid4().hex
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "times"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = model.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            for a, b in runs(texts, RUN):
                spelled = _spell(texts[a:b])
                scores = _sums(spelled, tree.value, name)
                hashes, many = _word_hashes(spelled)
                owner = np.repeat(np.arange(b - a), many)
                each, back = np.unique(hashes, return_inverse=True)
                at, known = Tree._find(keys, each)
                logs = np.where(known, np.log10(1.0 + (n[at] if len(n) else 0)), 0.0)
                base = np.bincount(owner, logs[back], b - a)
                seen = np.bincount(owner, known[back], b - a).astype(np.int64)
                far = ~known[back]
                pairs, times = np.unique(np.stack([owner[far].astype(np.uint64), hashes[far]], axis=1), axis=0, return_counts=True) if far.any() else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
                cuts = pa.array(np.searchsorted(pairs[:, 0].astype(np.int64), np.arange(b - a + 1)).astype(np.int32))
                rare = pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64)))
                often = pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int64)))
                rows = pa.array(np.arange(row, row + b - a))
                row += b - a
                yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(many), pa.array(seen), pa.array(base), pa.array(scores), rare, often], names)

    rows = docs.select("doc_id", "text", F.coalesce(~usable, F.lit(True)).alias("held_out"))
    made = written(rows.mapInArrow(apply, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<long>"), "scored")
    far = made.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    found = far.join(words, "key").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("of"))
    out = made.drop("rare", "times").join(found, "row", "left")
    if more_scores is not None:
        out = out.join(more_scores, "row").withColumn("score", F.col("score") + F.col("more_score"))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("of", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(bottom)).alias("base_score"),
        "score",
    )
