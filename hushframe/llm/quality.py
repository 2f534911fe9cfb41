"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors of its words, word pairs and character n-grams (of UTF-8 bytes), each hashed into
a table; a softmax layer follows.  Training is stochastic gradient descent in numpy on a bounded sample of labelled rows,
in one retryable task.  As both layers are linear, a text's log-odds are the average of one number for each feature, so
scoring needs just a table of such numbers.

Cases: null text is empty; an empty text has the end feature alone and gets a score like any other; labels other than 0
and 1, null labels and rows without text are not learned from; a document with several labels is learned from once for each;
without any label all scores are 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .store import plain_names
from .tokens import runs

#: Labelled documents that are learned from: those of the smallest hashes. A bound on the training set, not on scoring.
SAMPLE = 2000
#: Characters that a worker scores together; a longer text is scored by itself.
RUN = 400_000
BITS, DIM, EPOCHS, RATE, GRAMS = 18, 12, 12, 2.0, (2, 3, 4)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x5851F42D4C957F2D)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse; those of a very long text are not remembered."""
    known = _POWERS
    if "up" not in known or len(known["up"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        known = _POWERS if n <= 2 * RUN else {}
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", inverse)):
                known[name] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n - 1, base, np.uint64))]) if n > 1 else np.ones(1, np.uint64)
    return known["up"], known["down"]


def _slot(key: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (key + np.uint64(2 * kind + 1)) * _MUL
        return ((x ^ (x >> np.uint64(32))) * _MUL) >> np.uint64(64 - BITS)


#: The table entry of the feature that every text has.
END = 0


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: its table entries in text order, and the first and last+1 of each text's."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum(size)
    start = end - size
    key = buf.astype(np.uint64)
    for n in range(2, max(GRAMS) + 1):
        key = (key[:-1] << np.uint64(8)) | buf[n - 1 :] if len(key) > 1 else key[:0]
        if n in GRAMS:
            first = np.minimum(start, len(key))
            yield _slot(key, n), first, np.maximum(first, np.minimum(end - n + 1, len(key)))
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.ones(len(buf) + 1, bool)
    edge[:-1] = blank
    edge[end] = True  # a text ends a word
    inner = ~blank
    opens = inner.copy()
    opens[1:] &= blank[:-1]
    opens[start[size > 0]] |= inner[start[size > 0]]
    a = np.flatnonzero(opens)
    stops = np.flatnonzero(edge)
    b = stops[np.searchsorted(stops, a, side="right")] if len(a) else a
    up, down = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((buf + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)])
        word = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
    first, last = np.searchsorted(a, start), np.searchsorted(a, end)
    yield _slot(word, 9), first, last
    with np.errstate(over="ignore"):
        pair = word[:-1] * _BASE + word[1:] if len(word) > 1 else word[:0]
    first = np.minimum(first, len(pair))
    yield _slot(pair, 10), first, np.maximum(first, np.minimum(last - 1, len(pair)))


def train(entries: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 0) -> np.ndarray:
    """The log-odds of label 1 that each table entry contributes; ``entries``: (entries, weights that sum to 1) of each text."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = rng.uniform(-0.1, 0.1, (DIM, 2)).astype(np.float32)
    steps, done = EPOCHS * len(entries), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(entries)):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            at, weight = entries[k]
            own = vectors[at]
            hidden = weight @ own
            z = hidden @ out
            z = np.exp(z - z.max())
            miss = z / z.sum()
            miss[labels[k]] -= 1
            back = out @ miss
            out -= rate * np.outer(hidden, miss)
            # entries share the step by their weight; its square sum keeps the step of the average at the rate
            vectors[at] = own - (rate / (weight @ weight) * weight)[:, None] * back * np.float32(0.1)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)


def gathered(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct table entries of a text and their shares."""
    parts = [slots[a[0] : b[0]] for slots, a, b in features([text])]
    at, n = np.unique(np.concatenate([np.array([END], np.uint64), *parts]), return_counts=True)
    return at.astype(np.int32), (n / n.sum()).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, sample: int = SAMPLE) -> Broadcast:
    """The table of log-odds learned from at most ``sample`` rows of ``labels`` (doc_id, <label>) where ``usable`` holds."""
    spark = docs.sparkSession
    chosen = labels.where(usable & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # the sample bounds it

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            for doc, text, y in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                kept.append((doc, y, gathered(text)))
        kept.sort(key=lambda r: (r[0], r[1], len(r[2][0])))
        table = train([r[2] for r in kept], np.array([r[1] for r in kept])) if kept else np.zeros(1 << BITS, np.float32)
        yield pa.RecordBatch.from_pydict({"table": pa.array([table.tobytes()], pa.binary())})

    got = rows.select("doc_id", "text", "y").repartition(1).mapInArrow(learn, "table binary").collect()
    return spark.sparkContext.broadcast(bytes(got[0]["table"]) if got else np.zeros(1 << BITS, np.float32).tobytes())


def log_odds(texts: list[str], table: np.ndarray) -> np.ndarray:
    """The log-odds of label 1 for each text."""
    total, many = np.full(len(texts), float(table[END])), np.ones(len(texts))
    for slots, first, last in features(texts):
        sums = np.concatenate([[0.0], np.cumsum(table[slots], dtype=np.float64)])
        total += sums[last] - sums[first]
        many += last - first
    return total / many


def scored(docs: DataFrame, model: Broadcast, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; the text alone decides it."""
    docs = docs.drop(column)
    out = plain_names(docs)
    names = out.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(model.value, np.float32)
        for batch in batches:
            texts = batch.column("text").fill_null("").to_pylist()
            odds = [log_odds(texts[a:b], table) for a, b in runs(texts, RUN)]
            p = 1 / (1 + np.exp(-np.concatenate(odds))) if odds else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p)], [*names, column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(score, f"{kinds}, `{column}` double").toDF(*docs.columns, column)


def learns(doc_id: Column) -> Column:
    """Rows that may be learned from: two of three by a checksum of the id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those that the classifier scores below ``threshold``."""
    model = fit(docs, labels, "quality", learns(F.col("doc_id")), sample)
    return scored(docs, model, "__score").where(F.col("__score") >= threshold).drop("__score")
