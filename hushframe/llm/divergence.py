"""How far the sources of a language stand apart in their words: pairs of sources, and the words that mark a source.

Terms are runs of letters (A-Z in lower case, all beyond ASCII).  A language keeps the terms of at least ``LEAST``
documents; a source's smoothed share of a term is ``1 + floor(10**9 * (count + 1) / (N + V))``.

Count columns are deduplicated: terms of equal sparse vectors (source, count) are one row with a multiplicity.  Where both
sources of a pair have a term, the pair is evaluated once a distinct vector; where one of them has none, its value depends
on one count alone and is taken once a distinct count of a source; what remains of the V terms is in neither.  The three
sums make up the sum over all terms, in whole numbers throughout.  Terms are ranked by their vectors first; only the
terms of vectors that can be among the first ranks are looked up again.

Cases: null text, language and source are ``''`` and take part as such; a source without terms has the least share of
every term; a language without kept terms has pairs of value 0 and no terms; equal values are ordered by the item's bytes;
repeated rows count as often as they are there; texts are taken whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import written

LEAST = 3
RANKS = 200
#: Distinct terms that a counting task holds at most, and pairs of sources that a summing task holds at most.
HELD = 250_000
#: Rows of the table of sources up to which it is sent to all tasks (about 10 MB); beyond it is joined by shuffle.
SENT = 100_000

_UPPER = bytes(range(0x41, 0x5B))
#: Bytes to bytes: A-Z in lower case, all ASCII but letters to blanks.
_TERMS = bytes(b + 32 if b in _UPPER else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term by language and source; an empty term marks the source itself."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def emptied() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            terms = pa.array([b"", *n], pa.binary()).cast(pa.string())
            same = lambda x, k=len(terms): pa.array([x], pa.string()).take(pa.array(np.zeros(k, np.int64)))
            yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(df.__getitem__, n)], pa.int64())], schema=_COUNTS)
        held.clear()

    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            terms = text.translate(_TERMS).split()
            n.update(terms)
            df.update(set(terms))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from emptied()
    yield from emptied()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents), with an empty term for each source that occurs."""
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = plain.mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term in billionths, in exact arithmetic."""
    top = (count + 1).cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)")
    return _whole(top, F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q)."""
    return _whole((p - q) * (p - q), q)


def _joined(rows: DataFrame, sources: DataFrame, on: list[str], n: int) -> DataFrame:
    """``rows`` with the columns of ``sources`` (``n`` rows): sent round where it is small, else joined by shuffle, where Spark splits hot keys."""
    return rows.join(F.broadcast(sources) if n <= SENT else sources.hint("merge"), on)


_PAIRED = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("both", pa.int64())])


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each ordered pair of sources, what the vectors that hold both add: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), times the multiplicity.

    Sums are exact modulo 2**64, and the whole sum fits.
    """
    held: Counter = Counter()

    def emptied() -> Iterator[pa.RecordBatch]:
        if held:
            keys = list(held)
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([(held[k] + (1 << 63)) % (1 << 64) - (1 << 63) for k in keys], pa.int64())], schema=_PAIRED)
            held.clear()

    for batch in batches:
        names: dict[tuple[str, str], int] = {}
        flat = batch.column("vec").flatten()
        size = np.diff(batch.column("vec").offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        langs = batch.column("lang").to_pylist()
        own = np.fromiter((names.setdefault((langs[r], s), len(names)) for r, s in zip(row.tolist(), flat.field("source").to_pylist(), strict=True)), np.int64, len(row))
        p, p0 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("p", "p0"))
        m = batch.column("m").to_numpy()
        # every entry of a vector beside every entry of the same vector, some thousand vectors at a time
        start = np.cumsum(size) - size
        cut = np.searchsorted(np.cumsum(size * size), np.arange(1, int((size * size).sum()) // HELD + 1) * HELD)
        for rows in np.split(np.arange(len(size)), cut):
            k = size[rows]
            first = np.repeat(start[rows], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            width = np.repeat(k, k)
            x = np.repeat(first, width)
            y = np.repeat(np.repeat(start[rows], k), width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            x, y = x[x != y], y[x != y]
            f = lambda a, b: (a - b) ** 2 // b
            value = m[row[x]] * (f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y]))
            pairs, at = np.unique(own[x] * len(names) + own[y], return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, at, value)
            back = list(names)
            for pair, v in zip(pairs.tolist(), sums.tolist(), strict=True):
                a, b = back[pair // len(names)], back[pair % len(names)]
                held[a[0], a[1], b[1]] += v
            if len(held) > HELD:
                yield from emptied()
    yield from emptied()


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    by_term = term_counts(docs).groupBy("lang", "term")
    vec = F.array_sort(F.collect_list(F.struct("source", "n")))
    terms = by_term.agg(F.sum("df").alias("df"), vec.alias("vec")).where((F.col("df") >= least) | (F.col("term") == ""))
    terms = written(terms.select("lang", "term", "vec"), "terms")  # the empty term lists the sources
    kept = terms.where("term <> ''")
    total = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    vectors = written(kept.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("m")).select(F.monotonically_increasing_id().alias("id"), "lang", "vec", "m", total.alias("total")), "vectors")

    entries = vectors.select("id", "lang", "m", "total", F.explode("vec").alias("x")).select("id", "lang", "m", "total", "x.source", "x.n")
    of_source = entries.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("m")).alias("own"))
    of_lang = vectors.groupBy("lang").agg(F.sum(F.col("total") * F.col("m")).alias("all"), F.sum("m").alias("terms"))
    sources = terms.where("term = ''").select("lang", F.explode("vec.source").alias("source"))
    sources = sources.join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    sources = sources.select("lang", "source", *map(number, ("own", "all", "terms")))
    sources = written(sources.withColumn("p0", share(F.lit(0).cast("long"), F.col("own"), F.col("terms"))), "sources")
    n = sources.count()

    shared = _joined(entries, sources, ["lang", "source"], n).withColumn("p", share(F.col("n"), F.col("own"), F.col("terms")))
    return _pairs(shared, sources, n).unionByName(_terms(kept, vectors, shared, ranks))


def _pairs(shared: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    vectors = shared.groupBy("id").agg(F.first("lang").alias("lang"), F.first("m").alias("m"), F.collect_list(F.struct("source", "p", "p0")).alias("vec"))
    both = vectors.where(F.size("vec") > 1).drop("id").mapInArrow(_both, "lang string, a string, b string, both long")
    both = both.groupBy("lang", "a", "b").agg(exact(F.col("both")).alias("both"))
    # one source has the term: by distinct counts of each source
    counts = shared.groupBy("lang", "source", "p", "p0").agg(F.sum("m").alias("m"))
    other = sources.select("lang", F.col("source").alias("other"), F.col("p0").alias("o"))
    beside = _joined(counts, other, ["lang"], n).where("source <> other")
    m, p, p0, o = (F.col(c).cast("decimal(38,0)") if c == "m" else F.col(c) for c in ("m", "p", "p0", "o"))
    one = beside.groupBy("lang", "source", "other").agg(
        F.sum(m * (apart(p, o) - apart(p0, o)).cast("decimal(20,0)")).cast("decimal(38,0)").alias("given"),
        F.sum(m * (apart(o, p) - apart(o, p0)).cast("decimal(20,0)")).cast("decimal(38,0)").alias("taken"),
    )
    one = written(one, "one")
    every = _joined(sources.select("lang", F.col("source").alias("a"), "p0", "terms"), sources.select("lang", F.col("source").alias("b"), F.col("p0").alias("o")), ["lang"], n).where("a <> b")
    every = every.select("lang", "a", "b", (F.col("terms").cast("decimal(20,0)") * apart(F.col("p0"), F.col("o")).cast("decimal(18,0)")).alias("none"))
    given = one.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), "given")
    taken = one.select("lang", F.col("other").alias("a"), F.col("source").alias("b"), "taken")
    for part in (given, taken, both):
        every = every.join(part, ["lang", "a", "b"], "left")
    zero = F.lit(0).cast("decimal(38,0)")
    value = sum((F.coalesce(c, zero) for c in ("given", "taken", "both")), F.col("none")).cast("long")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = every.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))
    return found.withColumn("rank", F.row_number().over(order))


def _terms(kept: DataFrame, vectors: DataFrame, shared: DataFrame, ranks: int) -> DataFrame:
    q = share(F.col("total"), F.col("all"), F.col("terms"))
    marked = shared.withColumn("q", q).where("p > q").select("id", "lang", "source", apart(F.col("p"), F.col("q")).alias("value"))
    # a vector has one term at least: those behind so many others cannot be reached
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    marked = marked.withColumn("place", F.rank().over(by)).where(F.col("place") <= ranks).drop("place")
    found = vectors.select("id", "vec").join(marked, "id")
    found = kept.join(found, ["lang", "vec"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
