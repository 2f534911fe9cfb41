"""Hamming-distance links by the generalised pigeonhole principle.

The 64 bits of a fingerprint are grouped into parts so that correlated bits lie together.  Part i gets a threshold t_i of
its own; if the sum of (t_i + 1) is the distance limit plus one, two fingerprints within the limit agree in some part up
to its threshold.  A dynamic program picks the thresholds with the least estimated work, from counts over all
fingerprints.  Each fingerprint then probes, for each part, the values within that part's threshold; fingerprints that
meet in a bucket are compared in full.

Where components are wanted, only links that join what a task has not joined yet leave it, so a dense cluster gives a forest instead of all
of its pairs.  A bucket above ``LARGE`` fingerprints is not compared in place: it is dealt again by the bits that it
does not fix yet, in limit + 1 parts of which one must agree exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import partitions, written

#: Fingerprints of a bucket that are compared in one task; larger buckets are dealt again, which copies each row
#: ``limit + 1`` times.
LARGE = 40_000
#: Buckets up to this size are compared pair by pair, larger ones from a growing front.
SMALL = 64
#: Work of a probe row, which is shuffled and sorted, in comparisons.
PROBE = 3000
ONES = (1 << 64) - 1


def signed(x: int) -> int:
    """A 64-bit pattern as a signed long."""
    return x - (1 << 64) if x >> 63 else x


def correlated_parts(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits grouped greedily: a part starts with the bit of the strongest ties and takes those tied most to it.

    ``together[i, j]``: fingerprints with both bits set; the diagonal counts single bits.
    """
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        own = [max(sorted(left), key=lambda b: tie[b, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < size:
            nxt = max(sorted(left), key=lambda b: tie[b, own].sum())
            own.append(nxt)
            left.discard(nxt)
        out.append(sorted(own))
    return out


def mask_of(bits: list[int]) -> int:
    return reduce(lambda m, b: m | 1 << b, bits, 0)


def allocate(cost: list[list[float]], limit: int) -> list[int]:
    """Thresholds with sum of (t + 1) equal to limit + 1 and the least cost; ``cost[i][t + 1]`` is that of part i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for k, more in enumerate(own):
                if used + k <= limit + 1 and c + more < step.get(used + k, (float("inf"), []))[0]:
                    step[used + k] = (c + more, [*chosen, k - 1])
        best = step
    return best[limit + 1][1]


def plan(prints: DataFrame, limit: int, parts: int | None = None, band: str | None = None) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part, from statistics over all rows of ``prints`` (fp[, band]).

    Grouping and thresholds are worked out for several numbers of parts, of which the one of the least estimated work is
    taken: few parts make small buckets and many probes.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((64, 64)), 0
        for batch in batches:
            fp = np.ascontiguousarray(batch.column("fp").to_numpy())
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            rows += len(fp)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, 64)), pa.array(np.append(j, 64)), pa.array(np.append(total.ravel(), rows).astype(np.int64))], ["i", "j", "c"])

    together, n = np.zeros((64, 64)), 0
    for r in prints.select("fp").mapInArrow(both, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect():  # 4097 rows
        if r["i"] == 64:
            n = r["c"]
        else:
            together[r["i"], r["j"]] = r["c"]
    meet = 1.0  # the share of pairs whose bands meet; a few dozen bands
    if band and n:
        many = {r[band]: r["c"] for r in prints.groupBy(band).agg(F.count(F.lit(1)).alias("c")).collect()}
        meet = sum(c * (c + many.get(k - 1, 0) + many.get(k + 1, 0)) for k, c in many.items()) / n**2
    options = [correlated_parts(together, n, k) for k in ([parts] if parts else sorted({limit // d + 1 for d in (2, 3, 4)}))]
    # pairs that agree in a part but for k given bits: from them follow the pairs at each distance within the part
    masks, rng = [], np.random.default_rng(0)
    for o, groups in enumerate(options):
        for g, bits in enumerate(groups):
            for k in (0, 1, 2):
                dropped = rng.choice(bits, k, replace=False).tolist() if k else []
                masks.append((o, g, k, signed(mask_of(bits) & ~mask_of(dropped) & ONES)))
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(x[3])).alias("v")) for i, x in enumerate(masks)))).alias("x")
    same = prints.select(keys).groupBy("x.m", "x.v").count().groupBy("m").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("e"))
    equal = {masks[r["m"]][:3]: float(r["e"]) for r in same.collect()}
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for o, groups in enumerate(options):
        cost = []
        for g, bits in enumerate(groups):
            w = len(bits)
            e0, e1, e2 = (equal.get((o, g, k), 0.0) for k in (0, 1, 2))
            a1 = max(0.0, w * (e1 - e0))
            a2 = max(0.0, comb(w, 2) * (e2 - e0 - 2 * (e1 - e0)))
            a3 = a2 * (w - 2) / 3
            pairs = np.cumsum([e0, a1, a2, a3]) * meet
            cost.append([0.0] + [pairs[t] + PROBE * n * sum(comb(w, d) for d in range(t + 1)) for t in range(4)])
        if len(groups) * 4 <= limit:  # thresholds end at 3, so these parts cannot reach the limit
            continue
        chosen = allocate(cost, limit)
        work = sum(c[t + 1] for c, t in zip(cost, chosen, strict=True))
        if best is None or work < best[0]:
            best = (work, list(zip(groups, chosen, strict=True)))
    return best[1]


def _flips(width: int, threshold: int) -> np.ndarray:
    """Every pattern of at most ``threshold`` of ``width`` bits, the empty one first."""
    from itertools import combinations

    out = [mask_of(list(c)) for d in range(threshold + 1) for c in combinations(range(width), d)]
    return np.array(out, np.int64)


def _values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, moved together."""
    out = np.zeros(len(fp), np.int64)
    for i, bit in enumerate(bits):
        out |= ((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
    return out


_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _deeper(value: np.ndarray, bucket: np.ndarray, part: int) -> np.ndarray:
    """A bucket within a bucket; should two of them meet, that only costs comparisons."""
    with np.errstate(over="ignore"):
        x = (value ^ bucket * _ODD) * _ODD + np.uint64(part) * _STEP
        return (x ^ (x >> np.uint64(29))) * _ODD


class Links:
    """What a task has joined so far; only links that join something new are kept."""

    def __init__(self):
        self.up: dict = {}

    def _top(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def new(self, pairs: Iterator[tuple]) -> list[int]:
        out = []
        for k, (a, b) in enumerate(pairs):
            a, b = self._top(a), self._top(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append(k)
        if len(self.up) > 100_000:  # bounded memory: forgotten joins are only found again
            self.up.clear()
        return out


class Rows:
    """Rows of one bucket after another: signatures, and the parts (mask, threshold) in which near pairs have met before."""

    def __init__(self, columns: list[np.ndarray], sigs: int, limits: list[int], before: list[tuple[np.uint64, int]]):
        self.sigs, self.limits, self.before = columns[:sigs], limits, before

    def near(self, i, j) -> np.ndarray:
        """Which of the pairs i, j are within the limits (the first signature's, then that of both) and meet here first."""
        sigs = self.sigs
        d = np.bitwise_count(sigs[0][i] ^ sigs[0][j])
        hit = np.flatnonzero(d <= self.limits[0])
        pick = lambda k: k[hit] if isinstance(k, np.ndarray) else k
        if len(sigs) > 1 and len(hit):
            hit = hit[d[hit] + np.bitwise_count(sigs[1][pick(i)] ^ sigs[1][pick(j)]) <= self.limits[1]]
        for mask, threshold in self.before:
            if len(hit):
                hit = hit[np.bitwise_count((sigs[0][pick(i)] ^ sigs[0][pick(j)]) & mask) > threshold]
        return hit


def _pairs(bucket: np.ndarray, centre: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """All near pairs of a row that is at home in a bucket and any other there; rows are sorted, those at home first."""
    left, right, at, d = [], [], np.flatnonzero(centre[:-1]), 1
    while len(at):
        at = at[at + d < len(bucket)]
        at = at[bucket[at] == bucket[at + d]]
        near = at[rows.near(at, at + d)]
        left.append(near)
        right.append(near + d)
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2


def _front(home: int, size: int, rows: Rows) -> tuple[list[int], list[int]]:
    """A spanning forest of the near pairs of one bucket of which one is among the first ``home`` rows.

    What is reached leaves the rows that are still compared, so a dense cluster costs little more than its size.
    """
    left, right = [], []
    centres, others = np.arange(home), np.arange(home, size)
    front: list[int] = []
    while len(centres) or front:
        if front:
            q = front.pop()
        else:
            q, centres = int(centres[0]), centres[1:]
        got: list[int] = []
        if len(centres):
            near = rows.near(centres, q)
            if len(near):
                got += centres[near].tolist()
                centres = np.delete(centres, near)
        if q < home and len(others):
            near = rows.near(others, q)
            if len(near):
                got += others[near].tolist()
                others = np.delete(others, near)
        left += [q] * len(got)
        right += got
        front += got
    return left, right


def links(prints: DataFrame, limit: int, wide: int | None = None, parts: int | None = None, ids: tuple = (), band: str | None = None) -> DataFrame:
    """Links between the rows of ``prints`` (fp long[, fp2 long]); they join whatever lies within the limits.

    Near: at most ``limit`` differing bits in ``fp`` and, where ``wide`` is given, at most ``wide`` in both together.
    ``ids`` (longs): what tells rows apart, if not the fingerprints. ``band`` (int): only rows whose bands differ by one at
    most are compared.  Returns a_<id>, b_<id> for each of ``ids`` or of the fingerprints: a forest for each task, so every
    two near rows are joined, perhaps through others.  A near pair counts in the first of the parts in which it agrees.
    """
    spark = prints.sparkSession
    sig = ["fp"] if wide is None else ["fp", "fp2"]
    limits = [limit] if wide is None else [limit, wide]
    told = list(ids) or sig
    carry = [*sig, *ids]
    chosen = [(b, t) for b, t in plan(prints, limit, parts, band) if t >= 0]
    probes = [(i, bits, signed(mask_of(bits)), _flips(len(bits), t)) for i, (bits, t) in enumerate(chosen)]
    names = ["used", "away", "bucket", *carry]
    in_order = [(np.uint64(mask_of(bits)), t) for bits, t in chosen]
    earlier = {int(mask): in_order[:k] for k, (mask, _) in enumerate(in_order)}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cols = [np.ascontiguousarray(part.column(c).to_numpy()) for c in carry]
                fp = cols[0].view(np.uint64)
                level = part.column(band).to_numpy().astype(np.int64) if band else np.zeros(len(fp), np.int64)
                for i, bits, used, flips in probes:
                    # a row is at home under its own value, in its own band and the next one; elsewhere it only calls
                    value = _values(fp, bits)
                    home = [(value, level + up) for up in ((0, 1) if band else (0,))]
                    calls = ((value[:, None] ^ flips[None, 1:]).ravel(), np.repeat(level, len(flips) - 1))
                    values, levels = (np.concatenate([h[k] for h in home] + [calls[k]]) for k in (0, 1))
                    bucket = ((np.int64(i) << 7 | levels + 1) << 48) | values
                    away = np.zeros(len(bucket), np.int8)
                    away[len(home) * len(fp) :] = 1
                    row = np.concatenate([np.tile(np.arange(len(fp)), len(home)), np.repeat(np.arange(len(fp)), len(flips) - 1)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), used, np.int64)), pa.array(away), pa.array(bucket), *(pa.array(c[row]) for c in cols)], names)

    out_names = ["deferred", "used", "away", "bucket", *(f"a_{c}" for c in carry), *(f"b_{c}" for c in told)]
    told_at = [carry.index(c) for c in told]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Links()
        held: list[list[np.ndarray]] = []  # the bucket that may go on in the next batch
        size, spilling = 0, False
        final = 64 - 16  # fixed bits from which a bucket is small enough by itself

        def emit(deferred: bool, used: int, away: np.ndarray, bucket: np.ndarray, a: list[np.ndarray], b: list) -> pa.RecordBatch:
            n = len(away)
            plain = lambda c: pa.array(c.view(np.int64)) if c is not None else pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, deferred)), pa.array(np.full(n, signed(used), np.int64)), pa.array(away.astype(np.int8)), *map(plain, (bucket, *a, *b))], out_names)

        def joined(i, j, columns: list[np.ndarray]) -> pa.RecordBatch:
            i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
            keys = [columns[k] for k in told_at]
            left, right = (zip(*(c[x].tolist() for c in keys), strict=True) for x in (i, j))
            keep = np.array(known.new(zip(left, right, strict=True)), np.int64)
            i, j = i[keep], j[keep]
            zero = np.zeros(len(i), np.uint64)
            a = [c[i] if k in told_at else None for k, c in enumerate(columns)]
            return emit(False, 0, zero, zero, a, [columns[k][j] for k in told_at])

        def again(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """The rows of a large bucket, dealt by the bits that it does not fix."""
            used, (away, bucket), columns = int(rows[0][0]), rows[1:3], rows[3:]
            free = [b for b in range(64) if not used >> b & 1]
            for k in range(limit + 1):
                if some := free[k :: limit + 1]:
                    deeper = _deeper(columns[0] & np.uint64(mask_of(some)), bucket, k)
                    yield emit(True, used | mask_of(some), away, deeper, columns, [None] * len(told))

        def settle(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Whole buckets, sorted: small ones together, others one by one."""
            used, away, bucket, columns = rows[0], rows[1], rows[2], rows[3:]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            sizes = np.diff(cut)
            homes = np.add.reduceat((away == 0).astype(np.int64), cut[:-1])
            wanted = (sizes > 1) & (homes > 0)
            small = np.repeat(wanted & (sizes <= SMALL), sizes)
            for part in np.unique(used[small]):  # buckets of the same fixed bits together
                at = small & (used == part)
                mine = [c[at] for c in columns]
                i, j = _pairs(bucket[at], away[at] == 0, Rows(mine, len(sig), limits, earlier.get(int(part), [])))
                if len(i):
                    yield joined(i, j, mine)
            for k in np.flatnonzero(wanted & (sizes > SMALL)):
                a, b = cut[k], cut[k + 1]
                if b - a > LARGE and int(used[a]).bit_count() < final:
                    yield from again([r[a:b] for r in rows])
                    continue
                mine = [c[a:b] for c in columns]
                i, j = _front(int(homes[k]), int(b - a), Rows(mine, len(sig), limits, earlier.get(int(used[a]), [])))
                if i:
                    yield joined(i, j, mine)

        for batch in batches:
            rows = [np.ascontiguousarray(batch.column(c).to_numpy()) for c in names]
            rows = [r if r.itemsize == 1 else r.view(np.uint64) for r in rows]
            if not len(rows[0]):
                continue
            if held and held[-1][2][-1] != rows[2][0]:
                if not spilling:
                    yield from settle([np.concatenate(x) for x in zip(*held, strict=True)])
                held, size, spilling = [], 0, False
            order = rows[2].view(np.int64)
            last = int(np.searchsorted(order, order[-1], side="left"))
            if last:
                whole = [r[:last] for r in rows]
                if spilling:  # the rest of a large bucket that is being dealt again, then other buckets
                    n = int(np.searchsorted(order[:last], held[-1][2].view(np.int64)[-1], side="right"))
                    yield from again([r[:n] for r in whole])
                    whole = [r[n:] for r in whole]
                elif held:
                    whole = [np.concatenate(x) for x in zip(*held, whole, strict=True)]
                held, size, spilling = [], 0, False
                if len(whole[0]):
                    yield from settle(whole)
            tail = [r[last:] for r in rows]
            if spilling:
                yield from again(tail)
                held = [tail]
                continue
            held.append(tail)
            size += len(tail[0])
            if size > LARGE and int(tail[0][0]).bit_count() < final:
                yield from again([np.concatenate(x) for x in zip(*held, strict=True)])
                held, spilling = [tail], True
        if held and not spilling:
            yield from settle([np.concatenate(x) for x in zip(*held, strict=True)])

    rows = prints.select(*carry, *([band] if band else [])).mapInArrow(probe, "used long, away tinyint, " + ", ".join(f"{c} long" for c in names[2:]))
    schema = "deferred boolean, used long, away tinyint, bucket long, " + ", ".join(f"{c} long" for c in out_names[4:])
    pair = [f"{s}_{c}" for c in told for s in "ab"]
    found = []
    while True:
        dealt = rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "away", *sig)
        table = written(dealt.mapInArrow(compare, schema), "links")
        found.append(table.where("not deferred").select(*pair))
        deeper = table.where("deferred")
        if deeper.isEmpty():
            break
        rows = deeper.select("used", "away", "bucket", *(F.col(f"a_{c}").alias(c) for c in carry)).distinct()
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): node and the smallest node of its component.

    Large-star and small-star steps in turn until nothing changes; each is a table in the shared folder.  Nodes without an
    edge are not listed.
    """

    def signature(df: DataFrame) -> tuple:
        # a sum of hashes in exact decimals: an overflowing long sum is an error under ANSI rules
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head())

    def star(df: DataFrame, large: bool) -> DataFrame:
        # a > b throughout. Large: a node's larger neighbours go to its smallest; small: its smaller ones and itself do.
        if large:
            both = df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m"))
            least = least.select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
            out = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            least = df.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
            out = df.join(least, df["a"] == least["n"]).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
            out = out.select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
        return written(out.where("a > b").distinct(), "star")

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "star")
    mark = signature(now)
    while mark[0]:
        now = star(star(now, large=True), large=False)
        if (new := signature(now)) == mark:
            break
        mark = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
