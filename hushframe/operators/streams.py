"""Ordered folds per key that have a streaming twin in ``hushframe.streaming``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


class Restorer:
    """Puts originals in for placeholders in chunked text; holds back what could still become a placeholder."""

    def __init__(self, session: dict[str, str], buffer: str = ""):
        self.session, self.buffer = session, buffer
        names = sorted(filter(None, session), key=lambda p: (-len(p), p))
        self.whole = re.compile("|".join(map(re.escape, names))) if names else None
        self.heads = {n[:k] for n in names for k in range(1, len(n))}
        self.longest = max(map(len, names), default=0)

    def _restored(self, text: str) -> str:
        return self.whole.sub(lambda m: self.session[m[0]], text) if self.whole else text

    def push(self, chunk: str) -> str:
        """What is certain by now: all before the first place from which the text may be the beginning of a placeholder."""
        text = self.buffer + chunk
        end = len(text)
        at = self._open(text)
        while at < end and self.whole and (m := self._across(text, at)):  # a placeholder that ends within the tail takes it along
            at = self._open(text, m.end())
        self.buffer = text[at:]
        return self._restored(text[:at])

    def _open(self, text: str, least: int = 0) -> int:
        """The first place whose rest is a proper beginning of a placeholder."""
        first = max(least, len(text) - self.longest + 1)
        return next((i for i in range(first, len(text)) if text[i:] in self.heads), len(text))

    def _across(self, text: str, at: int):
        """The match that begins before ``at`` and goes past it."""
        return next((m for m in self.whole.finditer(text) if m.start() < at < m.end()), None)

    def flush(self) -> str:
        """What was held back, with whole placeholders restored."""
        text, self.buffer = self.buffer, ""
        return self._restored(text)


def restore_chunks(chunks: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Chunks (key, seq, chunk) restored in order: key, seq, emitted; the rest comes out with the last chunk.

    ``sessions``: key, session (map of placeholder and original).  A key's chunks arrive in the order of their sequence
    within a sorted partition, so no key is held as a group.
    """
    kind, seq = dict(chunks.dtypes)[key], dict(chunks.dtypes)["seq"]
    last = F.lead("seq").over(Window.partitionBy(key).orderBy("seq")).isNull()
    rows = chunks.withColumn("last", last).join(sessions, key, "left").select(key, "seq", "chunk", "last", "session")
    rows = rows.repartition(key).sortWithinPartitions(key, "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live: Restorer | None = None
        for batch in batches:
            out = []
            for chunk, end, session in zip(batch["chunk"], batch["last"], batch["session"], strict=True):
                live = live or Restorer(dict(session) if session is not None else {})
                text = live.push(chunk or "")
                if end:
                    text, live = text + live.flush(), None
                out.append(text)
            yield pd.DataFrame({key: batch[key], "seq": batch["seq"], "emitted": out})

    return rows.mapInPandas(run, f"{key} {kind}, seq {seq}, emitted string")


def first_in_window(events: DataFrame, keys: list[str], at: str, window: int) -> DataFrame:
    """Events that are not within ``window`` of the last one let through of their key; a clock that goes back lets one through.

    An ordered fold (by ``event_id``) over each key; not a tumbling window.  A key's events pass in order through a sorted
    partition and only the last time let through is held.
    """
    kinds = dict(events.dtypes)
    rows = events.select(*keys, "event_id", at).repartition(*keys).sortWithinPartitions(*keys, "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            keep = []
            times = batch.column(len(keys) + 1).to_pylist()
            for i, (own, time) in enumerate(zip(zip(*(batch.column(k).to_pylist() for k in range(len(keys))), strict=True), times, strict=True)):
                if own != key:
                    key, last = own, None
                if time is not None and (last is None or time - last >= window or time < last):
                    last = time
                    keep.append(i)
            yield batch.select([*keys, "event_id"]).take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "event_id"]))


def newest(items: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """A queue of bounded length per key: the newest ``limit`` items and how many were dropped before them."""
    latest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    total = F.count(F.lit(1)).over(Window.partitionBy(key))
    rows = items.withColumn("_n", F.row_number().over(latest)).withColumn("dropped", F.greatest(total - limit, F.lit(0)))
    return rows.where(F.col("_n") <= limit).drop("_n")


def allowed(requests: DataFrame, grants: DataFrame, key: str, at: str, valid: int) -> DataFrame:
    """Requests that use a grant of their key given at most ``valid`` before them, each grant once: adds ``allowed``.

    Requests and grants are one sequence per key; a request takes the last grant unless a request already has.
    """
    both = requests.select(key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), "event_id").unionByName(grants.select(key, F.col(at).alias("_at"), F.lit(0).alias("_kind"), "event_id"))
    order = Window.partitionBy(key).orderBy("_at", "_kind", "event_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = both.withColumn("_grant", F.last(F.when(F.col("_kind") == 0, F.col("_at")), True).over(before)).withColumn("_prev", F.lag("_kind").over(order))
    ok = (F.col("_prev") == 0) & (F.col("_at") - F.col("_grant") <= valid)
    return rows.where("_kind = 1").select(key, "event_id", F.coalesce(ok, F.lit(False)).alias("allowed"))


def sse_frames(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Server-sent events of a text: key, nth, event, data, complete.

    Frames end at a blank line; ``data:`` lines are joined by line feeds; a last frame without its blank line is incomplete.
    """
    body = F.regexp_replace(F.col(column), "\r\n", "\n")
    frames = F.split(body, "\n\n")
    rows = texts.select(key, F.posexplode(frames).alias("nth", "frame"), F.size(frames).alias("n")).where("frame <> ''")
    lines = F.split("frame", "\n")
    own = lambda prefix: F.transform(F.filter(lines, lambda x: x.startswith(prefix)), lambda x: F.regexp_replace(x, f"^{prefix} ?", ""))
    return rows.select(key, "nth", F.get(own("event:"), 0).alias("event"), F.array_join(own("data:"), "\n").alias("data"), (F.col("nth") < F.col("n") - 1).alias("complete"))


def sse_text(frames: DataFrame, key: str) -> DataFrame:
    """Frames (key, nth, event, data) as server-sent events again."""
    one = F.concat(F.when(F.col("event").isNotNull(), F.concat(F.lit("event: "), "event", F.lit("\n"))).otherwise(""), F.lit("data: "), "data", F.lit("\n\n"))
    rows = frames.select(key, F.struct("nth", one.alias("frame")).alias("x")).groupBy(key).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select(key, F.array_join(F.transform("xs", lambda x: x["frame"]), "").alias("body"))
