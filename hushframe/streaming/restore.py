"""Structured Streaming twins of the ordered folds: restoration of chunked text, and diagnostics let through once a window.

State is kept per key by Spark and survives a lost executor through the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.streams import Restorer


def restore_stream(chunks: DataFrame, session: dict[str, str], idle_ms: int = 60_000) -> DataFrame:
    """A stream of (stream_key, seq, chunk, last) restored: stream_key, seq, emitted.

    What could become a placeholder waits in the key's state for the next chunk; the last chunk, or ``idle_ms`` without one,
    lets it out (seq -1 for the latter).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else ""
        live = Restorer(session, held)
        if state.hasTimedOut:
            state.remove()
            text = live.flush()
            if text:
                yield pd.DataFrame({"stream_key": [key[0]], "seq": [-1], "emitted": [text]})
            return
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out, ended = [], False
        for chunk, last in zip(rows["chunk"], rows["last"], strict=True):
            text = live.push(chunk or "")
            if last:
                text, ended = text + live.flush(), True
            out.append(text)
        if ended:
            if state.exists:
                state.remove()
        else:
            state.update((live.buffer,))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"stream_key": key[0], "seq": rows["seq"].to_numpy(), "emitted": out})

    return chunks.groupBy("stream_key").applyInPandasWithState(step, "stream_key string, seq long, emitted string", "buffer string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def once_a_window(events: DataFrame, window_ms: int = 30_000, idle_ms: int | None = None) -> DataFrame:
    """A stream of (diagnostic_key, event_id, at) without what follows the last one let through within the window.

    ``idle_ms``: a key that is silent so long (the window at least) is forgotten, so that a stream without an end holds live
    keys alone; without it keys stay, which suits a stream that ends.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
        out = []
        for event_id, at in zip(rows["event_id"], rows["at"], strict=True):
            if last is None or at - last >= window_ms or at < last:
                last = int(at)
                out.append((key[0], int(event_id), last))
        if last is not None:
            state.update((last,))
            if idle_ms is not None:
                state.setTimeoutDuration(max(window_ms, idle_ms))
        yield pd.DataFrame(out, columns=["diagnostic_key", "event_id", "at"])

    return events.groupBy("diagnostic_key").applyInPandasWithState(step, "diagnostic_key string, event_id long, at long", "last long", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
