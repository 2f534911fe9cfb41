"""Nested values, units and batches: walking JSON, rewriting strings, chunking, packing, caches by content."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

# Chunking of long texts.
OVERLAP, LEAST = 512, 1024


def strings(df: DataFrame, column: str, key: str, keys: bool = False, number: bool = False) -> DataFrame:
    """Every string of a JSON column: key, path (JSON pointer), value; object keys too where asked.  Broken JSON has none.

    ``number``: with ``slot`` as well, the place of the string among those of its value.
    """

    def walk(value, path: str, out: list[tuple[str, str]]) -> None:
        if isinstance(value, str):
            out.append((path, value))
        elif isinstance(value, list):
            for i, x in enumerate(value):
                walk(x, f"{path}/{i}", out)
        elif isinstance(value, dict):
            for k, x in value.items():
                at = f"{path}/{k.replace('~', '~0').replace('/', '~1')}"
                if keys:
                    out.append((at + "#key", k))
                walk(x, at, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, values, places = [], [], [], []
            for i, text in enumerate(batch.column(column).to_pylist()):
                found: list[tuple[str, str]] = []
                try:
                    walk(json.loads(text or "null"), "", found)
                except ValueError:
                    continue
                at += [i] * len(found)
                paths += [p for p, _ in found]
                values += [v for _, v in found]
                places += range(len(found))
            columns = [batch.column(key).take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(places, pa.int32())] * number, [key, "path", "value"] + ["slot"] * number)

    return df.select(key, column).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, path string, value string" + ", slot int" * number)


def stable(df: DataFrame, column: str, into: str) -> DataFrame:
    """``df`` with the stable form of a JSON column: object keys in code point order, no white space; null if it is broken."""

    def form(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([form(x) for x in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != into)
    return df.drop(into).mapInArrow(run, f"{fields}, `{into}` string")


def rewritten(df: DataFrame, column: str, session: str, into: str, keys: bool = False) -> DataFrame:
    """``df`` with the strings of a JSON column rewritten by a map column (from, to): all occurrences, the longest first.

    ``into``: the new column; null where the JSON is broken or two keys of an object become one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[into] = [_rewrite(text, dict(m) if m is not None else {}, keys) for text, m in zip(batch[column], batch[session], strict=True)]
            yield batch

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != into)
    return df.drop(into).mapInPandas(run, f"{fields}, `{into}` string")


def _rewrite(text: str | None, mapping: dict[str, str], keys: bool) -> str | None:
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    if text is None:
        return None
    names = sorted(mapping, key=lambda k: (-len(k), k))
    find = re.compile("|".join(map(re.escape, names))) if names else None
    swap: Callable[[str], str] = (lambda s: find.sub(lambda m: mapping[m[0]], s)) if find else (lambda s: s)

    class Clash(Exception):
        pass

    def walk(x):
        if isinstance(x, str):
            return swap(x)
        if isinstance(x, list):
            return [walk(y) for y in x]
        if isinstance(x, dict):
            out = {}
            for k, y in x.items():
                k = swap(k) if keys else k
                if k in out:
                    raise Clash
                out[k] = walk(y)
            return out
        return x

    try:
        return json.dumps(walk(value), ensure_ascii=False, separators=(",", ":"))
    except Clash:
        return None


def chunk(text: str, most_chars: int, header: int = 0) -> list[tuple[int, int]]:
    """Overlapping windows of a text: each as long as fits, preferring to end after a line feed, then a blank, in its last third."""
    out, start = [], 0
    while True:
        end = min(len(text), start + max(1, most_chars - header))
        if end < len(text):
            least = start + int((end - start) * 0.65)
            cut = text.rfind("\n", least, end)
            cut = cut if cut >= 0 else max(text.rfind(" ", least, end), text.rfind("\t", least, end))
            if cut >= 0 and cut + 1 - start >= LEAST:
                end = cut + 1
        out.append((start, end))
        if end >= len(text):
            return out
        start = end - OVERLAP


def chunks(df: DataFrame, key: str, column: str = "text", most_chars: int = 4096) -> DataFrame:
    """Windows of long texts: key, nth, start, end, chunk.  Neighbours share 512 characters, so no short span is cut in both."""
    if most_chars <= OVERLAP + LEAST // 2:
        raise ValueError("windows must be longer than their overlap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(column).to_pylist()):
                for n, (a, b) in enumerate(chunk(text or "", most_chars)):
                    at.append(i)
                    rows.append((n, a, b, (text or "")[a:b]))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [key, "nth", "start", "end", "chunk"])

    return df.select(key, column).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, nth int, start int, end int, chunk string")


def packed(units: DataFrame, group: str, order: str | list[str], size: str | list[str], most: int | list[int]) -> DataFrame:
    """Units put into batches one after another: a new batch begins where the next unit would not fit one of the budgets.

    An ordered fold over each group's sizes; a unit larger than a batch has one of its own, a null size counts as 0.  A
    group's units pass in order through a sorted partition.  Adds ``batch``.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)
    order, sizes, limits = ([x] if isinstance(x, (str, int)) else list(x) for x in (order, size, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, key, used, number = True, None, [0] * len(sizes), 0
        for batch in batches:
            out = []
            for own, *needs in zip(batch.column(group).to_pylist(), *(batch.column(s).to_pylist() for s in sizes), strict=True):
                needs = [n or 0 for n in needs]
                if first or own != key:
                    first, key, used, number = False, own, [0] * len(sizes), 0
                if any(used) and any(u + n > m for u, n, m in zip(used, needs, limits, strict=True)):
                    used, number = [0] * len(sizes), number + 1
                used = [u + n for u, n in zip(used, needs, strict=True)]
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "batch"])

    return units.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, f"{fields}, `batch` int")


def apply_edits(df: DataFrame, key: str, column: str, edits: str) -> DataFrame:
    """Exact search-and-replace edits: key, text, error_code.

    ``edits``: array of search, replace, occurrence (from 1, or null), all, before, after.  All edits speak of the text as it
    came; missing, ambiguous and overlapping ones, and those that replace most of a long text, are errors.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [edit_text(text, list(e) if e is not None else []) for text, e in zip(batch[column], batch[edits], strict=True)]
            yield pd.DataFrame({key: batch[key], "text": [d[0] for d in done], "error_code": [d[1] for d in done]})

    return df.select(key, column, edits).mapInPandas(run, f"{key} {kind}, text string, error_code string")


# Bounds of edits.
MOST_EDITS, MOST_FRAGMENT, MOST_ANCHOR, WHOLE_SHARE, WHOLE_LEAST = 256, 8192, 2048, 0.8, 256


def edit_text(text: str | None, edits: list) -> tuple[str | None, str | None]:
    """The edited text, or why it was not edited."""
    if text is None:
        return None, "INVALID_TEXT_EDITS"
    if len(edits) > MOST_EDITS:
        return None, "TOO_MANY_TEXT_EDITS"
    spots: list[tuple[int, int, str]] = []
    for e in edits:
        old, new, before, after = e["search"], e["replace"], e["before"] or "", e["after"] or ""
        nth = e["occurrence"]
        nth = None if nth is None or nth != nth else int(nth)
        if not old or new is None or (nth is not None and nth < 1):
            return None, "INVALID_TEXT_EDIT"
        if max(len(old), len(new)) > MOST_FRAGMENT:
            return None, "TEXT_EDIT_TOO_LARGE"
        if max(len(before), len(after)) > MOST_ANCHOR:
            return None, "TEXT_EDIT_ANCHOR_TOO_LARGE"
        if old == new:
            continue
        if len(text) >= WHOLE_LEAST and len(old) >= len(text) * WHOLE_SHARE:
            return None, "WHOLE_DOCUMENT_EDIT"
        found, at = [], text.find(old)
        while at >= 0:
            if text[:at].endswith(before) and text.startswith(after, at + len(old)):
                found.append(at)
            at = text.find(old, at + len(old))
        if not found:
            return None, "TEXT_EDIT_NOT_FOUND"
        if not e["all"]:
            if nth is None and len(found) != 1:
                return None, "AMBIGUOUS_TEXT_EDIT"
            if nth is not None and nth > len(found):
                return None, "TEXT_EDIT_OCCURRENCE_NOT_FOUND"
            found = [found[0 if nth is None else nth - 1]]
        spots += [(a, a + len(old), new) for a in found]
    spots.sort()
    if any(b[0] < a[1] for a, b in zip(spots, spots[1:])):
        return None, "OVERLAPPING_TEXT_EDITS"
    for a, b, new in reversed(spots):
        text = text[:a] + new + text[b:]
    return text, None


_TOKEN = regex.compile(r"[\p{L}\p{N}_@.+:/-]+|\[private\]")


def coverage(original: str, safe: str) -> float:
    """The share of the original's tokens that the other text has in the same order, each at its first place after the last."""
    own, theirs = _TOKEN.findall(original.lower()), _TOKEN.findall(safe.lower())
    if not own:
        return 0.0 if theirs else 1.0
    places: dict[str, list[int]] = {}
    for i, token in enumerate(theirs):
        places.setdefault(token, []).append(i)
    at = matched = 0
    for token in own:
        spots = places.get(token, ())
        k = bisect_left(spots, at)
        if k < len(spots):
            at, matched = spots[k] + 1, matched + 1
    return matched / len(own)


def token_coverage(original: Column, safe: Column) -> Column:
    """:func:`coverage` of two text columns; null where either is."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else coverage(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return of(original, safe)


def isolated(original: Column, safe: Column, context: Column) -> Column:
    """Whether a rewritten text takes nothing from the context (segments of 10 characters or more) that was not in the original."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(context, r"(?i)\[CONTEXT\]", ""), r"(?i)-\s*(user|assistant):", ""))
    parts = F.transform(F.split(clean, r"[.,!?;\n]"), lambda s: F.lower(F.trim(s)))
    taken = F.exists(parts, lambda s: (F.length(s) >= 10) & ~F.contains(F.lower(original), s) & F.contains(F.lower(safe), s))
    return ~F.upper(safe).rlike(r"\[CONTEXT\]|REFERENCE HISTORY") & ~F.coalesce(taken, F.lit(False))
