"""Nested values through a classifier: strings to units, units to shared windows, replies back to their slots.

A value is a JSON text with a key.  Its strings are cut into overlapping units; units of many values share windows bounded
in characters and in tokens, each unit under a header; what a session knows already is shielded by boundary tokens; a
classifier (any function of a text) answers each window with its spans; spans are checked, given back to the values
that hold them, and put out of every string; values are rebuilt in their own shape.  :func:`fan_out` does this for each
distinct content that an earlier table does not answer.

Windows are classified side by side, so a value that two windows find is one entry, named by its first place in the value.

Cases: broken JSON, or a value without strings, passes unchanged; a null value stays null; empty strings are units without
text; a window whose reply breaks a rule gives its values an error and no rewritten form; repeated keys are an error of the
caller, repeated contents are one; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.known import KnownValues, fold
from ..session import kept
from . import sessions as M
from .values import LEAST, chunk

#: A classifier: the text of a window to the text with its spans put out, and the spans (placeholder, original).
Classifier = Callable[[str], tuple[str, list[tuple[str, str]]]]

# Room for a unit's header in the smallest window, the longest span, and error codes.
HEADER_ROOM, LONGEST = 128, 512
TOO_LARGE, CHANGED, BAD_SPAN, LEAK = "CONTEXT_TOO_LARGE", "INVALID_SANITIZED_CONTEXT", "INVALID_CLASSIFIER_SPAN", "PROTECTED_VALUE_LEAK"
BOUNDARY = "__BOUNDARY_"

# each match is a token: runs in pieces of 4, 3 and 2; what is not ASCII counts twice
_TOKEN = re.compile(r"\s{1,4}|[A-Za-z]{1,3}|[0-9]{1,2}|[^A-Za-z0-9\s]")
_WIDE = re.compile(r"[^\x00-\x7F\s]")


def tokens(text: str) -> int:
    """The token estimate of :func:`hushframe.functions.text.estimated_tokens` for one text."""
    return len(_TOKEN.findall(text)) + (0 if text.isascii() else len(_WIDE.findall(text)))


@dataclass(frozen=True)
class Budget:
    """What a classifier takes at once."""

    chars: int = 200_000
    tokens: int = 100_000

    def __post_init__(self) -> None:
        if self.chars <= LEAST + HEADER_ROOM or tokens(header(0, 0) + "!" * LEAST) > self.tokens:
            raise ValueError(f"{TOO_LARGE}: a window must hold a unit of {LEAST} characters and its header")


def header(slot: int, nth: int) -> str:
    return f"\n__SLOT_{slot}_{nth}__\n"


def cut(text: str, slot: int, window: Budget) -> list[tuple[int, int, int]]:
    """Windows (start, end, tokens) of a string that fit both budgets under their headers; neighbours share ``OVERLAP`` characters."""
    room = window.chars - HEADER_ROOM
    while True:
        spans = [(a, b, tokens(header(slot, i) + text[a:b])) for i, (a, b) in enumerate(chunk(text, room))]
        if all(n <= window.tokens for _, _, n in spans):
            return spans
        room = room * 3 // 4
        if room < LEAST:  # dense in tokens beyond what the window takes
            raise ValueError(TOO_LARGE)


def _texts(value) -> Iterator[str]:
    """The strings of a value, in their order."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, (list, dict)):
        for x in value.values() if isinstance(value, dict) else value:
            yield from _texts(x)


def _loaded(text: str | None):
    """A value that is JSON; broken ones have no strings."""
    try:
        return json.loads(text or "null")
    except ValueError:
        return None


@dataclass
class _Unit:
    """A part of a string in a window: what it is, and what the classifier is shown (none: nothing)."""

    key: object
    slot: int
    nth: int
    start: int
    text: str
    shown: str | None


class _Shield:
    """The boundary tokens of a session: put in before a text is shown, and taken out of spans."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.known, self.of = KnownValues(tokens), {t: o for t, o in reversed(tokens) if o}
        self.find = re.compile("|".join(map(re.escape, sorted(self.of, key=len, reverse=True))))

    def back(self, text: str) -> str:
        return self.find.sub(lambda m: self.of[m[0]], text) if self.of else text


def _answer(units: list[_Unit], shields: dict[object, _Shield], classifier: Classifier) -> tuple[str | None, list[tuple]]:
    """Why a window's reply breaks a rule, or no error and what its units hold: (key, slot, at, ord, placeholder, original)."""
    text = "".join(header(u.slot, u.nth) + u.shown for u in units if u.shown is not None)
    sanitized, pairs = classifier(text)
    known = KnownValues(pairs)
    if known(text)[0] != sanitized or any(BOUNDARY.lower() in p.lower() for p, _ in pairs):
        return CHANGED, []
    pairs = [(p, o) for p, o in pairs if not re.fullmatch(BOUNDARY + r"\d+__", o, re.I)]
    if any(not o or len(o) > LONGEST or re.search(r"[\r\n]", o) for _, o in pairs):
        return BAD_SPAN, []
    entries = [(n, p, o) for n, (p, o) in enumerate(pairs)]
    # what was shielded inside a span is itself again
    partly = [e for e in entries if BOUNDARY.lower() in e[2].lower()] if shields else []
    if partly:
        entries = sorted({e for e in entries if e not in partly} | {(n, p, s.back(o)) for n, p, o in partly for s in shields.values()})
        known = KnownValues([(p, o) for _, p, o in entries])
    of: dict[str, list[tuple[int, str, str]]] = {}
    for n, p, o in entries:
        if p and o and p != o:
            of.setdefault(fold(o), []).append((n, p, o))
    held = []
    for u in units:
        folded, first = fold(u.text), {}
        for a, b in known.all(folded):
            first.setdefault(folded[a:b], a)
        # spelled alike, at their first place
        held += [(u.key, u.slot, u.start + a, *e) for value, a in first.items() for e in of.get(value, ()) if e[2] in u.text]
    return None, held


_PLACE = [("slot", pa.int32()), ("at", pa.int64()), ("ord", pa.int64()), ("placeholder", pa.string()), ("original", pa.string())]


def _asked(values: DataFrame, key: str, column: str, classifier: Classifier, window: Budget) -> DataFrame:
    """window, n_units, chars, error_code, keys and held (key as k, slot, at, ord, placeholder, original) of every window.

    Values are dealt by ``key``.  The units of a lane, that is what one partition has unless partitions are put together,
    fill its windows one after another, so a task holds one window and what was found in a bounded number of them.
    ``values`` may have ``_tokens``, the boundary tokens (placeholder, original) of each value.
    """
    kind, n = dict(values.dtypes)[key], int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = values.withColumn("_lane", F.pmod(F.hash(key), F.lit(n))).sortWithinPartitions("_lane", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, own, at = TaskContext.get().partitionId(), 0, None, None
        units, shields, used = [], {}, [0, 0]
        calls, keys, held, ends = [], [], [], [0]

        def ask() -> None:
            nonlocal number
            error, found = _answer(units, shields, classifier)
            calls.append((f"{task}:{number}", len(units), used[0], error))
            keys.append(list(dict.fromkeys(u.key for u in units)))
            held.extend(found)
            ends.append(len(held))
            number += 1
            units.clear(), shields.clear()
            used[:] = 0, 0

        def made() -> pa.RecordBatch:
            names = [("window", pa.string()), ("n_units", pa.int32()), ("chars", pa.int64()), ("error_code", pa.string())]
            columns = [pa.array([c[i] for c in calls], t) for i, (_, t) in enumerate(names)]
            found = pa.StructArray.from_arrays([pa.array([h[i] for h in held], t) for i, t in enumerate([own, *(t for _, t in _PLACE)])], ["k", *(c for c, _ in _PLACE)])
            batch = pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.list_(own)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)], [*(c for c, _ in names), "keys", "held"])
            calls.clear(), keys.clear(), held.clear()
            ends[:] = [0]
            return batch

        for batch in batches:
            own = batch.column(key).type
            for i in range(batch.num_rows):
                name, lane = batch.column(key)[i].as_py(), batch.column("_lane")[i].as_py()
                if units and lane != at:
                    ask()
                at = lane
                tokens = batch.column("_tokens")[i].as_py() if "_tokens" in batch.schema.names else None
                shield = _Shield([(t["placeholder"], t["original"]) for t in tokens]) if tokens else None
                for slot, text in enumerate(_texts(_loaded(batch.column(column)[i].as_py()))):
                    for nth, (a, b, cost) in enumerate(cut(text, slot, window)):
                        needs = len(header(slot, nth)) + b - a, cost
                        if units and (used[0] + needs[0] > window.chars or used[1] + needs[1] > window.tokens):
                            ask()
                        used[:] = used[0] + needs[0], used[1] + needs[1]
                        units.append(_Unit(name, slot, nth, a, text[a:b], shield.known(text[a:b])[0] if shield else text[a:b]))
                        if shield:
                            shields[name] = shield
                if len(held) > M.HELD:
                    yield made()
        if units:
            ask()
        if calls:
            yield made()

    place = f"struct<k:{kind},slot:int,at:bigint,ord:bigint,placeholder:string,original:string>"
    return values.mapInArrow(run, f"window string, n_units int, chars bigint, error_code string, keys array<{kind}>, held array<{place}>")


def _shield(session: DataFrame, key: str) -> DataFrame:
    """Boundary tokens for the originals and placeholders of a session, as entries."""
    token = lambda n: F.concat(F.lit(BOUNDARY), n.cast("string"), F.lit("__"))
    number = F.col("ord") * 2
    sides = F.array(F.struct(number.alias("ord"), token(number).alias("placeholder"), F.col("original").alias("original")), F.struct((number + 1).alias("ord"), token(number + 1).alias("placeholder"), F.col("placeholder").alias("original")))
    return session.select(key, F.explode(sides).alias("e")).select(key, "e.*")


def _category(placeholder: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(placeholder, r"^\[([A-Z][A-Z0-9_]*?)_[0-9]+\]$", 1), F.lit("")), F.lit("PRIVATE_VALUE"))


def sanitize_values(values: DataFrame, key: str, column: str, classifier: Classifier, session: DataFrame | None = None, window: Budget = Budget()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Values rewritten, what was found, and the windows asked.

    ``session``: key, ord, placeholder, original of what is known.  Returns ``(key, sanitized, changed, error_code)``,
    ``(key, ord, placeholder, original)`` of the additions, and ``(window, n_units, chars, error_code)``, one row a call.
    """
    # values share windows: they are dealt over as many partitions as the cluster has
    done, found, asked = _sanitized(values.select(key, column).repartition(key), key, column, classifier, session, window)
    return done.select(key, "sanitized", "changed", "error_code"), found, asked


def _sanitized(values: DataFrame, key: str, column: str, classifier: Classifier, session: DataFrame | None = None, window: Budget = Budget()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`sanitize_values` of values that are dealt over the cluster; their other columns stay, and ``known`` is what each was rewritten with.

    Texts pass twice, to be shown and to be rewritten, each time whole and in one row; in between only what was found moves.
    """
    shown = values.select(key, column)
    if session is not None:
        session = session.select(key, F.col("ord").cast("long").alias("ord"), "placeholder", "original")
        tokens = _shield(session, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "placeholder", "original"))), lambda e: F.struct(e["placeholder"].alias("placeholder"), e["original"].alias("original"))).alias("_tokens"))
        shown = shown.join(tokens, key, "left")
    replies = kept(_asked(shown, key, column, classifier, window))

    # each value has what its units hold, by the first place
    held = replies.select(F.explode("held").alias("e")).select(F.col("e.k").alias(key), "e.slot", "e.at", "e.ord", "e.placeholder", "e.original")
    first = held.groupBy(key, F.lower("original").alias("folded")).agg(F.min(F.struct("slot", "at", "ord", "placeholder", "original")).alias("x"))
    if session is not None:
        first = first.join(session.select(key, F.lower("original").alias("folded")).distinct(), [key, "folded"], "left_anti")
    by = Window.partitionBy(key).orderBy("x.slot", "x.at", "folded")
    kinds = Window.partitionBy(key, _category(F.col("x.placeholder"))).orderBy("x.slot", "x.at", "folded")
    name = F.concat(F.lit("["), _category(F.col("x.placeholder")), F.lit("_"), F.row_number().over(kinds).cast("string"), F.lit("]"))
    found = first.select(key, F.row_number().over(by).cast("long").alias("ord"), name.alias("placeholder"), F.col("x.original").alias("original"))
    if session is not None:
        rebased = M.rebased(found, session, key)
        found = found.join(rebased.where("added").select(key, "ord", "target"), [key, "ord"]).select(key, "ord", F.col("target").alias("placeholder"), "original")
    found = kept(found)

    # every string is rewritten with all that is known of its value, and looked at again
    every = found.unionByName(session) if session is not None else found
    notes = every.select(key, F.struct("ord", "placeholder", "original").alias("e"), F.lit(None).cast("string").alias("why"))
    notes = notes.unionByName(replies.where("error_code is not null").select(F.explode("keys").alias(key), F.lit(None).cast(notes.schema["e"].dataType).alias("e"), F.col("error_code").alias("why")))
    notes = notes.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("known"), F.max("why").alias("_why"))
    return _rebuilt(values.join(notes, key, "left"), column), found, replies.select("window", "n_units", "chars", "error_code")


def _rewriter(entries: list[dict]) -> Callable[[str], tuple[str | None, str | None]]:
    """A string to its rewritten form, or to why it has none."""
    entries = [e for e in entries if e["placeholder"] and e["original"] and e["placeholder"] != e["original"]]
    known, of = KnownValues([(e["placeholder"], e["original"]) for e in entries]), {}
    for e in entries:
        of.setdefault(fold(e["original"]), []).append(e)

    def rewrite(text: str) -> tuple[str | None, str | None]:
        folded = fold(text)
        spans = known.all(folded)
        put, error = known.put(text, folded, spans)
        if error or not spans:
            return put, error
        folded = fold(put)
        left = [e for value in {folded[a:b] for a, b in known.all(folded)} for e in of.get(value, ())]
        names = {e["placeholder"] for e in left}
        return put, LEAK if any(e["original"] not in names for e in left) else None

    return rewrite


def _rebuilt(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with sanitized, changed, error_code in place of the column and _why: each value with its strings rewritten by ``known``."""
    others = [c for c in rows.columns if c not in (column, "_why")]

    def one(text: str | None, entries: list[dict] | None, error: str | None) -> tuple[str | None, bool, str | None]:
        if error or text is None or not entries:
            return None if error else text, False, error
        value, rewrite = _loaded(text), _rewriter(entries)
        puts = [rewrite(x) for x in _texts(value)]
        if error := max((e for _, e in puts if e), default=None):
            return None, False, error
        made = _put(value, iter([p for p, _ in puts]))
        return (json.dumps(made, ensure_ascii=False, separators=(",", ":")), True, None) if made != value else (text, False, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known, why = (batch.column(c) for c in (column, "known", "_why"))
            out = [one(texts[i].as_py(), known[i].as_py(), why[i].as_py()) for i in range(batch.num_rows)]
            made = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *made], [*others, "sanitized", "changed", "error_code"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", sanitized string, changed boolean, error_code string")


def _put(value, puts: Iterator[str]):
    if isinstance(value, str):
        return next(puts)
    if isinstance(value, list):
        return [_put(x, puts) for x in value]
    return {k: _put(x, puts) for k, x in value.items()} if isinstance(value, dict) else value


def fan_out(slots: DataFrame, classifier: Classifier, cache: DataFrame | None = None, policy: str = "strict", window: Budget = Budget()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Artifacts (slot_key, artifact_type, value) through the classifier, each distinct content that ``cache`` lacks once.

    ``cache``: cache_key, content_hash, artifact_type, policy, sanitized, additions of earlier runs; the new one has their
    rows and those of this run, and leaves the earlier one as it is.  Contents whose windows failed are not cached.
    Returns ``(slot_key, artifact_type, cache_key, hit, sanitized, error_code)`` of every slot, the new cache, and the windows asked.
    """
    body = F.coalesce("value", F.lit("null"))
    hashed = slots.select("slot_key", "artifact_type", "value", F.sha2(body.cast("binary"), 256).alias("content_hash"), F.sha2(F.concat_ws("\0", F.lit(policy), "artifact_type", body).cast("binary"), 256).alias("cache_key"))
    keys = kept(hashed.drop("value"))
    if cache is None:
        cache = slots.sparkSession.createDataFrame([], "cache_key string, content_hash string, artifact_type string, policy string, sanitized string, additions array<struct<ord:bigint,placeholder:string,original:string>>")
    # what each content is asked for is settled on ids
    asks = F.collect_set(F.struct("cache_key", "artifact_type")).alias("_asks")
    missing = kept(keys.join(cache.select("cache_key"), "cache_key", "left_anti").groupBy("content_hash").agg(asks))
    # one text for each content, that of its first slot: copies go where they are read, before texts move
    unique = hashed.groupBy("content_hash").agg(F.min_by("value", "slot_key").alias("value")).join(missing, "content_hash")
    done, _, asked = _sanitized(unique, "content_hash", "value", classifier, window=window)
    done = kept(done.select("content_hash", "sanitized", "error_code", "_asks", F.col("known").alias("additions")))
    fresh = done.select("*", F.inline("_asks"))
    answers = cache.select("cache_key", F.lit(True).alias("hit"), "sanitized", F.lit(None).cast("string").alias("error_code"))
    answers = answers.unionByName(fresh.select("cache_key", F.lit(False).alias("hit"), "sanitized", "error_code"))
    out = keys.join(answers, "cache_key", "left").select("slot_key", "artifact_type", "cache_key", F.coalesce("hit", F.lit(False)).alias("hit"), "sanitized", "error_code")
    none = F.array().cast("array<struct<ord:bigint,placeholder:string,original:string>>")
    fresh = fresh.where("error_code is null").select("cache_key", "content_hash", "artifact_type", F.lit(policy).alias("policy"), "sanitized", F.coalesce("additions", none).alias("additions"))
    return out, cache.select(*fresh.columns).unionByName(fresh), asked
