"""All detectors over a batch of texts, and their overlaps settled, in one Arrow function.

A column form of the same (:func:`hushframe.operators.privacy.raw_detections` and ``merge_detections``) runs every pattern
up to four times in interpreted lambdas; this one runs each pattern once, on texts that pass its cheap test, and settles
overlaps in time that grows with the number of spans.  The tests hold the two against each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .patterns import _SPACE, DETECTORS, NO_PERSON, Detector
from .spans import DETECTION

_BLANK = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), _SPACE)
_KIND = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64()), ("source", pa.string())]))
Found = tuple[str, str, int, int, float, str]


def compiled(pattern: str, ignore_case: bool = False) -> re.Pattern:
    r"""The pattern for Python: ASCII classes, all white space in \s, ^ and $ as the very ends."""
    out, inside = "", False
    for token in re.findall(r"\\.|.", pattern, re.S):
        if token == r"\s":
            token = _BLANK if inside else f"[{_BLANK}]"
        elif token == r"\S" and not inside:
            token = f"[^{_BLANK}]"
        elif token in "^$" and not inside:
            token = r"\A" if token == "^" else r"\Z"
        elif token in "[]":
            inside = token == "["
        out += token
    # a class that is negated begins with ^
    return re.compile(out, (re.I if ignore_case else 0) | re.A)


def _digits(value: str) -> str:
    return re.sub(r"[^0-9]", "", value)


def _luhn(value: str) -> bool:
    digits = _digits(value)
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and total % 10 == 0


_CHECKS: dict[str, Callable[[str], bool]] = {"": bool, "luhn": _luhn, "phone_digits": lambda v: 8 <= len(_digits(v)) <= 15, "not_a_term": lambda v: v.split()[0] not in NO_PERSON}


@cache
def _ready() -> list[tuple[Detector, re.Pattern, Callable[[str], object]]]:
    out = []
    for d in DETECTORS:
        if d.needs == "+" or not any(c in d.needs for c in r"\[](){}?*+"):
            words = [d.needs] if d.needs == "+" else d.needs.split("|")
            test: Callable[[str], object] = lambda text, words=words: any(w in text for w in words)
        else:
            test = compiled(d.needs.removeprefix("(?i)"), d.needs.startswith("(?i)")).search
        out.append((d, compiled(d.pattern, d.ignore_case), test))
    return out


def found(text: str) -> Iterator[Found]:
    """What the detectors find, in their order."""
    for d, pattern, test in _ready():
        if not test(text):
            continue
        for m in pattern.finditer(text):
            if (value := m[d.group]) and _CHECKS[d.check](value):
                start = m.start() + (m[0].index(value) if d.group else 0)
                if d.trim:
                    value = value.strip(" ").rstrip("'\"’")
                yield d.type, value, start, start + len(value), d.confidence, d.source


def settled(spans: list[Found], priority: Callable[[str, float], float]) -> list[Found]:
    """Overlaps settled from left to right: a span stays out or takes the place of the first that it overlaps, by priority."""
    kept: list[Found] = []
    near: list[int] = []  # those that end after the beginning of the span at hand
    for s in sorted((s for s in spans if s[1]), key=lambda s: (s[2], s[2] - s[3])):
        near = [i for i in near if kept[i][3] > s[2]]
        hit = next((i for i in near if kept[i][2] < s[3]), None)
        if hit is None:
            near.append(len(kept))
            kept.append(s)
        elif priority(s[0], s[4]) > priority(kept[hit][0], kept[hit][4]):
            kept[hit] = s
    return sorted(kept, key=lambda s: s[2])


def detections(text: Column, priorities: dict[str, int]) -> Column:
    """The settled detections of a text column; null stays null."""
    priority = lambda kind, confidence: float(priorities.get(kind, confidence * 10))

    @F.arrow_udf(DETECTION)
    def scan(texts: pa.Array) -> pa.Array:
        names = ("type", "value", "start", "end", "confidence", "source")
        return pa.array([None if t is None else [dict(zip(names, s, strict=True)) for s in settled(list(found(t)), priority)] for t in texts.to_pylist()], _KIND)

    return scan(text)
