"""Known values in texts: a case-folded automaton over the placeholders and originals of a session.

Folding keeps the length of a text, so places in the folded text are places in the text.  At each place the longest known
value counts, from left to right, and what has been put in is not looked at again.  A placeholder that stands in the text
shields what is in it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Entry = tuple[str, str]


def fold(text: str) -> str:
    """The text in lower case, code point by code point; what has no single lower-case form stays."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.replace("ς", "σ")


class KnownValues:
    """Entries (placeholder, original) of a session, in order; those with an empty side or equal sides do not count."""

    def __init__(self, session: Iterable[Entry]):
        entries = [(p, o) for p, o in session if p and o and p != o]
        # what an exact spelling becomes, by folded spelling; a placeholder becomes itself, before any original
        self.targets: dict[str, dict[str, str]] = {}
        for value, target in [*((p, p) for p, _ in entries), *((o, p) for p, o in entries)]:
            self.targets.setdefault(fold(value), {}).setdefault(value, target)
        self.automaton = ahocorasick.Automaton()
        for folded in self.targets:
            self.automaton.add_word(folded, len(folded))
        if self.targets:
            self.automaton.make_automaton()

    def all(self, folded: str) -> list[tuple[int, int]]:
        """Every occurrence of a known value in a folded text, also those that overlap, by their ends."""
        return [(last + 1 - size, last + 1) for last, size in self.automaton.iter(folded)] if self.targets else []

    def chosen(self, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The occurrences that count: the longest at each place, from left to right."""
        longest: dict[int, int] = {}
        for a, b in found:
            longest[a] = b  # those at one place come by their ends
        out, at = [], 0
        for a in sorted(longest):
            if a >= at:
                at = longest[a]
                out.append((a, at))
        return out

    def __call__(self, text: str) -> tuple[str | None, str | None]:
        """The text with placeholders for originals and no error; or no text and why: a spelling that two values could mean."""
        folded = fold(text)
        return self.put(text, folded, self.all(folded))

    def put(self, text: str, folded: str, found: list[tuple[int, int]]) -> tuple[str | None, str | None]:
        """The same, of a text whose folded form and occurrences are known."""
        parts, at = [], 0
        for a, b in self.chosen(found):
            meant = self.targets[folded[a:b]]
            target = meant.get(text[a:b]) or (next(iter(meant.values())) if len(meant) == 1 else None)
            if target is None:
                return None, "AMBIGUOUS_KNOWN_VALUE"
            parts += text[at:a], target
            at = b
        return "".join(parts) + text[at:] if parts else text, None


def put_out(df: DataFrame, column: str, session: str) -> DataFrame:
    """``df`` with ``sanitized`` and ``error_code``: the known values of a session column put out of a text column.

    ``session``: array of structs with placeholder and original, in order.  A null text stays null; columns of any name are
    kept.  Runs of rows with one session share its automaton.
    """
    own = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    row = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(own)))
    rows = df.select(row.alias("_row"), F.col(column).alias("_text"), F.transform(F.col(session), lambda e: F.struct(e["placeholder"].alias("p"), e["original"].alias("o"))).alias("_session"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, KnownValues([])
        for batch in batches:
            out = []
            for text, own in zip(batch.column("_text").to_pylist(), batch.column("_session").to_pylist(), strict=True):
                if own != last:
                    last, known = own, KnownValues([(e["p"], e["o"]) for e in own or ()])
                out.append((None, None) if text is None else known(text))
            made = [pa.array([x[i] for x in out], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *made], ["_row", "sanitized", "error_code"])

    out = rows.mapInArrow(run, f"_row {rows.schema['_row'].dataType.simpleString()}, sanitized string, error_code string")
    return out.select(*(F.col(f"_row.c{i}") for i in range(len(own))), "sanitized", "error_code").toDF(*df.columns, "sanitized", "error_code")
