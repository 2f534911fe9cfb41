"""Spans in texts as arrays of structs, by higher-order functions: finding, ordering, merging, splicing.

Offsets count code points from 0; spans are half-open.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPAN = "array<struct<value:string,start:int,end:int>>"
DETECTION = "array<struct<type:string,value:string,start:int,end:int,confidence:double,source:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: expressions that name it several times do not repeat its tree."""
    return F.get(F.transform(F.array(value), use), 0)


def find_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """value, start and end of every match of a Java pattern, or of one of its groups, in order.

    What lies between matches gives the offsets; a group is looked for from the beginning of its match.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), values.alias("value"))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + F.length(row["0"])
        start = begin + F.instr(row["1"], row["2"]) - F.lit(1) if group else begin
        found = F.struct(row["2"].alias("value"), start.cast("int").alias("start"), (start + F.length(row["2"])).cast("int").alias("end"))
        return F.struct((begin + F.length(row["1"])).cast("int").alias("at"), F.concat(acc["found"], F.array(found)).alias("found"))

    named = F.transform(rows, lambda r: F.struct(*(r.getField(n).alias(str(i)) for i, n in enumerate(("gap", "match", "value")))))
    empty = F.array().cast(SPAN)  # most patterns are in few texts: one search instead of three
    folded = F.aggregate(F.filter(named, lambda r: r["1"].isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda acc: acc["found"])
    return F.when(~text.rlike(pattern), empty).otherwise(F.filter(folded, lambda s: F.length(s["value"]) > 0))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two half-open spans share a place."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def contains_span(outer: Column, start: Column, end: Column) -> Column:
    return (outer["start"] <= start) & (outer["end"] >= end)


def by_start(spans: Column, longest_first: bool = False) -> Column:
    """Spans in order of their start (then the longer first); ties keep their order."""

    def compare(a: Column, b: Column) -> Column:
        tie = (b["end"] - b["start"]) - (a["end"] - a["start"]) if longest_first else F.lit(0)
        return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(tie).cast("int")

    return F.array_sort(spans, compare)


def splice(text: Column, replacements: Column) -> Column:
    """The text with spans (start, end, replacement) replaced, from the right."""
    ordered = F.array_sort(replacements, lambda a, b: (b["start"] - a["start"]).cast("int"))
    return F.aggregate(ordered, text, lambda t, r: F.concat(F.substring(t, F.lit(1), r["start"]), r["replacement"], F.substring(t, r["end"] + 1, F.length(t))))


def occurrences(text: Column, value: Column) -> Column:
    """Starts of the non-overlapping occurrences of a literal, from the left."""
    gaps = F.split(text, F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    heads = F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0)))
    fold = F.aggregate(
        heads,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda acc, gap: F.struct(
            (acc["at"] + F.length(gap) + F.length(value)).cast("int").alias("at"),
            F.concat(acc["found"], F.array((acc["at"] + F.length(gap)).cast("int"))).alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(F.length(value) > 0, fold).otherwise(F.array().cast("array<int>"))
