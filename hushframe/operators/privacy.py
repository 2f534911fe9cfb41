"""Detection, resolution, policy, redaction and restoration of sensitive spans in a text column.

All of it is column expressions: a text is scanned, resolved and rewritten in one narrow stage, without a shuffle.

Cases: a null text yields null spans and a null result; an empty text no spans; ties keep the order of the detectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import patterns as P, scan
from ..functions.known import put_out
from ..functions.spans import DETECTION, bound, by_start, contains_span, find_spans, occurrences, overlaps, splice
from ..functions.text import luhn, phone_digits, stand_in, stand_in_pattern

# Priority of types in overlaps; others have ten times their confidence.
PRIORITY = {"CONNECTION_STRING_CREDENTIAL": 100, "URL_QUERY_SECRET": 90, "URL_CREDENTIAL": 90, "API_KEY": 80, "EMAIL": 50, "IP_ADDRESS": 50}
# Types that are redacted wherever they stand outside protected spans.
SENSITIVE = ["EMAIL", "SSN", "CREDIT_CARD", "PHONE", "API_KEY", "AWS_ACCESS_KEY", "URL_CREDENTIAL", "URL_QUERY_SECRET", "CONNECTION_STRING_CREDENTIAL", "MEDICAL_ID", "MRN"]
CREDENTIALS = ["URL_CREDENTIAL", "URL_QUERY_SECRET", "CONNECTION_STRING_CREDENTIAL"]
IDENTITIES = ["PERSON", "ORGANIZATION", "LOCATION"]
PRIVATE_ADDRESS = r"^(?:10\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.)"
CONFIDENT = 0.9
PROTECTED = "array<struct<type:string,value:string,start:int,end:int>>"
REPLACEMENT = "array<struct<start:int,end:int,original:string,replacement:string,type:string,reason:string>>"


def _where(condition: Column, spans: Column, kind: str) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(kind))


def detector_spans(text: Column, d: P.Detector) -> Column:
    """What one detector finds: type, value, start, end, confidence, source."""
    found = find_spans(text, P.java(d.pattern, d.ignore_case), d.group)
    if d.check:
        test = {"luhn": luhn, "phone_digits": phone_digits, "not_a_term": lambda v: ~F.get(F.split(v, r"\s+"), 0).isin(P.NO_PERSON)}[d.check]
        found = F.filter(found, lambda s: test(s["value"]))
    value = (lambda v: F.regexp_replace(F.trim(v), "['\"’]+$", "")) if d.trim else (lambda v: v)
    made = F.transform(
        found,
        lambda s: F.struct(
            F.lit(d.type).alias("type"), value(s["value"]).alias("value"), s["start"].alias("start"),
            (s["start"] + F.length(value(s["value"]))).cast("int").alias("end"), F.lit(d.confidence).alias("confidence"), F.lit(d.source).alias("source"),
        ),
    )
    return _where(P.may_match(text, d.needs), made.cast(DETECTION), DETECTION)


def raw_detections(text: Column, detectors: list[P.Detector] | None = None) -> Column:
    """Everything the detectors find, in their order; spans may overlap."""
    return F.concat(*(detector_spans(text, d) for d in detectors or P.DETECTORS))


def priority(d: Column) -> Column:
    out = d["confidence"] * 10
    for kind, p in PRIORITY.items():
        out = F.when(d["type"] == kind, float(p)).otherwise(out)
    return out


def merge_detections(found: Column) -> Column:
    """Overlaps settled from left to right: a span stays out or takes the place of the first that it overlaps, by priority."""

    def step(kept: Column, d: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: overlaps(k, d)), F.lit(True))
        wins = priority(d) > priority(F.get(kept, (hit - 1).cast("int")))
        swapped = F.transform(kept, lambda k, i: F.when(i == hit - 1, d).otherwise(k))
        return F.when(hit == 0, F.concat(kept, F.array(d))).when(wins, swapped).otherwise(kept)

    ordered = by_start(F.filter(found, lambda d: F.length(d["value"]) > 0), longest_first=True)
    return by_start(F.aggregate(ordered, F.array().cast(DETECTION), step))


def detections(text: Column) -> Column:
    """The settled detections of a text, by one pass of all detectors over a batch of texts."""
    return scan.detections(text, PRIORITY)


def protected_spans(text: Column) -> Column:
    """URLs, connection strings, file paths and code: type, value, start, end, by start."""
    as_type = lambda spans, kind: F.transform(spans, lambda s: F.struct(F.lit(kind).alias("type"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"))).cast(PROTECTED)
    free = lambda spans, held, back=0: F.filter(spans, lambda s: ~F.exists(held, lambda h: contains_span(h, s["start"] - back, s["end"] - back)))
    urls = _where(text.rlike(r"(?i)://|www\."), as_type(find_spans(text, P.java(P.URL, True)), "URL"), PROTECTED)
    links = _where(F.contains(text, F.lit("://")), as_type(find_spans(text, P.java(P.CONNECTION_STRING, True)), "CONNECTION_STRING"), PROTECTED)
    # a path is looked for among earlier spans from the white space before it
    lead = lambda s: F.when(s["start"] > 0, 1).otherwise(0)
    paths = F.filter(find_spans(text, P.java(P.FILE_PATH), 1), lambda s: (F.length(s["value"]) >= 5) & ~s["value"].rlike(r"//|@|\.com|\.org"))
    apart = lambda held: F.filter(paths, lambda s: ~F.exists(held, lambda h: contains_span(h, s["start"] - lead(s), s["end"] - lead(s))))
    blocks = _where(F.contains(text, F.lit("```")), as_type(find_spans(text, P.java(P.CODE_BLOCK)), "CODE_BLOCK"), PROTECTED)
    ticks = _where(F.contains(text, F.lit("`")), as_type(find_spans(text, P.java(P.INLINE_CODE)), "INLINE_CODE"), PROTECTED)
    with_links = bound(urls, lambda held: F.concat(held, free(links, held)))
    with_paths = bound(with_links, lambda held: F.concat(held, _where(F.contains(text, F.lit("/")), as_type(apart(held), "FILE_PATH"), PROTECTED), blocks))
    return by_start(bound(with_paths, lambda held: F.concat(held, free(ticks, held))))


def inner_secrets(span: Column) -> Column:
    """Passwords and query secrets inside a URL or connection string, with places in the whole text."""
    shift = lambda spans, kind: F.transform(
        spans, lambda s: F.struct(F.lit(kind).alias("type"), s["value"].alias("value"), (s["start"] + span["start"]).cast("int").alias("start"), (s["end"] + span["start"]).cast("int").alias("end"))
    ).cast(PROTECTED)
    value = span["value"]
    users = _where(F.contains(value, F.lit("@")), shift(find_spans(value, P.java(P.INNER_CREDENTIAL), 2), "URL_CREDENTIAL"), PROTECTED)
    queries = _where(F.contains(value, F.lit("=")), shift(find_spans(value, P.java(P.INNER_QUERY_SECRET, True), 3), "URL_QUERY_SECRET"), PROTECTED)
    return _where(span["type"].isin("URL", "CONNECTION_STRING"), F.concat(users, queries), PROTECTED)


def should_redact(d: Column, spans: Column) -> Column:
    """The default policy for a detection among the protected spans of its text."""
    outside = (
        F.when(d["type"].isin(SENSITIVE), True)
        .when(d["type"] == "IP_ADDRESS", (d["confidence"] >= CONFIDENT) & ~d["value"].rlike(PRIVATE_ADDRESS))
        .otherwise(d["confidence"] >= CONFIDENT)
    )

    def policy(parent: Column) -> Column:
        exact = F.exists(inner_secrets(parent), lambda s: (s["start"] == d["start"]) & (s["end"] == d["end"]))
        inside = d["type"].isin(CREDENTIALS) | F.coalesce(exact, F.lit(False))
        return F.when(parent.isNotNull(), inside).otherwise(outside)

    parents = F.filter(spans, lambda s: contains_span(s, d["start"], d["end"]))
    return F.when(F.trim(d["value"]).isin(P.PUBLIC_TERMS), False).otherwise(bound(F.get(parents, 0), policy))


def should_redact_strict(d: Column, spans: Column, threshold: float = 0.65) -> Column:
    """The strict policy: sensitive types always, identities from a threshold, others by default."""
    always = [*SENSITIVE, "PRIVATE_IDENTIFIER", "PASSWORD", "SECRET", "CREDENTIAL", "TOKEN"]
    return F.when(d["type"].isin(always), True).when(d["type"].isin(IDENTITIES), d["confidence"] >= threshold).otherwise(should_redact(d, spans))


def classified(found: Column, spans: Column) -> Column:
    """Detections with their action, redact or keep."""
    return F.transform(found, lambda d: d.withField("action", F.when(should_redact(d, spans), "redact").otherwise("keep")))


def free_stand_in(low: Column, kind: Column, number: Column, taken: Column) -> Column:
    """The first stand-in from ``number`` on that neither the text (``low``: in lower case) holds, nor a replacement uses.

    It is an error if 1024 in a row are taken: a text must not go on without one.
    """
    unused = lambda c: ~F.contains(low, F.lower(c)) & ~F.exists(taken, lambda r: r["replacement"] == c)
    none = F.raise_error(F.lit("DUMMY_ALLOCATION_EXHAUSTED")).cast("string")
    later = lambda n: F.coalesce(F.get(F.filter(F.transform(F.sequence(n, n + 1023), lambda i: stand_in(kind, i)), unused), 0), none)
    return bound(number, lambda n: bound(stand_in(kind, n), lambda first: F.when(unused(first), first).otherwise(later(n))))


def _replacement(s: Column, value: Column, replacement: Column, reason: str) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), value.alias("original"), replacement.alias("replacement"), s["type"].alias("type"), F.lit(reason).alias("reason"))


def redaction_plan(text: Column, found: Column, spans: Column) -> Column:
    """Replacements: secrets inside protected spans first, then detections, numbered by type."""

    def policy(low: Column, kept: Column, s: Column) -> Column:
        again = F.exists(kept, lambda r: (r["start"] == s["start"]) & (r["end"] == s["end"]))
        number = F.size(F.filter(kept, lambda r: r["type"] == s["type"])) + 1
        new = _replacement(s, s["value"], free_stand_in(low, F.lit("API_KEY"), number, kept), "policy")
        return F.when(again, kept).otherwise(F.concat(kept, F.array(new)))

    def detector(low: Column, kept: Column, d: Column) -> Column:
        again = F.exists(kept, lambda r: (r["start"] == d["start"]) & (r["end"] == d["end"]))
        number = F.size(F.filter(kept, lambda r: (r["type"] == d["type"]) & (r["reason"] == "detector"))) + 1
        new = _replacement(d, d["value"], free_stand_in(low, d["type"], number, kept), "detector")
        return F.when(again, kept).otherwise(F.concat(kept, F.array(new)))

    def plan(low: Column) -> Column:
        inner = F.flatten(F.transform(spans, inner_secrets))
        by_policy = F.aggregate(inner, F.array().cast(REPLACEMENT), lambda kept, s: policy(low, kept, s))
        return F.aggregate(F.filter(found, lambda d: should_redact(d, spans)), by_policy, lambda kept, d: detector(low, kept, d))

    # the lowered text is made once and named by the lambda; most texts need none
    none = (F.size(found) == 0) & (F.size(F.filter(spans, lambda s: s["type"].isin("URL", "CONNECTION_STRING"))) == 0)
    return F.when(none, F.array().cast(REPLACEMENT)).otherwise(F.get(F.transform(F.array(F.lower(text)), plan), 0))


def strict_plan(text: Column, found: Column, spans: Column, threshold: float = 0.65) -> Column:
    """Replacements under the strict policy: overlaps skipped, one stand-in for each value whatever its case.

    Different values are numbered once each, by the type that each has first; their occurrences look the stand-in up.
    """
    item = "struct<start:int,end:int,original:string,folded:string,type:string>"

    def free(acc: Column, d: Column) -> Column:
        value = F.substring(text, d["start"] + 1, d["end"] - d["start"])
        new = F.struct(d["start"].alias("start"), d["end"].alias("end"), value.alias("original"), F.lower(value).alias("folded"), d["type"].alias("type"))
        # spans come by their starts: one that begins before the end of those kept overlaps one of them
        return F.when(d["start"] < acc["past"], acc).otherwise(F.struct(d["end"].alias("past"), F.concat(acc["kept"], F.array(new)).alias("kept")))

    wanted = F.filter(found, lambda d: should_redact_strict(d, spans, threshold))
    kept = F.aggregate(wanted, F.struct(F.lit(-1).alias("past"), F.array().cast(f"array<{item}>").alias("kept")), free, lambda acc: acc["kept"])
    named = "array<struct<folded:string,type:string,replacement:string>>"

    def number(low: Column, names: Column, x: Column) -> Column:
        first = F.size(F.filter(names, lambda r: r["type"] == x["type"])) + 1
        return F.concat(names, F.array(F.struct(x["folded"].alias("folded"), x["type"].alias("type"), free_stand_in(low, x["type"], first, names).alias("replacement"))))

    def plan(kept: Column, low: Column) -> Column:
        folded = F.transform(kept, lambda x: x["folded"])
        firsts = F.transform(F.array_distinct(folded), lambda v: F.element_at(kept, F.array_position(folded, v).cast("int")))
        names = F.aggregate(firsts, F.array().cast(named), lambda acc, x: number(low, acc, x))
        look_up = lambda of, x: F.element_at(F.filter(of, lambda r: r["folded"] == x["folded"]), 1)["replacement"]
        return F.get(F.transform(F.array(names), lambda of: F.transform(kept, lambda x: _replacement(x, x["original"], look_up(of, x), "strict"))), 0)

    # kept and the lowered text are made once and named by the lambda
    once = F.array(F.struct(kept.alias("kept"), F.lower(text).alias("low")))
    return F.get(F.transform(once, lambda o: plan(o["kept"], o["low"])), 0).cast(REPLACEMENT)


def session_entries(plan: Column) -> Column:
    """The session map of a plan as ordered entries: placeholder, original; a placeholder keeps its first place."""
    entries = F.transform(plan, lambda r: F.struct(r["replacement"].alias("placeholder"), r["original"].alias("original")))
    return F.aggregate(
        entries,
        F.array().cast("array<struct<placeholder:string,original:string>>"),
        lambda kept, e: F.when(F.exists(kept, lambda k: k["placeholder"] == e["placeholder"]), kept).otherwise(F.concat(kept, F.array(e))),
    )


def sanitize(df: DataFrame, column: str = "text", strict: bool = False, threshold: float = 0.65) -> DataFrame:
    """``df`` with protected, detections, plan, sanitized and session (placeholder, original) of a text column.

    Strictly, the session is applied to the whole text: a value that was detected once is put out wherever the text has it,
    whatever its case.  ``error_code`` says where that is ambiguous; such a text has no sanitized form.
    """
    text = F.col(column)
    out = df.withColumn("protected", protected_spans(text)).withColumn("detections", detections(text))
    plan = strict_plan(text, F.col("detections"), F.col("protected"), threshold) if strict else redaction_plan(text, F.col("detections"), F.col("protected"))
    out = out.withColumn("plan", plan).withColumn("session", session_entries(F.col("plan")))
    if not strict:
        return out.withColumn("sanitized", splice(text, F.col("plan")))
    return put_out(out, column, "session")


def restore(text: Column, session: Column) -> Column:
    """Placeholders replaced by their originals in one pass, the longest placeholder first at each place.

    ``session``: array of placeholder and original.  Nothing that has been put in is looked at again.
    """
    ordered = F.array_sort(session, lambda a, b: (F.length(b["placeholder"]) - F.length(a["placeholder"])).cast("int"))
    spots = F.flatten(F.transform(ordered, lambda e: F.transform(occurrences(text, e["placeholder"]), lambda at: F.struct(at.alias("start"), (at + F.length(e["placeholder"])).cast("int").alias("end"), e["original"].alias("replacement")))))
    kind = "array<struct<start:int,end:int,replacement:string>>"
    # at each place the longest match that begins there, left to right, past the end of the one before
    first = F.array_sort(spots, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]).cast("int"))
    chosen = F.aggregate(first, F.array().cast(kind), lambda kept, s: F.when(F.exists(kept, lambda k: overlaps(k, s)), kept).otherwise(F.concat(kept, F.array(s))))
    return splice(text, chosen)


def leaks(text: Column, session: Column) -> Column:
    """The originals that a text still holds, whatever their case, with placeholders blanked out."""
    low = F.aggregate(F.array_sort(session, lambda a, b: (F.length(b["placeholder"]) - F.length(a["placeholder"])).cast("int")), F.lower(text), lambda t, e: F.replace(t, F.lower(e["placeholder"]), F.repeat(F.lit(" "), F.length(e["placeholder"]))))
    # the blanked text is made once: inside the filter it would be made for every entry
    held = F.transform(F.array(low), lambda t: F.transform(F.filter(session, lambda e: F.contains(t, F.lower(e["original"]))), lambda e: e["original"]))
    return F.array_distinct(F.get(held, 0))


def unresolved(text: Column) -> Column:
    """Distinct placeholders and stand-ins in a text."""
    pattern = r"(?i)(?:\[PAI1_[A-Z][A-Z0-9_]{0,63}_[A-F0-9]{24,64}\]|\[[A-Z][A-Z0-9_]*_[0-9]+\]|" + stand_in_pattern() + ")"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
