"""Small text functions: digit checks, token estimates, stand-in values, secret types."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from .patterns import java


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits, not all the same, whose Luhn sum is a multiple of ten."""
    digits = digits_of(value)
    places = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    each = F.transform(places, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + x)
    return F.length(digits).between(13, 19) & ~digits.rlike(r"^(\d)\1+$") & (total % 10 == 0)


def phone_digits(value: Column) -> Column:
    """8 to 15 digits."""
    return F.length(digits_of(value)).between(8, 15)


def estimated_tokens(text: Column) -> Column:
    """A token estimate by runs: white space 4 a token, letters 3, digits 2, a non-ASCII character 2 tokens, others 1.

    Null and empty texts have none; any other text at least one.
    """
    run = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+|[A-Za-z]+|[0-9]+|[^\x00-\x7F]|[^A-Za-z0-9\s]"
    first = lambda c, p: F.substring(c, 1, 1).rlike(p)
    cost = lambda c: (
        F.when(first(c, r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"), F.ceil(F.length(c) / 4))
        .when(first(c, "[A-Za-z]"), F.ceil(F.length(c) / 3))
        .when(first(c, "[0-9]"), F.ceil(F.length(c) / 2))
        .when(first(c, r"[^\x00-\x7F]"), F.lit(2))
        .otherwise(F.lit(1))
        .cast("long")
    )
    total = F.aggregate(F.regexp_extract_all(text, F.lit(run), F.lit(0)), F.lit(0).cast("long"), lambda s, c: s + cost(c))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(F.greatest(total, F.lit(1).cast("long")))


# Pools of stand-in names.
PERSONS = ["Alex Morgan", "Jordan Lee", "Sam Rivera", "Taylor Brooks", "Casey Nguyen", "Riley Patel", "Morgan Chen", "Avery Scott"]
ORGANIZATIONS = ["Northwind Labs", "Acme Corporation", "Blue Harbor Inc", "Summit Analytics LLC", "Harborview Systems", "Cedar Ridge Bank", "Lumen Health Group"]
LOCATIONS = ["Springfield", "Riverdale", "Fairview", "Brookfield", "Ashford", "Lakeside", "Greenville"]
# Stand-ins by type as text before the number, least digits, what is added to the number, text after it.
STAND_INS: dict[str, tuple[str, int, int, str]] = {
    "EMAIL": ("contact", 1, 0, "@example.com"),
    "PHONE": ("+1 (555) 010-", 4, 0, ""),
    "IP_ADDRESS": ("10.0.0.", 1, 0, ""),
    "SSN": ("000-00-", 4, 1000, ""),
    "CREDIT_CARD": ("4111 1111 1111 ", 4, 1000, ""),
    "API_KEY": ("gsk_dummy_", 1, 0, "_redacted"),
    "AWS_ACCESS_KEY": ("AKIADUMMY", 8, 0, "KEY"),
    "ZIP": ("ZIP-", 5, 10000, ""),
    "POSTAL_CODE": ("ZIP-", 5, 10000, ""),
    "URL_CREDENTIAL": ("credential_", 1, 0, ""),
    "URL_QUERY_SECRET": ("redacted_secret_", 1, 0, ""),
    "CONNECTION_STRING_CREDENTIAL": ("user", 1, 0, ""),
    "MRN": ("MRN-", 5, 10000, ""),
    "MEDICAL_ID": ("MEDICAL-ID-", 1, 0, ""),
}
POOLS = {"PERSON": ("Person", PERSONS), "ORGANIZATION": ("Organization", ORGANIZATIONS), "LOCATION": ("Location", LOCATIONS)}


def _literals(values: Iterable[str | int]) -> Column:
    return F.expr("array(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "\\'") + "'" for v in values) + ")")


def stand_in(kind: Column, number: Column) -> Column:
    """The stand-in value number ``number`` (1 at least) of a type; unknown types have a general one."""
    n = F.greatest(F.lit(1), number).cast("int")
    before, least, plus, after = (_literals(x) for x in zip(*STAND_INS.values(), strict=True))
    at = (F.array_position(_literals(STAND_INS), kind) - 1).cast("int")  # -1, and so null, where it has none
    figure = (n + F.get(plus, at)).cast("string")
    padded = F.lpad(figure, F.greatest(F.get(least, at), F.length(figure)), F.lit("0"))
    out = F.coalesce(F.concat(F.get(before, at), padded, F.get(after, at)), F.concat(F.lit("SensitiveValue"), n.cast("string")))
    for name, (label, pool) in POOLS.items():
        picked = F.coalesce(F.get(_literals(pool), n - 1), F.concat(F.lit(label + " "), n.cast("string")))
        out = F.when(kind == name, picked).otherwise(out)
    return out


def stand_in_pattern() -> str:
    """A Java pattern for any stand-in value."""
    import re

    parts = [re.escape(before).replace(r"\ ", " ") + (rf"\d{{{least},}}" if least > 1 and kind != "AWS_ACCESS_KEY" else r"\d+") + re.escape(after) for kind, (before, least, _, after) in STAND_INS.items() if kind != "ZIP"]
    parts += [r"SensitiveValue\d+", r"Person \d+", r"Organization \d+", r"Location \d+", *PERSONS, *ORGANIZATIONS, *LOCATIONS]
    return "(?:" + "|".join(parts) + ")"


# What a bare value looks like, first match wins.
SECRET_SHAPES: list[tuple[str, str, bool]] = [
    ("EMAIL", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", True),
    ("PHONE", r"^\s*\+?\d[\d\s().-]{7,}\d\s*$", False),
    ("MRN", r"\bMRN[-\s]?\d{5,}\b", True),
    ("API_KEY", r"\bgsk_[A-Za-z0-9]{8,}\b", False),
    ("API_KEY", r"\b(?:sk|pk)_(?:live|test)_[A-Za-z0-9_]{8,}\b", False),
    ("AWS_ACCESS_KEY", r"\b(?:AKIA|ASIA)[A-Z0-9]{12,20}\b", False),
    ("API_KEY", r"\b[a-f0-9]{32,64}\b", True),
]


def secret_type(value: Column) -> Column:
    """The type that a value's shape suggests."""
    first = reduce(lambda out, shape: out.when(value.rlike(java(shape[1], shape[2])), shape[0]), SECRET_SHAPES, F)
    return first.otherwise("PRIVATE_IDENTIFIER")


def looks_like_secret(value: Column) -> Column:
    """Long hexadecimal runs, key prefixes, or an address."""
    return value.rlike(r"(?i)[0-9a-f]{16,}") | value.rlike(r"^(?:gsk_|sk_|pk_|AKIA)") | value.rlike(java(SECRET_SHAPES[0][1], True))


# Replies that name a kind of value instead of standing in for it.
VAGUE = ["api key", "api-key", "phone number", "email address", "credit card number", "sensitive info", "sensitive information", "personal information"]


def is_vague(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(VAGUE)
