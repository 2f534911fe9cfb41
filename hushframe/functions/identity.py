"""Keyed identities: canonical serialisation, HMAC-SHA-256 and placeholder aliases, by SQL functions alone.

Nothing but the key comes from outside.  ``Identity`` holds the key, the prefix of every derivation and the scope.
"""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# The kinds of scopes.
SCOPE_KINDS = ("global", "installation", "session", "request", "document", "policy")
# Aliases, canonical and legacy.
CANONICAL = r"\[PAI1_([A-Z][A-Z0-9_]{0,63})_([A-F0-9]{24,64})\]"
LEGACY = r"\[([A-Za-z][A-Za-z0-9_]{0,63})_([0-9]{1,10})\]"


def nfc(value: Column) -> Column:
    """The composed normal form; ICU, which Spark brings along, makes it of what is not ASCII."""
    made = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), value, F.lit(False))
    return F.when(value.rlike(r"[^\x00-\x7F]"), made).otherwise(value)


def nfkc(value: Column) -> Column:
    """The composed compatibility form."""
    made = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), value, F.lit(True))
    return F.when(value.rlike(r"[^\x00-\x7F]"), made).otherwise(value)


def serialized_string(value: Column) -> Column:
    """A string as s, its bytes, a colon and itself."""
    return F.concat(F.lit("s"), F.octet_length(value).cast("string"), F.lit(":"), value)


def serialized_record(fields: dict[str, Column]) -> Column:
    """Already serialised fields as an object: keys in order."""
    parts = [x for name in sorted(fields) for x in (F.lit(f"s{len(name.encode())}:{name}"), fields[name])]
    return F.concat(F.lit(f"o{len(fields)}:"), *parts)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 as lower-case hexadecimal digits; ``message`` is binary."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def framed(value: Column) -> Column:
    """The UTF-8 bytes of a string behind their number in four bytes."""
    raw = value.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 8, "0")), raw)


@dataclass(frozen=True)
class Identity:
    """Derives identities of values within a scope; ``kind`` and ``id`` name the scope, ``id`` may be a column."""

    key: bytes
    kind: str = "installation"
    scope_id: str | None = None
    prefix: bytes = b"hushframe\0identity\0v1\0"
    tag: str = field(default="PAI1")

    def __post_init__(self):
        if len(self.key) < 32:
            raise ValueError("identity keys have at least 32 bytes")
        if self.kind not in SCOPE_KINDS:
            raise ValueError(f"unknown scope: {self.kind}")

    @property
    def key_id(self) -> str:
        return "kid1:" + hmac.new(self.key, self.prefix + b"key-id", hashlib.sha256).hexdigest()[:32]

    def derive(self, domain: str, serialized: Column) -> Column:
        """The keyed digest of a serialised value in a domain."""
        name = domain.encode()
        head = self.prefix + len(name).to_bytes(4, "big") + name
        return hmac_sha256(self.key, F.concat(F.lit(bytearray(head)), framed(serialized)))

    def _scope(self, scope_id: Column | None) -> Column:
        own = F.lit(self.scope_id or self.key_id) if scope_id is None else scope_id
        return serialized_record({"kind": serialized_string(F.lit(self.kind)), "id": serialized_string(own)})

    def protected_value(self, value: Column, normalization: str = "nfc", scope_id: Column | None = None) -> Column:
        """pvi1: id of a value in the normal form named (nfc, or none for the value as it is)."""
        if normalization not in ("nfc", "none"):
            raise ValueError(f"unknown normalization: {normalization}")
        value = nfc(value) if normalization == "nfc" else value
        material = {"version": F.lit("d1"), "scope": self._scope(scope_id), "normalization": serialized_string(F.lit(normalization)), "value": serialized_string(value)}
        return F.concat(F.lit("pvi1:"), self.derive("protected-value", serialized_record(material)))

    def placeholder_digest(self, value_id: Column, category: Column, domain: str = "text", scope_id: Column | None = None) -> Column:
        material = {
            "version": F.lit("d1"), "scope": self._scope(scope_id), "domain": serialized_string(F.lit(domain)),
            "category": serialized_string(category), "protectedValueId": serialized_string(value_id),
        }
        return self.derive("placeholder", serialized_record(material))

    def placeholder(self, value: Column, category: Column, **scope) -> Column:
        """phi1: id of the placeholder of a value and category."""
        return F.concat(F.lit("phi1:"), self.placeholder_digest(self.protected_value(value, scope_id=scope.get("scope_id")), category, **scope))

    def alias(self, value: Column, category: Column, **scope) -> Column:
        """The canonical alias: tag, category and 24 digits."""
        digest = self.placeholder_digest(self.protected_value(value, scope_id=scope.get("scope_id")), category, **scope)
        return F.concat(F.lit(f"[{self.tag}_"), category, F.lit("_"), F.upper(F.substring(digest, 1, 24)), F.lit("]"))

    def reference(self, domain: str, value: Column) -> Column:
        """An opaque reference to a value: scheme, key and digest."""
        return F.concat(F.lit(f"hmac-sha256:{self.key_id}:"), self.derive(f"reference:{domain}", serialized_string(value)))

    def provider_identifier(self, value: Column, taken: Column, before: str = "hush_") -> Column:
        """The shortest of 12, 16, ... 64 digits behind a prefix that is not in the array ``taken``."""
        digest = self.derive("provider-identifier", serialized_string(value))
        candidates = F.transform(F.sequence(F.lit(12), F.lit(64), F.lit(4)), lambda n: F.concat(F.lit(before), F.substring(digest, F.lit(1), n)))
        return F.get(F.filter(candidates, lambda c: ~F.array_contains(taken, c)), 0)


def category(value: Column, fallback: str = "PRIVATE_VALUE") -> Column:
    """A category name: upper case, other characters to one underscore, none at the ends; the fallback if none is left."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(nfkc(F.coalesce(value, F.lit(fallback)))), r"[^A-Z0-9_]+", "_"), r"^_+|_+$", "")
    return F.when(plain.rlike(r"^[A-Z][A-Z0-9_]{0,63}$"), plain).otherwise(fallback)


def parse_alias(value: Column) -> Column:
    """format ('canonical', 'legacy' or null), category, digest and ordinal of an alias."""
    whole = lambda p: value.rlike(rf"\A{p}\z")
    ordinal = F.regexp_extract(value, LEGACY, 2).cast("long")
    legacy = whole(LEGACY) & (ordinal > 0)
    return F.struct(
        F.when(whole(CANONICAL), "canonical").when(legacy, "legacy").alias("format"),
        F.when(whole(CANONICAL), F.regexp_extract(value, CANONICAL, 1)).when(legacy, category(F.regexp_extract(value, LEGACY, 1))).alias("category"),
        F.when(whole(CANONICAL), F.lower(F.regexp_extract(value, CANONICAL, 2))).alias("digest"),
        F.when(~whole(CANONICAL) & legacy, ordinal).alias("ordinal"),
    )


def is_malformed_alias(value: Column) -> Column:
    """Begins like a canonical alias but is none."""
    return value.rlike(r"(?i)\A\[PAI[0-9]*_") & ~value.rlike(rf"\A{CANONICAL}\z")


def inferred_category(alias: Column) -> Column:
    """The category that an alias without grammar hints at."""
    return F.when(alias.rlike("(?i)api|key|token|secret|credential"), "API_KEY").when(alias.rlike("(?i)email|@"), "EMAIL").when(alias.rlike("(?i)phone|555"), "PHONE").otherwise("PRIVATE_VALUE")


def next_legacy_alias(alias: Column, occupied: Column) -> Column:
    """The next free [CATEGORY_n] after an alias; ``occupied``: an array of lower-case aliases."""
    parsed = parse_alias(alias)
    kind = F.coalesce(parsed["category"], inferred_category(alias))
    first = F.coalesce(parsed["ordinal"] + 1, F.lit(1))
    made = F.transform(F.sequence(first, first + F.size(occupied)), lambda n: F.concat(F.lit("["), kind, F.lit("_"), n.cast("string"), F.lit("]")))
    return F.get(F.filter(made, lambda c: ~F.array_contains(occupied, F.lower(c))), 0)


def collisions(ids: DataFrame, id_column: str, value: str) -> DataFrame:
    """Of distinct pairs of id and value: n_values, n_ids, and n_collisions, the ids that stand for more than one value."""
    by_id = ids.groupBy(id_column).agg(F.countDistinct(value).alias("n"))
    return by_id.agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_ids"), F.sum((F.col("n") > 1).cast("long")).alias("n_collisions"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
