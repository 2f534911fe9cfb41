"""Queries over texts: detectors, protected spans, redaction, session maps, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import identity as I, patterns as P
from ..functions.spans import find_spans
from ..functions.text import estimated_tokens, is_vague, looks_like_secret, luhn, secret_type, stand_in
from ..operators import privacy as V, sessions as M
from .registry import Tables, query

#: Detectors whose patterns have no look-around, which DuckDB can run.
PLAIN = [d for d in P.DETECTORS if "(?=" not in d.pattern and "(?<" not in d.pattern and "(?!" not in d.pattern]


def _values(d: P.Detector) -> str:
    value = f"unnest(regexp_extract_all(text, {P.duckdb(d.pattern, d.ignore_case)}, {d.group}))"
    return f"SELECT doc_id, '{d.name}' AS detector, v AS value FROM (SELECT doc_id, {value} AS v FROM documents) WHERE v <> ''"


def _unchecked(t: Tables, detectors: list[P.Detector]) -> DataFrame:
    text = F.col("text")

    def of(d: P.Detector) -> Column:
        spans = find_spans(text, P.java(d.pattern, d.ignore_case), d.group)
        named = F.transform(spans, lambda s: F.struct(F.lit(d.name).alias("detector"), s["value"].alias("value")))
        return F.when(P.may_match(text, d.needs), named).otherwise(F.array().cast("array<struct<detector:string,value:string>>"))

    found = F.concat(*map(of, detectors))
    return t.documents.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.detector", "x.value")


@query("detector_values", " UNION ALL ".join(map(_values, PLAIN)))
def detector_values(t: Tables) -> DataFrame:
    """Every match of every detector pattern, before value tests."""
    return _unchecked(t, PLAIN)


_WORD_EDGE = "(^|[^0-9A-Za-z])"


# No text of the tables holds such a number: two are added to each, of which some are too short.
_CALLS_SQL = "text || ' call +' || (doc_id % 998 + 1) || ' ' || (doc_id * 7919 + 5000000) || ' or +' || (doc_id % 98 + 1) || '.20-' || (doc_id % 9000 + 1000) || ' ' || (doc_id % 900 + 100)"


@query(
    "detector_phone_international",
    rf"""SELECT doc_id, v[-1:] <> '' AS held, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORD_EDGE}(\+\d{{1,3}}(?:[\s.-]?\d){{8,14}})', 2)) AS v FROM (SELECT doc_id, {_CALLS_SQL} AS text FROM documents)) GROUP BY ALL""",
)
def detector_phone_international(t: Tables) -> DataFrame:
    """International phone numbers by document, with two candidates of its own added to each text."""
    d = next(d for d in P.DETECTORS if d.name == "phone_international")
    found = t.documents.select("doc_id", F.explode(V.detector_spans(F.expr(_CALLS_SQL), d)).alias("x"))
    return found.groupBy("doc_id").agg(F.lit(True).alias("held"), F.count(F.lit(1)).alias("n")).select("doc_id", "held", "n")


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_CARDS = next(d for d in P.DETECTORS if d.check == "luhn")


@query(
    "luhn_check",
    f"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, {P.duckdb(_CARDS.pattern)})) AS v FROM documents), d AS (SELECT doc_id, v, {_DIGITS} AS s FROM c),
    e AS (SELECT doc_id, v, s, list_sum(list_transform(range(length(s)), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(s[length(s) - i] AS INT) > 4 THEN CAST(s[length(s) - i] AS INT) * 2 - 9 ELSE CAST(s[length(s) - i] AS INT) * 2 END ELSE CAST(s[length(s) - i] AS INT) END)) AS total FROM d)
    SELECT doc_id, v AS value, length(s) BETWEEN 13 AND 19 AND length(replace(s, s[1], '')) > 0 AND total % 10 = 0 AS valid FROM e""",
)
def luhn_check(t: Tables) -> DataFrame:
    """Card-shaped values and whether they pass the digit test."""
    found = t.documents.select("doc_id", F.explode(find_spans(F.col("text"), P.java(_CARDS.pattern))).alias("x"))
    return found.select("doc_id", F.col("x.value").alias("value"), luhn(F.col("x.value")).alias("valid"))


@query("detect_merged")
def detect_merged(t: Tables) -> DataFrame:
    """Detections of all documents after overlaps are settled."""
    found = t.documents.select("doc_id", F.posexplode(V.detections(F.col("text"))).alias("nth", "x"))
    return found.select("doc_id", "nth", "x.*")


@query("detect_types")
def detect_types(t: Tables) -> DataFrame:
    """Settled detections by language and type."""
    found = t.documents.select("lang", F.explode(V.detections(F.col("text"))).alias("x"))
    return found.groupBy("lang", F.col("x.type").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.avg("x.confidence").alias("confidence"))


@query(
    "protected_urls",
    f"SELECT page_id, v AS value, strlen(v) AS bytes FROM (SELECT page_id, unnest(regexp_extract_all(html, {P.duckdb(P.URL, True)})) AS v FROM pages)",
)
def protected_urls(t: Tables) -> DataFrame:
    """URLs in pages."""
    found = t.pages.select("page_id", F.explode(find_spans(F.col("html"), P.java(P.URL, True))).alias("x"))
    return found.select("page_id", F.col("x.value").alias("value"), F.octet_length("x.value").cast("long").alias("bytes"))


@query("protected_spans")
def protected_spans(t: Tables) -> DataFrame:
    """Protected spans of pages, by start."""
    found = t.pages.select("page_id", F.posexplode(V.protected_spans(F.col("html"))).alias("nth", "x"))
    return found.select("page_id", "nth", "x.*")


@query("policy_actions")
def policy_actions(t: Tables) -> DataFrame:
    """Detections with the action that the default policy takes."""
    rows = t.documents.select("doc_id", V.detections(F.col("text")).alias("d"), V.protected_spans(F.col("text")).alias("p"))
    found = rows.select("doc_id", F.explode(V.classified(F.col("d"), F.col("p"))).alias("x"))
    return found.select("doc_id", "x.type", "x.value", "x.start", "x.end", "x.action")


@query("sanitize")
def sanitize(t: Tables) -> DataFrame:
    """The flagship: every document rewritten, with its session map."""
    done = V.sanitize(t.documents)
    return done.select("doc_id", "sanitized", F.size("plan").alias("n_replacements"), F.to_json("session").alias("session"))


_EMAIL = P.DETECTORS[0]
_EMAILS_SQL = f"len(list_distinct(list_transform(regexp_extract_all(text, {P.duckdb(_EMAIL.pattern, True)}), lambda e: lower(e))))::INT AS n_emails"


def _emails(plan: str) -> Column:
    """How many different addresses a plan replaces."""
    return F.size(F.array_distinct(F.transform(F.filter(plan, lambda r: r["type"] == "EMAIL"), lambda r: F.lower(r["original"])))).alias("n_emails")


@query("sanitize_round_trip", f"SELECT doc_id, text AS restored, 0 AS n_left, {_EMAILS_SQL} FROM documents")
def sanitize_round_trip(t: Tables) -> DataFrame:
    """Sanitised and restored documents, the addresses that were replaced, and those that the sanitised text still holds."""
    done = V.sanitize(t.documents)
    left = F.size(F.filter("plan", lambda r: (r["type"] == "EMAIL") & F.contains(F.col("sanitized"), r["original"])))
    return done.select("doc_id", V.restore(F.col("sanitized"), F.col("session")).alias("restored"), left.alias("n_left"), _emails("plan"))


@query("sanitize_strict_round_trip", f"SELECT doc_id, lower(text) AS restored, 0 AS n_leaks, {_EMAILS_SQL} FROM documents")
def sanitize_strict_round_trip(t: Tables) -> DataFrame:
    """Strictly sanitised documents: restored text (in lower case, as one original stands for all its spellings), the originals
    that the whole sanitised text still holds, whatever their case, and the addresses that were replaced."""
    done = V.sanitize(t.documents, strict=True, threshold=0.85)
    left = F.size(V.leaks(F.col("sanitized"), F.col("session")))
    return done.select("doc_id", F.lower(V.restore(F.col("sanitized"), F.col("session"))).alias("restored"), left.alias("n_leaks"), _emails("plan"))


@query(
    "redact_emails",
    f"SELECT doc_id, regexp_replace(text, {P.duckdb(_EMAIL.pattern, True)}, '[EMAIL]', 'g') AS redacted, len(regexp_extract_all(text, {P.duckdb(_EMAIL.pattern, True)})) AS n FROM documents",
)
def redact_emails(t: Tables) -> DataFrame:
    """Addresses spliced out by their offsets."""
    spans = F.transform(find_spans(F.col("text"), P.java(_EMAIL.pattern, True)), lambda s: s.withField("replacement", F.lit("[EMAIL]")))
    from ..functions.spans import splice

    rows = t.documents.select("doc_id", "text", spans.alias("s"))
    return rows.select("doc_id", splice(F.col("text"), F.col("s")).alias("redacted"), F.size("s").cast("long").alias("n"))


_STAND_IN_SQL = """CASE type WHEN 'EMAIL' THEN 'contact' || n || '@example.com' WHEN 'PHONE' THEN '+1 (555) 010-' || lpad(n::VARCHAR, 4, '0') WHEN 'IP_ADDRESS' THEN '10.0.0.' || n
    WHEN 'SSN' THEN '000-00-' || (1000 + n) WHEN 'CREDIT_CARD' THEN '4111 1111 1111 ' || (1000 + n) WHEN 'API_KEY' THEN 'gsk_dummy_' || n || '_redacted'
    WHEN 'AWS_ACCESS_KEY' THEN 'AKIADUMMY' || lpad(n::VARCHAR, 8, '0') || 'KEY' WHEN 'POSTAL_CODE' THEN 'ZIP-' || (10000 + n) WHEN 'MRN' THEN 'MRN-' || (10000 + n)
    WHEN 'PERSON' THEN coalesce((['Alex Morgan', 'Jordan Lee', 'Sam Rivera', 'Taylor Brooks', 'Casey Nguyen', 'Riley Patel', 'Morgan Chen', 'Avery Scott'])[n], 'Person ' || n)
    ELSE 'SensitiveValue' || n END"""
_KINDS = ["EMAIL", "PHONE", "IP_ADDRESS", "SSN", "CREDIT_CARD", "API_KEY", "AWS_ACCESS_KEY", "POSTAL_CODE", "MRN", "PERSON", "OTHER"]


@query(
    "stand_ins",
    f"SELECT event_id, type, {_STAND_IN_SQL} AS value FROM (SELECT event_id, CAST(event_id % 500 + 1 AS INT) AS n, ({_KINDS!r})[CAST(event_id % {len(_KINDS)} + 1 AS INT)] AS type FROM events)",
)
def stand_ins(t: Tables) -> DataFrame:
    """Stand-in values of all types."""
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % len(_KINDS)).cast("int"))
    rows = t.events.select("event_id", kind.alias("type"), (F.col("event_id") % 500 + 1).cast("int").alias("n"))
    return rows.select("event_id", "type", stand_in(F.col("type"), F.col("n")).alias("value"))


_WORDS = r"[0-9A-Za-z@._+-]{8,}"


@query(
    "secret_types",
    rf"""SELECT doc_id, v AS value, CASE WHEN regexp_matches(v, {P.duckdb(_EMAIL.pattern, True)}) THEN 'EMAIL' WHEN regexp_matches(v, '^\s*\+?\d[\d\s().-]{{7,}}\d\s*$') THEN 'PHONE' WHEN regexp_matches(v, '(?i)\bMRN[-\s]?\d{{5,}}\b') THEN 'MRN'
    WHEN regexp_matches(v, '\bgsk_[A-Za-z0-9]{{8,}}\b') OR regexp_matches(v, '\b(?:sk|pk)_(?:live|test)_[A-Za-z0-9_]{{8,}}\b') THEN 'API_KEY' WHEN regexp_matches(v, '\b(?:AKIA|ASIA)[A-Z0-9]{{12,20}}\b') THEN 'AWS_ACCESS_KEY'
    WHEN regexp_matches(v, '(?i)\b[a-f0-9]{{32,64}}\b') THEN 'API_KEY' ELSE 'PRIVATE_IDENTIFIER' END AS type,
    regexp_matches(v, '(?i)[0-9a-f]{{16,}}') OR regexp_matches(v, '^(?:gsk_|sk_|pk_|AKIA)') OR regexp_matches(v, {P.duckdb(_EMAIL.pattern, True)}) AS secret, false AS vague
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_WORDS}')) AS v FROM documents)""",
)
def secret_types(t: Tables) -> DataFrame:
    """What long words look like."""
    v = F.col("value")
    words = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))).alias("value"))
    return words.select("doc_id", "value", secret_type(v).alias("type"), looks_like_secret(v).alias("secret"), is_vague(v).alias("vague"))


@query(
    "token_estimates",
    r"""SELECT doc_id, greatest(1, CAST(list_sum(list_transform(regexp_extract_all(text, '\s+|[A-Za-z]+|[0-9]+|[^\x00-\x7F]|[^A-Za-z0-9\s]'), lambda x:
    CASE WHEN regexp_matches(x, '^\s') THEN ceil(length(x) / 4.0) WHEN regexp_matches(x, '^[A-Za-z]') THEN ceil(length(x) / 3.0) WHEN regexp_matches(x, '^[0-9]') THEN ceil(length(x) / 2.0)
    WHEN regexp_matches(x, '^[^\x00-\x7F]') THEN 2 ELSE 1 END)) AS BIGINT)) * (text <> '')::BIGINT AS tokens FROM documents""",
)
def token_estimates(t: Tables) -> DataFrame:
    """Estimated tokens of every document."""
    return t.documents.select("doc_id", estimated_tokens(F.col("text")).alias("tokens"))


# ---- identities

#: A key for the queries; applications bring their own.
KEY = bytes(range(32))


def _sql_hmac(message: str) -> str:
    inner, outer = (bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || ({message}))))"


def _sql_derive(domain: str, serialized: str) -> str:
    head = I.Identity(KEY).prefix + len(domain).to_bytes(4, "big") + domain.encode()
    return _sql_hmac(f"unhex('{head.hex()}') || unhex(lpad(to_hex(strlen({serialized})), 8, '0')) || encode({serialized})")


_SCOPE = f"'o2:s2:ids{len(I.Identity(KEY).key_id)}:{I.Identity(KEY).key_id}s4:kinds12:installation'"
_PVI = "'o4:s13:normalizations3:nfcs5:scope' || " + _SCOPE + " || 's5:values' || strlen(v) || ':' || v || 's7:versiond1'"
_PHI = "'o5:s8:categorys' || strlen(c) || ':' || c || 's6:domains4:texts16:protectedValueIds' || strlen(pvi) || ':' || pvi || 's5:scope' || " + _SCOPE + " || 's7:versiond1'"


@query(
    "identities",
    f"""WITH a AS (SELECT DISTINCT source AS v, 'SOURCE' AS c FROM documents UNION SELECT DISTINCT role, 'ROLE' FROM conversations UNION SELECT url, 'URL' FROM pages),
    b AS (SELECT v, c, 'pvi1:' || {_sql_derive('protected-value', _PVI)} AS pvi FROM a), d AS (SELECT v, c, pvi, {_sql_derive('placeholder', _PHI)} AS p FROM b)
    SELECT v AS value, c AS category, pvi AS value_id, 'phi1:' || p AS placeholder_id, '[PAI1_' || c || '_' || upper(p[:24]) || ']' AS alias FROM d""",
)
def identities(t: Tables) -> DataFrame:
    """Keyed ids and aliases of distinct values."""
    one = lambda df, c, kind: df.select(F.col(c).alias("value"), F.lit(kind).alias("category"))
    rows = one(t.documents, "source", "SOURCE").union(one(t.conversations, "role", "ROLE")).union(one(t.pages, "url", "URL")).distinct()
    who = I.Identity(KEY)
    v, c = F.col("value"), F.col("category")
    return rows.select("value", "category", who.protected_value(v).alias("value_id"), who.placeholder(v, c).alias("placeholder_id"), who.alias(v, c).alias("alias"))


@query(
    "identity_collisions",
    f"""WITH a AS (SELECT DISTINCT url AS v FROM pages), b AS (SELECT v, substr({_sql_derive('protected-value', _PVI)}, 1, 2) AS id FROM a), g AS (SELECT id, count(*) AS n FROM b GROUP BY ALL)
    SELECT sum(n)::BIGINT AS n_values, count(*) AS n_ids, count(*) FILTER (n > 1) AS n_collisions FROM g""",
)
def identity_collisions(t: Tables) -> DataFrame:
    """Ids cut to two digits, so that some stand for more than one value."""
    rows = t.pages.select(F.col("url").alias("value"), I.Identity(KEY).protected_value(F.col("url")).alias("id")).distinct()
    return I.collisions(rows.withColumn("id", F.substring("id", 6, 2)), "id", "value")


_ALIASES = ["[PAI1_EMAIL_ECBB0E783762732B0EA17ECF]", "[PERSON_12]", "[person_0]", "[PAI1_EMAIL_12]", "api key", "x", "[Phone_7]", "user@example", "555 call", "[A__B_3]"]


@query(
    "alias_grammar",
    rf"""WITH a AS (SELECT event_id, ({_ALIASES!r})[CAST(event_id % {len(_ALIASES)} + 1 AS INT)] AS alias FROM events),
    b AS (SELECT event_id, alias, regexp_full_match(alias, '{I.CANONICAL}') AS canonical, regexp_full_match(alias, '{I.LEGACY}') AND CAST(coalesce(nullif(regexp_extract(alias, '{I.LEGACY}', 2), ''), '0') AS BIGINT) > 0 AS legacy FROM a)
    SELECT event_id, alias, CASE WHEN canonical THEN 'canonical' WHEN legacy THEN 'legacy' END AS format,
    CASE WHEN canonical THEN regexp_extract(alias, '{I.CANONICAL}', 1) WHEN legacy THEN trim(regexp_replace(upper(regexp_extract(alias, '{I.LEGACY}', 1)), '[^A-Z0-9_]+', '_', 'g'), '_') END AS category,
    regexp_matches(alias, '(?i)^\[PAI[0-9]*_') AND NOT canonical AS malformed,
    CASE WHEN regexp_matches(alias, '(?i)api|key|token|secret|credential') THEN 'API_KEY' WHEN regexp_matches(alias, '(?i)email|@') THEN 'EMAIL' WHEN regexp_matches(alias, '(?i)phone|555') THEN 'PHONE' ELSE 'PRIVATE_VALUE' END AS hint FROM b""",
)
def alias_grammar(t: Tables) -> DataFrame:
    """How aliases parse."""
    rows = t.events.select("event_id", F.get(F.array(*map(F.lit, _ALIASES)), (F.col("event_id") % len(_ALIASES)).cast("int")).alias("alias"))
    parsed = I.parse_alias(F.col("alias"))
    return rows.select("event_id", "alias", parsed["format"].alias("format"), parsed["category"].alias("category"), I.is_malformed_alias(F.col("alias")).alias("malformed"), I.inferred_category(F.col("alias")).alias("hint"))


# ---- session maps, from the long words of conversations

_LONG = "[A-Za-z]{9,}"
_ENTRIES_SQL = f"""words AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{_LONG}')) AS w, generate_subscripts(regexp_extract_all(text, '{_LONG}'), 1) AS i FROM conversations),
    firsts AS (SELECT conv_id, w AS original, min(turn * 100000 + i) AS place FROM words GROUP BY ALL),
    entries AS (SELECT conv_id, '[PRIVATE_VALUE_' || row_number() OVER (PARTITION BY conv_id ORDER BY place, original) || ']' AS placeholder, original, row_number() OVER (PARTITION BY conv_id ORDER BY place, original) AS ord FROM firsts)"""


def entries(t: Tables) -> DataFrame:
    """Session entries: conv_id, ord, placeholder, original; numbered by first occurrence in the conversation."""
    words = t.conversations.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(_LONG), F.lit(0))).alias("i", "original"))
    firsts = words.groupBy("conv_id", "original").agg(F.min(F.col("turn") * 100000 + F.col("i") + 1).alias("at"))
    ordered = Window.partitionBy("conv_id").orderBy("at", "original")
    numbered = firsts.withColumn("ord", F.row_number().over(ordered))
    return numbered.select("conv_id", "ord", F.concat(F.lit("[PRIVATE_VALUE_"), F.col("ord").cast("string"), F.lit("]")).alias("placeholder"), "original")


@query("session_entries", f"WITH {_ENTRIES_SQL} SELECT conv_id, CAST(ord AS INT) AS ord, placeholder, original FROM entries")
def session_entries(t: Tables) -> DataFrame:
    """Placeholders of conversations in order of first occurrence."""
    return entries(t)


@query(
    "session_canonical",
    f"WITH {_ENTRIES_SQL} SELECT conv_id, lower(original) AS folded, arg_min(placeholder, ord) AS placeholder, arg_min(original, ord) AS original, count(*) AS aliases FROM entries GROUP BY ALL",
)
def session_canonical(t: Tables) -> DataFrame:
    """The first alias of each value, whatever its case."""
    rows = entries(t)
    first = lambda c: F.min_by(c, "ord").alias(c)
    return rows.groupBy("conv_id", F.lower("original").alias("folded")).agg(first("placeholder"), first("original"), F.count(F.lit(1)).alias("aliases"))


@query(
    "session_merge",
    f"""WITH {_ENTRIES_SQL}, a AS (SELECT conv_id % 20 AS thread, placeholder, original FROM entries WHERE conv_id % 40 < 20), b AS (SELECT conv_id % 20 AS thread, placeholder, original FROM entries WHERE conv_id % 40 >= 20),
    u AS (SELECT * FROM a UNION SELECT * FROM b) SELECT thread, placeholder, count(DISTINCT original) AS originals, min(original) AS original, CASE WHEN count(DISTINCT original) > 1 THEN 'AMBIGUOUS_SESSION_MAP' END AS error_code FROM u GROUP BY ALL""",
)
def session_merge(t: Tables) -> DataFrame:
    """Union of session maps; a placeholder with two originals is an error."""
    rows = entries(t).select((F.col("conv_id") % 20).alias("thread"), "placeholder", "original").distinct()
    merged = rows.groupBy("thread", "placeholder").agg(F.countDistinct("original").alias("originals"), F.min("original").alias("original"))
    return merged.withColumn("error_code", F.when(F.col("originals") > 1, "AMBIGUOUS_SESSION_MAP"))


@query(
    "session_three_way_merge",
    f"""WITH {_ENTRIES_SQL}, base AS (SELECT conv_id, placeholder p, original o FROM entries WHERE ord % 3 <> 0), cur AS (SELECT conv_id, placeholder p, CASE WHEN ord % 11 = 5 THEN original || '!' ELSE original END o FROM entries WHERE ord % 5 <> 0), inc AS (SELECT conv_id, placeholder p, CASE WHEN ord % 7 = 0 THEN original || '?' ELSE original END o FROM entries WHERE ord % 2 = 0),
    k AS (SELECT conv_id, p FROM base UNION SELECT conv_id, p FROM cur UNION SELECT conv_id, p FROM inc),
    j AS (SELECT k.conv_id, k.p, base.o AS b, cur.o AS c, inc.o AS i FROM k LEFT JOIN base USING (conv_id, p) LEFT JOIN cur USING (conv_id, p) LEFT JOIN inc USING (conv_id, p))
    SELECT conv_id, p AS placeholder, CASE WHEN b IS NOT NULL THEN CASE WHEN i IS NULL AND c = b THEN NULL ELSE c END ELSE coalesce(c, i) END AS original,
    coalesce(CASE WHEN b IS NOT NULL AND i IS NOT NULL THEN i <> b WHEN b IS NOT NULL THEN c <> b ELSE c <> i END, false) AS collision FROM j""",
)
def session_three_way_merge(t: Tables) -> DataFrame:
    """Base, current and incoming maps: an entry that incoming drops goes, new ones come, other changes collide."""
    rows = entries(t)
    side = lambda keep, value, name: rows.where(keep).select("conv_id", "placeholder", value.alias(name))
    o, n = F.col("original"), F.col("ord")
    base = side(n % 3 != 0, o, "b")
    current = side(n % 5 != 0, F.when(n % 11 == 5, F.concat(o, F.lit("!"))).otherwise(o), "c")
    incoming = side(n % 2 == 0, F.when(n % 7 == 0, F.concat(o, F.lit("?"))).otherwise(o), "i")
    all_three = base.join(current, ["conv_id", "placeholder"], "full").join(incoming, ["conv_id", "placeholder"], "full")
    b, c, i = F.col("b"), F.col("c"), F.col("i")
    kept = F.when(b.isNotNull(), F.when(i.isNull() & (c == b), None).otherwise(c)).otherwise(F.coalesce(c, i))
    clash = F.when(b.isNotNull() & i.isNotNull(), i != b).when(b.isNotNull(), c != b).otherwise(c != i)
    return all_three.select("conv_id", "placeholder", kept.alias("original"), F.coalesce(clash, F.lit(False)).alias("collision"))


@query(
    "session_normalize",
    f"""WITH {_ENTRIES_SQL}, f AS (SELECT conv_id, lower(original) AS k, count(DISTINCT original) AS spellings FROM entries GROUP BY ALL)
    SELECT conv_id, count(*) AS n_values, sum(spellings)::BIGINT AS n_entries, count(*) FILTER (spellings > 1) AS n_folded FROM f GROUP BY ALL""",
)
def session_normalize(t: Tables) -> DataFrame:
    """Values of a session and those that differ in case only."""
    folded = entries(t).groupBy("conv_id", F.lower("original").alias("k")).agg(F.countDistinct("original").alias("spellings"))
    return folded.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_values"), F.sum("spellings").alias("n_entries"), F.sum((F.col("spellings") > 1).cast("long")).alias("n_folded"))


@query(
    "session_inheritance",
    f"""WITH {_ENTRIES_SQL}, p AS (SELECT DISTINCT conv_id, conv_id - 1 AS parent FROM entries WHERE conv_id % 3 = 1)
    SELECT p.conv_id, count(*) AS inherited, count(DISTINCT lower(e.original)) AS values FROM p JOIN entries e ON e.conv_id = p.parent WHERE NOT EXISTS (SELECT 1 FROM entries o WHERE o.conv_id = p.conv_id AND o.original = e.original) GROUP BY ALL""",
)
def session_inheritance(t: Tables) -> DataFrame:
    """Entries of the parent that a fork does not have."""
    rows = entries(t)
    forks = rows.where("conv_id % 3 = 1").select("conv_id", (F.col("conv_id") - 1).alias("parent")).distinct()
    theirs = rows.select(F.col("conv_id").alias("parent"), "original")
    new = forks.join(theirs, "parent").join(rows.select("conv_id", "original"), ["conv_id", "original"], "left_anti")
    return new.groupBy("conv_id").agg(F.count(F.lit(1)).alias("inherited"), F.countDistinct(F.lower("original")).alias("values"))


def _beside(t: Tables) -> DataFrame:
    """Turns with what the session of their conversation knows of them."""
    return M.beside_session(t.conversations, entries(t), "conv_id", "text")


@query(
    "session_round_trip",
    f"""WITH {_ENTRIES_SQL}, h AS (SELECT c.conv_id, c.turn, count(*) AS n FROM conversations c JOIN entries e ON c.conv_id = e.conv_id AND contains(lower(c.text), lower(e.original)) GROUP BY ALL)
    SELECT conv_id, turn, text AS restored, 0 AS n_leaks, coalesce(n, 0)::INT AS n_held FROM conversations LEFT JOIN h USING (conv_id, turn)""",
)
def session_round_trip(t: Tables) -> DataFrame:
    """Known values put out of turns and back in; what is left of them in between, whatever its case."""
    safe, held = F.col("sanitized"), F.col("held")
    return _beside(t).select("conv_id", "turn", V.restore(safe, held).alias("restored"), F.size(V.leaks(safe, held)).alias("n_leaks"), F.size(held).alias("n_held"))


@query(
    "session_relevant",
    f"WITH {_ENTRIES_SQL} SELECT c.conv_id, c.turn, e.placeholder, e.original FROM conversations c JOIN entries e ON c.conv_id = e.conv_id AND contains(lower(c.text), lower(e.original))",
)
def session_relevant(t: Tables) -> DataFrame:
    """Entries of a session that a turn holds, whatever their case."""
    return _beside(t).select("conv_id", "turn", F.explode("held").alias("e")).select("conv_id", "turn", "e.placeholder", "e.original")


@query(
    "session_leaks",
    f"WITH {_ENTRIES_SQL} SELECT c.conv_id, c.turn, count(DISTINCT e.original) AS leak_count FROM conversations c JOIN entries e ON c.conv_id = e.conv_id AND contains(lower(c.text), lower(e.original)) GROUP BY ALL",
)
def session_leaks(t: Tables) -> DataFrame:
    """Protected originals that unsanitised turns hold."""
    return _beside(t).where(F.size("held") > 0).select("conv_id", "turn", F.size(F.array_distinct(F.transform("held", lambda e: e["original"]))).cast("long").alias("leak_count"))


@query(
    "session_detections",
    f"""WITH {_ENTRIES_SQL}, m AS (SELECT c.conv_id, c.turn, e.original, len(regexp_split_to_array(lower(c.text), lower(e.original))) - 1 AS n FROM conversations c JOIN entries e ON c.conv_id = e.conv_id) SELECT conv_id, turn, original, n FROM m WHERE n > 0""",
)
def session_detections(t: Tables) -> DataFrame:
    """How often turns hold the values of their session, whatever their case."""
    return _beside(t).select("conv_id", "turn", F.explode("held").alias("e")).select("conv_id", "turn", "e.original", F.col("e.n").cast("long").alias("n"))


@query(
    "session_orientation",
    f"""WITH {_ENTRIES_SQL}, s AS (SELECT conv_id, CASE WHEN ord % 4 = 0 THEN original ELSE placeholder END AS k, CASE WHEN ord % 4 = 0 THEN placeholder ELSE original END AS v, ord FROM entries), t AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS a FROM conversations GROUP BY ALL)
    SELECT s.conv_id, CASE WHEN contains(t.a, lower(v)) THEN k ELSE v END AS placeholder, CASE WHEN contains(t.a, lower(v)) THEN v ELSE k END AS original FROM s JOIN t USING (conv_id) WHERE contains(t.a, lower(v)) OR contains(t.a, lower(k))""",
)
def session_orientation(t: Tables) -> DataFrame:
    """Entries that came the wrong way round are turned by what the original text holds."""
    swap = F.col("ord") % 4 == 0
    rows = entries(t).select("conv_id", "ord", F.when(swap, F.col("original")).otherwise(F.col("placeholder")).alias("k"), F.when(swap, F.col("placeholder")).otherwise(F.col("original")).alias("v"))
    rows = rows.withColumn("ord", F.col("ord") * 2)
    sides = [rows.select("conv_id", (F.col("ord") + i).alias("ord"), F.lit("[SIDE]").alias("placeholder"), F.col(c).alias("original")) for i, c in enumerate("vk")]
    held = M.beside_session(t.conversations.select("conv_id", "text"), sides[0].unionByName(sides[1]), "conv_id", "text")
    held = held.select("conv_id", F.explode("held.ord").alias("side")).groupBy("conv_id", (F.col("side") - F.col("side") % 2).alias("ord")).agg(F.bool_or(F.col("side") % 2 == 0).alias("by_v"))
    pick = lambda a, b: F.when(F.col("by_v"), F.col(a)).otherwise(F.col(b))
    return rows.join(held, ["conv_id", "ord"]).select("conv_id", pick("k", "v").alias("placeholder"), pick("v", "k").alias("original"))


@query(
    "session_valid_entries",
    f"WITH {_ENTRIES_SQL} SELECT e.conv_id, t.turn, e.placeholder, contains(lower(t.text), lower(e.original)) AND length(e.original) <= 512 AND NOT (length(e.original) > 80 AND length(e.original) > length(t.text) * 0.35) AS valid FROM entries e JOIN conversations t USING (conv_id)",
)
def session_valid_entries(t: Tables) -> DataFrame:
    """Every entry of a session beside every turn, and whether the turn supports it: held by it, on one line, not too long."""
    o, x = F.col("original"), F.col("text")
    valid = (F.col("at") > 0) & ~o.rlike("[\\r\\n]") & (F.length(o) <= 512) & ~((F.length(o) > 80) & (F.length(o) > F.length(x) * 0.35))
    return M.beside_every_entry(t.conversations, entries(t), "conv_id", "text").select("conv_id", "turn", "placeholder", valid.alias("valid"))


@query(
    "session_casing",
    f"WITH {_ENTRIES_SQL} SELECT e.conv_id, t.turn, e.placeholder, CASE WHEN instr(lower(t.text), lower(e.original)) > 0 THEN substr(t.text, instr(lower(t.text), lower(e.original)), length(e.original)) ELSE upper(e.original) END AS original FROM entries e JOIN conversations t USING (conv_id)",
)
def session_casing(t: Tables) -> DataFrame:
    """Every original of a session as every turn first spells it; in upper case where the turn does not hold it."""
    spelled = F.when(F.col("at") > 0, F.substring(F.col("text"), F.col("at"), F.length("original"))).otherwise(F.upper("original"))
    return M.beside_every_entry(t.conversations, entries(t), "conv_id", "text").select("conv_id", "turn", "placeholder", spelled.alias("original"))


@query(
    "session_fingerprint",
    f"WITH {_ENTRIES_SQL} SELECT conv_id, sha256(string_agg(placeholder || '=' || original, chr(10) ORDER BY placeholder)) AS fingerprint, count(*) AS mapping_count FROM entries GROUP BY ALL",
)
def session_fingerprint(t: Tables) -> DataFrame:
    """Order-free fingerprint of a session map: equal maps have equal ones."""
    rows = entries(t).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("placeholder", "original"))).alias("m"))
    line = F.array_join(F.transform("m", lambda e: F.concat(e["placeholder"], F.lit("="), e["original"])), "\n")
    return rows.select("conv_id", F.sha2(line, 256).alias("fingerprint"), F.size("m").cast("long").alias("mapping_count"))


@query(
    "unresolved_placeholders",
    r"SELECT event_id, list_distinct(regexp_extract_all('to [EMAIL_' || event_id % 7 || '] or contact' || event_id % 5 || '@example.com, [EMAIL_' || event_id % 7 || ']', '(?i)\[[A-Z][A-Z0-9_]*_[0-9]+\]|contact[0-9]+@example\.com')).list_sort().array_to_string('|') AS found FROM events",
)
def unresolved_placeholders(t: Tables) -> DataFrame:
    """Distinct placeholders that texts still hold."""
    n = lambda k: (F.col("event_id") % k).cast("string")
    text = F.concat(F.lit("to [EMAIL_"), n(7), F.lit("] or contact"), n(5), F.lit("@example.com, [EMAIL_"), n(7), F.lit("]"))
    return t.events.select("event_id", F.array_join(F.array_sort(V.unresolved(text)), "|").alias("found"))




# ---- rules of session maps

_SPOILED = """sp AS (SELECT conv_id, ord, CASE WHEN conv_id % 7 = 1 AND ord = 3 THEN '[PAI1_BAD_1]' WHEN conv_id % 7 = 2 AND ord = 2 THEN lower('[PRIVATE_VALUE_1]') ELSE placeholder END AS placeholder,
    CASE WHEN conv_id % 7 = 3 AND ord = 2 THEN '[private_value_1]' WHEN conv_id % 7 = 4 AND ord = 2 THEN '' ELSE original END AS original FROM entries)"""


def _spoiled(t: Tables) -> DataFrame:
    """Session entries of which some break a rule."""
    c, n = F.col("conv_id") % 7, F.col("ord")
    name = F.when((c == 1) & (n == 3), "[PAI1_BAD_1]").when((c == 2) & (n == 2), "[private_value_1]").otherwise(F.col("placeholder"))
    value = F.when((c == 3) & (n == 2), "[private_value_1]").when((c == 4) & (n == 2), "").otherwise(F.col("original"))
    return entries(t).select("conv_id", "ord", name.alias("placeholder"), value.alias("original"))


@query(
    "session_rules",
    f"""WITH {_ENTRIES_SQL}, {_SPOILED}, v AS (SELECT * FROM sp WHERE placeholder <> '' AND original <> '' AND placeholder <> original),
    bad AS (SELECT conv_id, 'INVALID_SESSION_MAP' AS error_code FROM v WHERE lower(placeholder) IN ('__proto__', 'prototype', 'constructor') OR regexp_matches(placeholder, '(?i)^\\[PAI[0-9]*_') AND NOT regexp_full_match(placeholder, '{I.CANONICAL}')),
    amb AS (SELECT conv_id, 'AMBIGUOUS_SESSION_MAP' FROM v GROUP BY conv_id, lower(placeholder) HAVING count(DISTINCT placeholder) > 1 OR count(DISTINCT original) > 1 UNION ALL SELECT a.conv_id, 'AMBIGUOUS_SESSION_MAP' FROM v a JOIN v b ON a.conv_id = b.conv_id AND lower(a.placeholder) = lower(b.original))
    SELECT conv_id, max(error_code) AS error_code FROM (SELECT * FROM bad UNION ALL SELECT * FROM amb) GROUP BY conv_id""",
)
def session_rules(t: Tables) -> DataFrame:
    """Maps that break a rule; some are spoiled on purpose."""
    return M.map_errors(_spoiled(t), "conv_id")


@query(
    "session_inherited",
    f"""WITH {_ENTRIES_SQL}, cur AS (SELECT conv_id, placeholder, original FROM entries WHERE ord % 2 = 0), their AS (SELECT conv_id, ord, CASE WHEN conv_id % 5 = 1 AND ord % 4 = 0 THEN placeholder || 'x' ELSE placeholder END AS placeholder, CASE WHEN conv_id % 5 = 2 AND ord = 2 THEN original || '!' ELSE original END AS original FROM entries),
    j AS (SELECT t.*, c.original AS has FROM their t LEFT JOIN cur c ON c.conv_id = t.conv_id AND c.placeholder = t.placeholder), n AS (SELECT * FROM j WHERE has IS NULL), h AS (SELECT conv_id, original, count(*) AS k FROM cur GROUP BY ALL),
    e AS (SELECT conv_id, 0 AS r FROM j WHERE has <> original UNION ALL SELECT n.conv_id, 1 FROM n LEFT JOIN h ON h.conv_id = n.conv_id AND h.original = n.original GROUP BY n.conv_id, n.original HAVING count(*) + coalesce(any_value(k), 0) > 1)
    SELECT conv_id, CAST(NULL AS VARCHAR) AS placeholder, CASE min(r) WHEN 0 THEN 'PLACEHOLDER_COLLISION' ELSE 'ALIAS_LIMIT' END AS error_code FROM e GROUP BY ALL UNION ALL SELECT conv_id, placeholder, NULL FROM n WHERE conv_id NOT IN (SELECT conv_id FROM e)""",
)
def session_inherited(t: Tables) -> DataFrame:
    """What sessions take over of another map, and where that collides."""
    rows, c, n = entries(t), F.col("conv_id") % 5, F.col("ord")
    name = F.when((c == 1) & (n % 4 == 0), F.concat("placeholder", F.lit("x"))).otherwise(F.col("placeholder"))
    value = F.when((c == 2) & (n == 2), F.concat("original", F.lit("!"))).otherwise(F.col("original"))
    theirs = rows.select("conv_id", "ord", name.alias("placeholder"), value.alias("original"))
    new, errors = M.inherited(rows.where("ord % 2 = 0"), theirs, "conv_id")
    return errors.select("conv_id", F.lit(None).cast("string").alias("placeholder"), "error_code").unionByName(new.select("conv_id", "placeholder", F.lit(None).cast("string").alias("error_code")))


@query(
    "session_rebased",
    f"""WITH {_ENTRIES_SQL}, a AS (SELECT conv_id, ord, '[PRIVATE_VALUE_' || (ord + 1) || ']' AS placeholder, CASE WHEN ord % 2 = 0 THEN original ELSE original || '+' END AS original FROM entries),
    k AS (SELECT conv_id, count(*) AS n FROM entries GROUP BY ALL), f AS (SELECT a.*, e.placeholder AS keeps, k.n FROM a JOIN k USING (conv_id) LEFT JOIN entries e ON e.conv_id = a.conv_id AND e.original = a.original),
    m AS (SELECT *, keeps IS NULL AND ord + 1 <= n AS moves, greatest(n, (SELECT max(ord) + 1 FROM a x WHERE x.conv_id = f.conv_id)) AS top FROM f)
    SELECT conv_id, ord::BIGINT AS ord, placeholder, CASE WHEN keeps IS NOT NULL THEN keeps WHEN moves THEN '[PRIVATE_VALUE_' || (top + count(*) FILTER (moves) OVER (PARTITION BY conv_id ORDER BY ord)) || ']' ELSE placeholder END AS target, keeps IS NULL AS added FROM m""",
)
def session_rebased(t: Tables) -> DataFrame:
    """Additions numbered from one again, fitted among the entries that a session has."""
    rows = entries(t)
    value = F.when(F.col("ord") % 2 == 0, F.col("original")).otherwise(F.concat("original", F.lit("+")))
    new = rows.select("conv_id", "ord", F.concat(F.lit("[PRIVATE_VALUE_"), (F.col("ord") + 1).cast("string"), F.lit("]")).alias("placeholder"), value.alias("original"))
    return M.rebased(new, rows, "conv_id").select("conv_id", "ord", "placeholder", "target", "added")


@query("session_known_text")
def session_known_text(t: Tables) -> DataFrame:
    """Known values put out of all turns, whatever their case; where that is ambiguous, why."""
    rows = t.conversations.withColumn("text", F.when(F.col("turn") % 2 == 0, F.upper("text")).otherwise(F.col("text")))
    return M.beside_session(rows, entries(t), "conv_id", "text").where("session_size > 0").select("conv_id", "turn", "sanitized", "error_code")


@query(
    "model_spans",
    r"""WITH w AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{5,}') AS w FROM documents) SELECT doc_id, CASE WHEN w = '' OR doc_id % 4 = 1 OR doc_id % 4 = 2 THEN NULL ELSE w END AS value, CASE WHEN w = '' OR doc_id % 4 = 1 OR doc_id % 4 = 2 THEN NULL ELSE len(string_split(text, w)) - 1 END AS n FROM w""",
)
def model_spans(t: Tables) -> DataFrame:
    """Replies of a model with a span each (a type that is not allowed, a value that is not there, repeated, fenced), and where the span lies."""
    word, way = F.regexp_extract("text", "[A-Za-z]{5,}", 0), F.col("doc_id") % 4
    kind = F.when(way == 1, "SOMETHING").otherwise("PERSON")
    value = F.when(way == 2, F.concat(word, F.lit(" #nowhere#"))).otherwise(word)
    one = F.concat(F.lit('{"value":"'), value, F.lit('","type":"'), kind, F.lit('"}'))
    reply = F.concat(F.lit('Here it is: {"spans":['), one, F.when(way == 3, F.concat(F.lit(","), one)).otherwise(""), F.lit("]}\n```"))
    spans = M.model_spans(reply, F.col("text"))
    rows = t.documents.select("doc_id", "text", spans.alias("spans"))
    return rows.select("doc_id", F.get("spans", 0)["value"].alias("value"), F.when(F.size("spans") > 0, F.size(M.model_detections(F.col("spans"), F.col("text")))).cast("long").alias("n"))
