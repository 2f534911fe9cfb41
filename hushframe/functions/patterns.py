r"""The detectors: type, confidence, pattern, captured group, and a cheap test that a text must pass first.

Patterns are written once, in the dialect of the formats they come from (ASCII \b, \d and \w), and turned into Java's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Detector:
    """A pattern; ``needs`` is a pattern or literal without which no match is possible; ``check`` names a value test."""

    name: str
    type: str
    confidence: float
    pattern: str
    group: int = 0
    ignore_case: bool = False
    needs: str = ""
    check: str = ""
    source: str = "regex"
    trim: bool = False


# Detector types, confidences and patterns, in order of precedence among equal spans.
DETECTORS: list[Detector] = [
    Detector("email", "EMAIL", 0.99, r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", ignore_case=True, needs="@"),
    Detector("ip_address", "IP_ADDRESS", 0.95, r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", needs=r"\d\."),
    Detector("ssn", "SSN", 0.98, r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b", needs=r"\d{4}"),
    Detector("credit_card", "CREDIT_CARD", 0.9, r"\b(?:\d[ -]*?){13,19}\b", needs=r"\d[ -]*\d[ -]*\d", check="luhn"),
    Detector("phone_international", "PHONE", 0.94, r"(?<![\dA-Za-z])\+\d{1,3}(?:[\s.-]?\d){8,14}(?!\d)", needs="+"),
    Detector("phone_ten_digits", "PHONE", 0.88, r"\b[6-9]\d{4}[\s.-]?\d{5}\b", needs=r"\d{5}"),
    Detector("phone_general", "PHONE", 0.85, r"(?:\+\d{1,3}[-.\s()]*)?(?:\(?\d{2,5}\)?[-.\s()]*){1,3}\d{4}\b", needs=r"\d{4}", check="phone_digits"),
    Detector("phone_labelled", "PHONE", 0.82, r"\b(?:phone|tel|telephone|mobile)\s*[:=]?\s*(\d{3}[-.]\d{4})\b", 1, True, needs=r"\d{3}[-.]\d{4}"),
    Detector("key_gsk", "API_KEY", 0.93, r"\bgsk_[A-Za-z0-9]{20,}\b", needs="gsk_"),
    Detector("key_live_test", "API_KEY", 0.92, r"\b(?:sk|pk)_(?:live|test)_[A-Za-z0-9_]{8,}\b", needs="k_"),
    Detector("key_api_hex", "API_KEY", 0.9, r"\bapi\s*:?\s*([a-f0-9]{32,64})\b", 1, True, needs=r"[0-9A-Fa-f]{32}"),
    Detector("key_api_key_hex", "API_KEY", 0.88, r"\bapi\s*key\b[^.\n]{0,60}?\b([a-f0-9]{32,64})\b", 1, True, needs=r"[0-9A-Fa-f]{32}"),
    Detector("aws_access_key", "AWS_ACCESS_KEY", 0.95, r"\b(?:AKIA|ASIA|AROA|AIDA|AGPA|ANPA|ANVA|AIPA)[A-Z0-9]{12,20}\b", needs=r"A[A-Z]{3}[A-Z0-9]{12}"),
    Detector("key_vendor", "API_KEY", 0.88, r"\b(?:sk|pk|rk|xox[baprs]-|ghp_|gho_|github_pat_)[A-Za-z0-9_-]{8,}\b", needs=r"[spr]k[A-Za-z0-9_-]{8}|xox|gh[po]_|github_pat_"),
    Detector("key_assigned", "API_KEY", 0.8, r"\b(?:api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?token)[:\s=]+['\"]?([A-Za-z0-9_\-./+=]{12,})['\"]?", 1, True, needs=r"(?i)key|token"),
    Detector("key_generic", "API_KEY", 0.8, r"\b(?:sk|pk|api|key|token|secret)[-_]?[A-Za-z0-9]{16,}\b", needs=r"(?:sk|pk|api|key|token|secret)[-_]?[A-Za-z0-9]{16}"),
    Detector("key_secret_is", "API_KEY", 0.75, r"\bsecret\s+is\s+([A-Za-z0-9_-]{8,})", 1, True, needs=r"(?i)secret"),
    Detector("url_credential", "URL_CREDENTIAL", 0.97, r"(?:https?:\/\/|ftp:\/\/)(?:[^@\/\s]+):([^@\/\s]+)@", 1, needs="://"),
    Detector("url_query_secret", "URL_QUERY_SECRET", 0.95, r"[?&](?:token|access_token|api_key|signature|password|secret|sig|code)=([^&\s\"]{8,})", 1, True, needs="="),
    Detector("connection_user", "CONNECTION_STRING_CREDENTIAL", 0.96, r"\b(?:postgres(?:ql)?|mysql|mongodb|redis|amqp|kafka):\/\/([^:\/\s]+):([^@\/\s]+)@", 1, needs="://"),
    Detector("connection_password", "CONNECTION_STRING_CREDENTIAL", 0.96, r"\b(?:postgres(?:ql)?|mysql|mongodb|redis|amqp|kafka):\/\/(?:[^:\/\s]+):([^@\/\s]+)@", 1, needs="://"),
    Detector("connection_redis", "CONNECTION_STRING_CREDENTIAL", 0.95, r"\bredis:\/\/:([^@\/\s]+)@", 1, needs="redis://"),
    Detector("mrn", "MRN", 0.97, r"\bMRN[-\s]?\d{5,}\b", ignore_case=True, needs=r"(?i)mrn"),
    Detector("medical_patient", "MEDICAL_ID", 0.94, r"\bPatient\s+ID[:\s]+([A-Z0-9]{4,})", 1, True, needs=r"(?i)patient"),
    Detector("medical_member", "MEDICAL_ID", 0.93, r"\b(?:Insurance|Member)\s+ID[:\s]+([A-Z0-9]{4,})", 1, True, needs=r"(?i)insurance|member"),
    Detector("organization_suffix", "ORGANIZATION", 0.72, r"\b([A-Z][A-Za-z0-9&.'-]*(?:[ \t]+[A-Z][A-Za-z0-9&.'-]*){0,4}[ \t]+(?:Inc|LLC|Ltd|Corp|Corporation|Company|Labs|Systems|Bank|Hospital|University))\b", 1, needs=r"Inc|LLC|Ltd|Corp|Company|Labs|Systems|Bank|Hospital|University", source="heuristic"),
    Detector("person_contact", "PERSON", 0.9, r"\bContact[ \t]+([A-Z][A-Za-z'’-]+(?:[ \t]+[A-Z][A-Za-z'’-]+)+)[ \t]+at\b", 1, needs="Contact", source="context", trim=True),
    Detector("person_named", "PERSON", 0.9, r"\b(?:my name is[ \t]+|name['\"]?[ \t]*:[ \t]*['\"]?)([A-Z][A-Za-z'’-]+(?:[ \t]+[A-Z][A-Za-z'’-]+)+?)(?=[,'\".}]|[ \t]+(?:and|my|with|at|from|in)\b|$)", 1, True, needs=r"(?i)name", source="context", trim=True),
    Detector("person_role", "PERSON", 0.85, r"\b(?:patient|customer|employee)[ \t]+([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)+?)(?=[,'\".}]|[ \t]+(?:reported|said|has|is|was)\b|$)", 1, True, needs=r"(?i)patient|customer|employee", source="context", trim=True),
    Detector("organization_named", "ORGANIZATION", 0.86, r"\b(?:company['\"]?[ \t]*:[ \t]*['\"]?|my company is[ \t]+)([A-Z][A-Za-z0-9&.'-]*(?:[ \t]+[A-Z][A-Za-z0-9&.'-]*){0,3}?)(?=[,'\".}]|[ \t]+(?:and|my|with|at)\b|$)", 1, True, needs=r"(?i)company", source="context", trim=True),
    Detector("location_named", "LOCATION", 0.86, r"\b(?:city['\"]?[ \t]*:[ \t]*['\"]|live in[ \t]+|located in[ \t]+)([A-Z][A-Za-z .'-]+?)(?=[,'\".}]|[ \t]+(?:and|my|with|at)\b|$)", 1, True, needs=r"(?i)city|live in|located in", source="context", trim=True),
    Detector("postal_code", "POSTAL_CODE", 0.86, r"\bzip['\"]?\s*:\s*['\"]?(\d{5}(?:-\d{4})?)", 1, True, needs=r"(?i)zip", source="context", trim=True),
    Detector("person_dob", "PERSON", 0.82, r"\b(?:name|DOB)[ \t]*:[ \t]*([A-Z][a-z]+(?:[ \t]+[A-Z][a-z]+)?)\b", 1, needs=r"name|DOB", source="context", trim=True),
    Detector("location_known", "LOCATION", 0.84, r"\b(New York|Berlin|Boston|San Francisco|Seattle|London|Paris|Mumbai|Delhi|Bengaluru|Tokyo)\b", needs=r"New York|Berlin|Boston|San Francisco|Seattle|London|Paris|Mumbai|Delhi|Bengaluru|Tokyo", source="context"),
    Detector("person_bigram", "PERSON", 0.68, r"\b(?:Dr\.?[ \t]+|Prof\.?[ \t]+|Mr\.?[ \t]+|Ms\.?[ \t]+|Mrs\.?[ \t]+)?([A-Z][a-z]+(?:[-'][A-Z][a-z]+)?[ \t]+[A-Z][a-z]+(?:[-'][A-Z][a-z]+)?(?:[ \t]+(?:Jr\.?|Sr\.?|III|IV))?)\b", 1, needs=r"[A-Z][a-z'-]+[ \t]+[A-Z]", check="not_a_term", source="heuristic"),
]

# Protected spans, in the order in which they are looked for.
URL = r"\b(?:https?:\/\/|ftp:\/\/|www\.)[^\s<>\"']+"
CONNECTION_STRING = r"\b(?:postgres(?:ql)?|mysql|mongodb|redis|amqp|kafka|https?):\/\/\S+"
FILE_PATH = r"(?:^|\s)((?:\/[A-Za-z0-9._-]+)+(?:\/[A-Za-z0-9._-]+)?)"
CODE_BLOCK = r"```[\s\S]*?```"
INLINE_CODE = r"`[^`]+`"
# Secrets inside URLs and connection strings.
INNER_CREDENTIAL = r"(?:https?:\/\/|ftp:\/\/)([^:]+):([^@]+)@"
INNER_QUERY_SECRET = r"([?&])(token|access_token|api_key|signature|password|secret|sig)=([^&\s\"]+)"

# First words of capitalised pairs that are no persons.
NO_PERSON = "TypeScript JavaScript GitHub GitLab React Angular Docker Kubernetes Contact Please Return Write Replace Using Running Getting Having Making Going".split()
# Terms that are never redacted. The list is matched as a whole value.
PUBLIC_TERMS = (
    "React Gemini OAuth TypeScript GitHub Kubernetes Terraform Node Python Docker Linux macOS Windows JavaScript HTML CSS PostgreSQL MySQL MongoDB Redis Kafka RabbitMQ "
    "GraphQL REST API SDK CLI JSON XML YAML npm yarn pnpm pip conda git ssh http localhost CORS JWT OIDC SAML LDAP"
).split()

#: White space beyond ASCII that the formats count as such.
_SPACE = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


#: Beginnings of patterns whose first character is a word character, so that only what is before it decides on an edge.
_WORD_FIRST = ("(?:sk", "(?:api", "(?:AKIA", "(?:25", "(?:phone", "(?:postgres", "(?:Insurance", "(?:my", "(?:patient", "(?:company", "(?:city", "(?:name", "(?:Dr", "([A-Z]", "(New", "[6-9]", "\\d", "(?:\\d", "gsk", "api", "secret", "redis", "MRN", "Patient", "Contact", "zip")


def java(pattern: str, ignore_case: bool = False) -> str:
    r"""The pattern for Java: ASCII word edges, all white space in \s, and $ as the very end."""
    out, i, inside = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            if e == "b" and not out and pattern[2:].startswith(_WORD_FIRST):
                out += r"(?<![A-Za-z0-9_])"
            elif e == "b" and not inside:
                out += r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
            elif e == "s":
                out += _SPACE if inside else f"[{_SPACE}]"
            elif e == "S":
                # within a class only [\s\S] occurs, which is any character
                out += r"\S" if inside else f"[^{_SPACE}]"
            elif e == "/":
                out += "/"
            else:
                out += c + e
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]":
            inside = False
        elif c == "$" and not inside:
            c = r"\z"
        elif c == "^" and not inside:
            c = r"\A"
        out += c
        i += 1
    return ("(?i)" if ignore_case else "") + out


def duckdb(pattern: str, ignore_case: bool = False) -> str:
    """The pattern as a quoted literal for DuckDB's engine, which has no look-around."""
    return "'" + (("(?i)" if ignore_case else "") + pattern.replace(r"\/", "/")).replace("'", "''") + "'"


def may_match(text: Column, needs: str) -> Column:
    """Whether a text passes the cheap test of a detector."""
    words = [needs] if needs == "+" else needs.split("|")
    if needs == "+" or not any(c in needs for c in r"\[](){}?*+"):
        return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))
    return text.rlike(java(needs.removeprefix("(?i)"), needs.startswith("(?i)")))
