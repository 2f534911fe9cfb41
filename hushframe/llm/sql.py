"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str) -> str:
    return f"regexp_extract_all(translate(coalesce({table}.text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


DECONTAMINATE = f"""
WITH b AS (SELECT item_id, {_words('benchmark')} AS words FROM benchmark),
w AS (SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0),
pat AS (SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS p FROM w),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('documents')} AS words FROM documents),
spots AS (SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM pat) WHERE len(words) >= size),
h AS (SELECT rid, i, x.size, item_id FROM (SELECT rid, size, i, array_to_string(words[i:i + size - 1], ' ') AS p FROM spots) x JOIN pat ON pat.size = x.size AND pat.p = x.p),
hit AS (SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS place FROM h) GROUP BY rid),
who AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM h) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(who.n, 0)::BIGINT AS n_items, sha256(coalesce(who.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN who USING (rid)
"""

_FIVE = "('0x' || substr(sha, 5 * g + 1, 5))::INT"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GROUP = " || ".join(f"substr('{_BASE32}', (({_FIVE} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), q AS (SELECT page_id, strlen(body) AS n, upper(sha1(body)) AS sha, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(8), lambda g: {_GROUP}), '') AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q
"""

_LETTERS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_SHARE = "1 + (1000000000::HUGEINT * ({c} + 1)) // ({n} + {v})"
_APART = "(({p}) - ({q})) * (({p}) - ({q})) // ({q})"
DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS} AS words FROM documents),
t AS (SELECT rid, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
langs AS (SELECT lang, sum(c) AS n, count(*) AS v FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN own USING (lang, source) GROUP BY ALL),
given AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c, {_SHARE.format(c='coalesce(o.c, 0)', n='g.n', v='l.v')} AS p, {_SHARE.format(c='k.c', n='l.n', v='l.v')} AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum({_APART.format(p='a.p', q='b.p')}) AS value FROM given a JOIN given b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, {_APART.format(p='p', q='q')} AS value FROM given WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_QUOTED = """["'']?"""
_ASSIGN = f"({_KEYWORDS}){_QUOTED}\\x20*[:=]\\x20*{_QUOTED}([A-Za-z0-9+/_.=-]+)"
# kind, pattern, what a match must be
_KINDS = [
    ("assign", _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]{24,}", "true"),
    ("pem", "-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", "true"),
    ("github", "\\bgh[pousr]_[A-Za-z0-9]{36,}", "true"),
    ("slack", "\\bxox[abprs]-[A-Za-z0-9-]{10,}", "true"),
    ("jwt", "\\beyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", "true"),
]
# a match begins after the pieces and matches before it
_FOUND = " UNION ALL ".join(
    f"SELECT rid, {place} AS place, '{kind}' AS kind, spot, spot + length(m) AS past FROM (SELECT rid, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS spot"
    f" FROM (SELECT rid, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS ps FROM d))) WHERE {test}"
    for place, (kind, pattern, test) in enumerate(_KINDS)
)
_LISTED = "string_agg(kind || ':' || spot::BIGINT || ':' || past::BIGINT, ',' ORDER BY spot, place)"
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), found AS ({_FOUND}),
each AS (SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c, {_LISTED} FILTER (place < 3) AS base, {_LISTED} AS spans FROM found GROUP BY rid)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob FROM d LEFT JOIN each USING (rid)
"""

# crc32 by its table of bytes
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_BYTES = "list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)"
RESAMPLE = f"""
WITH tab AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {_CRC_STEP}) AS v FROM (SELECT unnest(range(256)) AS k))),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('documents')} AS words FROM documents),
b AS (SELECT unnest({_words('benchmark')}) AS word FROM benchmark),
dw AS (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(words) AS word FROM d) GROUP BY ALL),
hashed AS (SELECT word, xor(list_reduce([4294967295::BIGINT] || {_BYTES}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT word FROM dw UNION SELECT word FROM b), tab),
src AS (SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
tgt AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (word) GROUP BY bucket),
alls AS (SELECT (SELECT coalesce(sum(s), 0) FROM src) + 10000 AS s_all, (SELECT coalesce(sum(t), 0) FROM tgt) + 10000 AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * s_all::DOUBLE / ((s + 1)::DOUBLE * t_all::DOUBLE)))::BIGINT AS g FROM src LEFT JOIN tgt USING (bucket), alls),
total AS (SELECT rid, sum(n * g)::BIGINT AS x, sum(n)::BIGINT AS n FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY rid),
weighed AS (SELECT d.rid, doc_id, coalesce(n, 0) AS n_features, coalesce((x - ((x % n) + n) % n) // n, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN total USING (rid)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS fit FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (rid)
"""

ORACLES = {"op4_warc": WARC, "op6_decontaminate": DECONTAMINATE, "op11_divergence": DIVERGENCE, "op12_secrets": SECRETS, "op13_resample": RESAMPLE}
