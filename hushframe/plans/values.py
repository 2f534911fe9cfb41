"""Queries over nested values, edits, streams, files and formats."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import identity as I
from ..functions.known import KnownValues
from ..operators import privacy as V, provenance as E, streams as K, structured as T, values as B
from ..sources import formats as X
from .registry import Tables, query

# ---- JSON


def _nested(t: Tables) -> DataFrame:
    """Turns as nested JSON values: id, body."""
    words = F.slice(F.split("text", " "), 1, 3)
    body = F.struct(F.col("role").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content"), F.struct(words.alias("a/b"), F.col("turn").alias("n")).alias("meta~"))
    return t.conversations.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.to_json(body).alias("body"))


@query(
    "json_strings",
    """WITH c AS (SELECT conv_id || ':' || turn AS id, role, text, string_split(text, ' ')[1:3] AS w FROM conversations)
    SELECT id, '/role' AS path, role AS value FROM c WHERE role IS NOT NULL UNION ALL SELECT id, '/content/0/type', 'text' FROM c UNION ALL SELECT id, '/content/0/text', text FROM c WHERE text IS NOT NULL
    UNION ALL SELECT id, '/meta~0/a~1b/' || (i - 1), w[i] FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM c)""",
)
def json_strings(t: Tables) -> DataFrame:
    """Every string of nested values, with its path."""
    return B.strings(_nested(t), "body", "id")


def long_words(least: int) -> T.Classifier:
    """A stand-in for a model: words of so many letters are private."""

    def classify(text: str) -> tuple[str, list[tuple[str, str]]]:
        found = dict.fromkeys(m.group() for m in re.finditer(f"[A-Za-z]{{{least},}}", text))
        pairs = [(f"[PRIVATE_VALUE_{i}]", v) for i, v in enumerate(found, 1)]
        return KnownValues(pairs)(text)[0] or "", pairs

    return classify


@query("structured_values", "SELECT conv_id || ':' || turn AS id, lower(text) AS restored, 0 AS n_left, regexp_matches(text, '[A-Za-z]{9,}') AS changed FROM conversations WHERE text IS NOT NULL")
def structured_values(t: Tables) -> DataFrame:
    """Nested values through a classifier and back: the text again, private words left in between, and whether any was found."""
    rows = t.conversations.where("text is not null").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.to_json(F.struct(F.array(F.struct("text")).alias("content"), F.col("turn").alias("n"))).alias("body"))
    done, found, _ = T.sanitize_values(rows, "id", "body", long_words(9))
    session = found.groupBy("id").agg(F.collect_list(F.struct("placeholder", "original")).alias("session"))
    safe = F.get_json_object("sanitized", "$.content[0].text")
    back = V.restore(safe, F.coalesce("session", F.array().cast("array<struct<placeholder:string,original:string>>")))
    return done.join(session, "id", "left").select("id", F.lower(back).alias("restored"), F.size(F.regexp_extract_all(safe, F.lit("[A-Za-z]{9,}"), F.lit(0))).alias("n_left"), "changed")


@query(
    "artifact_fan_out",
    """WITH s AS (SELECT doc_id, coalesce(lang, '') AS artifact_type, coalesce(text, '') AS text FROM documents), c AS (SELECT DISTINCT artifact_type, text FROM s WHERE doc_id % 5 = 0)
    SELECT s.artifact_type, count(*) AS slots, count(c.text) AS hits, 0::BIGINT AS n_left, 0::BIGINT AS failed FROM s LEFT JOIN c USING (artifact_type, text) GROUP BY ALL""",
)
def artifact_fan_out(t: Tables) -> DataFrame:
    """Documents through a classifier by distinct content: a run over an earlier snapshot fills the table that a run over all asks first."""
    slots = t.documents.select(F.col("doc_id").cast("string").alias("slot_key"), F.coalesce("lang", F.lit("")).alias("artifact_type"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("value"), (F.col("doc_id") % 5 == 0).alias("early"))
    _, cache, _ = T.fan_out(slots.where("early"), long_words(12))
    out, _, _ = T.fan_out(slots, long_words(12), cache)
    left = F.size(F.regexp_extract_all(F.get_json_object("sanitized", "$.text"), F.lit("[A-Za-z]{12,}"), F.lit(0)))
    return out.groupBy("artifact_type").agg(F.count(F.lit(1)).alias("slots"), F.sum(F.col("hit").cast("long")).alias("hits"), F.sum(left).cast("long").alias("n_left"), F.count("error_code").alias("failed"))


@query("json_round_trip", "SELECT event_id, md5(json(props)::VARCHAR) AS digest FROM events")
def json_round_trip(t: Tables) -> DataFrame:
    """Strings put out of values and back in: the value is the same."""
    there = F.create_map(F.lit("a"), F.lit("§"))
    back = F.create_map(F.lit("§"), F.lit("a"))
    rows = t.events.select("event_id", "props", there.alias("there"), back.alias("back"))
    rows = B.rewritten(rows, "props", "there", "safe")
    rows = B.rewritten(rows, "safe", "back", "restored")
    return rows.select("event_id", F.md5("restored").alias("digest"))


@query(
    "json_fingerprints",
    """WITH k AS (SELECT event_id, props, unnest(list_sort(json_keys(props))) AS k FROM events), f AS (SELECT event_id, '{' || string_agg('"' || k || '":' || json_extract(props, '$.' || k)::VARCHAR, ',' ORDER BY k) || '}' AS form FROM k GROUP BY event_id)
    SELECT sha256(form) AS fingerprint, count(*) AS n FROM f GROUP BY ALL""",
)
def json_fingerprints(t: Tables) -> DataFrame:
    """Values by the digest of their stable form; the order of keys does not matter."""
    rows = B.stable(t.events.select("event_id", "props"), "props", "form")
    return rows.groupBy(F.sha2("form", 256).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


@query("slot_identity", r"SELECT page_id, '/' || array_to_string(list_transform(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: replace(replace(x, '~', '~0'), '/', '~1')), '/') AS pointer, CASE WHEN contains(url, '?') THEN 'tool_output' WHEN contains(url, '#') THEN 'assistant_message' ELSE 'message_text' END AS artifact_type FROM pages")
def slot_identity(t: Tables) -> DataFrame:
    """JSON pointers of slots and their artifact types."""
    parts = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    pointer = F.concat(F.lit("/"), F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))), "/"))
    kind = F.when(F.contains("url", F.lit("?")), "tool_output").when(F.contains("url", F.lit("#")), "assistant_message").otherwise("message_text")
    return t.pages.select("page_id", pointer.alias("pointer"), kind.alias("artifact_type"))


@query("header_allowlist", "SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') AND regexp_full_match(event_type, '[A-Za-z0-9._-]{1,64}') THEN event_type END AS kept FROM events")
def header_allowlist(t: Tables) -> DataFrame:
    """Metadata that is on the list and a safe token."""
    ok = F.col("event_type").isin("click", "view", "purchase") & F.col("event_type").rlike(r"\A[A-Za-z0-9._-]{1,64}\z")
    return t.events.select("event_id", F.when(ok, F.col("event_type")).alias("kept"))


@query("session_context", "SELECT conv_id, turn, coalesce(nullif(regexp_extract(text, '\\b[a-z]{5}\\b'), ''), role) AS session_key FROM conversations")
def session_context(t: Tables) -> DataFrame:
    """The first safe candidate for a session key."""
    word = F.regexp_extract("text", r"(?:(?<![A-Za-z0-9_])(?=[a-z]))[a-z]{5}(?![A-Za-z0-9_])", 0)
    return t.conversations.select("conv_id", "turn", F.coalesce(F.when(word != "", word), "role").alias("session_key"))


# ---- units


@query("chunks")
def chunks(t: Tables) -> DataFrame:
    """Overlapping windows of all documents."""
    rows = B.chunks(t.documents, "doc_id")
    return rows.select("doc_id", "nth", "start", "end", F.md5("chunk").alias("digest"))


@query("chunks_cover", "SELECT doc_id, n_chars AS covered FROM documents")
def chunks_cover(t: Tables) -> DataFrame:
    """Windows joined without their overlaps are the document."""
    rows = B.chunks(t.documents, "doc_id")
    before = Window.partitionBy("doc_id").orderBy("nth")
    fresh = F.col("end") - F.coalesce(F.lag("end").over(before), F.col("start"))
    return rows.select("doc_id", fresh.cast("long").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("covered"))


@query(
    "units_packed",
    """WITH RECURSIVE u AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations), f AS (SELECT conv_id, n, size AS used, 0 AS batch FROM u WHERE n = 1
    UNION ALL SELECT u.conv_id, u.n, CASE WHEN f.used > 0 AND f.used + u.size > 1000 THEN u.size ELSE f.used + u.size END, f.batch + CASE WHEN f.used > 0 AND f.used + u.size > 1000 THEN 1 ELSE 0 END FROM f JOIN u ON u.conv_id = f.conv_id AND u.n = f.n + 1)
    SELECT conv_id, turn, CAST(size AS INT) AS size, batch FROM u JOIN f USING (conv_id, n)""",
)
def units_packed(t: Tables) -> DataFrame:
    """Turns of a conversation in batches of 1000 characters, in order."""
    units = t.conversations.select("conv_id", "turn", F.length("text").alias("size"))
    return B.packed(units, "conv_id", "turn", "size", 1000)


@query("token_budgets", "SELECT ctx, out, ctx - out - greatest(768, ctx // 8) AS tokens, 2 * (ctx - out - greatest(768, ctx // 8)) AS chars, ctx - out - greatest(768, ctx // 8) >= 768 AS usable FROM (SELECT DISTINCT CAST(2048 + user_id % 16 * 1024 AS BIGINT) AS ctx, CAST(256 + user_id % 2 * 256 AS BIGINT) AS out FROM events)")
def token_budgets(t: Tables) -> DataFrame:
    """What a model's context leaves for private text."""
    rows = t.events.select((2048 + F.col("user_id") % 16 * 1024).cast("long").alias("ctx"), (256 + F.col("user_id") % 2 * 256).cast("long").alias("out")).distinct()
    tokens = F.col("ctx") - F.col("out") - F.greatest(F.lit(768), F.floor(F.col("ctx") / 8))
    return rows.select("ctx", "out", tokens.alias("tokens"), (tokens * 2).alias("chars"), (tokens >= 768).alias("usable"))


# ---- edits and rewrites


_FRAGMENT = "substr(text, 3, 6)"


@query(
    "text_edits",
    f"""WITH e AS (SELECT doc_id, text, {_FRAGMENT} AS old, len(string_split(text, {_FRAGMENT})) - 1 AS n FROM documents)
    SELECT doc_id, CASE WHEN error_code IS NULL THEN CASE WHEN doc_id % 3 = 0 THEN replace(text, old, '<edit>') ELSE substr(text, 1, instr(text, old) - 1) || '<edit>' || substr(text, instr(text, old) + length(old)) END END AS text, error_code
    FROM (SELECT *, CASE WHEN text IS NULL THEN 'INVALID_TEXT_EDITS' WHEN old = '' THEN 'INVALID_TEXT_EDIT' WHEN length(text) >= 256 AND length(old) >= length(text) * 0.8 THEN 'WHOLE_DOCUMENT_EDIT' WHEN doc_id % 3 = 1 AND n > 1 THEN 'AMBIGUOUS_TEXT_EDIT' END AS error_code FROM e)""",
)
def text_edits(t: Tables) -> DataFrame:
    """A fragment of each document replaced: wherever it occurs, where it may occur only once, and at its first place."""
    way = F.col("doc_id") % 3
    edit = F.struct(
        F.substring("text", 3, 6).alias("search"), F.lit("<edit>").alias("replace"), F.when(way == 2, 1).cast("int").alias("occurrence"), (way == 0).alias("all"),
        F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"),
    )
    return B.apply_edits(t.documents.select("doc_id", "text", F.array(edit).alias("edits")), "doc_id", "text", "edits")


@query("edit_offsets", "SELECT doc_id, len(string_split(text, 'the')) - 1 AS n FROM documents WHERE contains(text, 'the')")
def edit_offsets(t: Tables) -> DataFrame:
    """Occurrences of a fragment."""
    from ..functions.spans import occurrences

    return t.documents.where(F.contains("text", F.lit("the"))).select("doc_id", F.size(occurrences(F.col("text"), F.lit("the"))).cast("long").alias("n"))


_BEFORE = "SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations"


def _with_before(t: Tables) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", "text", before.alias("before")).where("before is not null")


@query(
    "rewrite_checks",
    rf"""WITH b AS ({_BEFORE}) SELECT conv_id, turn, len(regexp_extract_all(text, '\r\n|\r|\n')) = len(regexp_extract_all(before, '\r\n|\r|\n')) AS breaks_ok, len(string_split(text, '```')) = len(string_split(before, '```')) AS fences_ok,
    length(text) >= greatest(0, length(before) * 0.72 - 80) AND length(text) <= length(before) * 1.25 + 120 AS length_ok FROM b WHERE before IS NOT NULL""",
)
def rewrite_checks(t: Tables) -> DataFrame:
    """What a rewritten text must share with its source, asked of each turn and the one before it."""
    x, y = F.col("text"), F.col("before")
    breaks = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\r\n|\r|\n"), F.lit(0)))
    fences = lambda c: F.size(F.split(c, "```", -1))
    fits = (F.length(x) >= F.greatest(F.lit(0), F.length(y) * 0.72 - 80)) & (F.length(x) <= F.length(y) * 1.25 + 120)
    return _with_before(t).select("conv_id", "turn", (breaks(x) == breaks(y)).alias("breaks_ok"), (fences(x) == fences(y)).alias("fences_ok"), fits.alias("length_ok"))


_TOKENS = r"[\p{L}\p{N}_@.+:/-]+|\[private\]"


@query(
    "rewrite_coverage",
    f"""WITH RECURSIVE b AS ({_BEFORE}), k AS (SELECT conv_id, turn, regexp_extract_all(lower(before), '{_TOKENS}') AS own, regexp_extract_all(lower(text), '{_TOKENS}') AS theirs FROM b WHERE before IS NOT NULL),
    f AS (SELECT conv_id, turn, 0 AS i, 0 AS spot, 0 AS n FROM k UNION ALL
      SELECT conv_id, turn, i + 1, CASE WHEN hit > 0 THEN spot + hit ELSE spot END, CASE WHEN hit > 0 THEN n + 1 ELSE n END FROM (SELECT f.*, coalesce(list_position(k.theirs[f.spot + 1:], k.own[f.i + 1]), 0) AS hit FROM f JOIN k ON k.conv_id = f.conv_id AND k.turn = f.turn AND f.i < len(k.own)))
    SELECT k.conv_id, k.turn, CASE WHEN len(own) = 0 THEN CASE WHEN len(theirs) = 0 THEN 1.0 ELSE 0.0 END ELSE n / len(own) END::DOUBLE AS coverage FROM k JOIN f ON k.conv_id = f.conv_id AND k.turn = f.turn AND f.i = len(k.own)""",
)
def rewrite_coverage(t: Tables) -> DataFrame:
    """How much of the turn before a turn keeps, in order."""
    return _with_before(t).select("conv_id", "turn", B.token_coverage(F.col("before"), F.col("text")).alias("coverage"))


@query(
    "context_isolation",
    f"""WITH b AS (SELECT *, CASE WHEN turn % 2 = 0 THEN text || ' ' || substr(before, 1, 60) WHEN turn % 5 = 0 THEN text || ' [Context]' ELSE text END AS safe FROM ({_BEFORE}) WHERE before IS NOT NULL)
    SELECT conv_id, turn, NOT regexp_matches(upper(safe), '[[]CONTEXT[]]|REFERENCE HISTORY') AND len(list_filter(list_transform(regexp_split_to_array(before, '[.,!?;' || chr(10) || ']'), lambda x: lower(trim(x))), lambda x: length(x) >= 10 AND NOT contains(lower(text), x) AND contains(lower(safe), x))) = 0 AS isolated FROM b""",
)
def context_isolation(t: Tables) -> DataFrame:
    """Rewritten turns, some with a piece of the turn before put in, and whether they take anything from it."""
    x, y, n = F.col("text"), F.col("before"), F.col("turn")
    safe = F.when(n % 2 == 0, F.concat(x, F.lit(" "), F.substring(y, 1, 60))).when(n % 5 == 0, F.concat(x, F.lit(" [Context]"))).otherwise(x)
    return _with_before(t).select("conv_id", "turn", B.isolated(x, safe, y).alias("isolated"))


# ---- streams


@query("stream_restore", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS restored FROM conversations GROUP BY ALL")
def stream_restore(t: Tables) -> DataFrame:
    """Turns cut into chunks of seven characters with placeholders in them, restored chunk by chunk."""
    safe = F.replace(F.replace("text", F.lit("the"), F.lit("[WORD_1]")), F.lit("ing"), F.lit("[WORD_12]"))
    pieces = t.conversations.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(safe, F.lit(r"(?s).{1,7}"), F.lit(0))).alias("i", "chunk"))
    parts = pieces.select("conv_id", (F.col("turn") * 1_000_000 + F.col("i")).alias("seq"), "chunk")
    session = F.create_map(F.lit("[WORD_1]"), F.lit("the"), F.lit("[WORD_12]"), F.lit("ing"))
    sessions = t.conversations.select("conv_id").distinct().withColumn("session", session)
    done = K.restore_chunks(parts, sessions, "conv_id")
    whole = done.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "emitted"))).alias("xs"))
    return whole.select("conv_id", F.array_join(F.transform("xs", lambda x: x["emitted"]), "").alias("restored"))


@query("stream_arguments", "SELECT conv_id, role, string_agg(text, '' ORDER BY turn) AS arguments, length(string_agg(text, '')) <= 1000000 AS within FROM conversations GROUP BY ALL")
def stream_arguments(t: Tables) -> DataFrame:
    """Deltas gathered in order under a bound."""
    rows = t.conversations.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("xs"))
    whole = F.array_join(F.transform("xs", lambda x: x["text"]), "")
    return rows.select("conv_id", "role", whole.alias("arguments"), (F.length(whole) <= 1_000_000).alias("within"))


@query("stream_tool_calls", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_tool_calls(t: Tables) -> DataFrame:
    """One of each repeated call, the first."""
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query(
    "stream_diagnostics",
    """WITH RECURSIVE e AS (SELECT event_id, event_type, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events), f AS (SELECT event_type, n, event_id, ms AS last, true AS emitted FROM e WHERE n = 1
    UNION ALL SELECT e.event_type, e.n, e.event_id, CASE WHEN e.ms - f.last >= 30000 OR e.ms < f.last THEN e.ms ELSE f.last END, e.ms - f.last >= 30000 OR e.ms < f.last FROM f JOIN e ON e.event_type = f.event_type AND e.n = f.n + 1) SELECT event_type, event_id FROM f WHERE emitted""",
)
def stream_diagnostics(t: Tables) -> DataFrame:
    """Events let through once a window of 30 s after the last one let through."""
    rows = t.events.select("event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return K.first_in_window(rows, ["event_type"], "at", 30_000)


@query("stream_queue", "SELECT user_id, event_id, greatest(count(*) OVER (PARTITION BY user_id) - 3, 0) AS dropped FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def stream_queue(t: Tables) -> DataFrame:
    """The newest three events of a user, and how many went."""
    return K.newest(t.events.select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 3).select("user_id", "event_id", "dropped")


@query(
    "stream_allowance",
    """WITH b AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS ms, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS kind FROM events), w AS (SELECT *, last_value(CASE WHEN kind = 0 THEN ms END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ms, kind, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g, lag(kind) OVER (PARTITION BY user_id ORDER BY ms, kind, event_id) AS p FROM b)
    SELECT user_id, event_id, coalesce(p = 0 AND ms - g <= 120000, false) AS allowed FROM w WHERE kind = 1""",
)
def stream_allowance(t: Tables) -> DataFrame:
    """Requests that follow a grant of at most two minutes before, each grant once."""
    rows = t.events.select("user_id", "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return K.allowed(rows.where("event_type <> 'view'"), rows.where("event_type = 'view'"), "user_id", "at", 120_000)


@query("stream_compactor", "SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS user_text, text AS assistant_text FROM conversations QUALIFY role = 'assistant' AND lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user' AND turn >= 2")
def stream_compactor(t: Tables) -> DataFrame:
    """Pairs of user and assistant turns after those that are compacted already."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.withColumn("user_text", F.lag("text").over(order)).withColumn("before", F.lag("role").over(order))
    return rows.where("role = 'assistant' AND before = 'user' AND turn >= 2").select("conv_id", "turn", "user_text", F.col("text").alias("assistant_text"))


_SSE = "'event: turn' || chr(10) || 'data: ' || replace(text, chr(10), chr(10) || 'data: ') || chr(10) || chr(10)"


@query("sse_frames", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS nth, 'turn' AS event, text AS data, true AS complete FROM conversations")
def sse_frames(t: Tables) -> DataFrame:
    """Turns written as server-sent events and read again."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    frames = t.conversations.select("conv_id", nth.alias("nth"), F.lit("turn").alias("event"), F.replace("text", F.lit("\n"), F.lit("\ndata: ")).alias("data"))
    return K.sse_frames(K.sse_text(frames, "conv_id"), "conv_id", "body")


# ---- files, formats, errors


@query(
    "startup_files",
    """WITH d AS (SELECT doc_id, source, n_chars, sha256(text) AS h FROM documents), m AS (SELECT doc_id, h, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM d WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT h FROM d WHERE source < 'src5')
    SELECT d.doc_id, CASE WHEN m.size = d.n_chars THEN 'metadata' WHEN b.h IS NOT NULL THEN 'blob' ELSE 'read' END AS tier, d.h AS content_hash FROM d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN b ON b.h = d.h""",
)
def startup_files(t: Tables) -> DataFrame:
    """Contents known by unchanged metadata, by a blob of the same digest, or by reading."""
    files = t.documents.select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("h"))
    size = F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))  # some have changed since
    last = files.where("doc_id % 2 = 0").select("doc_id", size.alias("size"))
    blobs = files.where("source < 'src5'").select("h").distinct()
    return X.content_tiers(files, last, blobs).select("doc_id", "tier", F.col("h").alias("content_hash"))




@query(
    "plan_references",
    """WITH s AS (SELECT doc_id, unnest(w) AS value, CAST(generate_subscripts(w, 1) - 1 AS INT) AS nth FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{8,}') AS w FROM documents)), f AS (SELECT *, min(nth) OVER (PARTITION BY doc_id, value) AS first FROM s)
    SELECT doc_id, nth, value, sha256(value) AS reference, '[WORD_' || dense_rank() OVER (PARTITION BY doc_id ORDER BY first) || ']' AS placeholder FROM f""",
)
def plan_references(t: Tables) -> DataFrame:
    """Spans of a plan checked against the text by digest, and numbered by first occurrence of their value."""
    rows = t.documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("nth", "value"))
    first = F.min("nth").over(Window.partitionBy("doc_id", "value"))
    rows = rows.withColumn("first", first)
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first"))
    return rows.select("doc_id", "nth", "value", F.sha2("value", 256).alias("reference"), F.concat(F.lit("[WORD_"), number.cast("string"), F.lit("]")).alias("placeholder"))


@query("high_risk_gate", "SELECT CAST(count(*) AS BIGINT) AS blocked FROM events WHERE event_id % 10 IN (0, 3)")
def high_risk_gate(t: Tables) -> DataFrame:
    """Additions whose placeholder names a secret, a contact or a medical value."""
    kinds = ["EMAIL", "PERSON", "LOCATION", "API_KEY"] + ["ORGANIZATION"] * 6
    alias = F.concat(F.lit("["), F.get(F.array(*map(F.lit, kinds)), (F.col("event_id") % 10).cast("int")), F.lit("_1]"))
    risky = I.parse_alias(alias)["category"].rlike("EMAIL|PHONE|KEY|TOKEN|SECRET|CREDENTIAL|MEDICAL|MRN|SSN|CARD")
    return t.events.where(risky).agg(F.count(F.lit(1)).alias("blocked"))


@query("body_limits", "SELECT page_id, strlen(html) <= 16384 AS within FROM pages")
def body_limits(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.within_bytes(F.col("html"), 16384).alias("within"))


@query("env_entries", "SELECT event_id, 'KEY_' || event_id % 5 AS name, event_type AS value FROM events WHERE event_id % 3 <> 0")
def env_entries(t: Tables) -> DataFrame:
    """Lines of env files; every third is a comment."""
    e = F.col("event_id")
    line = F.concat(F.when(e % 3 == 0, "# ").otherwise("export "), F.lit("KEY_"), (e % 5).cast("string"), F.lit(" = '"), "event_type", F.lit("' "))
    rows = t.events.select("event_id", X.env_entries(line).alias("x")).where("x is not null")
    return rows.select("event_id", "x.name", "x.value")


@query("env_merge", "SELECT DISTINCT 'K' || user_id AS name, CASE WHEN user_id % 2 = 0 THEN 'process' ELSE 'file' END AS value FROM events")
def env_merge(t: Tables) -> DataFrame:
    """Settings of the process before those of a file; empty ones do not count."""
    users = t.events.select("user_id").distinct()
    own = users.select(F.concat(F.lit("K"), F.col("user_id").cast("string")).alias("name"), F.lit("file").alias("value"))
    over = users.select(F.concat(F.lit("K"), F.col("user_id").cast("string")).alias("name"), F.when(F.col("user_id") % 2 == 0, "process").otherwise("").alias("value"))
    return X.merged_config(own, over)


@query("image_urls", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'INVALID_BASE64' WHEN 2 THEN 'IMAGE_TYPE_MISMATCH' ELSE 'UNSUPPORTED_IMAGE' END AS error_code FROM events")
def image_urls(t: Tables) -> DataFrame:
    """Image data URLs, three of four faulty."""
    urls = ["data:image/png;base64,iVBORw0KGgo=", "data:image/png;base64,iVBORw0KGg", "data:image/jpeg;base64,iVBORw0KGgo=", "data:text/plain;base64,AAAA"]
    url = F.get(F.array(*map(F.lit, urls)), (F.col("event_id") % 4).cast("int"))
    return t.events.select("event_id", X.data_url(url)["error_code"].alias("error_code"))


# Categories of failures, whether they may be tried again, and the status that goes with them.
FAILURES = {"configuration": (False, 500), "invalid_request": (False, 400), "privacy_block": (False, 422), "provider_timeout": (True, 504), "provider_unavailable": (True, 503), "provider_response": (True, 502), "internal": (False, 500)}
_NAMES = list(FAILURES)


@query(
    "failures",
    f"SELECT ({_NAMES!r})[CAST(event_id % {len(_NAMES)} + 1 AS INT)] AS category, ({[r for r, _ in FAILURES.values()]!r})[CAST(event_id % {len(_NAMES)} + 1 AS INT)] AS retryable, count(*) AS n FROM events GROUP BY ALL",
)
def failures(t: Tables) -> DataFrame:
    """Failures by category with what may be tried again."""
    table = t.spark.createDataFrame([(k, r, s) for k, (r, s) in FAILURES.items()], "category string, retryable boolean, status int")
    own = t.events.select(F.get(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % len(_NAMES)).cast("int")).alias("category"))
    return own.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(table), "category").select("category", "retryable", "n")


# ---- changes of files

_NEXT = "CASE doc_id % 3 WHEN 0 THEN substr(text, 1, length(text) // 2) || 'Ω§' || substr(text, length(text) // 2 + 1) WHEN 1 THEN substr(text, 1, length(text) // 2) || 'Ω' || substr(text, length(text) // 2 + 6) ELSE text END"


def _changed(t: Tables) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    head = F.substring(F.col("text"), F.lit(1), half)
    tail = lambda skip: F.substring(F.col("text"), half + 1 + skip, F.length("text"))
    new = F.when(F.col("doc_id") % 3 == 0, F.concat(head, F.lit("Ω§"), tail(0))).when(F.col("doc_id") % 3 == 1, F.concat(head, F.lit("Ω"), tail(5))).otherwise(F.col("text"))
    return t.documents.select("doc_id", "text", new.alias("next"))


@query(
    "minimal_replacements",
    """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN length(text) // 2 END::INT AS "start", CASE doc_id % 3 WHEN 0 THEN length(text) // 2 WHEN 1 THEN least(length(text) // 2 + 5, length(text)) END::INT AS "end", CASE doc_id % 3 WHEN 0 THEN 'Ω§' WHEN 1 THEN 'Ω' END AS inserted FROM documents""",
)
def minimal_replacements(t: Tables) -> DataFrame:
    """Documents that something was put into, that lost something for something else, or that stayed."""
    return E.replacements(_changed(t), "text", "next").select("doc_id", "start", "end", "inserted")


@query(
    "files_reconciled",
    f"""WITH c AS (SELECT doc_id, sha256(text) AS a, sha256({_NEXT}) AS b FROM documents), p AS (SELECT DISTINCT a AS h FROM c WHERE doc_id % 2 = 0)
    SELECT doc_id, CASE WHEN a = b THEN 'unchanged' ELSE 'changed' END AS status, b IN (SELECT h FROM p) AS plan_reuse, a IN (SELECT h FROM p) AS has_previous FROM c""",
)
def files_reconciled(t: Tables) -> DataFrame:
    """Files changed outside, against the plans at hand."""
    rows = _changed(t).select("doc_id", F.sha2("text", 256).alias("old_hash"), F.sha2("next", 256).alias("new_hash"))
    return E.reconciled(rows, rows.where("doc_id % 2 = 0").select(F.col("old_hash").alias("content_hash")), "doc_id")


@query(
    "patches_parsed",
    "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'update,add' END AS types, CASE WHEN doc_id % 4 < 3 THEN len(string_split(text, chr(10))) + 1 END::BIGINT AS n_lines FROM documents",
)
def patches_parsed(t: Tables) -> DataFrame:
    """Patches of two files with a document as the body of one; every fourth climbs out of its folder and is none."""
    path = F.when(F.col("doc_id") % 4 == 3, "../b.txt").otherwise("b.txt")
    patch = F.concat(F.lit("*** Begin Patch\n*** Update File: a.txt\n"), "text", F.lit("\n*** Add File: "), path, F.lit("\n+x\n*** End Patch\n"))
    found = E.patches(t.documents.select("doc_id", patch.alias("patch")), "patch")
    n = F.aggregate("sections", F.lit(0).cast("long"), lambda s, x: s + F.size(x["body"]))
    return found.select("doc_id", F.array_join(F.transform("sections", lambda x: x["type"]), ",").alias("types"), n.alias("n_lines"))


#: A document as a file of lines, its first line, and how often that line's text stands in it, as SQL.
_FILE_SQL = r"""f AS (SELECT doc_id, coalesce(text, '') || chr(10) AS t, replace(split_part(coalesce(text, ''), chr(10), 1) || chr(10), chr(13) || chr(10), chr(10)) AS c FROM documents),
    n AS (SELECT *, (length(t) - length(replace(t, c, ''))) // length(c) AS k, replace(t, c, replace(c, chr(10), ' (changed)' || chr(10))) AS a FROM f)"""


@query(
    "patches_applied",
    f"""WITH {_FILE_SQL}, s AS (
        SELECT doc_id, 'a.txt' AS path, CASE WHEN k = 1 THEN md5(a) END AS next_md5, length(t) AS source_length, length(a) AS next_length, CASE WHEN k = 0 THEN 'NOT_FOUND' WHEN k > 1 THEN 'AMBIGUOUS' END AS error_code FROM n WHERE doc_id % 7 > 0
        UNION ALL SELECT doc_id, 'b.txt', md5('x' || chr(10)), 0, 2, CASE WHEN doc_id % 4 = 1 THEN 'EXISTS' END FROM n WHERE doc_id % 7 > 0
        UNION ALL SELECT doc_id, 'c/d.txt', NULL, 2, 0, CASE WHEN doc_id % 2 = 1 THEN 'ABSENT' END FROM n WHERE doc_id % 7 > 0 AND doc_id % 5 = 0
        UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 'NOT_A_PATCH' FROM n WHERE doc_id % 7 = 0)
    SELECT doc_id, path, CASE WHEN error_code IS NULL THEN next_md5 END AS next_md5, CASE WHEN error_code IS NULL THEN source_length END::INT AS source_length, CASE WHEN error_code IS NULL THEN next_length END::INT AS next_length, error_code, count(error_code) OVER (PARTITION BY doc_id) = 0 AS applied FROM s""",
)
def patches_applied(t: Tables) -> DataFrame:
    """A patch of up to three files for every document: its first line is changed, a file is added that may be there, one is
    deleted that may not; every seventh climbs out of its folder and is none."""
    docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    line = F.split("text", "\n")[0]
    gone = F.when(F.col("doc_id") % 5 == 0, "*** Delete File: c/d.txt\n").otherwise("")
    added = F.when(F.col("doc_id") % 7 == 0, "c/../../b.txt").otherwise("b.txt")
    patch = F.concat(F.lit("*** Begin Patch\n*** Update File: a.txt\n@@ first line\n-"), line, F.lit("\n+"), F.regexp_replace(line, "\r$", ""), F.lit(" (changed)\n*** Add File: "), added, F.lit("\n+x\n"), gone, F.lit("*** End Patch\n"))
    other = lambda path, rest: docs.where(rest).select("doc_id", F.lit(path).alias("path"), F.lit("y\n").alias("text"))
    files = docs.select("doc_id", F.lit("a.txt").alias("path"), F.concat("text", F.lit("\n")).alias("text"))
    files = files.union(other("b.txt", "doc_id % 4 = 1")).union(other("c/d.txt", "doc_id % 2 = 0"))
    found = E.apply_patches(docs.select("doc_id", patch.alias("patch")), files, "doc_id")
    return found.select("doc_id", "path", F.md5("next").alias("next_md5"), "source_length", "next_length", "error_code", "applied")


_WORD_SQL = "w AS (SELECT doc_id, text, CASE WHEN doc_id % 11 = 0 THEN 'no such words' ELSE regexp_extract(text, '[A-Za-z]{6,}') END AS o, doc_id % 5 AS kind FROM documents), k AS (SELECT *, CASE WHEN o = '' THEN 0 ELSE (length(text) - length(replace(text, o, ''))) // length(o) END AS n FROM w)"


@query(
    "files_predicted",
    f"""WITH {_WORD_SQL}, e AS (SELECT *, CASE WHEN kind = 0 THEN NULL WHEN text IS NULL THEN 'ABSENT' WHEN o = '' THEN 'EMPTY_SEARCH' WHEN n = 0 THEN 'NOT_FOUND' WHEN kind = 1 AND n > 1 THEN 'AMBIGUOUS' END AS error_code,
        CASE kind WHEN 0 THEN 'new content' WHEN 1 THEN replace(text, o, '[GONE]') WHEN 2 THEN replace(text, o, '[GONE]') ELSE replace(replace(text, o, '[GONE]'), '[GONE]', '[DONE, TWICE]') END AS a FROM k)
    SELECT doc_id, error_code, CASE WHEN error_code IS NULL THEN md5(a) END AS next_md5, CASE WHEN error_code IS NULL THEN length(a) END::INT AS next_length, CASE WHEN error_code IS NULL THEN CASE kind WHEN 0 THEN 0 WHEN 1 THEN n WHEN 2 THEN n ELSE 1 END END::INT AS n_edits,
        CASE WHEN error_code IS NULL AND kind IN (1, 2) THEN instr(text, o) - 1 END::INT AS first_start FROM e""",
)
def files_predicted(t: Tables) -> DataFrame:
    """What files will be once written, edited at one or every place, or edited twice; some edits have no place, some several."""
    kind, word = F.col("doc_id") % 5, F.when(F.col("doc_id") % 11 == 0, "no such words").otherwise(F.regexp_extract("text", "[A-Za-z]{6,}", 0))
    edit = lambda old, new, every: F.struct(old.alias("old_text"), F.lit(new).alias("new_text"), every.alias("every"))
    first = edit(word, "[GONE]", kind != 1)
    rows = t.documents.select(
        "doc_id", "text", F.when(kind == 0, "write").when(kind < 3, "edit").otherwise("multi_edit").alias("tool"), F.lit("new content").alias("content"),
        F.when(kind < 3, F.array(first)).otherwise(F.array(first, edit(F.lit("[GONE]"), "[DONE, TWICE]", F.lit(True)))).alias("asked"),
    )
    found = E.predicted(rows, "text", "tool", "content", "asked")
    start = F.when(kind.isin(1, 2), F.try_element_at("edits", F.lit(1))["start"])
    return found.select("doc_id", "error_code", F.md5("next").alias("next_md5"), "next_length", F.when(F.col("edits").isNotNull(), F.size("edits")).alias("n_edits"), start.alias("first_start"))


@query(
    "text_private_spans",
    """WITH w AS (SELECT doc_id, lower(text) AS x, lower(regexp_extract(text, '[A-Za-z]{6,}')) AS w FROM documents) SELECT doc_id, len(string_split(x, w)) - 1 AS n, instr(x, w) - 1 AS first FROM w WHERE w <> ''""",
)
def text_private_spans(t: Tables) -> DataFrame:
    """Where documents hold a known value, whatever its case."""
    word = F.regexp_extract("text", "[A-Za-z]{6,}", 0)
    rows = t.documents.select("doc_id", "text", F.array(F.struct(F.lit("[WORD_1]").alias("placeholder"), F.upper(word).alias("original"))).alias("session")).where(word != "")
    spans = E.private_spans(rows, "text", "session")
    return spans.select("doc_id", F.size("spans").cast("long").alias("n"), F.get("spans", 0)["start"].cast("long").alias("first"))
