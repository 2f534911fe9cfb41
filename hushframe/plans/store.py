"""Queries over stores, files, edit geometry and lineage.

``events`` stands for the use of a cache (user_id: key, event_type: artifact type); ``conversations`` for sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import geometry as G, lineage as L, store as S
from ..operators.derived import derived_plans
from .registry import Tables, query

_MS = "(epoch_us(ts) // 1000)"


def _log(t: Tables) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", F.col("user_id").alias("key"), F.col("event_type").alias("artifact_type"), at.alias("at"), "value", "props")


_ITEMS_SQL = f"""log AS (SELECT event_id, user_id AS key, event_type AS artifact_type, {_MS} AS ms, value FROM events),
    items AS (SELECT key, min(ms) AS created_at, max(ms) AS last_used_at, count(*) AS writes, arg_max(artifact_type, ms * 1000000 + event_id) AS artifact_type, arg_max(event_id, ms * 1000000 + event_id) AS event_id FROM log GROUP BY key)"""


def items(t: Tables) -> DataFrame:
    log = _log(t).withColumn("nth", F.col("at") * 1_000_000 + F.col("event_id"))
    out = log.groupBy("key").agg(F.min("at").alias("created_at"), F.max("at").alias("last_used_at"), F.count(F.lit(1)).alias("writes"), F.max_by("artifact_type", "nth").alias("artifact_type"), F.max_by("event_id", "nth").alias("event_id"))
    return out


@query("store_upsert", f"WITH {_ITEMS_SQL} SELECT * FROM items")
def store_upsert(t: Tables) -> DataFrame:
    """The last write of each key; creation time and number of writes are kept."""
    return items(t)


@query(
    "store_touch",
    f"WITH {_ITEMS_SQL}, r AS (SELECT key, count(*) AS hits, max(ms) + 5 AS used FROM log WHERE artifact_type = 'click' GROUP BY key) SELECT i.key, coalesce(r.hits, 0) AS hit_count, greatest(i.last_used_at, coalesce(r.used, 0)) AS last_used_at FROM items i LEFT JOIN r USING (key)",
)
def store_touch(t: Tables) -> DataFrame:
    """Reads counted on the items they hit."""
    reads = _log(t).where("artifact_type = 'click'").select("key", (F.col("at") + 5).alias("at"))
    return S.touched(items(t), reads, "key", "at").select("key", "hit_count", "last_used_at")


@query("store_latest", f"SELECT max({_MS}) AS latest FROM events")
def store_latest(t: Tables) -> DataFrame:
    return _log(t).agg(F.max("at").alias("latest"))


_NOW = "(SELECT max(last_used_at) FROM items)"


@query("store_expire", f"WITH {_ITEMS_SQL} SELECT key, last_used_at FROM items WHERE last_used_at >= {_NOW} - 86400000")
def store_expire(t: Tables) -> DataFrame:
    """Items used within a day of the last use of any."""
    own = items(t)
    now = own.agg(F.max("last_used_at").alias("now"))  # one row
    return own.join(F.broadcast(now)).where(F.col("last_used_at") >= F.col("now") - 86_400_000).select("key", "last_used_at")


@query("store_trim", f"WITH {_ITEMS_SQL} SELECT key, last_used_at FROM items ORDER BY last_used_at DESC, key LIMIT 100")
def store_trim(t: Tables) -> DataFrame:
    """The hundred most recently used items."""
    return S.most_recent(items(t), 100, "key").select("key", "last_used_at")


@query("store_trim_by_type", f"WITH {_ITEMS_SQL} SELECT artifact_type, key, last_used_at FROM items QUALIFY row_number() OVER (PARTITION BY artifact_type ORDER BY last_used_at DESC, key) <= 10")
def store_trim_by_type(t: Tables) -> DataFrame:
    """The ten most recently used items of each type."""
    return S.most_recent_per(items(t), "artifact_type", 10, "key").select("artifact_type", "key", "last_used_at")


@query("store_prune", f"WITH {_ITEMS_SQL}, young AS (SELECT * FROM items WHERE last_used_at >= {_NOW} - 172800000) SELECT key, writes FROM young ORDER BY last_used_at DESC, key LIMIT 200")
def store_prune(t: Tables) -> DataFrame:
    """Expiry, then the bound."""
    own = items(t)
    young = own.join(F.broadcast(own.agg(F.max("last_used_at").alias("now")))).where(F.col("last_used_at") >= F.col("now") - 172_800_000)
    return S.most_recent(young, 200, "key").select("key", "writes")


@query("store_lookup", f"WITH {_ITEMS_SQL} SELECT l.event_id, i.key IS NOT NULL AND i.artifact_type = l.artifact_type AS hit FROM log l LEFT JOIN (SELECT * FROM items WHERE key % 3 <> 0) i ON i.key = l.key")
def store_lookup(t: Tables) -> DataFrame:
    """Requests that find an item of their policy."""
    cached = items(t).where("key % 3 <> 0").select("key", "last_used_at", "artifact_type")
    return S.lookup(_log(t), cached, "key", "artifact_type", F.lit(0)).select("event_id", "hit")


@query("store_summary", f"WITH {_ITEMS_SQL} SELECT count(*) AS n, coalesce(sum(writes), 0)::BIGINT AS writes, min(created_at) AS oldest, max(last_used_at) AS newest FROM items")
def store_summary(t: Tables) -> DataFrame:
    return items(t).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("writes"), F.lit(0)).alias("writes"), F.min("created_at").alias("oldest"), F.max("last_used_at").alias("newest"))


@query("store_by_type", f"WITH {_ITEMS_SQL} SELECT artifact_type, count(*) AS n, sum(writes)::BIGINT AS writes FROM items GROUP BY ALL ORDER BY n DESC, artifact_type")
def store_by_type(t: Tables) -> DataFrame:
    return items(t).groupBy("artifact_type").agg(F.count(F.lit(1)).alias("n"), F.sum("writes").alias("writes")).orderBy(F.desc("n"), "artifact_type")


@query("store_list", f"WITH {_ITEMS_SQL} SELECT key, artifact_type, writes, last_used_at FROM items ORDER BY last_used_at DESC, key LIMIT 10")
def store_list(t: Tables) -> DataFrame:
    return S.most_recent(items(t), 10, "key").select("key", "artifact_type", "writes", "last_used_at")


@query(
    "threads_updated_at",
    f"SELECT user_id AS key, event_id, {_MS} AS saved_at, max({_MS} - n) OVER (PARTITION BY user_id ORDER BY n) + n AS updated_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) AS n FROM events)",
)
def threads_updated_at(t: Tables) -> DataFrame:
    """Update times that rise with every save of a thread, never before the clock."""
    log = _log(t).select("key", F.col("key").alias("session_id"), "event_id", F.col("at").alias("occurred_at"))
    return L.recorded(log).select("key", "event_id", F.col("occurred_at").alias("saved_at"), F.col("recorded_at").alias("updated_at"))


@query("threads_parents", "SELECT user_id AS key, list_sort(list_distinct(list(event_type))).array_to_string(',') AS parents FROM events GROUP BY ALL")
def threads_parents(t: Tables) -> DataFrame:
    """The union of the parents that a thread's saves name."""
    return t.events.groupBy(F.col("user_id").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("parents"))


@query(
    "content_cache",
    "SELECT sha256(text) AS content_hash, count(*) AS slots, count(*) - 1 AS deduplicated, min(doc_id) AS representative FROM documents GROUP BY ALL",
)
def content_cache(t: Tables) -> DataFrame:
    """Slots by content: each distinct content is classified once."""
    return t.documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("slots"), (F.count(F.lit(1)) - 1).alias("deduplicated"), F.min("doc_id").alias("representative"))


@query(
    "artifact_metrics",
    """WITH s AS (SELECT doc_id, lang, sha256(concat_ws(chr(1), 'policy', lang, text)) AS cache_key FROM documents), c AS (SELECT DISTINCT cache_key FROM s WHERE doc_id % 5 = 0)
    SELECT s.lang, count(*) AS slots, count(*) FILTER (c.cache_key IS NOT NULL) AS cache_hits, count(*) FILTER (c.cache_key IS NULL) AS uncached, count(DISTINCT s.cache_key) FILTER (c.cache_key IS NULL) AS unique_uncached FROM s LEFT JOIN c USING (cache_key) GROUP BY ALL""",
)
def artifact_metrics(t: Tables) -> DataFrame:
    """Cache hits, misses and distinct misses by type."""
    slots = t.documents.select("doc_id", "lang", F.sha2(F.concat_ws("\u0001", F.lit("policy"), "lang", "text"), 256).alias("cache_key"))
    cached = slots.where("doc_id % 5 = 0").select("cache_key").distinct().withColumn("hit", F.lit(True))
    rows = slots.join(cached, "cache_key", "left")
    miss = F.col("hit").isNull()
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("slots"), F.count("hit").alias("cache_hits"), F.sum(miss.cast("long")).alias("uncached"), F.countDistinct(F.when(miss, F.col("cache_key"))).alias("unique_uncached"))


# ---- manifests and mutations


@query(
    "manifest_fingerprints",
    "SELECT source, sha256(concat_ws(':', n::VARCHAR, " + ", ".join(f"s{k}::VARCHAR" for k in range(4)) + ")) AS fingerprint, n AS n_entries FROM (SELECT source, count(*) AS n, " + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 15 * k}, 15) AS BIGINT)::HUGEINT) AS s{k}" for k in range(4)) + " FROM (SELECT source, sha256(concat_ws(chr(0), doc_id::VARCHAR, sha256(text))) AS h FROM documents) GROUP BY ALL)",
)
def manifest_fingerprints(t: Tables) -> DataFrame:
    """A digest of each manifest, whatever the order of its entries."""
    rows = t.documents.select("source", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("content"))
    return S.fingerprint(rows, "source", ["path", "content"])


@query(
    "manifests_incomplete",
    "SELECT DISTINCT source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def manifests_incomplete(t: Tables) -> DataFrame:
    """Manifests with an entry whose content is gone."""
    entries = t.documents.select("source", "doc_id")
    return S.incomplete(t.documents.select("source").distinct(), entries, t.labels.select("doc_id"), "source", "doc_id")


@query("ledger_cascade", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def ledger_cascade(t: Tables) -> DataFrame:
    """Children that a deletion of their parents leaves."""
    return S.without_parents(t.labels, t.documents.where("lang <> 'en'").select("doc_id"), "doc_id").select("doc_id", "quality")


@query("ledger_alias_join", "SELECT p.page_id, count(*) AS n FROM pages p JOIN documents d ON d.n_chars = length(p.html) GROUP BY ALL")
def ledger_alias_join(t: Tables) -> DataFrame:
    """Contents found through an alias."""
    alias = t.pages.select("page_id", F.length("html").cast("long").alias("n_chars"))
    return alias.join(t.documents.select("n_chars"), "n_chars").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ledger_constraints",
    "SELECT count(*) FILTER (l_shipdate < o_orderdate) AS reversed, count(*) FILTER (l_quantity < 0) AS negative, count(*) FILTER (o_orderkey IS NULL) AS orphans FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
)
def ledger_constraints(t: Tables) -> DataFrame:
    """Rows that break a range, a sign or a reference."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    many = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return rows.agg(many(F.coalesce(F.col("l_shipdate") < F.col("o_orderdate"), F.lit(False))).alias("reversed"), many(F.col("l_quantity") < 0).alias("negative"), many(F.col("o_orderkey").isNull()).alias("orphans"))


@query(
    "mutation_states",
    """WITH RECURSIVE x AS (SELECT user_id AS mutation_id, (['stage', 'commit', 'rollback'])[CAST(event_id % 3 + 1 AS INT)] AS op, event_id % 2 AS planned, event_id % 5 % 2 AS actual, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    f AS (SELECT DISTINCT mutation_id, 0::BIGINT AS n, 'missing' AS state, NULL::BIGINT AS planned, 0 AS conflicts FROM x UNION ALL
      SELECT x.mutation_id, x.n,
        CASE WHEN op = 'stage' AND state IN ('missing', 'rolled_back') THEN 'pending' WHEN op = 'commit' AND state = 'pending' AND actual = f.planned THEN 'committed' WHEN op = 'rollback' AND state = 'pending' THEN 'rolled_back' ELSE state END,
        CASE WHEN op = 'stage' AND state IN ('missing', 'rolled_back') THEN x.planned ELSE f.planned END,
        f.conflicts + CASE WHEN op = 'stage' AND state IN ('pending', 'committed') AND x.planned <> f.planned OR op = 'commit' AND state IN ('pending', 'committed') AND actual <> f.planned OR op = 'rollback' AND state = 'committed' THEN 1 ELSE 0 END
      FROM f JOIN x ON x.mutation_id = f.mutation_id AND x.n = f.n + 1)
    SELECT mutation_id, arg_max(state, n) AS state, CAST(arg_max(conflicts, n) AS INT) AS conflicts FROM f GROUP BY ALL""",
)
def mutation_states(t: Tables) -> DataFrame:
    """States of mutations after their operations: events of a user are stage, commit and rollback by their number."""
    op = F.get(F.array(F.lit("stage"), F.lit("commit"), F.lit("rollback")), (F.col("event_id") % 3).cast("int"))
    log = t.events.select(F.col("user_id").alias("mutation_id"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 2).alias("planned"), (F.col("event_id") % 5 % 2).alias("actual"))
    return S.mutation_states(log)


# ---- geometry: every hundredth character of a document begins a span of 20; edits lie every 250 characters

_SPANS_SQL = "SELECT doc_id, i * 100 AS s, i * 100 + 20 AS e FROM (SELECT doc_id, unnest(range(0, (n_chars - 20) // 100 + 1)) AS i FROM documents WHERE n_chars >= 20)"
_EDITS_SQL = "SELECT doc_id, n_chars, j * 250 + 10 AS s, j * 250 + 10 + (doc_id + j) % 4 * 5 AS e, (doc_id * 7 + j) % 13 AS inserted FROM (SELECT doc_id, n_chars, unnest(range(0, (n_chars - 40) // 250 + 1)) AS j FROM documents WHERE n_chars >= 40)"


def _spans(t: Tables) -> DataFrame:
    i = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_chars") - 20) / 100))).alias("i")
    rows = t.documents.where("n_chars >= 20").select("doc_id", "n_chars", i)
    return rows.select("doc_id", (F.col("i") * 100).cast("long").alias("start"), (F.col("i") * 100 + 20).cast("long").alias("end"))


def _edits(t: Tables) -> DataFrame:
    j = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_chars") - 40) / 250))).alias("j")
    rows = t.documents.where("n_chars >= 40").select("doc_id", "n_chars", j)
    at = F.col("j") * 250 + 10
    return rows.select("doc_id", "n_chars", at.cast("long").alias("start"), (at + (F.col("doc_id") + F.col("j")) % 4 * 5).cast("long").alias("end"), ((F.col("doc_id") * 7 + F.col("j")) % 13).cast("long").alias("inserted"))


@query(
    "geometry_propagate",
    f"""WITH sp AS ({_SPANS_SQL}), ed AS ({_EDITS_SQL}), j AS (SELECT sp.doc_id, sp.s, sp.e, coalesce(sum(CASE WHEN sp.s >= ed.e THEN ed.inserted - (ed.e - ed.s) END), 0) AS shift, count(*) FILTER (sp.e > ed.s AND NOT sp.s >= ed.e) AS cut FROM sp LEFT JOIN ed ON ed.doc_id = sp.doc_id AND sp.e > ed.s GROUP BY ALL)
    SELECT doc_id, CAST(s + shift AS BIGINT) AS "start", CAST(e + shift AS BIGINT) AS "end" FROM j WHERE cut = 0""",
)
def geometry_propagate(t: Tables) -> DataFrame:
    """Spans after the edits of their documents."""
    return G.propagate(_spans(t), _edits(t).drop("n_chars"), "doc_id")


@query(
    "geometry_rescan",
    f"""WITH ed AS ({_EDITS_SQL}), sh AS (SELECT *, coalesce(sum(inserted - (e - s)) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift, n_chars + sum(inserted - (e - s)) OVER (PARTITION BY doc_id) AS nxt FROM ed),
    r AS (SELECT doc_id, greatest(0, least(nxt, s + shift - 64)) AS a, greatest(0, least(nxt, s + shift + inserted + 64)) AS b FROM sh), m AS (SELECT *, CASE WHEN a > max(b) OVER w THEN 1 WHEN max(b) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT doc_id, CAST(min(a) AS BIGINT) AS "start", CAST(max(b) AS BIGINT) AS "end" FROM g GROUP BY doc_id, island""",
)
def geometry_rescan(t: Tables) -> DataFrame:
    """Joined ranges around edits that must be scanned again."""
    return G.rescan_ranges(_edits(t), "doc_id", "n_chars")


@query(
    "geometry_lengths",
    f"WITH ed AS ({_EDITS_SQL}) SELECT doc_id, any_value(n_chars) AS source_length, CAST(any_value(n_chars) + sum(inserted - (e - s)) AS BIGINT) AS next_length, bool_and(s <= e AND inserted >= 0) AS valid FROM ed GROUP BY doc_id",
)
def geometry_lengths(t: Tables) -> DataFrame:
    """The length equation of a mutation."""
    rows = _edits(t).groupBy("doc_id").agg(F.max("n_chars").alias("source_length"), F.sum(F.col("inserted") - (F.col("end") - F.col("start"))).alias("d"), F.min((F.col("start") <= F.col("end")) & (F.col("inserted") >= 0)).alias("valid"))
    return rows.select("doc_id", "source_length", (F.col("source_length") + F.col("d")).alias("next_length"), "valid")


@query(
    "plans_derived",
    f"""WITH d AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 11 = 0 THEN 'pending' ELSE 'committed' END AS status, CASE WHEN doc_id % 7 = 0 THEN 'write_file' ELSE 'replace_in_file' END AS kind, CASE WHEN doc_id % 13 <> 0 THEN n_chars END AS source, doc_id % 17 = 0 AND n_chars >= 40 AS spoilt FROM documents),
    sp AS ({_SPANS_SQL}), ed AS ({_EDITS_SQL}), sh AS (SELECT *, row_number() OVER w - 1 AS nth, coalesce(sum(inserted - (e - s)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM ed WINDOW w AS (PARTITION BY doc_id ORDER BY s)),
    o AS (SELECT d.doc_id, d.source, CASE WHEN status <> 'committed' THEN 'mutation_not_committed' WHEN kind = 'write_file' AND (source IS NULL OR d.doc_id % 2 = 0) THEN 'full_write_lengths_unknown' WHEN source IS NULL THEN 'source_length_unknown' WHEN spoilt THEN 'edits_invalid' END AS reason, coalesce(g.grown, 0) AS grown FROM d LEFT JOIN (SELECT doc_id, sum(inserted - (e - s)) AS grown FROM ed GROUP BY ALL) g USING (doc_id)),
    j AS (SELECT sp.doc_id, sp.s, sp.e, coalesce(sum(CASE WHEN sp.s >= ed.e THEN ed.inserted - (ed.e - ed.s) END), 0) AS shift, count(*) FILTER (sp.e > ed.s AND NOT sp.s >= ed.e) AS cut FROM sp LEFT JOIN ed ON ed.doc_id = sp.doc_id AND sp.e > ed.s GROUP BY ALL),
    r AS (SELECT sh.doc_id, greatest(0, least(o.source + o.grown, s + shift - 64)) AS a, greatest(0, least(o.source + o.grown, s + shift + inserted + 64)) AS b FROM sh JOIN o ON o.doc_id = sh.doc_id AND o.reason IS NULL),
    m AS (SELECT *, CASE WHEN a <= max(b) OVER w THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT doc_id, 'outcome' AS part, coalesce(reason, 'derived') AS note, CAST(NULL AS BIGINT) AS "start", CAST(CASE WHEN reason IS NULL THEN source + grown END AS BIGINT) AS "end" FROM o
    UNION ALL SELECT j.doc_id, 'span', 'place', CAST(s + shift AS BIGINT), CAST(e + shift AS BIGINT) FROM j JOIN o ON o.doc_id = j.doc_id AND o.reason IS NULL WHERE cut = 0
    UNION ALL SELECT sh.doc_id, 'span', 'inserted', CAST(s + shift + 1 AS BIGINT), CAST(s + shift + 5 AS BIGINT) FROM sh JOIN o ON o.doc_id = sh.doc_id AND o.reason IS NULL WHERE inserted >= 5
    UNION ALL SELECT doc_id, 'range', 'scan', CAST(min(a) AS BIGINT), CAST(max(b) AS BIGINT) FROM i GROUP BY doc_id, island""",
)
def plans_derived(t: Tables) -> DataFrame:
    """What is known of documents' plans after their edits: outcomes, spans, ranges to scan; some mutations cannot be used."""
    d, n = F.col("doc_id"), F.col("n_chars")
    old, new = F.concat(F.lit("old"), d.cast("string")), F.concat(F.lit("new"), d.cast("string"))
    muts = t.documents.select(
        d.alias("mutation_id"), F.when(d % 11 == 0, "pending").otherwise("committed").alias("status"), F.when(d % 7 == 0, "write_file").otherwise("replace_in_file").alias("operation_type"),
        F.when(d % 13 != 0, n.cast("long")).alias("source_length"), F.when(d % 2 == 1, n.cast("long")).alias("next_length"), old.alias("expected_content_hash"), new.alias("next_content_hash"),
    )
    nth = F.floor(F.col("start") / 250)
    # spoilt mutations lack their first edit's number
    edits = _edits(t).select(d.alias("mutation_id"), (nth + (d % 17 == 0).cast("long")).alias("nth"), "start", "end", "inserted")
    put = edits.where("inserted >= 5").select("mutation_id", "nth", F.lit(0).alias("place"), F.lit(1).cast("long").alias("offset"), F.lit(4).cast("long").alias("length"), F.lit("inserted").alias("classification"), F.lit("ref").alias("reference"))
    spans = _spans(t).select(old.alias("content_hash"), F.lit("strict").alias("policy_fingerprint"), "start", "end", F.lit("place").alias("classification"), F.lit("ref").alias("reference"))
    outcomes, found, ranges = derived_plans(muts, edits, put, t.documents.select(old.alias("content_hash"), F.lit("strict").alias("policy_fingerprint")), spans)
    row = lambda df, part, note, start, end: df.select(F.col("mutation_id").alias("doc_id"), F.lit(part).alias("part"), note.alias("note"), start.alias("start"), end.alias("end"))
    rows = row(outcomes, "outcome", F.coalesce("reason", "status"), F.lit(None).cast("long"), F.col("next_length"))
    return rows.union(row(found, "span", F.col("classification"), F.col("start"), F.col("end"))).union(row(ranges, "range", F.lit("scan"), F.col("start"), F.col("end")))


@query("geometry_merge_spans", f"WITH sp AS ({_SPANS_SQL}) SELECT DISTINCT doc_id, s AS \"start\", e AS \"end\" FROM (SELECT * FROM sp WHERE s % 200 = 0 UNION ALL SELECT * FROM sp WHERE s % 300 = 0)")
def geometry_merge_spans(t: Tables) -> DataFrame:
    """The distinct spans of two plans."""
    spans = _spans(t)
    return spans.where("start % 200 = 0").union(spans.where("start % 300 = 0")).distinct()


@query(
    "boxes",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, l_quantity + 10 AS x1, l_discount * 100 + 5 AS y1 FROM lineitem), u AS (SELECT l_orderkey, min(x) AS x0, min(y) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY ALL)
    SELECT l_orderkey, greatest(0, least(39, floor(x0)))::BIGINT AS x0, greatest(0, least(9, floor(y0)))::BIGINT AS y0, greatest(greatest(0, least(39, floor(x0))) + 1, least(40, ceil(x1)))::BIGINT AS x1, greatest(greatest(0, least(9, floor(y0))) + 1, least(10, ceil(y1)))::BIGINT AS y1 FROM u""",
)
def boxes(t: Tables) -> DataFrame:
    """Boxes of a group joined and held within an image."""
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    rows = t.lineitem.select("l_orderkey", F.array(x, y, x + 10, y + 5).alias("b")).groupBy("l_orderkey").agg(F.collect_list("b").alias("bs"))
    held = rows.select("l_orderkey", G.box_clamp(G.box_union(F.col("bs")), F.lit(40), F.lit(10)).alias("b"))
    return held.select("l_orderkey", *(F.get("b", i).cast("long").alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query(
    "box_overlaps",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS y, lag(l_quantity) OVER w AS px, lag(l_discount * 100) OVER w AS py FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount * 100))
    SELECT l_orderkey, l_linenumber, round(greatest(0, least(px + 10, x + 10) - greatest(px, x)) * greatest(0, least(py + 5, y + 5) - greatest(py, y)) / 50.0, 6) AS overlap FROM b WHERE px IS NOT NULL""",
)
def box_overlaps(t: Tables) -> DataFrame:
    """Neighbouring lines of an order that cover the same region."""
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.array(x, y, x + 10, y + 5).alias("b"))
    before = F.lag("b").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", F.get("b", 0), F.get("b", 1)))
    return rows.withColumn("a", before).where("a is not null").select("l_orderkey", "l_linenumber", F.round(G.box_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


# ---- lineage: a conversation is a session, its turns are events that follow each other

_LINEAGE_SQL = """ev AS (SELECT 'event-' || lpad(conv_id::VARCHAR, 6, '0') || '-' || lpad(turn::VARCHAR, 3, '0') AS event_id, 'session-' || conv_id AS session_id, CASE WHEN turn = 0 THEN 'session_created' WHEN role = 'user' THEN 'provider_request' ELSE 'provider_response' END AS event_type,
    conv_id * 1000 + turn % 3 * 10 AS occurred_at, CASE WHEN turn > 0 THEN 'event-' || lpad(conv_id::VARCHAR, 6, '0') || '-' || lpad((turn - 1)::VARCHAR, 3, '0') END AS parent_event_id, 'value-' || length(text) % 50 AS value_id, conv_id, turn FROM conversations)"""


def events_of(t: Tables) -> DataFrame:
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    c, n = F.col("conv_id"), F.col("turn")
    eid = lambda turn: F.concat(F.lit("event-"), pad(c, 6), F.lit("-"), pad(turn, 3))
    kind = F.when(n == 0, "session_created").when(F.col("role") == "user", "provider_request").otherwise("provider_response")
    return t.conversations.select(
        eid(n).alias("event_id"), F.concat(F.lit("session-"), c.cast("string")).alias("session_id"), kind.alias("event_type"), (c * 1000 + n % 3 * 10).alias("occurred_at"),
        F.when(n > 0, eid(n - 1)).alias("parent_event_id"), F.concat(F.lit("value-"), (F.length("text") % 50).cast("string")).alias("value_id"), "conv_id", "turn",
    )


@query("lineage_validate", f"WITH {_LINEAGE_SQL} SELECT event_id, CASE WHEN conv_id % 9 = 0 THEN 'INVALID_EVENT_TYPE' WHEN conv_id % 10 = 0 THEN 'INVALID_EVENT_ID' WHEN event_type <> 'session_created' AND turn % 7 = 6 THEN 'PARENT_REQUIRED' END AS error_code FROM ev")
def lineage_validate(t: Tables) -> DataFrame:
    """Why events are not accepted; some are spoiled on purpose."""
    ev = events_of(t)
    kind = F.when(F.col("conv_id") % 9 == 0, "unknown").otherwise(F.col("event_type"))
    eid = F.when(F.col("conv_id") % 10 == 0, "bad id").otherwise(F.col("event_id"))
    parent = F.when(F.col("turn") % 7 != 6, F.col("parent_event_id"))
    return ev.select("event_id", L.event_error(kind, eid, parent, F.col("occurred_at")).alias("error_code"))


_TYPES_SQL = "[" + ", ".join(f"'{x}'" for x in L.EVENT_TYPES) + "]"


@query(
    "lineage_shapes",
    f"""WITH e AS (SELECT conv_id, turn, conv_id % 9 AS spoilt, {_TYPES_SQL}[turn % 12 + 1] AS kind FROM conversations)
    SELECT conv_id, turn, kind AS event_type, CASE
        WHEN spoilt = 1 AND kind IN ('value_protected', 'value_derived', 'placeholder_assigned', 'transformation') THEN 'MISSING_VALUE_ID' WHEN spoilt = 2 AND kind <> 'session_created' THEN 'PARENT_REQUIRED'
        WHEN spoilt = 3 THEN 'INVALID_REASON_CODE' WHEN spoilt = 4 AND turn % 3 > 0 THEN 'INVALID_METADATA' WHEN spoilt = 5 AND kind = 'value_protected' THEN 'MISSING_POLICY_REF_OR_TRANSFORMATION'
        WHEN spoilt = 5 AND kind IN ('value_derived', 'transformation') THEN 'MISSING_TRANSFORMATION' WHEN spoilt = 6 THEN 'INVALID_PROVIDER' WHEN spoilt = 7 AND kind = 'placeholder_assigned' THEN 'MISSING_PLACEHOLDER_ID'
        WHEN spoilt = 8 AND kind IN ('session_created', 'value_protected') THEN 'FORBIDDEN_PARENT_VALUE_ID' END AS error_code,
        CASE WHEN spoilt <> 4 OR turn % 3 = 0 THEN '{{"attempt":' || turn || ',"byteLength":' || strlen(coalesce(e2.text, '')) || ',"success":' || (turn % 2 = 0) || '}}' END AS metadata
    FROM e JOIN conversations e2 USING (conv_id, turn)""",
)
def lineage_shapes(t: Tables) -> DataFrame:
    """Why events of all types are not accepted by themselves, and their metadata in order; some are spoilt on purpose."""
    c, n = F.col("conv_id"), F.col("turn")
    spoilt, kind = c % 9, F.element_at(F.array(*map(F.lit, L.EVENT_TYPES)), (n % 12 + 1).cast("int"))
    ref = lambda name, *of: F.concat(F.lit(f"{name}:"), F.md5(F.concat_ws("/", *(x.cast("string") for x in of))))
    unless = lambda k, x: F.when(spoilt != k, x)
    new = kind == "session_created"
    extra = F.when((spoilt == 4) & (n % 3 == 1), ',"note":1').when((spoilt == 4) & (n % 3 == 2), ',"retryCount":-1').otherwise("")
    given = F.concat(F.lit('{"success":'), (n % 2 == 0).cast("string"), F.lit(',"byteLength":"'), F.octet_length(F.coalesce("text", F.lit(""))).cast("string"), F.lit('","attempt":'), n.cast("string"), extra, F.lit("}"))
    ev = t.conversations.select(
        c, n, kind.alias("event_type"), ref("event", c, n).alias("event_id"), ref("session", c).alias("session_id"), (c * 1000 + n).alias("occurred_at"), unless(2, ref("event", c, n - 1)).alias("parent_event_id"),
        unless(1, F.when(~new, ref("value", c))).alias("value_id"), F.when((spoilt == 8) | (kind == "value_derived"), ref("value", n)).alias("parent_value_id"), unless(5, F.lit("mask")).alias("transformation"),
        unless(7, F.when(~new, ref("placeholder", c))).alias("placeholder_id"), F.when(kind == "placeholder_assigned", "[PERSON_1]").alias("placeholder"), F.when(spoilt == 6, "a blank").otherwise("local").alias("provider"),
        F.lit("chat").alias("operation"), *(ref(x, c, n).alias(f"{x}_ref") for x in ("request", "response", "restoration", "cache")), F.when(spoilt == 3, "because").otherwise("redaction").alias("reason_code"), given.alias("metadata"),
    )
    return ev.select("conv_id", "turn", "event_type", L.shape_error(ev).alias("error_code"), L.normal_metadata(F.col("metadata")).alias("metadata"))


@query("lineage_append", f"WITH {_LINEAGE_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at, event_id) AS k FROM ev) SELECT event_id, max(occurred_at - k) OVER (PARTITION BY session_id ORDER BY k) + k AS recorded_at FROM n")
def lineage_append(t: Tables) -> DataFrame:
    """Recording times that rise within a session."""
    return L.recorded(events_of(t)).select("event_id", "recorded_at")


@query("lineage_values", f"WITH {_LINEAGE_SQL} SELECT value_id, arg_min(event_id, printf('%012d', occurred_at) || event_id) AS origin_event_id, min(occurred_at) AS created_at FROM ev GROUP BY ALL")
def lineage_values(t: Tables) -> DataFrame:
    """The registry of values: where each was first seen."""
    return L.first_seen(events_of(t), "value_id").select("value_id", "origin_event_id", "created_at")


@query("lineage_event_join", f"WITH {_LINEAGE_SQL} SELECT e.event_id, p.event_type AS parent_type, p.value_id AS parent_value_id FROM ev e LEFT JOIN ev p ON p.event_id = e.parent_event_id")
def lineage_event_join(t: Tables) -> DataFrame:
    """Events with what is known of their parents."""
    ev = events_of(t)
    parents = ev.select(F.col("event_id").alias("parent_event_id"), F.col("event_type").alias("parent_type"), F.col("value_id").alias("parent_value_id"))
    return ev.join(parents, "parent_event_id", "left").select("event_id", "parent_type", "parent_value_id")


@query("lineage_session", f"WITH {_LINEAGE_SQL} SELECT event_id, occurred_at FROM ev WHERE session_id = 'session-3' ORDER BY occurred_at, event_id LIMIT 10000")
def lineage_session(t: Tables) -> DataFrame:
    """The events of a session in order."""
    return events_of(t).where("session_id = 'session-3'").orderBy("occurred_at", "event_id").limit(L.LIMIT).select("event_id", "occurred_at")


@query("lineage_value", f"WITH {_LINEAGE_SQL} SELECT e.event_id FROM ev e LEFT JOIN ev p ON p.event_id = e.parent_event_id WHERE e.value_id = 'value-7' OR p.value_id = 'value-7'")
def lineage_value(t: Tables) -> DataFrame:
    """The events of a value, as their own or their parent's."""
    ev = events_of(t)
    parents = ev.select(F.col("event_id").alias("parent_event_id"), F.col("value_id").alias("parent_value_id"))
    return ev.join(parents, "parent_event_id", "left").where("value_id = 'value-7' OR parent_value_id = 'value-7'").select("event_id")


@query(
    "lineage_causal",
    f"WITH {_LINEAGE_SQL}, s AS (SELECT conv_id, max(turn) AS last FROM ev GROUP BY ALL) SELECT e2.event_id AS start_id, e.event_id, e.parent_event_id, CAST(s.last - e.turn AS INT) AS depth, CAST(NULL AS VARCHAR) AS error_code FROM ev e JOIN s USING (conv_id) JOIN ev e2 ON e2.conv_id = e.conv_id AND e2.turn = s.last WHERE s.last = (SELECT count(*) - 1 FROM ev x WHERE x.conv_id = e.conv_id) UNION ALL SELECT e2.event_id, NULL, NULL, NULL, 'PARENT_NOT_FOUND' FROM s JOIN ev e2 ON e2.conv_id = s.conv_id AND e2.turn = s.last WHERE s.last <> (SELECT count(*) - 1 FROM ev x WHERE x.conv_id = s.conv_id)",
)
def lineage_causal(t: Tables) -> DataFrame:
    """From the last event of sessions up to their roots."""
    ev = events_of(t)
    starts = ev.groupBy("conv_id").agg(F.max_by("event_id", "turn").alias("event_id"))
    return L.causal_path(ev, starts)


@query("lineage_chronological", f"WITH {_LINEAGE_SQL} SELECT event_id, occurred_at FROM ev WHERE occurred_at BETWEEN 5000 AND 20010 ORDER BY occurred_at, event_id LIMIT 10000")
def lineage_chronological(t: Tables) -> DataFrame:
    """The events of a time range in order."""
    return events_of(t).where(F.col("occurred_at").between(5000, 20010)).orderBy("occurred_at", "event_id").limit(L.LIMIT).select("event_id", "occurred_at")


@query("lineage_protected_request", f"WITH {_LINEAGE_SQL} SELECT session_id, value_id, arg_min(event_id, turn) AS event_id, count(*) AS uses FROM ev GROUP BY ALL")
def lineage_protected_request(t: Tables) -> DataFrame:
    """One assignment of each value in a session, at its first use."""
    return events_of(t).groupBy("session_id", "value_id").agg(F.min_by("event_id", "turn").alias("event_id"), F.count(F.lit(1)).alias("uses"))


@query("lineage_restorations", f"WITH {_LINEAGE_SQL} SELECT event_id, lag(event_id) OVER (PARTITION BY session_id, value_id ORDER BY turn) AS parent_event_id FROM ev")
def lineage_restorations(t: Tables) -> DataFrame:
    """Each use of a value follows the one before in its session."""
    order = Window.partitionBy("session_id", "value_id").orderBy("turn")
    return events_of(t).select("event_id", F.lag("event_id").over(order).alias("parent_event_id"))


@query("lineage_summary", f"WITH {_LINEAGE_SQL} SELECT event_type, count(*) AS n, count(DISTINCT session_id) AS sessions FROM ev GROUP BY ALL")
def lineage_summary(t: Tables) -> DataFrame:
    return events_of(t).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("sessions"))


@query("lineage_integrity", f"WITH {_LINEAGE_SQL} SELECT count(*) - count(DISTINCT event_id) AS repeated, count(*) FILTER (parent_event_id IS NOT NULL AND parent_event_id NOT IN (SELECT event_id FROM ev)) AS missing_parents FROM ev")
def lineage_integrity(t: Tables) -> DataFrame:
    """Repeated ids and parents that are not there."""
    ev = events_of(t)
    one = ev.agg((F.count(F.lit(1)) - F.countDistinct("event_id")).alias("repeated"))
    lost = ev.where("parent_event_id is not null").join(ev.select(F.col("event_id").alias("parent_event_id")), "parent_event_id", "left_anti").agg(F.count(F.lit(1)).alias("missing_parents"))
    return one.join(F.broadcast(lost))
