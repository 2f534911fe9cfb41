"""Incremental secret scans over a ledger of content-addressed blobs.

A version of a file is a path and a text; its blob is the SHA-256 of the text.  The ledger is a table of
(blob, rules, spans): which versions of which rules have seen the blob, and what they found.  A scan addresses all versions,
scans only the pairs of blob and rule version that the ledger lacks, each distinct text once, appends them to the ledger,
and joins the findings back to every path that has the blob.  A new version of one rule scans all blobs for that rule alone.

Spans are code points, end exclusive.  Rules hold the text's own characters; a cheap test on the whole text decides
whether a rule's pattern is run at all.

Cases: a null text is an empty one; an empty text has no spans; null paths are a path of their own and all their versions are
kept; repeated rows are answered as often as they are there; texts are scanned whole; a ledger without rows, or None, knows
nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import new_path, written

_HEX = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))


@dataclass(frozen=True)
class Rule:
    """What is searched for. ``least`` characters of ``group`` make a match count; ``hint`` says, from the text, its lower case and bytes, whether to look."""

    kind: str
    version: int
    pattern: str
    hint: Callable[[str, str, bytes], bool]
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost matches, none overlapping; those that are too short are dropped after they have taken their place."""
        return [m.span() for m in re.finditer(self.pattern, text) if len(m[self.group]) >= self.least]


# The first three rules are given by the format of the findings; the others are public token formats.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    Rule("assign", 1, ASSIGN, lambda text, low, raw: any(k in low for k in ("passw", "secret", "token", "api")) and (":" in text or "=" in text), group=2, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", lambda text, low, raw: "AKIA" in text, least=20),
    Rule("hex", 1, r"[0-9a-f]+", lambda text, low, raw: b"x" * 24 in raw.translate(_HEX), least=24),
]
MORE = [
    Rule("pem", 1, r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----", lambda text, low, raw: "PRIVATE KEY-----" in text),
    Rule("github", 1, r"(?a:\b)gh[pousr]_[A-Za-z0-9]{36,}", lambda text, low, raw: "gh" in text),
    Rule("slack", 1, r"(?a:\b)xox[abprs]-[A-Za-z0-9-]{10,}", lambda text, low, raw: "xox" in text),
    Rule("jwt", 1, r"(?a:\b)eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", lambda text, low, raw: "eyJ" in text),
]
RULES = [*BASE, *MORE]

LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
#: Rows of ids that are sent to all tasks at most (about 100 bytes each); beyond, texts are joined by shuffle.
SENT = 500_000


def _blob() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)


def addressed(versions: DataFrame) -> DataFrame:
    """path, blob of every row of ``versions`` (path, text)."""
    return versions.select("path", _blob().alias("blob"))


def unseen(ids: DataFrame, ledger: DataFrame | None, rules: list[Rule]) -> DataFrame:
    """blob, path (the smallest that has it), rules (that have not seen it) of every blob that the ledger lacks in part."""
    blobs = ids.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path")).alias("x")).select("blob", "x.path")
    every = F.array(*(F.lit(r.name) for r in rules)).cast("array<string>")
    if ledger is None:
        return blobs.withColumn("rules", every)
    known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("known"))
    lacks = blobs.join(known, "blob", "left").withColumn("rules", F.array_except(every, F.coalesce("known", F.array().cast("array<string>"))))
    return lacks.where(F.size("rules") > 0).select("blob", "path", "rules")


def _scanner(rules: list[Rule]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    of = {r.name: r for r in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            for text, raw, todo in zip(batch.column("text").to_pylist(), raws, batch.column("rules").to_pylist(), strict=True):
                low = text.lower()
                spans.append([(n, a, b) for n in todo if of[n].hint(text, low, raw) for a, b in of[n].spans(text)])
            found = pa.array([[{"rule": n, "start": a, "end": b} for n, a, b in own] for own in spans], _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("rules"), found], ["blob", "rules", "spans"])

    return scan


def scan_unseen(versions: DataFrame, ids: DataFrame, todo: DataFrame, rules: list[Rule]) -> DataFrame:
    """The ledger rows of ``todo`` (blob, path, rules; stored), one a blob.

    Texts stay where they are read: the shorter list of ids, of what is to be scanned or of what is not, is sent to them.
    If both are long, texts are joined by shuffle.
    """
    texts = versions.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _blob().alias("blob"))
    same = ["path", "blob"]
    every = F.array(*(F.lit(r.name) for r in rules)).cast("array<string>")
    some, full = todo.where(F.size("rules") < len(rules)), todo.where(F.size("rules") == len(rules))
    # what is scanned by all rules is what is left without the rest
    key = lambda c: F.struct(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())
    ids = ids.withColumn("at", key("path")).select("at", "blob").distinct()
    texts = texts.withColumn("at", key("path")).drop("path")
    wanted = full.select(key("path").alias("at"), "blob")
    skipped = written(ids.join(wanted, ["at", "blob"], "left_anti"), "skipped")
    n_full, n_skip = wanted.count(), skipped.count()
    if n_skip <= min(SENT, n_full):
        chosen = texts.join(F.broadcast(skipped), ["at", "blob"], "left_anti")
    else:
        chosen = texts.join(F.broadcast(wanted) if n_full <= SENT else wanted.hint("merge"), ["at", "blob"], "left_semi")
    chosen = chosen.select("blob", "text", every.alias("rules"))
    n_some = some.count()
    if n_some:
        part = some.select(key("path").alias("at"), "blob", "rules")
        part = texts.join(F.broadcast(part) if n_some <= SENT else part.hint("merge"), ["at", "blob"])
        chosen = chosen.unionByName(part.select("blob", "text", "rules"))
    found = chosen.mapInArrow(_scanner(rules), LEDGER)
    # rows that share path and text are scanned alike
    return found.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("spans").alias("spans"))


def update(versions: DataFrame, ledger: str | None = None, rules: list[Rule] = RULES) -> tuple[DataFrame, str]:
    """Address and scan ``versions`` (path, text); path and blob of all rows, and the path of the ledger with what was new.

    ``ledger`` is the path of an earlier ledger, which stays as it is; the new one has its rows and those of this scan, one
    file set a scan.  A scan that fails leaves the earlier ledger as it was.
    """
    spark = versions.sparkSession
    ids = written(addressed(versions), "ids")
    before = spark.read.schema(LEDGER).parquet(ledger) if ledger else None
    todo = written(unseen(ids, before, rules), "todo")
    after = new_path(spark, "ledger")
    fresh = scan_unseen(versions, ids, todo, rules)
    (fresh if before is None else before.unionByName(fresh)).write.parquet(after)
    return ids, after


def findings(ids: DataFrame, ledger: str, rules: list[Rule] = RULES) -> DataFrame:
    """path, blob, spans (rule, start, end; of the current ``rules`` only, by start and order of the rules) of every row of ``ids``."""
    spark = ids.sparkSession
    place = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))))
    own = F.filter("spans", lambda s: s["rule"].isin([r.name for r in rules]))
    kept = spark.read.schema(LEDGER).parquet(ledger).select("blob", own.alias("spans")).where(F.size("spans") > 0)
    kept = kept.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    in_order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place[s["rule"]].alias("place"), s["end"].alias("end"), s["rule"].alias("rule"))))
    kept = written(kept.select("blob", in_order.alias("spans")), "kept")
    none = F.array().cast("array<struct<start:int,place:int,end:int,rule:string>>")
    out = ids.join(kept.hint("merge"), "blob", "left").withColumn("spans", F.coalesce("spans", none))
    return out.select("path", "blob", F.transform("spans", lambda s: F.struct(s["rule"].alias("rule"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.substring_index(s["rule"], "@", 1), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob of every row of ``docs`` (doc_id, text)."""
    ids, ledger = update(docs.select(F.col("doc_id").alias("path"), "text"), None, rules)
    found = findings(ids, ledger, rules)
    base = [r.name for r in BASE]
    n = lambda name: F.size(F.filter("spans", lambda s: s["rule"] == name)).cast("long")
    given = F.filter("spans", lambda s: s["rule"].isin(base))
    return found.select(
        F.col("path").alias("doc_id"), *(n(r.name).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(span_text(given).cast("binary"), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), "blob",
    )
