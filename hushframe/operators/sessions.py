"""Rules of session maps: which entries count, when a map is ambiguous, how maps are inherited and rebased, and known values
put out of texts.

A session map is rows of a key, ``ord``, ``placeholder`` and ``original``; the first placeholder of an original is its
established one.  Restoration is exact, look-up of originals ignores case.

Cases: entries with a null or empty side, or equal sides, do not count; a key without entries has no rows; repeated
entries count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import identity as I
from ..functions.known import KnownValues, fold, put_out
from ..functions.spans import occurrences

# Names that no placeholder may have, and error codes.
UNSAFE = ["__proto__", "prototype", "constructor"]
INVALID, AMBIGUOUS = "INVALID_SESSION_MAP", "AMBIGUOUS_SESSION_MAP"


def counted(entries: DataFrame) -> DataFrame:
    """The entries that count."""
    p, o = F.col("placeholder"), F.col("original")
    return entries.where((F.length(p) > 0) & (F.length(o) > 0) & (p != o))


def map_errors(entries: DataFrame, key: str) -> DataFrame:
    """key, error_code of every map that breaks a rule.

    INVALID: a placeholder has an unsafe name or is a malformed canonical one.  AMBIGUOUS: two placeholders differ in case
    only, one placeholder has two originals, or a placeholder is also an original, whatever the case.
    """
    rows = counted(entries).select(key, "placeholder", "original", F.lower("placeholder").alias("_p"), F.lower("original").alias("_o"))
    bad = rows.where(F.col("_p").isin(UNSAFE) | I.is_malformed_alias(F.col("placeholder"))).select(key, F.lit(INVALID).alias("error_code"))
    by_name = rows.groupBy(key, "_p").agg(F.min("placeholder").alias("a"), F.max("placeholder").alias("b"), F.min("original").alias("c"), F.max("original").alias("d"))
    twice = by_name.where("a <> b or c <> d").select(key, F.lit(AMBIGUOUS).alias("error_code"))
    both = rows.select(key, "_p").join(rows.select(key, F.col("_o").alias("_p")).distinct(), [key, "_p"], "left_semi").select(key, F.lit(AMBIGUOUS).alias("error_code"))
    # an invalid name is found first
    return bad.union(twice).union(both).groupBy(key).agg(F.max("error_code").alias("error_code"))


def inherited(current: DataFrame, theirs: DataFrame, key: str, most: int = 1) -> tuple[DataFrame, DataFrame]:
    """The entries of ``theirs`` that ``current`` takes over (key, ord, placeholder, original), and (key, error_code) of collisions.

    PLACEHOLDER_COLLISION: a placeholder stands for another original already; ALIAS_LIMIT: an original would have more than
    ``most`` placeholders; else the rules of :func:`map_errors`, of both together.  A key with a collision takes over nothing.
    """
    own = counted(current).select(key, "placeholder", F.col("original").alias("_has")).distinct()
    rows = counted(theirs).join(own, [key, "placeholder"], "left")
    clash = rows.where("_has <> original").select(key, F.lit("PLACEHOLDER_COLLISION").alias("error_code"))
    new = rows.where("_has is null").drop("_has").dropDuplicates([key, "placeholder", "original"])
    have = own.groupBy(key, F.col("_has").alias("original")).agg(F.count(F.lit(1)).alias("_n"))
    nth = F.row_number().over(Window.partitionBy(key, "original").orderBy("ord", "placeholder"))
    over = new.withColumn("_nth", nth).join(have, [key, "original"], "left").where(F.col("_nth") + F.coalesce("_n", F.lit(0)) > most).select(key, F.lit("ALIAS_LIMIT").alias("error_code"))
    together = map_errors(current.select(key, "placeholder", "original").unionByName(theirs.select(key, "placeholder", "original")), key)
    rank = F.when(F.col("error_code") == "PLACEHOLDER_COLLISION", 0).when(F.col("error_code") == "ALIAS_LIMIT", 1).otherwise(2)
    errors = clash.union(over).union(together).groupBy(key).agg(F.min_by("error_code", rank).alias("error_code"))
    return new.join(errors, key, "left_anti").select(key, "ord", "placeholder", "original"), errors


def rebased(additions: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """``additions`` with their ``target`` among the existing entries: key, ord, placeholder, original, target, added.

    An original that has a placeholder keeps that one (``added`` is false).  A placeholder that is taken by another original,
    or that is an existing original, gets the next free number.  An original that is an existing placeholder is an error
    (AMBIGUOUS, in ``error_code``; the key's other columns are null then).  Additions of equal ``ord`` come by placeholder and original.
    """
    have = counted(existing)
    order = F.min_by("placeholder", "ord").alias("_keeps")
    of_original = have.groupBy(key, "original").agg(order)
    names = have.groupBy(key, F.lower("placeholder").alias("_p")).agg(F.min("original").alias("_taken_by"))
    originals = have.select(key, F.lower("original").alias("_p"), F.lit(True).alias("_is_original")).distinct()
    rows = counted(additions).where(F.col(key).isNotNull()).select(key, "ord", "placeholder", "original", F.lower("placeholder").alias("_p"), F.lower("original").alias("_o"))
    wrong = rows.join(names.select(key, F.col("_p").alias("_o")), [key, "_o"], "left_semi").select(key).distinct().withColumn("error_code", F.lit(AMBIGUOUS))
    rows = rows.join(of_original, [key, "original"], "left").join(names, [key, "_p"], "left").join(originals, [key, "_p"], "left")
    moves = F.col("_keeps").isNull() & (F.coalesce("_is_original", F.lit(False)) | F.coalesce(F.col("_taken_by") != F.col("original"), F.lit(False)))
    rows = rows.join(wrong, key, "left_anti").withColumn("_moves", moves)
    still = rows.where("not _moves").select(key, "ord", "placeholder", "original", F.coalesce("_keeps", "placeholder").alias("target"), F.col("_keeps").isNull().alias("added"))
    moved = _renumbered(rows.where("_moves"), have.select(key, "placeholder", "original").unionByName(counted(additions).select(key, "placeholder", "original")), key)
    done = still.unionByName(moved.withColumn("added", F.lit(True))).withColumn("ord", F.col("ord").cast("long")).withColumn("error_code", F.lit(None).cast("string"))
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    return done.unionByName(wrong.select(key, none("ord", "long"), none("placeholder", "string"), none("original", "string"), none("target", "string"), none("added", "boolean"), "error_code"))


def _renumbered(rows: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """key, ord, placeholder, original, target: each placeholder, in order, as the next free [CATEGORY_n] after it.

    ``taken``: entries whose placeholders and originals are not free, whatever their case.  Only names of that form can be
    met, so a name is its category and number.  Rows pass in sorted partitions, the taken numbers of a category before its
    rows; a task holds the taken numbers of one category of one key, with a link from each to the next that may be free, so
    the work grows with the rows whatever the length of a key.
    """
    parsed = I.parse_alias(F.col("placeholder"))
    name = F.explode(F.array(F.lower("placeholder"), F.lower("original")))
    form = r"\A\[(.*)_([1-9][0-9]{0,17})\]\z"
    none = lambda kind: F.lit(None).cast(kind)
    used = taken.select(key, name.alias("_t")).where(F.col("_t").rlike(form)).select(
        F.col(key).alias("_key"), F.regexp_extract("_t", form, 1).alias("_category"), F.lit(0).alias("_kind"), F.regexp_extract("_t", form, 2).cast("long").alias("_n"),
        none("string").alias("_name"), none("long").alias("ord"), none("string").alias("placeholder"), none("string").alias("original"),
    ).distinct()
    name = F.coalesce(parsed["category"], I.inferred_category(F.col("placeholder")))
    asks = rows.select(
        F.col(key).alias("_key"), F.lower(name).alias("_category"), F.lit(1).alias("_kind"), F.coalesce(parsed["ordinal"] + 1, F.lit(1)).cast("long").alias("_n"),
        name.alias("_name"), F.col("ord").cast("long").alias("ord"), "placeholder", "original",
    )
    used = used.join(asks.select("_key", "_category").distinct(), ["_key", "_category"], "left_semi").select(*asks.columns)
    both = asks.unionByName(used).repartition("_key", "_category").sortWithinPartitions("_key", "_category", "_kind", "ord", "placeholder", "original")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, after = None, {}  # of each taken number, one behind it: the next free one is at the end of such links
        for batch in batches:
            keep, targets = [], []
            columns = (batch.column(c).to_pylist() for c in ("_key", "_category", "_kind", "_n", "_name"))
            for i, (own, category, kind, n, name) in enumerate(zip(*columns, strict=True)):
                if at != (own, category):
                    at, after = (own, category), {}
                if not kind:
                    after[n] = n + 1
                    continue
                path = []
                while n in after:
                    path.append(n)
                    n = after[n]
                for x in (*path, n):
                    after[x] = n + 1
                keep.append(i)
                targets.append(f"[{name}_{n}]")
            chosen = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("_key", "ord", "placeholder", "original")]
            yield pa.RecordBatch.from_arrays([*chosen, pa.array(targets, pa.string())], [key, "ord", "placeholder", "original", "target"])

    return both.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, ord long, placeholder string, original string, target string")


#: Known values put out of a text column by a session column of the same row.
sanitize_known = put_out


_HELD = "array<struct<ord:bigint,placeholder:string,original:string,n:int,first:int>>"
_HELD_ARROW = {"ord": pa.int64(), "placeholder": pa.string(), "original": pa.string(), "n": pa.int32(), "first": pa.int32()}
#: Held entries, of a batch's rows together, at which what is done of it is passed on.
HELD = 50_000


class _Held:
    """Held entries of rows, in columns."""

    def __init__(self) -> None:
        self.ends, self.columns = [0], {c: [] for c in _HELD_ARROW}

    def add(self, folded: str, spans: list[tuple[int, int]], of: dict[str, list]) -> None:
        found: dict[str, list[int]] = {}  # count, first, end of the last counted
        for a, b in spans:
            if (value := folded[a:b]) in of:
                seen = found.setdefault(value, [0, a, 0])
                if a >= seen[2]:
                    seen[0], seen[2] = seen[0] + 1, b
        for x in sorted((*x, n, first) for value, (n, first, _) in found.items() for x in of[value]):
            for column, v in zip(self.columns.values(), x, strict=True):
                column.append(v)
        self.ends.append(len(self.columns["n"]))

    def array(self) -> pa.Array:
        made = pa.StructArray.from_arrays([pa.array(self.columns[c], kind) for c, kind in _HELD_ARROW.items()], list(_HELD_ARROW))
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), made)


def _hot(rows: DataFrame, key: str) -> tuple[int, DataFrame]:
    """The number of partitions, and the keys with more rows than an even share of them, as ``_hot``; these are fewer."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    share = rows.count() // n + 1
    return n, F.broadcast(counts.where(F.col("count") > share).select(F.col(key).alias("_hot")))


def _spread(rows: DataFrame, n: int) -> Column:
    """One of ``n`` partitions by the whole row."""
    own = (F.col("`" + c.replace("`", "``") + "`") for c, kind in rows.dtypes if "map<" not in kind and kind != "variant")
    return F.pmod(F.xxhash64(*own), F.lit(n)).cast("int")


def beside_every_entry(rows: DataFrame, entries: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with each entry (ord, placeholder, original) of the session of their ``key``: one row for every pair.

    ``at``: where a text column first holds the original, whatever its case (from 1; 0: nowhere, null: no text).  The pairs
    of a session are as many as its rows times its entries, so no task holds them: rows of sessions with more of them than
    an even share are dealt over all partitions, and entries follow.  Rows without a session are left out.

    Folding keeps the length of a text: the one capital whose lower case is longer is folded to a plain letter.
    """
    n, hot = _hot(rows, key)
    fold_case = lambda c: F.lower(F.translate(c, "\u0130", "i"))
    left = rows.withColumn("_low", fold_case(F.col(column))).join(hot, F.col(key) == F.col("_hot"), "left")
    left = left.withColumn("_part", F.when(F.col("_hot").isNotNull(), _spread(rows, n)).otherwise(0)).drop("_hot")
    right = entries.select(key, "ord", "placeholder", "original", fold_case(F.col("original")).alias("_o")).join(hot, F.col(key) == F.col("_hot"), "left")
    right = right.withColumn("_part", F.explode(F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [key, "_part"]).withColumn("at", F.instr(F.col("_low"), F.col("_o"))).drop("_part", "_low", "_o")


def beside_session(rows: DataFrame, entries: DataFrame, key: str, column: str, put: bool = True, again: bool = False) -> DataFrame:
    """``rows`` with what the session of their ``key`` knows of a text column: sanitized, error_code, held, session_size.

    ``entries``: key, ord, placeholder, original.  ``held``: each entry whose original the text holds, whatever its case, with
    the number of its occurrences (those that overlap not counted twice) and the first of them (from 0).  Without ``put``
    nothing is sanitized: sanitized and error_code are null.  With ``again`` there is also ``left``: what the sanitized text
    still holds, like ``held``.

    Entries and rows meet in sorted partitions, the entries of a session before its rows, so that the automaton of a session
    is built once and no row carries the session.  Sessions with more rows than an even share are dealt over all
    partitions, each with the entries; there are fewer such sessions than partitions.

    Cases: a null text is sanitized to null and holds nothing; rows without a session, or with a null key, know nothing;
    entries with an empty side or equal sides are no entries.
    """
    n, hot = _hot(rows, key)
    own = [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]
    dealt = rows.join(hot, rows[key] == F.col("_hot"), "left")
    none = lambda kind: F.lit(None).cast(kind)
    row = F.struct(*(c.alias(f"c{i}") for i, c in enumerate(own)))
    dealt = dealt.select(
        F.col(key).alias("_key"), F.when(F.col("_hot").isNotNull(), _spread(rows, n)).otherwise(0).alias("_part"), F.lit(1).alias("_kind"), none("long").alias("_ord"),
        none("string").alias("_placeholder"), none("string").alias("_original"), F.col(column).alias("_text"), row.alias("_row"),
    )
    known = entries.where(F.col(key).isNotNull() & (F.col("placeholder") != "") & (F.col("original") != "") & (F.col("placeholder") != F.col("original")))
    known = known.join(hot, known[key] == F.col("_hot"), "left")
    parts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    known = known.select(
        F.col(key).alias("_key"), F.explode(parts).alias("_part"), F.lit(0).alias("_kind"), F.col("ord").cast("long").alias("_ord"),
        F.col("placeholder").alias("_placeholder"), F.col("original").alias("_original"), none("string").alias("_text"), none(dealt.schema["_row"].dataType).alias("_row"),
    )
    both = dealt.unionByName(known).repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_kind", "_ord")

    extra = ["sanitized", "error_code", "held", *(["left"] if again else []), "session_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, session, known, of = None, [], None, {}
        for batch in batches:
            keep, sanitized, errors, sizes, held, left = [], [], [], [], _Held(), _Held()

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                rows = batch.column("_row").take(pa.array(keep, pa.int64()))
                lists = [x.array() for x in ([held, left] if again else [held])]
                return pa.RecordBatch.from_arrays([rows, pa.array(sanitized, pa.string()), pa.array(errors, pa.string()), *lists, pa.array(sizes, pa.int32())], ["_row", *extra])

            columns = (batch.column(c).to_pylist() for c in ("_key", "_part", "_kind", "_ord", "_placeholder", "_original", "_text"))
            for i, (key, part, kind, number, placeholder, original, text) in enumerate(zip(*columns, strict=True)):
                if at != (key, part):
                    at, session, known = (key, part), [], None
                if not kind:
                    session.append((number, placeholder, original))
                    continue
                if known is None:
                    known, of = KnownValues([x[1:] for x in session]), {}
                    for x in session:
                        of.setdefault(fold(x[2]), []).append(x)
                folded = fold(text or "")
                spans = known.all(folded)
                done = known.put(text, folded, spans) if put and text is not None else (None, None)
                keep.append(i)
                sanitized.append(done[0])
                errors.append(done[1])
                sizes.append(len(session))
                held.add(folded, spans, of)
                if again:
                    folded = fold(done[0] or "")
                    left.add(folded, known.all(folded), of)
                if held.ends[-1] + left.ends[-1] > HELD:
                    yield made()
                    keep, sanitized, errors, sizes, held, left = [], [], [], [], _Held(), _Held()
            yield made()

    kinds = {"sanitized": "string", "error_code": "string", "held": _HELD, "left": _HELD, "session_size": "int"}
    out = both.mapInArrow(run, f"_row {dealt.schema['_row'].dataType.simpleString()}, " + ", ".join(f"{c} {kinds[c]}" for c in extra))
    return out.select(*(F.col(f"_row.c{i}") for i in range(len(own))), *extra).toDF(*rows.columns, *extra)


# What a model may call a span, and how many and how long spans may be.
SPAN_TYPES = (
    "EMAIL SSN CREDIT_CARD PHONE API_KEY AWS_ACCESS_KEY URL_CREDENTIAL URL_QUERY_SECRET CONNECTION_STRING_CREDENTIAL MEDICAL_ID MRN "
    "PRIVATE_IDENTIFIER PASSWORD SECRET CREDENTIAL TOKEN PERSON ORGANIZATION LOCATION IP_ADDRESS POSTAL_CODE ZIP"
).split()
MOST_SPANS, LONGEST_SPAN = 2048, 512
_SPANS = "array<struct<value:string,type:string>>"


def model_spans(reply: Column, text: Column) -> Column:
    """The distinct spans (value, type) of a model's JSON reply about a text, or null if any of it breaks a rule.

    Values are on one line, at most 512 characters long and in the text; types are of the list; 2048 spans at most.
    """
    spans = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), f"struct<spans:{_SPANS}>")["spans"]
    fits = lambda s: (
        s.isNotNull() & F.coalesce(F.length(s["value"]).between(1, LONGEST_SPAN), F.lit(False)) & ~s["value"].rlike(r"[\r\n]") & F.contains(text, s["value"]) & F.coalesce(s["type"].isin(SPAN_TYPES), F.lit(False))
    )
    return F.when((F.size(spans) <= MOST_SPANS) & F.forall(spans, fits), F.array_distinct(spans))


def model_detections(spans: Column, text: Column) -> Column:
    """Every occurrence of a model's spans in a text, as detections of full confidence."""
    at = lambda s: F.transform(
        occurrences(text, s["value"]),
        lambda i: F.struct(s["type"].alias("type"), s["value"].alias("value"), i.alias("start"), (i + F.length(s["value"])).cast("int").alias("end"), F.lit(1.0).alias("confidence"), F.lit("local-ai-span").alias("source")),
    )
    return F.flatten(F.transform(spans, at))
