"""Canonical exact fingerprints of documents, by SQL functions alone.

A text is normalised (NFKC), case-folded (all of Unicode: ß as ss, final sigmas as others) and normalised again, and its runs of white space become single blanks without those at the ends.
Its digest is 128 bits: two xxHash64 values of the canonical text with different beginnings.  Texts that share a digest are
compared byte by byte; should two different canonical texts ever share one, their fingerprints get a number each.

Being exact, fingerprints are alike entirely or not at all: likeness is 1 or 0.

Cases: null text is empty, and empty texts are equal to each other; null ``doc_id`` values come first and equal ones are
ordered by text; a single document is its own next one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import partitions, range_bucket, range_edges, written

#: What comes before the text in the second hash.
SALT = "canonical text"


def canonical(text: Column) -> Column:
    """The canonical form; ICU, which Spark brings along, normalises and folds."""
    normal = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), normal(text), F.lit(True))
    return F.trim(F.regexp_replace(normal(folded), r"(?U)\s+", " "))


def wide_hash(form: Column) -> list[Column]:
    """Two hashes of a canonical form."""
    return [F.xxhash64(form), F.xxhash64(F.lit(SALT), form)]


def hex_digest(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def clashes(forms: DataFrame) -> DataFrame:
    """Numbers for different canonical texts that share a digest: h1, h2, form, nth (0 for the first); usually none.

    ``forms`` (h1, h2, form).  Only the least and greatest text of a digest leave a task.
    """
    # a window over a digest's texts would move them all; least and greatest differ only if two texts do
    unequal = forms.groupBy("h1", "h2").agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select("h1", "h2")
    own = forms.join(unequal, ["h1", "h2"], "left_semi").distinct()
    return own.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("form")) - 1)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, copies (rows with that fingerprint) of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    form = docs.select("doc_id", canonical(text).alias("form"))
    hashed = form.select("doc_id", "form", *(h.alias(n) for h, n in zip(wide_hash(F.col("form")), ("h1", "h2"), strict=True)))
    shared = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    shared = written(shared.where("copies > 1"), "shared")
    odd = written(clashes(hashed.join(shared, ["h1", "h2"], "left_semi").select("h1", "h2", "form")), "clashes")
    if odd.isEmpty():
        out = hashed.select("doc_id", "h1", "h2").join(shared, ["h1", "h2"], "left")
        return out.select("doc_id", hex_digest(F.col("h1"), F.col("h2")).alias("fingerprint"), F.coalesce("copies", F.lit(1)).alias("copies"))
    named = hashed.join(odd, ["h1", "h2", "form"], "left").select("doc_id", _named("h1", "h2", "nth").alias("fingerprint"))
    many = named.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    return named.join(many, "fingerprint").select("doc_id", "fingerprint", "copies")


def _named(high: str, low: str, nth: str) -> Column:
    return F.concat(hex_digest(F.col(high), F.col(low)), F.when(F.col(nth) > 0, F.concat(F.lit("-"), F.col(nth))).otherwise(""))


def _with_next(docs: DataFrame) -> DataFrame:
    """at (doc_id, null lowest), text, h1, h2 and those of the next row in ascending order; the first follows the last.

    Rows are dealt into ranges of ``doc_id``; each range also gets the first row of the next range.
    """
    spark = docs.sparkSession
    edges = range_edges(docs, "doc_id", partitions(spark))
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"), text, range_bucket(F.col("doc_id"), edges).alias("bucket"))
    least = rows.groupBy("bucket").agg(F.min("at").alias("at"))  # one row a range
    order = Window.orderBy("bucket")
    least = least.withColumn("to", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = rows.join(F.broadcast(least), ["bucket", "at"]).groupBy("to").agg(F.min(F.struct("text", "doc_id", "at")).alias("x"))
    heads = heads.select("x.doc_id", "x.at", "x.text", F.col("to").alias("bucket"), F.lit(1).alias("extra"))
    both = rows.withColumn("extra", F.lit(0)).unionByName(heads).repartitionById(len(edges) + 1, "bucket")
    form = both.withColumn("form", canonical(F.col("text")))
    form = form.select("doc_id", "at", "text", "bucket", "extra", *(h.alias(n) for h, n in zip(wide_hash(F.col("form")), ("h1", "h2"), strict=True)))
    by = Window.partitionBy("bucket").orderBy("extra", "at", "text")
    follow = {f"next_{c}": F.lead(c).over(by) for c in ("at", "text", "h1", "h2")}
    return form.select("*", *(c.alias(n) for n, c in follow.items())).where("extra = 0")


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with its last half (rounded down, in code points) replaced by the beginning of ``following``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edits(docs: DataFrame) -> DataFrame:
    """Every text and its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = _with_next(docs).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("form", canonical(F.col("edited")))
    rows = written(
        rows.select(
            "doc_id", "at", "next_at", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            "h1", "h2", "next_h1", "next_h2", *(h.alias(n) for h, n in zip(wide_hash(F.col("form")), ("e1", "e2"), strict=True)),
        ),
        "hashed",
    )
    about = ["h1", "h2", "at", "next_h1", "next_h2", "next_at"]
    pair = lambda a, b, kind: rows.select(F.col(a).alias("d1"), F.col(b).alias("d2"), F.lit(kind).alias("kind"), *about)
    every = pair("h1", "h2", 0).unionByName(pair("e1", "e2", 1))
    shared = every.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2")
    shared = written(every.join(shared, ["d1", "d2"], "left_semi").distinct(), "shared")
    # the texts of equal digests alone are fetched again, by id and digest, to be compared
    wanted = shared.select("at").union(shared.where("kind = 1").select("next_at")).distinct()
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    text = text.join(wanted.hint("merge"), "at", "left_semi").withColumn("form", canonical(F.col("text")))
    # rows that share id and canonical text are one here; texts are dealt by id at every size
    text = text.select("at", *(h.alias(n) for h, n in zip(wide_hash(F.col("form")), ("h1", "h2"), strict=True)), "form", "text").dropDuplicates(["at", "h1", "h2", "text"])
    own = text.join(shared.where("kind = 0").select("at", "h1", "h2").distinct(), ["at", "h1", "h2"], "left_semi").select("h1", "h2", "form")
    following = text.select(*(F.col(c).alias(f"next_{c}") for c in ("at", "h1", "h2", "text")))
    made = shared.where("kind = 1").join(text.drop("form"), ["at", "h1", "h2"]).join(following, ["next_at", "next_h1", "next_h2"])
    made = made.select(F.col("d1").alias("h1"), F.col("d2").alias("h2"), canonical(edited_text(F.col("text"), F.col("next_text"))).alias("form"))
    forms = own.unionByName(made)
    again = wide_hash(F.col("form"))  # rows that share id and digest with another text are told apart by their digest
    odd = written(clashes(forms.where((again[0] == F.col("h1")) & (again[1] == F.col("h2"))).select("h1", "h2", "form")), "clashes")
    same = lambda a, b: ((F.col(a[0]) == F.col(b[0])) & (F.col(a[1]) == F.col(b[1]))).cast("double")
    if odd.isEmpty():
        return rows.select(
            "doc_id", "n_chars", "edited_sha256", hex_digest(F.col("h1"), F.col("h2")).alias("fingerprint"), hex_digest(F.col("e1"), F.col("e2")).alias("edited_fingerprint"),
            same(("h1", "h2"), ("e1", "e2")).alias("near_edited"), same(("h1", "h2"), ("next_h1", "next_h2")).alias("near_next"),
        )
    # two texts share a digest: name every text by its digest and number
    whole = _with_next(docs)
    whole = whole.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    named = whole.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *(canonical(F.col(c)).alias(c) for c in ("text", "edited", "next_text")))
    for column, name in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "next_fingerprint")):
        high, low = wide_hash(F.col(column))
        number = odd.select(F.col("h1").alias("high"), F.col("h2").alias("low"), F.col("form").alias(column), "nth")
        named = named.withColumn("high", high).withColumn("low", low).join(number, ["high", "low", column], "left").withColumn(name, _named("high", "low", "nth")).drop("high", "low", "nth")
    alike = lambda name: (F.col("fingerprint") == F.col(name)).cast("double")
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("edited_fingerprint").alias("near_edited"), alike("next_fingerprint").alias("near_next"))
