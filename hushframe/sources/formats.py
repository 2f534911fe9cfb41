"""Small formats around the engine: env files, JSON session vaults, data URLs, file manifests, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What images begin with, and their bounds.
IMAGE_BYTES = 8 << 20
MAGIC = {"image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF", "image/webp": "52494646"}


def env_entries(lines: Column) -> Column:
    """name and value of a KEY=VALUE line; null for comments and other lines.  Quotes around a value go."""
    line = F.trim(lines)
    name = F.regexp_extract(line, r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1)
    raw = F.trim(F.regexp_replace(line, r"^[^=]*=", ""))
    value = F.when(raw.rlike(r"""^(["']).*\1$"""), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(~line.startswith("#") & (name != ""), F.struct(name.alias("name"), value.alias("value")))


def read_env(spark: SparkSession, path: str) -> DataFrame:
    """The entries of an env file; the last of a name wins."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), env_entries(F.col("value")).alias("e")).where("e is not null")
    return rows.groupBy("e.name").agg(F.max_by("e.value", "n").alias("value"))


def merged_config(own: DataFrame, over: DataFrame) -> DataFrame:
    """name, value: non-empty values of ``over`` before those of ``own``."""
    return own.withColumnRenamed("value", "a").join(over.withColumnRenamed("value", "b"), "name", "full").select("name", F.coalesce(F.when(F.col("b") != "", F.col("b")), "a").alias("value"))


def data_url(url: Column) -> Column:
    """mime, bytes and error_code of an image data URL: known type, whole base64, matching first bytes, not too large."""
    mime = F.regexp_extract(url, r"^data:(image/(?:png|jpeg|webp));base64,", 1)
    body = F.regexp_extract(url, r"^data:image/(?:png|jpeg|webp);base64,([A-Za-z0-9+/]*={0,2})$", 1)
    whole = (body != "") & (F.length(body) % 4 == 0)
    raw = F.when(whole, F.unbase64(body))
    head = F.hex(F.substring(raw, 1, 8))
    fits = F.coalesce(*(F.when(mime == m, head.startswith(x)) for m, x in MAGIC.items()), F.lit(False))
    error = F.when(mime == "", "UNSUPPORTED_IMAGE").when(~whole, "INVALID_BASE64").when(F.octet_length(raw) > IMAGE_BYTES, "IMAGE_TOO_LARGE").when(~fits, "IMAGE_TYPE_MISMATCH")
    return F.struct(F.when(mime != "", mime).alias("mime"), F.octet_length(raw).alias("bytes"), error.alias("error_code"))


def file_manifest(spark: SparkSession, path: str, most_bytes: int = 1 << 20) -> DataFrame:
    """path, length, content_hash of the files below a folder, those above ``most_bytes`` left out before they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.col("length") <= most_bytes).select("path", "length", F.sha2("content", 256).alias("content_hash"))


def within_bytes(text: Column, limit: int) -> Column:
    """Whether a body is within its byte limit."""
    return F.octet_length(text) <= limit


def write_sessions(sessions: DataFrame, path: str, buckets: int = 64) -> None:
    """Session maps as JSON lines, in folders by a digest of the session key."""
    bucket = F.pmod(F.xxhash64("session_key"), F.lit(buckets)).cast("int").alias("bucket")
    sessions.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").json(path)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session maps written by :func:`write_sessions`: session_key, session."""
    return spark.read.schema("session_key string, session map<string,string>, bucket int").json(path).drop("bucket")


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """A table stored as Parquet, and its row count and order-free checksum."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64(*back.columns)).alias("checksum"))


def content_tiers(files: DataFrame, last: DataFrame, blobs: DataFrame) -> DataFrame:
    """How each file's content is known: ``tier`` is metadata, blob or read.

    ``files``: doc_id, n_chars, h (digest); ``last``: doc_id and size when it was last read; ``blobs``: digests at hand.
    """
    rows = files.join(last, "doc_id", "left").join(blobs.select("h", F.lit(True).alias("_blob")), "h", "left")
    tier = F.when(F.col("size") == F.col("n_chars"), "metadata").when(F.col("_blob"), "blob").otherwise("read")
    return rows.withColumn("tier", tier).drop("size", "_blob")
