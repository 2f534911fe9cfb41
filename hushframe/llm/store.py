"""Shared-folder tables: how the operators of this subpackage cut lineage.

Driver and executors share only the folder named by ``spark.checkpoint.dir``; every intermediate that must survive a
lost executor is a table or a file written there.  The folder is read from the session; one is made only where the
setting is absent (single-machine tests).
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LOCAL: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, without a trailing slash."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="hushframe-")
            spark.sparkContext.setCheckpointDir(_LOCAL[app])
        found = _LOCAL[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/hushframe/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as a table in the shared folder and read back: later plans start from the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for :func:`release`."""
    return len(_WRITTEN)


def release(spark: SparkSession, keep: str | None = None, since: int = 0) -> None:
    """Delete every intermediate written (since a :func:`mark`) but ``keep``; call it once what uses them has been stored."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = [p for p in _WRITTEN[since:] if p != keep]
    _WRITTEN[since:] = [keep] if keep in _WRITTEN[since:] else []
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        with contextlib.suppress(Exception):
            path.getFileSystem(conf).delete(path, True)


def filesystem(uri: str):
    """The Arrow file system and the path inside it for a URI of any scheme that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


def partitions(spark: SparkSession) -> int:
    """The cluster's shuffle width; operators that lay out their own partitions follow it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_edges(df: DataFrame, column: str, n: int) -> list:
    """Ascending cut points that deal ``column`` into ``n`` ranges of about equal row counts; reads only that column."""
    if n < 2:
        return []
    probs = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(column, probs, max(10_000, 50 * n)).alias("q")).head()
    return sorted(set((got and got["q"]) or []))


def range_bucket(column, edges: list):
    """Bucket number of a value: how many edges are at or below it, found by halving; null goes to bucket 0."""

    def halve(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(edges[mid]), halve(mid + 1, hi)).otherwise(halve(lo, mid))

    return halve(0, len(edges)).cast("int")


def plain_names(df: DataFrame, taken: Iterable[str] = ()) -> DataFrame:
    """``df`` with other names for columns that Python functions cannot take: repeated ones, those with odd characters, those ``taken``."""
    seen = {c.lower() for c in taken}
    names = []
    for i, c in enumerate(df.columns):
        names.append(c if re.fullmatch(r"\w+", c) and c.lower() not in seen else f"_column_{i}")
        seen.add(c.lower())
    return df.toDF(*names)


def quoted(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
