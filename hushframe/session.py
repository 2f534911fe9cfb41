"""Making this package importable in Spark's Python workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_KEPT: list[str] = []


#: Deletes the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """The shared folder that the session names; one of its own only where none is named."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="hushframe-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder: for texts, which a checkpoint would hold as they are.

    What was shuffled to make it is deleted at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path, before = f"{_folder(spark)}/{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # the execution takes the setting over when it begins
        df.write.option("compression", "zstd").parquet(path)
    finally:
        _KEPT.append(path)
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table of :func:`kept`; call it once what uses them has been stored."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _KEPT:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        path.getFileSystem(conf).delete(path, True)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source files to the executors of the session, once an application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        out = Path(tempfile.mkdtemp(prefix="hushframe-src-")) / "hushframe.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(out))
        _SHIPPED.add(app)
        # rows hold whole texts: the default of 10,000 to a batch is too many
        if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        # and a thousand long ones are too many as well
        if spark.sparkContext.getConf().get("spark.sql.execution.arrow.maxBytesPerBatch") is None:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark
