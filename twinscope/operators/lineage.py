"""Cutting the lineage of a table in the folder that the executors share.

A checkpoint keeps the size estimates of the plan it replaces, which multiply from join to
join. A table that is written and read again has the size of its files, so the plans of
later stages stay as small as those of the first.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session that names
    none gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="twinscope-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete what :func:`cut` has written; plans that read it are then void."""
    while _written:
        session, path = _written.pop()
        jvm = session.sparkContext._jvm
        if jvm is not None:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _at_exit() -> None:
    try:
        release()
    except Exception:  # the session was stopped before
        pass
