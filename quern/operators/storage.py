"""Results that must not be computed twice: written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder, if one was made.
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set a temporary one, but only if all runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = _own[0] if _own else f"file://{tempfile.mkdtemp(prefix='quern-')}"
        _own[:] = [folder]
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and reads it back."""
    path = scratch(df.sparkSession, "stable")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
