"""Tables in the folder that driver and executors share, to cut lineage between rounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a settled table lies, as an attribute of its DataFrame.
_PLACE = "_settled_at"


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Unset, a folder of our own on a local master; on a cluster that is an error, since executors would write where no one else looks."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='graphloom-')}")
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder; what is written there goes when the session ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    place, fs = _folder(spark, path)
    fs.mkdirs(place)
    fs.deleteOnExit(place)  # only of what exists, so the place itself is a folder within it
    return f"{path}/data"


def settled(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` written as Parquet and read back.

    A lost executor then costs the reading of a file, not the whole computation.
    ``release`` deletes the files; the rest go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place, fs = _folder(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PLACE, path)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes the files of settled tables that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, _PLACE, None)
        if path is not None:
            target = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
            setattr(table, _PLACE, None)
