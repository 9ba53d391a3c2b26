"""Intermediate tables on reliable storage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured a local master gets a temporary one; a cluster has to name its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quirefold-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_folders: set[str] = set()


def _removed(spark: SparkSession, folder: str) -> None:
    """Deletes the application's own settled tables when its driver ends in good order."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or jsc is None:  # the context has been stopped
        return
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage on reliable storage (a lost executor costs a reread, not a recomputation), gives Catalyst true
    sizes, and lets a column be read alone.
    """
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/quirefold/{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        atexit.register(_removed, spark, own)
    at = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
