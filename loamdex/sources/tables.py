"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; all paths of an application lie in one folder."""
    return f"{shared_folder(spark)}/loamdex/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored; no result that is still to be read may come from it."""
    remove(spark, f"{shared_folder(spark)}/loamdex/{spark.sparkContext.applicationId}")


_made: list[list[str]] = []


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, as a stored table; all that was stored on the way to it is deleted."""
    _made.append([])
    try:
        out = stored(make(), name, scratch=False)
    finally:
        for path in _made.pop():
            remove(spark, path)
    return out


def stored(df: DataFrame, name: str, scratch: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and lost executors cost a re-read.  scratch: settled() may delete it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    for paths in _made if scratch else _made[:-1]:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
