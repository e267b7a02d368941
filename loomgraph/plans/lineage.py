"""Cutting lineage in iterative plans, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame


def folder(spark) -> str:
    """spark.checkpoint.dir; on one machine (tests), where that is unset, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder. Where spark.cleaner.referenceTracking.cleanCheckpoints is true, Spark
    removes it when nothing refers to it any more; else it stays until the folder is emptied."""
    folder(df.sparkSession)
    return df.checkpoint()


class Steps:
    """Tables of a loop, as Parquet in the shared folder; a new one of a name takes the old one's place.

    The planner knows their size by their files. A checkpoint's is the one its plan was estimated at, and joins multiply estimates, so in a loop
    that joins what it made before they get three times the digits in each turn, until they fill the driver."""

    def __init__(self, spark):
        self.spark, self.root, self.at = spark, f"{folder(spark)}/loomgraph/{uuid.uuid4().hex}", {}
        atexit.register(self._end)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df, computed once. What read the last table of that name must have been computed."""
        n = self.at[name] = self.at.get(name, 0) + 1
        df.write.parquet(f"{self.root}/{name}-{n}")
        remove(self.spark, f"{self.root}/{name}-{n - 1}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}-{n}")

    def _end(self) -> None:
        if self.spark.sparkContext._jsc is not None:  # a stopped session leaves nobody to ask
            with contextlib.suppress(Exception):
                remove(self.spark, self.root)


# --- stored tables --------------------------------------------------------------------------------------------


def _files(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)


def publish(spark, made: str, path: str) -> None:
    """Moves a finished folder to its name; where another writer was first, that one's stays and this one goes."""
    target, files = _files(spark, path)
    source = _files(spark, made)[0]
    if not files.exists(target):
        files.mkdirs(target.getParent())
        if files.rename(source, target):
            return
    files.delete(source, True)


def drop_others(spark, path: str, keep: str) -> None:
    """Removes what stands under path and does not begin with `keep`, but for what is still being built."""
    root, files = _files(spark, path)
    for other in files.listStatus(root) if files.exists(root) else ():
        name = other.getPath().getName()
        if not name.startswith((keep, "building-")):
            files.delete(other.getPath(), True)


def remove(spark, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)
