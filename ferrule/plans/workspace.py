"""Tables written on the way to a result, in a folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, as in tests, may leave it unset."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="ferrule-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


class Workspace:
    """Written intermediate tables in the shared folder: lineage ends there, so a lost executor re-reads instead of recomputing.

    Results read them when they run, so the folder is deleted as the session's file system closes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        system, path = self._system(self.root)
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _system(self, where: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def file(self, name: str) -> str:
        """A path for a file that is no Spark table; the shared folder must then be a mounted one."""
        where = self._system(self.path(name))[1].toUri()
        if where.getScheme() not in (None, "file"):
            raise ValueError(f"{self.root} is no folder that all machines mount")
        return where.getPath()

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> tuple[str, DataFrame]:
        where = self.path(name)
        df.write.option("compression", codec).parquet(where)
        return where, self.spark.read.schema(df.schema).parquet(where)

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        return self.write(df, name, codec)[1]

    def release(self) -> None:
        """Let Spark delete shuffle files of finished steps: it does so once the driver's collector has met them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, where: str) -> None:
        """Delete a table that a later one replaces."""
        system, path = self._system(where)
        system.delete(path, True)
