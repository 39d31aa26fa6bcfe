"""Written tables in the folder all executors share.

Intermediate tables are cut here rather than kept in executor storage, so losing an executor never
loses them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="nestplane-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Workspace:
    """A fresh subfolder of the shared folder, one per job."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/nestplane/{purpose}-{uuid.uuid4().hex}"
        self.written: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df`` as parquet, in folders ``by`` a column if given, and give back a reader of it."""
        where = f"{self.path}/{name}"
        (df.write.partitionBy(by) if by else df.write).parquet(where)
        stored = self.spark.read.schema(df.schema).parquet(where)
        self.written[id(stored)] = (stored, where)
        return stored

    def follow(self, reader: DataFrame, stored: DataFrame) -> None:
        """Let ``reader``, made from ``stored``, stand for its table in ``drop``."""
        self.written[id(reader)] = (reader, self.written.pop(id(stored))[1])

    def drop(self, stored: DataFrame, keep_part: int | None = None) -> None:
        """Delete a table this workspace wrote, once nothing reads it any more; the folder of ``keep_part`` may stay."""
        _, where = self.written.pop(id(stored), (None, None))
        if where is not None:
            fs, path = _folder(self.spark, where)
            if keep_part is None:
                fs.delete(path, True)
            else:
                for found in fs.globStatus(path.suffix("/part=*")):
                    if found.getPath().getName() != f"part={keep_part}":
                        fs.delete(found.getPath(), True)

    def clear(self) -> None:
        """Delete the whole folder, once nothing reads it any more."""
        self.written.clear()
        fs, path = _folder(self.spark, self.path)
        fs.delete(path, True)


def exists(spark: SparkSession, where: str) -> bool:
    fs, path = _folder(spark, where)
    return fs.exists(path)


def delete(spark: SparkSession, where: str) -> None:
    fs, path = _folder(spark, where)
    fs.delete(path, True)


def _folder(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
