"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a table and reading it again, so a lost executor
costs a re-read and never a recomputation. The folder is the one the cluster
names in ``spark.checkpoint.dir``; only a local session without that setting
gets a temporary one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gleaner-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Workspace:
    """Written tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def keep(self, frame: DataFrame, table: str) -> DataFrame:
        """Write ``frame`` and return it as read back."""
        frame.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(frame.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_checked(large: DataFrame, small: DataFrame, on, how: str, most_rows: int) -> DataFrame:
    """Join with ``small`` broadcast only if it has at most ``most_rows`` rows.

    ``small`` must be a written table, so that counting it reads a footer. A
    larger one is joined by shuffle, where AQE may split skewed partitions.
    """
    if small.count() <= most_rows:
        small = F.broadcast(small)
    return large.join(small, on, how)
