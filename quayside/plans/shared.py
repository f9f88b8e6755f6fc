"""Tables in the folder that driver and executors share: where a lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session, as in tests, gets a temporary one where none is named."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="quayside-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def barrier(df: DataFrame, name: str) -> DataFrame:
    """Writes a stage to the shared folder and reads it back: lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Stages:
    """Stages of one operator in the shared folder. It drops those that its result does not read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """Hints a broadcast where the rows, counted, stay under the limit; else Spark shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """For work that is far dearer than reading: rows dealt to all cores where the input is too small to be read by all.

    By the optimizer's estimate; a larger input has a partition for every core by itself and is not moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    whole = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    piece = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if whole < cores * piece else df
