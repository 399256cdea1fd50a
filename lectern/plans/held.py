"""Tables that a plan of several rounds writes between them, so that each round's plan is short and restarts from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; on one machine (tests) a local one, if none is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.getCheckpointDir():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return (named or sc.getCheckpointDir()).rstrip("/")


class Held:
    """Written tables of one run, and where they are."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}/held-{uuid.uuid4().hex}"
        self.count = 0
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.path}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove all tables: nothing may read them any more."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
