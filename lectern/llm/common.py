"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound on what any operator here broadcasts, in bytes.
BROADCAST_BYTES = 64 << 20
#: Whether Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session has none and runs on one machine (tests, a laptop) is a local folder made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has written to. What is still there when the application ends goes then."""
    sc = spark.sparkContext
    own = f"{shared_dir(spark)}/lectern/{sc.applicationId}"
    if getattr(sc, "_lectern_own", None) != own:
        where = spark._jvm.org.apache.hadoop.fs.Path(own)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
        sc._lectern_own = own
    return f"{own}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages restart from there when executors are lost.

    As the table is whole then, the shuffle files of the write go at its end, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    spark.sparkContext.setJobDescription(label)
    try:
        df.write.parquet(path)
    finally:
        spark.sparkContext.setJobDescription(None)
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one run; those that nothing reads any more are removed, so that disk holds what is in use."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: list[tuple[DataFrame, str]] = []
        self.sent: list = []

    def broadcast(self, value):
        """A broadcast that lasts as long as the tables."""
        self.sent.append(self.spark.sparkContext.broadcast(value))
        return self.sent[-1]

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh_path(self.spark, label)
        out = written(df, label, path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables that ``write`` returned. What was made from them must be written by now."""
        for path in [p for df, p in self.held if any(df is x for x in tables)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.held = [(df, p) for df, p in self.held if not any(df is x for x in tables)]

    def clear(self) -> None:
        self.drop(*(df for df, _ in self.held))
        for b in self.sent:
            b.unpersist()
        self.sent = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(id_col: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


#: Most bytes of a batch that goes to Python, where the session has Spark's default of 64 MB: each batch stands in memory
#: on both sides, for each core.
BATCH_BYTES = 4 << 20


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once the executors can import this package: sent along where the session hasn't done so yet."""
    import zipfile
    from pathlib import Path

    spark = df.sparkSession
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("64MB", "67108864b", "67108864"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not getattr(sc, "_lectern_sent", False):
        top = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="lectern-"), "lectern_package.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(archive))
        sc._lectern_sent = True
    return df


def release() -> None:
    """Give back to the system what a task has freed: workers live on, and would keep it beside the next operator's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def mapped(df: DataFrame, f: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` on executors that have this package, whose workers release memory at a task's end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            release()

    return shipped(df).mapInArrow(run, schema)
