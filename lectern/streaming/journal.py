"""Logs that streams write: each event once, whatever fails and is run again.

A micro-batch's lines go to a folder of their own attempt; then an entry of the manifest, made by one rename, names that
folder. Readers see the folders that entries name: whole batches, each once, and nothing of attempts that failed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.logs import event_lines, read_lines, session_files


def _store(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a function that makes its paths."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark._jsc.hadoopConfiguration()), to


def _enter(spark: SparkSession, path: str, number: int, folder: str) -> bool:
    """Put a batch into the manifest; False if another attempt has done so."""
    store, to = _store(spark, path)
    entry, draft = f"{path}/manifest/{number:012d}.json", f"{path}/drafts/{uuid.uuid4().hex}.json"
    out = store.create(to(draft), False)
    out.write(bytearray(json.dumps({"batch": number, "folder": folder}).encode()))
    out.close()
    store.mkdirs(to(f"{path}/manifest"))
    won = not store.exists(to(entry)) and store.rename(to(draft), to(entry))
    if not won:
        store.delete(to(draft), False)
    return won


def append_batch(events: DataFrame, path: str, number: int) -> bool:
    """Append a micro-batch's events (ts, event and whatever else) to a log, under the batch's number. A batch that is in the
    log already stays as it is: False. An empty batch is entered too."""
    spark = events.sparkSession
    path = path.rstrip("/")
    store, to = _store(spark, path)
    if store.exists(to(f"{path}/manifest/{number:012d}.json")):
        return False
    folder = f"lines/batch={number}/{uuid.uuid4().hex}"
    event_lines(events).write.text(f"{path}/{folder}")
    won = _enter(spark, path, number, folder)
    if not won:
        store.delete(to(f"{path}/{folder}"), True)
    return won


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all batches in a log's manifest: batch, path (the log's), line_no (in a batch), line. No manifest, no lines.

    The manifest's entries are listed in the driver, as Spark lists the files to read."""
    path = path.rstrip("/")
    store, to = _store(spark, path)
    if not store.exists(to(f"{path}/manifest")):
        return spark.createDataFrame([], "batch long, path string, line_no long, line string")
    folders = [f"{path}/{r.folder}" for r in spark.read.schema("batch long, folder string").json(f"{path}/manifest").collect()]
    lines = read_lines(spark, folders) if folders else spark.createDataFrame([], "path string, line_no long, line string")
    return lines.select(F.regexp_extract("path", r"/batch=(\d+)/[0-9a-f]+/", 1).cast("long").alias("batch"), F.lit(path).alias("path"), "line_no", "line")


def journal(events: DataFrame, path: str, checkpoint: str):
    """Start the stream that appends ``events`` to a log."""

    def write(batch: DataFrame, number: int) -> None:
        append_batch(batch, path, number)

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()


def write_session(spark: SparkSession, path: str) -> None:
    """Write what a log says of its session (see ``session_files``) as JSON beside it, in place of what stood there."""
    session_files(read_journal(spark, path)).write.mode("overwrite").json(f"{path.rstrip('/')}/session")
