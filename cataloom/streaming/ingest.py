"""Run logs as a stream: new files are framed and upserted into a snapshot catalog batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cataloom.operators.keys import latest
from cataloom.sources import runlogs
from cataloom.sources.store import Store


def log_stream(spark: SparkSession, path: str, glob: str = "*.{log,txt}") -> DataFrame:
    """path, mtime, text of log files as they come."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def ingest_runs(spark: SparkSession, logs: str, store: str, checkpoint: str, least_build: int = runlogs.LEAST_BUILD, buckets: int = 64) -> StreamingQuery:
    """Keeps the store's tables ``runs``, one row by (log file, frame), and ``batches``, from log files that appear under ``logs``. Processes what is there and stops.

    A batch reads and writes only the buckets that its logs fall in, and both tables change in one commit. A batch that is run again after a failure is
    known by its stream and number in ``batches`` and passed over.
    """
    target = Store(spark, store, buckets)

    def one(batch: DataFrame, number: int) -> None:
        version = target.version()
        told = spark.createDataFrame([(checkpoint, number)], "stream string, batch long")
        own = told.select(target.bucket("stream", "batch")).first()[0]
        before = target.read("batches", version, [own])
        if before is not None and not before.join(told, ["stream", "batch"], "left_semi").isEmpty():
            return
        found = runlogs.runs(runlogs.frames(batch), least_build).withColumn("seen", F.col("mtime"))
        touched = [r[0] for r in found.select(target.bucket("log_file")).distinct().collect()]  # as many as there are buckets at most
        old = target.read("runs", version, touched)
        rows = found if old is None else old.unionByName(found)
        values = [c for c in rows.columns if c not in ("log_file", "frame")]
        merged = latest(rows, ["log_file", "frame"], values, ["seen", "timestamp"]).select(rows.columns)
        told = told if before is None else before.unionByName(told)
        target.commit({"runs": (merged, ["log_file"]), "batches": (told, ["stream", "batch"])}, version)

    return log_stream(spark, logs).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, stamp: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by time window and key; late rows beyond the watermark are dropped in a stream, none in a batch."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
