"""The background flows as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docscreen.sources import ingest


FILES = "path string, modificationTime timestamp, length long, content binary"


def process(spark: SparkSession, folder: str, sink: str, checkpoint: str, screen: Callable[[DataFrame], DataFrame]):
    """Screens the files of a folder as they come. The checkpoint remembers what is done, and each micro-batch writes
    its own folder by overwriting it, so a restart repeats nothing and loses nothing. Faulty files become rows with an
    error."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)

    def each(batch: DataFrame, number: int) -> None:
        rows = ingest.accepted(ingest.identified(batch))
        good = screen(rows.where("error is null")).withColumn("error", F.lit(None).cast("string"))
        good.unionByName(rows.where("error is not null").drop("content"), allowMissingColumns=True).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def action_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Audit events by action and tumbling window; ts without a zone is taken as UTC."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return ts.withWatermark("ts", late).groupBy(F.window("ts", window), "action").count()


def fresh(documents: DataFrame, late: str = "1 day") -> DataFrame:
    """Documents whose content hasn't come within the watermark: a bounded form of the whole-history probe."""
    return documents.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["sha256"])
