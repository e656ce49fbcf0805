"""Micro-batch jobs over landed event files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder of the session. Where none is set, a temporary one in local mode; on a cluster that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_counts(events: DataFrame, folder: str, by: str = "event_type", ts: str = "ts", length: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """at, by, n: rows of a stream per tumbling window, after all files that are there now.

    Each micro-batch writes its updated windows to a folder of its number, so a batch that is run again replaces its own
    rows; the latest batch wins. The watermark bounds the state; rows later than `late` behind it go, as do null times."""
    spark = events.sparkSession
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, length)["start"].alias("at"), by).agg(F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    schema = counts.withColumn("batch", F.lit(0).cast("int")).schema
    return spark.read.schema(schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out").groupBy("at", by).agg(F.max_by("n", "batch").alias("n"))
