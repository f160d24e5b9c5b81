"""Extensions: the incremental batch operators as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.sources.tables import exists, upsert


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Landed Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours", time: str = "ts", group: str = "event_type", value: str = "value") -> DataFrame:
    """Rows (start, group, n, total) per window; what is later than the watermark is left out."""
    windows = events.withWatermark(time, late) if events.isStreaming else events
    out = windows.groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), group, "n", "total")


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Keeps the last row of each key in a table of numbered versions; a repeated batch rewrites its own version.

    ``path`` holds ``v=<batch>`` folders; readers take the highest."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v={number - 1}"
        old = spark.read.parquet(before) if number and exists(spark, before) else batch.limit(0)
        upsert(old, batch, keys, order).write.mode("overwrite").parquet(f"{path}/v={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The highest version of such a table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    versions = [int(x.getPath().getName()[2:]) for x in found if x.getPath().getName().startswith("v=")]
    return spark.read.parquet(f"{path}/v={max(versions)}")
