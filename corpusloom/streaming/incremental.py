"""New documents as a stream: each is classified and described once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.pipeline import enrich


def documents(spark: SparkSession, folder: str, schema: str, per_trigger: int = 16) -> DataFrame:
    """Parquet files that appear in ``folder``, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def first_deliveries(stream: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """The first row of each key; repeated deliveries within ``late`` are dropped
    and the state of keys older than that is forgotten."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Rows in each window of event time, late ones included up to ``late``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))


def enrich_to(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the enriched rows of each batch to ``out``; a batch that is repeated
    after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        enrich(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
