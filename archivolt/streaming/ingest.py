"""Evidence that keeps arriving: an addition to the batch operators, with the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def first_deliveries(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Each record once: its first delivery within the watermark of ``registered_at``. State older than that is dropped."""
    return stream.filter("record_id is not null and registered_at is not null").withWatermark("registered_at", late).dropDuplicatesWithinWatermark(["record_id"])


def by_hour(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(hour, source_category, records): deliveries by hour of registration."""
    return stream.withWatermark("registered_at", late).groupBy(F.window("registered_at", "1 hour").alias("w"), "source_category").agg(F.count("*").alias("records")).select(F.col("w.start").alias("hour"), "source_category", "records")


def written(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there to Parquet, exactly once, and ends."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
