"""Extension: the request ledger as a stream, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def hourly(events: DataFrame) -> DataFrame:
    """Number and total of the events of each type and hour; the same plan for a table and a stream."""
    w = F.window(F.col("ts"), "1 hour")
    totals = events.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return totals.select("event_type", F.col("w.start").alias("window_start"), "n", "total")


def stream(spark: SparkSession, folder: str, late: str = "2 hours") -> DataFrame:
    """The hourly totals of a folder that receives JSON events; rows later than ``late`` are left out."""
    return hourly(spark.readStream.schema(SCHEMA).json(folder).withWatermark("ts", late))
