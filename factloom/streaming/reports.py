"""The feed of committed transactions as a structured stream over the log's folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factloom.sources.facts import LOG


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Facts as they are committed under path/log."""
    return spark.readStream.schema(T._parse_datatype_string(LOG)).option("basePath", f"{path}/log").parquet(f"{path}/log")


def subscribe(spark: SparkSession, path: str, checkpoint: str, on_tx: Callable[[DataFrame], None], from_t: int = 0, once: bool = True) -> StreamingQuery:
    """Calls on_tx with each batch's facts after from_t, in order of (t, seq); where it has got to is in checkpoint."""

    def batch(df: DataFrame, _: int) -> None:
        rows = df.where(F.col("t") > from_t).orderBy("t", "seq", "e", "attr")
        if not rows.isEmpty():
            on_tx(rows)

    writer = reports(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by window and type, batch or stream; an extension."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
