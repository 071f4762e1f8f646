"""Running term counts over a stream of texts, and windowed counts over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.staging import folder


def running_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """w, n so far; a stateful aggregation on the term."""
    w = F.explode(F.regexp_extract_all(F.lower(F.col(column)), F.lit("[a-z]+"), 0))
    return texts.select(w.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """window start, key, n, total of ``value``; rows later than ``late`` are dropped by the watermark."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), key)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def run_available(df: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> StreamingQuery:
    """Process what is there and stop; the result is a table in the shared folder, seen as the view ``name``.

    In complete mode each batch's result replaces the one before, else they are appended.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], df.schema).write.parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    writer = df.writeStream.outputMode(mode).foreachBatch(keep).trigger(availableNow=True)
    query = writer.option("checkpointLocation", checkpoint or f"{path}-checkpoint").start()
    query.awaitTermination()
    spark.read.schema(df.schema).parquet(path).createOrReplaceTempView(name)
    return query
