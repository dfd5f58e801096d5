"""Incremental conversion: new files or rows are converted once, against a manifest that only grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).parquet(folder)


def incremental(source: DataFrame, key: str, convert: Callable[[DataFrame], DataFrame], manifest: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Convert each batch's rows whose ``key`` the manifest (Parquet, columns key and more) does not hold yet.

    Rows of one key within a batch count once; a repeated batch writes nothing twice, because its rows are written
    under their batch number. Null keys are never held to be done."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(batch.filter(F.col(key).isNull()))
        try:
            done = spark.read.parquet(manifest).filter(F.col("batch") != number).select(F.col(key).alias("__done"))
            new = new.join(done, new[key] == done["__done"], "left_anti")
        except Exception as e:  # no manifest yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        convert(new).write.mode("overwrite").parquet(f"{manifest}/batch={number}")

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(events: DataFrame, ts: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Records and characters by window of arrival; rows later than ``delay`` are left out."""
    w = F.window(ts, window)
    return events.withWatermark(ts, delay).groupBy(w.alias("window")).agg(F.count("*").alias("records"), F.sum("n_chars").alias("chars"))
