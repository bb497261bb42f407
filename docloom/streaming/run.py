"""Streams of files as tables, and sinks that survive a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docloom.session import shared_dir


def stream_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def windowed_counts(stream: DataFrame, at: str, by: list[str], size: str, late: str) -> DataFrame:
    """Rows of each window of time and group; rows later than `late` behind the greatest time are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("window"), *by).agg(F.count(F.lit(1)).alias("n"))


def write_table(stream: DataFrame, path: str, name: str, mode: str = "append") -> StreamingQuery:
    """Appends a stream to a Parquet table, once for each input even after a failure; stops when the input is used up."""
    where = f"{shared_dir(stream.sparkSession)}/streams/{name}"
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", where).trigger(availableNow=True).start()
