"""Streams of lines and records. All scalar and text functions here are stateless, so they run on streams as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sse_data


def line_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(folder)


def record_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def event_payloads(lines: DataFrame) -> DataFrame:
    """The JSON of the data lines of a stream of server-sent events; the closing mark and other lines go."""
    data = lines.select(sse_data("value").alias("data")).where(F.col("data").isNotNull() & (F.trim("data") != "[DONE]"))
    return data.select(F.try_parse_json("data").alias("payload"), "data")


def micro_batches(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """run(rows, number) for each micro-batch; numbers let a sink leave out what it has."""
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batch_map(df: DataFrame, run, schema: str) -> DataFrame:
    """run(frame) -> frame over Arrow batches in parallel."""

    def each(frames):
        for frame in frames:
            yield run(frame)

    return df.mapInPandas(each, schema)
