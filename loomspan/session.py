"""A session with the settings that the engine expects, and the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df for work that costs much a row: dealt to all cores where the scan has fewer partitions than there are cores, else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, each: int = 4) -> DataFrame:
    """df for work that costs seconds a row group: always dealt anew, to `each` tasks a core at least. A scan's partitions don't tell: those that hold no beginning of a row group are empty."""
    return df.repartition(max(each * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))
