"""What the operators of this package share: row keys, tables in the shared folder, byte-level tokenising, tokenizer files."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "__row"
ID = "__id"
TEXT = "__text"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__row, __id, __text) of docs; other columns, whatever their names, are left behind.

    __row tells rows apart even when doc_id is null or repeated. It depends on the input's partition and position only,
    so a lost partition of a file scan that is computed again gets the same keys. Where keys made twice must agree, docs
    must be settled(). A null text is an empty one.
    """
    return docs.select(F.col(id_col).cast("long").alias(ID), F.coalesce(F.col(text_col), F.lit("")).alias(TEXT)).withColumn(ROW, F.monotonically_increasing_id())


def settled(df: DataFrame) -> DataFrame:
    """df, such that what reads it twice meets the same rows in the same order both times, so that row keys made from it agree.

    A scan of files under filters and projections is so by itself. Anything else (a join, a sort, a sample) is stored first.
    """
    todo = [df._jdf.queryExecution().optimizedPlan()]
    if not todo[0].deterministic():
        return shared_table(df)
    while todo:
        node = todo.pop()
        if node.nodeName().split()[0] not in ("Project", "Filter", "Relation", "LogicalRelation", "LocalRelation"):
            return shared_table(df)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return df


def remainder(id_column: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text, so its remainder is 0."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset, a folder beside the warehouse's tables, but in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_loomspan"
    return folder.rstrip("/")


def shared_table(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, its lineage cut, readable after executors are lost.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file's place: in folder if given, else in the installed public_tokenizers."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_cache() -> dict:
    """What a Python worker keeps from task to task."""
    return sys.modules.setdefault("_loomspan_worker", types.ModuleType("_loomspan_worker")).__dict__


def series_udf(run, schema: str, columns: int = 1):
    """A pandas UDF over an iterator of batches, so that what it needs is loaded once a task."""
    given = pd.Series if columns == 1 else tuple[(pd.Series,) * columns]
    run.__annotations__ = {"batches": Iterator[given], "return": Iterator[pd.Series if " " not in schema else pd.DataFrame]}
    return F.pandas_udf(run, schema)


class Shared:
    """A broadcast value that may hold objects of this library, which executors needn't have installed."""

    def __init__(self, spark: SparkSession, value):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return cloudpickle.loads(self.data.value)

    def forget(self):
        """Drops this process's copy of the data; it is loaded again when it is asked for."""
        self.data.__dict__.pop("_value", None)
