"""Records and lines from files: JSON, JSON lines, Parquet, TSV, text, and JSON inside zip and tar archives."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = "path string, member string, line long, value string"


def _members(data: bytes, path: str):
    """(name, file) of the archive's JSON files, opened one after the other."""
    if path.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in sorted(z.namelist()):
                if name.endswith((".json", ".jsonl")):
                    with z.open(name) as f:
                        yield name, f
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if m.isfile() and m.name.endswith((".json", ".jsonl")):
                    yield m.name, t.extractfile(m)


def _unpack(frames):
    for frame in frames:
        for path, data in zip(frame["path"], frame["content"], strict=True):
            rows: list[tuple] = []
            for name, f in _members(data, path):
                if name.endswith(".jsonl"):
                    for n, line in enumerate(io.TextIOWrapper(f, "utf-8-sig")):
                        if line.strip():
                            rows.append((path, name, n, line.strip()))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["path", "member", "line", "value"])
                            rows = []
                else:
                    found = json.load(io.TextIOWrapper(f, "utf-8-sig"))
                    rows += [(path, name, n, json.dumps(x, ensure_ascii=False)) for n, x in enumerate(found if isinstance(found, list) else [found])]
            yield pd.DataFrame(rows, columns=["path", "member", "line", "value"])


def archive_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, line, value): the JSON records of zip or tar archives, an archive a task."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_unpack, ROWS)


def records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of a file or folder by its ending: .json, .jsonl and their .gz, .parquet, .tsv, .csv, .zip, .tar, .tar.gz, .tgz."""
    reader = spark.read.schema(schema) if schema else spark.read
    low = path.lower()
    if low.endswith((".zip", ".tar", ".tar.gz", ".tgz")):
        rows = archive_rows(spark, path)
        if schema:
            return rows.select(F.from_json("value", schema).alias("r")).select("r.*")
        return rows.withColumn("value", F.parse_json("value"))
    if low.endswith((".jsonl", ".jsonl.gz")):
        return reader.json(path)
    if low.endswith((".json", ".json.gz")):
        return reader.json(path, multiLine=True)
    if low.endswith((".tsv", ".tsv.gz")):
        return reader.csv(path, sep="\t", header=schema is None)
    if low.endswith((".csv", ".csv.gz")):
        return reader.csv(path, header=schema is None)
    if low.endswith(".xlsx"):
        return excel_cells(spark, path)
    return reader.parquet(path)


def excel_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, value) of workbooks; needs openpyxl on the executors."""

    def cells(frames):
        import openpyxl

        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                book = openpyxl.load_workbook(io.BytesIO(data), read_only=True)
                yield pd.DataFrame([(name, s.title, i, j, str(v)) for s in book for i, row in enumerate(s.iter_rows(values_only=True)) for j, v in enumerate(row) if v is not None], columns=["path", "sheet", "row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "path string, sheet string, row int, col int, value string")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: lines without their ends and a byte order mark."""
    return spark.read.text(path).select(F.rtrim(F.regexp_replace("value", "^﻿", "")).alias("value"))


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no (from 0), line of the lines in a text column."""
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("line", F.rtrim("line"))


def nth_line(lines: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n-th line of each key; negative n counts from the end."""
    if n >= 0:
        return lines.where(F.col("line_no") == n)
    return lines.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("line_no")))).where(F.col("_back") == -n).drop("_back")


def distinct_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Each line once for each key, where it first stands."""
    return lines.groupBy(*keys, "line").agg(F.min("line_no").alias("line_no"))


def find_line(lines: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """The number of the first line of each key that matches."""
    return lines.where(F.col("line").rlike(pattern)).groupBy(*keys).agg(F.min("line_no").alias("line_no"))


def edit_lines(lines: DataFrame, key: str, insert_at: int | None = None, new: str | None = None, remove: str | None = None) -> DataFrame:
    """Lines with one put in at a place of every key, or those that match removed; numbers are given anew."""
    out = lines
    if insert_at is not None:
        out = out.withColumn("line_no", F.when(F.col("line_no") >= insert_at, F.col("line_no") + 1).otherwise(F.col("line_no")))
        out = out.unionByName(lines.select(key).distinct().select(key, F.lit(insert_at).alias("line_no"), F.lit(new).alias("line")))
    if remove is not None:
        out = out.where(~F.col("line").rlike(remove))
    return out.withColumn("line_no", F.row_number().over(Window.partitionBy(key).orderBy("line_no")) - 1)


def listing(spark: SparkSession, folder: str, ending: str = "", recursive: bool = False) -> DataFrame:
    """path, length and time of the files of a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", f"*{ending}") if ending else reader).load(folder).select("path", "length", "modificationTime")


def load(source: DataFrame, name: str, replace: bool = False) -> bool:
    """source as a table; without replace, an existing table stays as it is."""
    spark = source.sparkSession
    if spark.catalog.tableExists(name) and not replace:
        return False
    source.write.mode("overwrite").saveAsTable(name)
    return True


def upsert(old: DataFrame, new: DataFrame, key: str, replace: bool = True) -> DataFrame:
    """Rows of both; of equal keys the new one (replace) or the old one (ignore)."""
    first, second = (new, old) if replace else (old, new)
    return first.dropDuplicates([key]).unionByName(second.join(first.select(key), key, "left_anti").dropDuplicates([key]))


def write_json_lines(df: DataFrame, path: str, compress: bool = True) -> None:
    df.write.option("compression", "gzip" if compress else "none").json(path)


def write_table(df: DataFrame, url: str, name: str, batch: int = 1024, **options) -> None:
    """To a database by JDBC."""
    df.write.format("jdbc").options(url=url, dbtable=name, batchsize=batch, **options).mode("append").save()


def read_table(spark: SparkSession, url: str, name: str, fetch: int = 1024, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, fetchsize=fetch, **options).load()


def memory_map(path_and_content: DataFrame) -> DataFrame:
    """(path, values) of raw arrays whose element type is the file's ending, such as .float32."""

    def read(frames):
        import numpy as np

        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "values": [np.frombuffer(c, dtype=p.rpartition(".")[2]).astype("float64") for p, c in zip(frame["path"], frame["content"], strict=True)]})

    return path_and_content.select("path", "content").mapInPandas(read, "path string, values array<double>")


def infer_kind(values: Column | str) -> Column:
    """The narrowest of bool, int, float, json and str that a text column's value fits."""
    v = F.col(values) if isinstance(values, str) else values
    json_like = v.rlike(r"^\s*[\[{][\s\S]*[\]}]\s*$") & F.try_parse_json(v).isNotNull()
    return F.when(v.isNull(), "null").when(F.lower(v).isin("true", "false"), "bool").when(v.rlike(r"^[+-]?\d{1,18}$"), "int").when(v.try_cast("double").isNotNull(), "float").when(json_like, "json").otherwise("str")
