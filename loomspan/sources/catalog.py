"""Tables from lists of records with inferred types, keys and column order; what the catalog knows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ORDER = ("null", "bool", "int", "float", "str", "json")


def kind_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        if value[:1] + value[-1:] in ("{}", "[]"):
            try:
                json.loads(value)
                return "json"
            except ValueError:
                pass
        return "str"
    return "json"


def column_kinds(rows: list[dict]) -> dict[str, str]:
    """The widest kind of each key, in the order null, bool, int, float, str, json."""
    out: dict[str, str] = {}
    for row in rows:
        for k, v in row.items():
            out[k] = max(out.get(k, "null"), kind_of(v), key=_ORDER.index)
    return out


def table_from_records(spark: SparkSession, rows: list[dict], key: str | None = None) -> tuple[DataFrame, str]:
    """A frame of driver-side records and its key: the given or first unique column of whole numbers, else of the shortest unique texts, else a made one.

    Columns: the key, texts by length, others, `training` last. Lists and objects are JSON text.
    """
    kinds = column_kinds(rows)
    values = {c: [r.get(c) for r in rows] for c in kinds}
    unique = lambda c: None not in values[c] and len(set(map(str, values[c]))) == len(rows)
    size = lambda c: max((len(str(v)) for v in values[c] if v is not None), default=0)
    if key is None:
        key = next((c for c in kinds if kinds[c] == "int" and unique(c)), None) or min((c for c in kinds if kinds[c] == "str" and unique(c)), key=size, default=None)
    made = key is None
    if made:
        key = next(n for n in ("id", "uuid", "_id") if n not in kinds)
    rest = [c for c in kinds if c not in (key, "training")]
    order = [key, *sorted((c for c in rest if kinds[c] == "str"), key=size), *(c for c in rest if kinds[c] != "str"), *(["training"] if "training" in kinds else [])]
    types = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType()}
    schema = T.StructType([T.StructField(c, T.LongType() if made and c == key else types.get(kinds[c], T.StringType())) for c in order])

    def cell(c, i):
        if made and c == key:
            return i + 1
        v = values[c][i]
        if v is None or kinds[c] in ("bool", "int"):
            return v
        if kinds[c] == "float":
            return float(v)
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    return spark.createDataFrame([tuple(cell(c, i) for c in order) for i in range(len(rows))], schema), key


def definition(df: DataFrame) -> DataFrame:
    """column, kind: the column types of a table definition, from one pass over the data."""
    checks = []
    for f in df.schema:
        c, kind = F.col(f.name), f.dataType.typeName()
        if kind in ("long", "integer", "short", "byte"):
            out = F.when((F.min(c) >= 0) & (F.max(c) <= 255), "tinyint").otherwise("int")
        elif kind == "boolean":
            out = F.lit("tinyint")
        elif kind in ("double", "float"):
            out = F.lit("float")
        elif kind == "string":
            n = F.coalesce(F.max(F.length(c)), F.lit(0))
            out = F.when(n >= 768, "text").otherwise(F.concat(F.lit("varchar("), n.cast("string"), F.lit(")")))
        else:
            out = F.lit("json")
        checks.append(F.struct(F.lit(f.name).alias("column"), out.alias("kind")))
    return df.agg(F.array(*checks).alias("a")).select(F.explode("a").alias("c")).select("c.*")


def tables(spark: SparkSession) -> list[str]:
    return [t.name for t in spark.catalog.listTables()]


def describe(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(name)]


def raw_query(spark: SparkSession, sql: str, order: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A statement with clauses put at its end."""
    for word, value in (("ORDER BY", order), ("LIMIT", limit), ("OFFSET", offset)):
        sql += f" {word} {value}" if value is not None else ""
    return spark.sql(sql)
