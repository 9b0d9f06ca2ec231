"""Differences of values and frames, intervals that don't overlap, orders of trees, numbered vocabularies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..udf import arrow_udf


def differences(left, right, path: str = "$") -> list[tuple[str, str, str, str]]:
    """(path, kind, left, right) where two JSON values differ: a key or length of one, the type, or the value."""
    if type(left) is not type(right) and not (isinstance(left, (int, float)) and isinstance(right, (int, float)) and not isinstance(left, bool) and not isinstance(right, bool)):
        return [(path, "type", json.dumps(left), json.dumps(right))]
    if isinstance(left, dict):
        out = []
        for k in sorted(left.keys() | right.keys()):
            if k not in left or k not in right:
                out.append((f"{path}.{k}", "key", json.dumps(left.get(k)), json.dumps(right.get(k))))
            else:
                out += differences(left[k], right[k], f"{path}.{k}")
        return out
    if isinstance(left, list):
        out = [(path, "length", str(len(left)), str(len(right)))] if len(left) != len(right) else []
        for i, (a, b) in enumerate(zip(left, right, strict=False)):
            out += differences(a, b, f"{path}[{i}]")
        return out
    return [] if left == right else [(path, "value", json.dumps(left), json.dumps(right))]


@arrow_udf("array<struct<path:string,kind:string,left:string,right:string>>")
def json_differences(left: pd.Series, right: pd.Series) -> pd.Series:
    def one(a, b):
        found = differences(json.loads(a) if a is not None else None, json.loads(b) if b is not None else None)
        return [dict(zip(("path", "kind", "left", "right"), d, strict=True)) for d in found]

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])


def frame_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the one that the other lacks, as often as it lacks them, with the side."""
    only = lambda a, b, name: a.exceptAll(b).withColumn("side", F.lit(name))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def without_overlaps(hits: Column) -> Column:
    """Of an array of struct(begin, end, ...), those that stand when the longest (of equals the first) push out what they overlap."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct((h["begin"] - h["end"]).alias("less"), h["begin"].alias("begin"), h.alias("hit"))))
    start = F.slice(ordered, 1, 0)
    step = lambda kept, x: F.when(F.exists(kept, lambda k: (k["hit"]["begin"] < x["hit"]["end"]) & (x["hit"]["begin"] < k["hit"]["end"])), kept).otherwise(F.concat(kept, F.array(x)))
    return F.array_sort(F.transform(F.aggregate(ordered, start, step), lambda k: k["hit"]))


def traversal(nodes: list[dict], order: str = "pre") -> list[int]:
    """Ids of a node array in pre-, post- or breadth-first order."""
    children: dict = {}
    for n in nodes:
        children.setdefault(n["parent"], []).append(n["id"])
    if order == "breadth":
        out = list(children.get(None, []))
        for i in out:
            out += children.get(i, [])
        return out
    out, todo = [], [(i, False) for i in reversed(children.get(None, []))]
    while todo:
        i, done = todo.pop()
        if order == "pre" or done:
            out.append(i)
        if not done:
            todo += ([(i, True)] if order == "post" else []) + [(c, False) for c in reversed(children.get(i, []))]
    return out


def node_path(nodes: list[dict], node: int) -> list[int]:
    """Ids from the root to the node."""
    parent = {n["id"]: n["parent"] for n in nodes}
    out = [node]
    while parent[out[-1]] is not None:
        out.append(parent[out[-1]])
    return out[::-1]


@arrow_udf("array<int>")
def post_order(nodes: pd.Series) -> pd.Series:
    return nodes.map(lambda n: traversal([dict(x) for x in n], "post"))


def numbered_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """word, id: a vocabulary file's lines and their numbers; read by one task, as line numbers need."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")).alias("id", "word"))
    return rows.select("word", "id")


def set_path(value, path: list, new):
    """A nested value with one place set; objects and lists are made and grown where the path leads beyond them."""
    if not path:
        return new
    key, rest = path[0], path[1:]
    if isinstance(key, int):
        out = list(value) if isinstance(value, list) else []
        out += [None] * (key + 1 - len(out))
    else:
        out = dict(value) if isinstance(value, dict) else {}
    out[key] = set_path(out[key] if isinstance(key, int) else out.get(key), rest, new)
    return out


def set_json_path(column: Column, path: list, new) -> Column:
    """A JSON text with one nested value set."""

    @arrow_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(set_path(json.loads(t) if t else None, path, new), ensure_ascii=False))

    return run(column)
