"""Operators on tables: selection by a table's types, paging, intervals, fuzzy lookup, paragraph windows, train flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import pad
from ..udf import row_udf
from .markdown import containers


def select_rows(df: DataFrame, fields: list[str] | str = "*", where: str | Column | None = None, order: Column | str | None = None, limit: int | None = None, offset: int = 0, **conditions) -> DataFrame:
    """Rows by conditions column=value: a list is IN, a text on an array, struct, map or variant column a pattern on its JSON, any other value equality."""
    out = df
    for name, value in conditions.items():
        kind = df.schema[name].dataType.typeName()
        if isinstance(value, (list, tuple, set)):
            out = out.where(F.col(name).isin(list(value)))
        elif isinstance(value, str) and kind in ("array", "struct", "map", "variant"):
            out = out.where(F.to_json(name).rlike(value))
        else:
            out = out.where(F.col(name) == value)
    out = out.where(where) if where is not None else out
    out = out.orderBy(order) if order is not None else out
    out = out.offset(offset) if offset else out
    out = out.limit(limit) if limit is not None else out
    return out if fields == "*" else out.select(*([fields] if isinstance(fields, str) else fields))


def pages(df: DataFrame, size: int, order: Column | str, limit: int | None = None):
    """DataFrames of at most size rows each, in order; the last one doesn't pass the limit."""
    n = df.count() if limit is None else min(limit, df.count())
    for at in range(0, n, size):
        yield df.orderBy(order).offset(at).limit(min(size, n - at))


def ranked(df: DataFrame, order: Column, name: str = "rank", rows_each: int = 1_000_000, most: int = 4096) -> DataFrame:
    """A column of ranks from 0 over the whole frame, without a task that sees all of it.

    Ranges of the order, bounded by values of a sample, are ranked each; a range starts at the number of rows before it. The
    bounds are fixed before they are used, so that all passes agree. Equal values share a range: give an order without many ties.
    """
    n = df.count()
    parts = max(1, min(most, n // rows_each))
    if parts == 1:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1)
    keyed = df.withColumn("_key", F.struct(order.alias("v")))
    sample = keyed.select("_key").sample(min(1.0, 40 * parts / n), 3).limit(80 * parts).orderBy("_key").collect()
    schema = T.StructType([T.StructField("b", T.ArrayType(keyed.schema["_key"].dataType))])
    bounds = df.sparkSession.createDataFrame([([r[0] for r in sample][39::40],)], schema)
    placed = keyed.join(F.broadcast(bounds)).withColumn("_part", F.size(F.filter("b", lambda b: b <= F.col("_key")))).drop("b")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy("_key")) - 1)
    return local.join(F.broadcast(sizes.select("_part", "_before")), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_before", "_local", "_key")


def shuffled_pages(df: DataFrame, size: int, order: Column, seed: int = 1234) -> DataFrame:
    """A column page by the order, and a column place: a random order inside each page."""
    paged = ranked(df, order, "_rank").withColumn("page", F.floor(F.col("_rank") / size)).drop("_rank")
    return paged.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(F.rand(seed))))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, n_null, n_distinct, low, high, longest: what a table definition is inferred from."""
    parts = []
    for c in columns or df.columns:
        text = F.col(c).cast("string")
        parts.append(df.agg(F.lit(c).alias("column"), F.count("*").alias("n"), F.sum(F.col(c).isNull().cast("long")).alias("n_null"), F.countDistinct(c).alias("n_distinct"), F.max(F.length(text)).alias("longest")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def statistics(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"), F.sum(column).alias("sum"))


def error_rate(df: DataFrame, right: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.sum((~right).cast("long")).alias("errors"), F.avg(right.cast("int")).alias("accuracy"))


def merge_intervals(df: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """keys, start, stop: overlapping and touching intervals of each key as one (gaps and islands).

    An island is given out at its last row, after one sort: no table of islands is kept in memory.
    """
    w = Window.partitionBy(*keys).orderBy("_start", "_stop")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(F.col(start) < F.col(stop)).select(*keys, F.col(start).alias("_start"), F.col(stop).alias("_stop"))
    rows = rows.withColumn("_before", F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_reach", F.max("_stop").over(so_far)).withColumn("_next", F.lead("_start").over(w))
    rows = rows.withColumn("_first", F.max(F.when(F.col("_before").isNull() | (F.col("_start") > F.col("_before")), F.col("_start"))).over(so_far))
    return rows.where("_next IS NULL OR _next > _reach").select(*keys, F.col("_first").alias("start"), F.col("_reach").alias("stop"))


def intersect_intervals(left: DataFrame, right: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, start, stop of every meeting of (keys, start, stop) rows. Both sides are cut into cells of `width`, so the join is on equal cells; a meeting counts in the cell where it starts."""
    cells = lambda df: df.where("start < stop").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    both = cells(left).join(cells(right).select(*keys, "_cell", F.col("start").alias("_start"), F.col("stop").alias("_stop")), [*keys, "_cell"])
    start, stop = F.greatest("start", "_start"), F.least("stop", "_stop")
    return both.where((start < stop) & (F.floor(start / width) == F.col("_cell"))).select(*keys, start.alias("start"), stop.alias("stop"))


def interval_fragments(df: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """keys, start, stop: the stretches between neighbouring boundaries that some interval covers, and how many do."""
    ends = df.where(F.col(start) < F.col(stop)).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(stop).alias("at"), F.lit(-1).alias("d")))).alias("e")).groupBy(*keys, F.col("e.at").alias("start")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("start")
    return ends.withColumn("stop", F.lead("start").over(w)).withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("depth > 0").select(*keys, "start", "stop", "depth")


def fuzzy_matches(left: DataFrame, right: DataFrame, radius: int, word: str = "word") -> DataFrame:
    """word, match, distance: pairs within an edit distance.

    If two words differ in at most r edits, some of r + 1 parts of the one stands in the other within r places of its own,
    and their lengths differ by r at most. So pairs meet on part, place and length; only those are compared.
    """
    parts, n = radius + 1, F.length(word)
    cut = lambda k: F.struct(F.floor(n * k / parts).cast("int").alias("a"), F.floor(n * (k + 1) / parts).cast("int").alias("b"))
    near = F.array(*(F.lit(d) for d in range(-radius, radius + 1)))
    own = left.select(word, n.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(radius)), cut)).alias("p")).withColumn("part", F.substring(word, F.col("p.a") + 1, F.col("p.b") - F.col("p.a")))
    own = own.withColumn("d", F.explode(near)).withColumn("e", F.explode(near)).select(word, "part", (F.col("p.a") + F.col("d")).alias("place"), (F.col("n") + F.col("e")).alias("m")).where("place >= 0 and m >= 0")
    # The parts' sizes follow from the words' lengths; there are as many rows as there are lengths.
    sizes = own.select("m", F.length("part").alias("size")).distinct()
    other = right.select(F.col(word).alias("match"), F.length(word).alias("m")).join(F.broadcast(sizes), "m")
    grams = other.where("m >= size").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("size")))).withColumn("part", F.substring("match", F.col("place") + 1, F.col("size"))).select("match", "m", "place", "part")
    met = own.join(grams, ["part", "place", "m"]).select(word, "match").distinct()
    return met.withColumn("distance", F.levenshtein(word, "match", radius)).where("distance >= 0")


def sliding_minimum(df: DataFrame, keys: list[str], order: str, value: Column, size: int = 5) -> DataFrame:
    """keys, first, average: of the windows of `size` consecutive rows the one with the least average, the earliest of equals."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, size - 1)
    rows = df.withColumn("_v", value).withColumn("_n", F.count("*").over(w)).withColumn("_a", F.avg("_v").over(w)).where(F.col("_n") == size)
    return rows.groupBy(*keys).agg(F.min(F.struct(F.col("_a"), F.col(order).alias("first"))).alias("m")).select(*keys, F.col("m.first").alias("first"), F.col("m._a").alias("average"))


def follows(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """A column follows: whether the value is one more than the row's before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("follows", F.coalesce(F.col(value) == before + 1, F.lit(False)))


def overflow(df: DataFrame, column: str, most: int, truncate: bool) -> DataFrame:
    """Texts over `most` characters cut, or their rows left out."""
    if truncate:
        return df.withColumn(column, F.substring(column, 1, most))
    return df.where(F.col(column).isNull() | (F.length(column) <= most))


def split_code(name) -> Column:
    """train 1, test 0, dev or val 2, other 3."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.startswith("train"), 1).when(c.startswith("test"), 0).when(c.startswith("dev") | c.startswith("val"), 2).otherwise(3)


def training_flag(df: DataFrame, seed: int = 0) -> DataFrame:
    return df if "training" in df.columns else df.withColumn("training", F.floor(F.rand(seed) * 2).cast("int"))


@row_udf("array<struct<start:bigint,stop:bigint,kind:string>>")
def _containers(spans, nodes):
    return containers([tuple(n.values()) for n in nodes], [tuple(s.values()) for s in spans])


def containing_node(spans: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """spans (keys, start, stop) with the kind of the innermost node (keys, start_idx, end_idx, depth, kind) around them.

    The spans and the nodes of a key meet as two lists, which are read once in order of their starts; no pairs are made.
    """
    own = spans.groupBy(*keys).agg(F.collect_set(F.struct(F.col("start").cast("long"), F.col("stop").cast("long"))).alias("_spans"))
    other = nodes.groupBy(*keys).agg(F.collect_list(F.struct(F.col("start_idx").cast("long"), F.col("end_idx").cast("long"), "depth", "kind")).alias("_nodes"))
    found = own.join(other, keys).select(*keys, F.explode(_containers("_spans", "_nodes")).alias("_c"))
    kinds = {c: spans.schema[c].dataType for c in ("start", "stop")}
    return found.select(*keys, *(F.col(f"_c.{c}").cast(kinds[c]).alias(c) for c in kinds), "_c.kind")


def padded(df: DataFrame, column: str, fill, left: bool = False) -> DataFrame:
    """df whose arrays in a column have the length of its longest one; of arrays of arrays the inner ones get theirs too, and what is added is full of fill."""
    nested = df.schema[column].dataType.elementType.typeName() == "array"
    sizes = [F.max(F.size(column)).alias("_width")]
    if nested:
        sizes.append(F.max(F.array_max(F.transform(column, lambda x: F.size(x)))).alias("_height"))
    rows = df.join(F.broadcast(df.agg(*sizes)))  # one row is broadcast
    value = F.col(column)
    more = F.lit(fill)
    if nested:
        value = F.transform(value, lambda x: pad(x, F.col("_height"), fill, left))
        more = F.array_repeat(F.lit(fill), F.col("_height"))
    extra = F.array_repeat(more, F.greatest(F.lit(0), F.col("_width") - F.size(column)))
    value = F.concat(extra, value) if left else F.concat(value, extra)
    return rows.withColumn(column, value).drop("_width", "_height")
