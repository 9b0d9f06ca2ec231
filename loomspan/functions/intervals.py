"""Sets of half-open integer intervals, as arrays of struct(start, stop), and rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "array<struct<start:bigint,stop:bigint>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def interval(start, stop) -> Column:
    return F.struct(_c(start).cast("long").alias("start"), _c(stop).cast("long").alias("stop"))


def normalize(intervals) -> Column:
    """Disjoint and sorted; touching intervals merge, empty ones go."""
    full = F.filter(_c(intervals), lambda x: x["start"] < x["stop"])
    ordered = F.array_sort(full)

    def step(acc, x):
        joins = (F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["stop"])
        grown = F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["stop"], x["stop"]).alias("stop"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(x)))

    return F.when(F.size(full) < 2, full).otherwise(F.aggregate(ordered, F.array().cast(KIND), step))


def union(a, b) -> Column:
    return normalize(F.concat(_c(a), _c(b)))


def intersect(a, b) -> Column:
    meet = F.flatten(F.transform(_c(a), lambda x: F.transform(_c(b), lambda y: F.struct(F.greatest(x["start"], y["start"]).alias("start"), F.least(x["stop"], y["stop"]).alias("stop")))))
    return normalize(meet)


def difference(a, b) -> Column:
    """What of a isn't in b: a's intervals cut by b's, one after the other."""

    def cut(acc, y):
        pieces = F.transform(acc, lambda x: F.array(F.struct(x["start"].alias("start"), F.least(x["stop"], y["start"]).alias("stop")), F.struct(F.greatest(x["start"], y["stop"]).alias("start"), x["stop"].alias("stop"))))
        return F.filter(F.flatten(pieces), lambda x: x["start"] < x["stop"])

    return F.aggregate(normalize(b), normalize(a), cut)


def symmetric_difference(a, b) -> Column:
    return union(difference(a, b), difference(b, a))


def fragments(a, b) -> Column:
    """The union, cut at every boundary of either."""
    both = F.concat(_c(a), _c(b))
    ends = F.array_sort(F.array_distinct(F.flatten(F.transform(both, lambda x: F.array(x["start"], x["stop"])))))
    spans = F.transform(F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))), lambda s, i: F.struct(s.alias("start"), F.get(ends, i + 1).alias("stop")))
    return F.filter(spans, lambda s: F.exists(both, lambda x: (x["start"] <= s["start"]) & (s["stop"] <= x["stop"])))


def shift(a, by) -> Column:
    return F.transform(_c(a), lambda x: F.struct((x["start"] + by).alias("start"), (x["stop"] + by).alias("stop")))


def cardinality(a, disjoint: bool = False) -> Column:
    """Whole numbers in the set; disjoint: no two of its intervals meet, as in what the other functions return."""
    return F.aggregate(_c(a) if disjoint else normalize(a), F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])


def contains(a, value) -> Column:
    return F.exists(_c(a), lambda x: (x["start"] <= value) & (value < x["stop"]))


def members(a) -> Column:
    return F.flatten(F.transform(normalize(a), lambda x: F.sequence(x["start"], x["stop"] - 1)))


def rectangle(x_start, x_stop, y_start, y_stop) -> Column:
    return F.struct(*(_c(v).cast("long").alias(n) for v, n in ((x_start, "x_start"), (x_stop, "x_stop"), (y_start, "y_start"), (y_stop, "y_stop"))))


def area(r) -> Column:
    return F.greatest(F.lit(0), r["x_stop"] - r["x_start"]) * F.greatest(F.lit(0), r["y_stop"] - r["y_start"])


def rectangle_intersect(a, b) -> Column:
    """Null if they don't meet."""
    out = F.struct(F.greatest(a["x_start"], b["x_start"]).alias("x_start"), F.least(a["x_stop"], b["x_stop"]).alias("x_stop"), F.greatest(a["y_start"], b["y_start"]).alias("y_start"), F.least(a["y_stop"], b["y_stop"]).alias("y_stop"))
    return F.when((out["x_start"] < out["x_stop"]) & (out["y_start"] < out["y_stop"]), out)


def rectangle_union(a, b) -> Column:
    """One rectangle where the two share a whole side or one holds the other, else both."""
    holds = lambda p, q: (p["x_start"] <= q["x_start"]) & (q["x_stop"] <= p["x_stop"]) & (p["y_start"] <= q["y_start"]) & (q["y_stop"] <= p["y_stop"])
    beside = lambda s, t: (a[f"{t}_start"] == b[f"{t}_start"]) & (a[f"{t}_stop"] == b[f"{t}_stop"]) & (a[f"{s}_start"] <= b[f"{s}_stop"]) & (b[f"{s}_start"] <= a[f"{s}_stop"])
    hull = F.struct(F.least(a["x_start"], b["x_start"]).alias("x_start"), F.greatest(a["x_stop"], b["x_stop"]).alias("x_stop"), F.least(a["y_start"], b["y_start"]).alias("y_start"), F.greatest(a["y_stop"], b["y_stop"]).alias("y_stop"))
    return F.when(holds(a, b) | holds(b, a) | beside("x", "y") | beside("y", "x"), F.array(hull)).otherwise(F.array(a, b))


def rectangle_difference(a, b) -> Column:
    """At most four pieces of a outside b: below, above, left and right of it."""
    m = rectangle_intersect(a, b)
    piece = lambda x0, x1, y0, y1: F.struct(x0.alias("x_start"), x1.alias("x_stop"), y0.alias("y_start"), y1.alias("y_stop"))
    pieces = F.array(piece(a["x_start"], a["x_stop"], a["y_start"], m["y_start"]), piece(a["x_start"], a["x_stop"], m["y_stop"], a["y_stop"]), piece(a["x_start"], m["x_start"], m["y_start"], m["y_stop"]), piece(m["x_stop"], a["x_stop"], m["y_start"], m["y_stop"]))
    return F.when(m.isNull(), F.array(a)).otherwise(F.filter(pieces, lambda p: area(p) > 0))
