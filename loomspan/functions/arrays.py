"""Functions of arrays, maps and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def index_of(array, value) -> Column:
    """Index from 0, or -1."""
    return (F.array_position(_c(array), value) - 1).cast("int")


def find_index(array, predicate) -> Column:
    """Index of the first element for which predicate holds, or -1."""
    hits = F.filter(F.transform(_c(array), lambda x, i: F.when(predicate(x), i).otherwise(-1)), lambda i: i >= 0)
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))


def rindex(array, value) -> Column:
    at = F.array_position(F.reverse(_c(array)), value)
    return F.when(at == 0, -1).otherwise(F.size(_c(array)) - at).cast("int")


def argmax(array) -> Column:
    return index_of(array, F.array_max(_c(array)))


def argmin(array) -> Column:
    return index_of(array, F.array_min(_c(array)))


def is_constant(array) -> Column:
    return F.size(F.array_distinct(_c(array))) <= 1


def partition_by(array, predicate) -> Column:
    """struct(hit, rest)."""
    a = _c(array)
    return F.struct(F.filter(a, predicate).alias("hit"), F.filter(a, lambda x: ~predicate(x)).alias("rest"))


def split_by_pivot(array, pivot) -> Column:
    """struct(hit, rest) by a place, a slice, a list of places or a predicate.

    A place: what is before it and the rest. A slice that rises: its elements and the others. A slice that falls: the
    others and its elements, from the last one down. Places below 0 count from the end; those outside the array are none.
    """
    a = _c(array)
    if callable(pivot):
        return partition_by(a, pivot)
    n = F.size(a)
    back = lambda i: n + i if i < 0 else F.lit(i)
    if isinstance(pivot, int):
        at = F.greatest(F.lit(0), F.least(n, back(pivot)))
        return F.struct(F.slice(a, F.lit(1), at).alias("hit"), F.slice(a, at + 1, n).alias("rest"))
    if isinstance(pivot, slice):
        step = pivot.step or 1
        first = back(pivot.start) if pivot.start is not None else F.lit(0) if step > 0 else n - 1
        last = back(pivot.stop) if pivot.stop is not None else n if step > 0 else F.lit(-1)
        if step > 0:
            first = F.greatest(F.lit(0), first)
            inside = lambda i: (i >= first) & (i < last) & ((i - first) % step == 0)
        else:
            first = F.least(n - 1, first)
            inside = lambda i: (i <= first) & (i > last) & ((first - i) % -step == 0)
        taken = F.filter(a, lambda x, i: inside(i))
        others = F.filter(a, lambda x, i: ~inside(i))
        return F.struct(taken.alias("hit"), others.alias("rest")) if step > 0 else F.struct(others.alias("hit"), F.reverse(taken).alias("rest"))
    places = F.array(*(back(i).cast("int") for i in pivot)) if len(pivot) else F.array().cast("array<int>")
    return F.struct(F.filter(a, lambda x, i: F.array_contains(places, i)).alias("hit"), F.filter(a, lambda x, i: ~F.array_contains(places, i)).alias("rest"))


def delete_indices(array, indices) -> Column:
    gone = _c(indices)
    return F.filter(_c(array), lambda _, i: ~F.array_contains(gone, i))


def split_at(array, predicate, kind: str) -> Column:
    """Pieces between the elements for which predicate holds; kind: the type of an element."""
    empty = F.array().cast(f"array<{kind}>")
    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("done"), empty.alias("open"))
    step = lambda acc, x: F.when(predicate(x), F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), empty.alias("open"))).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x)).alias("open")))
    return F.aggregate(_c(array), start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


def clip(value, low, high) -> Column:
    return F.least(F.greatest(_c(value), F.lit(low)), F.lit(high))


def every_nth(array, start: int = 0, stop: int | None = None, step: int = 1) -> Column:
    inside = lambda i: (i >= start) & ((i - start) % step == 0) & (F.lit(True) if stop is None else i < stop)
    return F.filter(_c(array), lambda _, i: inside(i))


def splice(array, start: int, count: int, items) -> Column:
    a = _c(array)
    return F.concat(F.slice(a, 1, start), items, F.filter(a, lambda _, i: i >= start + count))


def merge_sorted(left, right) -> Column:
    return F.array_sort(F.concat(_c(left), _c(right)))


def lower_bound(array, value) -> Column:
    """Place of the first element of a sorted array that isn't below value."""
    return F.size(F.filter(_c(array), lambda x: x < value))


def equal_range(array, value) -> Column:
    return F.struct(lower_bound(array, value).alias("start"), F.size(F.filter(_c(array), lambda x: x <= value)).alias("stop"))


def binary_insert(array, value) -> Column:
    at = lower_bound(array, value)
    return F.concat(F.filter(_c(array), lambda _, i: i < at), F.array(value), F.filter(_c(array), lambda _, i: i >= at))


def compare_arrays(left, right) -> Column:
    """-1, 0 or 1: element by element, the shorter first."""
    a, b = _c(left), _c(right)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def pad(array, width, fill, left: bool = False) -> Column:
    more = F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(width) - F.size(_c(array)) if isinstance(width, int) else width - F.size(_c(array))))
    return F.concat(more, _c(array)) if left else F.concat(_c(array), more)


def pad_randomly(array, width: int, fill, seed) -> Column:
    """The array with fill put in at places that the seed (a column) draws, until it has the width; its last element stays the last."""
    a = _c(array)
    missing = F.greatest(F.lit(0), F.lit(width) - F.size(a))
    draws = F.when(missing > 0, F.sequence(F.lit(1), missing)).otherwise(F.array().cast("array<int>"))
    place = lambda acc, k: (F.pmod(F.xxhash64(_c(seed), k), F.greatest(F.size(acc), F.lit(1))) + 1).cast("int")
    return F.aggregate(draws, a, lambda acc, k: F.array_insert(acc, place(acc, k), F.lit(fill)))


def random_combination(n, k, seed) -> Column:
    """k of the numbers from 0 to n - 1 (all, if there are fewer), falling, as the seed draws them."""
    numbers = F.when(_c(n) > 0, F.sequence(F.lit(0), _c(n) - 1)).otherwise(F.array().cast("array<int>"))
    drawn = F.array_sort(F.transform(numbers, lambda i: F.struct(F.xxhash64(_c(seed), i).alias("key"), i.alias("i"))))
    return F.sort_array(F.transform(F.slice(drawn, F.lit(1), _c(k)), lambda d: d["i"]), asc=False)


def gcd(a, b) -> Column:
    """Greatest common divisor: Euclid's steps, at most 92 of them for longs."""
    start = F.struct(F.abs(_c(a)).cast("long").alias("x"), F.abs(_c(b)).cast("long").alias("y"))
    step = lambda acc, _: F.when(acc["y"] == 0, acc).otherwise(F.struct(acc["y"].alias("x"), F.pmod(acc["x"], F.when(acc["y"] == 0, 1).otherwise(acc["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda acc: acc["x"])


def symmetric_sum(array, k: int) -> Column:
    """Elementary symmetric polynomial of degree k."""
    start = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    step = lambda acc, x: F.transform(acc, lambda v, i: F.when(i == 0, v).otherwise(v + x * F.get(acc, i - 1)))
    return F.get(F.aggregate(F.transform(_c(array), lambda x: x.cast("double")), start, step), F.lit(k))


def merge_add(left, right) -> Column:
    """Map with the sums of both maps' values."""
    return F.map_zip_with(_c(left), _c(right), lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def sorted_items(mapping) -> Column:
    return F.array_sort(F.map_entries(_c(mapping)))


def combine_reward(reward, scores, reward_mask: int = 1, score_masks: list[int] | None = None) -> Column:
    """reward * mask + sum of scores * masks; if any score is negative, positive scores and a reward of 0 or more count nothing."""
    r, s = _c(reward), _c(scores)
    low = F.exists(s, lambda x: x < 0)
    masks = F.array(*(F.lit(m) for m in score_masks)) if score_masks else F.transform(s, lambda _: F.lit(1))
    kept = F.transform(F.arrays_zip(s.alias("s"), masks.alias("m")), lambda z: F.when(low & (z["s"] > 0), 0.0).otherwise(z["s"] * z["m"]))
    return F.when(low & (r >= 0), 0.0).otherwise(r * reward_mask) + F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)


def get_path(variant, *path: str | int, kind: str = "string") -> Column:
    """A nested value of a variant, null where the path ends early."""
    return F.try_variant_get(_c(variant), "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path), kind)


def lexical_runs(array, most_gap: int) -> Column:
    """Pieces of a sorted array of numbers whose neighbours lie at most most_gap apart."""
    start = F.struct(F.array().cast("array<array<bigint>>").alias("done"), F.array().cast("array<bigint>").alias("open"))

    def step(acc, x):
        joins = (F.size(acc["open"]) == 0) | (x - F.element_at(acc["open"], -1) <= most_gap)
        return F.when(joins, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(x)).alias("open"))).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), F.array(x).alias("open")))

    return F.aggregate(F.transform(_c(array), lambda x: x.cast("long")), start, step, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


ACTIVATIONS = {
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "gelu": lambda x: 0.5 * x * (1 + F.tanh(F.lit(0.7978845608028654) * (x + 0.044715 * x * x * x))),
    "hard_sigmoid": lambda x: F.least(F.greatest(0.2 * x + 0.5, F.lit(0.0)), F.lit(1.0)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh,
}


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, not at each place where use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def softmax(array) -> Column:
    a = _c(array)
    powers = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(_sum(p), lambda total: F.transform(p, lambda x: x / total)))


def logsumexp(array) -> Column:
    a = _c(array)
    return let(F.array_max(a), lambda top: top + F.log(_sum(F.transform(a, lambda x: F.exp(x - top)))))


def l2_normalize(array) -> Column:
    a = _c(array)
    return let(F.sqrt(_sum(F.transform(a, lambda x: x * x))), lambda norm: F.transform(a, lambda x: x / norm))
