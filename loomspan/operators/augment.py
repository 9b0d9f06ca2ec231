"""Seeded augmentation and enumeration: shuffled answers, permutations, combinations, random pads and samples."""

from __future__ import annotations

import itertools
import random
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..udf import row_udf
from .frames import ranked
from .sentences import sentences


def deform(text: str, seed: int) -> str:
    """Sentences or clauses in another order, one clause twice; what is numbered keeps its order. The same seed gives the same."""
    rng = random.Random(seed)
    lines = text.split("\n")
    for i, line in enumerate(lines):
        parts = sentences(line)
        free = [k for k, p in enumerate(parts) if not re.match(r"\s*(?:\d+[.)、]|[①-⑳]|[-*] )", p)]
        if len(free) > 1:
            order = free[:]
            rng.shuffle(order)
            bare = [parts[k] for k in order]
            for k, p in zip(free, bare, strict=True):
                parts[k] = p
        lines[i] = "".join(parts)
    clauses = [(i, m.span()) for i, line in enumerate(lines) for m in re.finditer(r"[^,，、;；.。!?！？]+[,，、;；]", line)]
    if clauses:
        i, (a, b) = rng.choice(clauses)
        lines[i] = lines[i][:b] + lines[i][a:b] + lines[i][b:]
    return "\n".join(lines)


@row_udf("string")
def deform_udf(text, seed):
    return deform(text or "", int(seed))


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n random rows; more than there are: all of them as often as needed, then a part."""
    total = df.count()
    if not total:
        return df
    whole, rest = divmod(n, total)
    part = df.orderBy(F.rand(seed)).limit(rest)
    return part if not whole else df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(whole)))).drop("_copy").unionByName(part)


def batches(df: DataFrame, size: int, order: Column, keys: list[str] | None = None) -> DataFrame:
    """A column batch: as few batches of at most `size` rows as there can be, of sizes that differ by one at most, the larger first."""
    if keys is None:
        n = df.count()
        many = max(1, -(-n // size))
        large, base = n % many, n // many
        at = F.col("_rank")
        batch = F.when(at < large * (base + 1), F.floor(at / (base + 1))).otherwise(large + F.floor((at - large * (base + 1)) / F.lit(max(base, 1))))
        return ranked(df, order, "_rank").withColumn("batch", batch.cast("int")).drop("_rank")
    w = Window.partitionBy(*keys)
    n, rank = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    rows = df.withColumn("_rank", rank).withColumn("_n", n).withColumn("_many", F.ceil(F.col("_n") / size))
    large, base = F.col("_n") % F.col("_many"), F.floor(F.col("_n") / F.col("_many"))
    at = F.col("_rank")
    batch = F.when(at < large * (base + 1), F.floor(at / (base + 1))).otherwise(large + F.floor((at - large * (base + 1)) / base))
    return rows.withColumn("batch", batch.cast("int")).drop("_rank", "_n", "_many")


def permutations_udtf():
    @F.udtf(returnType="permutation array<int>")
    class Permutations:
        def eval(self, n: int):
            for p in itertools.permutations(range(n)):
                yield (list(p),)

    return Permutations


def combinations_udtf():
    @F.udtf(returnType="combination array<int>")
    class Combinations:
        def eval(self, n: int, k: int):
            for c in itertools.combinations(range(n), k):
                yield (list(c),)

    return Combinations


def top_k(df: DataFrame, k: int, by: Column, keys: list[str] | None = None) -> DataFrame:
    """The k rows of each group (or in all) that come first by `by`."""
    if not keys:
        return df.orderBy(by).limit(k)
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where(F.col("_nth") <= k).drop("_nth")
