"""Positions and running sums in key order without one global sort.

Rows get the number of a key range by an expression of their own key, so every plan that uses it agrees;
they are ordered within their range, and the ranges' totals (a few thousand numbers) shift what each range
found. Split points come from a bounded sample and decide only how even the ranges are, never a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range should hold, the most ranges there are, and sampled keys for each split point.
ROWS_IN_RANGE, MOST_RANGES, SAMPLED = 500_000, 4096, 20
RANGE = "__range"


def split_points(df: DataFrame, keys: list[str], rows_in_range: int) -> list[tuple]:
    """Keys that cut df into ranges of about so many rows; at most MOST_RANGES * SAMPLED keys reach the driver."""
    n = df.select(*keys).count()
    ranges = min(MOST_RANGES, math.ceil(n / rows_in_range))
    if ranges < 2:
        return []
    seen = df.select(*keys).sample(fraction=min(1.0, SAMPLED * ranges / n), seed=11).distinct().orderBy(*keys).limit(2 * SAMPLED * ranges).collect()
    step = max(1, len(seen) // ranges)
    return [tuple(r) for r in seen[step::step]]


def range_of(df: DataFrame, keys: list[str], splits: list[tuple]) -> Column:
    """How many split points aren't after the row's key; counted in two steps, so a row meets few of them."""
    if not splits:
        return F.lit(0)
    types = [df.schema[k].dataType for k in keys]
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    points = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(s, types, strict=True))]) for s in splits]
    width = math.isqrt(len(points)) + 1
    groups = [points[i : i + width] for i in range(0, len(points), width)]
    passed = lambda items: F.size(F.filter(F.array(*items), lambda p: p <= key))
    group = F.greatest(passed([g[0] for g in groups]) - 1, F.lit(0))
    inside = F.size(F.filter(F.element_at(F.array(*[F.array(*g) for g in groups]), group + 1), lambda p: p <= key))
    return group * F.lit(width) + inside


def running(df: DataFrame, keys: list[str], sums: dict[str, Column], rows_in_range: int = ROWS_IN_RANGE) -> DataFrame:
    """df with, for each name in sums, the sum of that number over all rows before the row in key order.

    Keys order as Spark does (NULL first). Rows of equal keys follow each other in no set order, so the keys
    should be unique. An empty table stays empty."""
    r = df.withColumn(RANGE, range_of(df, keys, split_points(df, keys, rows_in_range)))
    here = {name: f"__{name}" for name in sums}
    r = r.withColumns({here[name]: c.cast("long") for name, c in sums.items()})
    w = Window.partitionBy(RANGE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inside = r.withColumns({name: F.coalesce(F.sum(here[name]).over(w), F.lit(0)) for name in sums}).drop(*here.values())
    totals = r.groupBy(RANGE).agg(*[F.sum(here[name]).alias(here[name]) for name in sums])
    every = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # over the ranges, not the rows
    before = totals.select(RANGE, *[F.coalesce(F.sum(here[name]).over(every), F.lit(0)).alias(here[name]) for name in sums])
    out = inside.join(F.broadcast(before), RANGE)
    return out.withColumns({name: F.col(name) + F.col(here[name]) for name in sums}).drop(RANGE, *here.values())
