"""From source and target to row changes, and changes applied to a target: all rows or none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .paging import RefusedError


def lockstep(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Counts that must all be zero before anything is changed: rows of one side only, planned values
    that differ, repeated or NULL keys. One full outer join, one aggregate."""
    s = source.select(*keys, *[F.col(c).alias(f"s_{c}") for c in columns], F.lit(1).alias("in_s"))
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in columns], F.lit(1).alias("in_t"))
    # a key is counted on each side before the join, so a repeated one can't multiply rows
    s, t = (_once(d, keys, f"rows_{x}") for d, x in ((s, "s"), (t, "t")))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    j = s.join(t, keys, "full_outer")  # partitioned by the keys already; NULL keys meet nothing and count as bad
    n = lambda cond, name: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    both = F.col("in_s").isNotNull() & F.col("in_t").isNotNull()
    differs = reduce(lambda a, b: a | b, [~F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")) for c in columns], F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("rows"), n(F.col("in_t").isNull(), "only_source"), n(F.col("in_s").isNull(), "only_target"), n(both & differs, "conflicts"), n(null | (F.coalesce("rows_s", F.lit(0)) > 1) | (F.coalesce("rows_t", F.lit(0)) > 1), "bad_keys"))


def _once(side: DataFrame, keys: list[str], count: str) -> DataFrame:
    rest = [c for c in side.columns if c not in keys]
    return side.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], F.count(F.lit(1)).alias(count))


def require_lockstep(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> None:
    r = lockstep(source, target, keys, columns).first()
    if r["only_source"] or r["only_target"] or r["conflicts"] or r["bad_keys"]:
        raise RefusedError(f"conflict: {r['only_source']} + {r['only_target']} unmatched, {r['conflicts']} changed, {r['bad_keys']} keys NULL or repeated")
    if not r["rows"]:
        raise RefusedError("incomplete: no rows")


def row_changes(masked: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, expected_<c>, replacement_<c>; rows whose planned values are all NULL have nothing to write."""
    some = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
    return masked.where(some).select(*keys, *[F.col(c).alias(f"expected_{c}") for c in columns], *[F.col(f"{c}_masked").alias(f"replacement_{c}") for c in columns])


def change_violations(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: NULL where a value must be, a value where NULL must stay, an unchanged value."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    one = lambda c: F.struct(
        F.lit(c).alias("column"),
        n(F.col(f"expected_{c}").isNotNull() & F.col(f"replacement_{c}").isNull()).alias("to_null"),
        n(F.col(f"expected_{c}").isNull() & F.col(f"replacement_{c}").isNotNull()).alias("from_null"),
        n(F.col(f"expected_{c}") == F.col(f"replacement_{c}")).alias("unchanged"),
    )
    return changes.agg(F.array(*[one(c) for c in columns]).alias("x")).select(F.inline("x"))


def merged(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The target with the changes, and applied_ (whether the row took one): a row takes its change only
    if all its planned values are still the expected ones."""
    c = changes.withColumn("has_", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"expected_{x}")) for x in columns])
    j = target.join(c, keys, "left").withColumn("applied_", F.coalesce(F.col("has_") & same, F.lit(False)))
    return j.select(*[F.when(F.col("applied_"), F.col(f"replacement_{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in target.columns], "applied_")


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], path: str) -> int:
    """Write the changed target to a new path, after checking that every change meets exactly one row."""
    bad = change_violations(changes, columns).where("to_null + from_null + unchanged > 0").count()
    if bad:
        raise RefusedError("unsafe: a change isn't one")
    m = merged(target, changes, keys, columns)
    want, took = changes.count(), m.agg(F.sum(F.col("applied_").cast("int"))).first()[0] or 0
    if want != took:
        raise RefusedError(f"conflict: {want} changes, {took} rows")
    m.drop("applied_").write.mode("errorifexists").parquet(path)
    return took
