"""Counting, sampling and keyset pages, with byte bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .order import ROWS_IN_RANGE, running

MAX_VALUE_BYTES, MAX_SAMPLE_BYTES = 1 << 20, 16 << 20


class RefusedError(ValueError):
    """A refusal by category; no value is ever in its text."""


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def sample(df: DataFrame, column: str, limit: int) -> tuple[DataFrame, bool]:
    """At most ``limit`` distinct values (the least ones) that aren't NULL, and whether there are more.

    Values over 1 MiB, or 16 MiB in all, are refused. The look-ahead row is a sorted limit, which
    Spark keeps as a bounded heap in each task."""
    if not 1 <= limit <= 10_000:
        raise RefusedError("invalid: sample limit")
    ahead = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value").limit(limit + 1)
    size = F.octet_length(F.col("value").cast("string"))
    s = ahead.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("most"), F.sum(size).alias("all")).first()
    if (s["most"] or 0) > MAX_VALUE_BYTES or (s["all"] or 0) > MAX_SAMPLE_BYTES:
        raise RefusedError("unsafe: sample bytes")
    return ahead.orderBy("value").limit(limit), s["n"] > limit


def after_key(keys: list[str], values: list) -> F.Column:
    """The row's key comes after values, key column by key column."""
    out = F.lit(False)
    for k, v in reversed(list(zip(keys, values, strict=True))):
        out = (F.col(k) > F.lit(v)) | ((F.col(k) == F.lit(v)) & out)
    return out


def page(df: DataFrame, keys: list[str], columns: list[str], after: list | None, size: int) -> DataFrame:
    """The next page in key order, with one row of look-ahead marked ``ahead``.

    The predicate and the projection reach the scan; the order is a bounded top-k."""
    if not keys or not 1 <= size <= 1000:
        raise RefusedError("invalid: page request")
    d = df.where(after_key(keys, after)) if after else df
    top = d.select(*dict.fromkeys([*keys, *columns])).orderBy(*keys).limit(size + 1)
    return top.withColumn("ahead", F.row_number().over(Window.orderBy(*keys)) > size)


def limited(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The first rows in key order: a table's row budget (0: all). A bounded top-k, no global sort."""
    if rows < 0 or not keys:
        raise RefusedError("invalid: row budget")
    return df.orderBy(*keys).limit(rows) if rows else df


def coverage(columns: DataFrame) -> DataFrame:
    """tables, columns, rows, complete of per-column results (table_name, column_name, rows, whole).

    A table counts its rows once; without any column nothing is complete."""
    t = columns.groupBy("table_name").agg(F.count(F.lit(1)).alias("c"), F.max("rows").alias("r"), F.bool_and("whole").alias("w"))
    return t.agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.sum("c"), F.lit(0)).alias("columns"), F.coalesce(F.sum("r"), F.lit(0)).alias("rows"), F.coalesce(F.bool_and("w"), F.lit(False)).alias("complete"))


def row_bytes(df: DataFrame, columns: list[str] | None = None) -> F.Column:
    """What a row's values take in canonical form; NULL takes nothing. Decimals are not supported."""
    cost = F.lit(0).cast("long")
    for field in df.schema:
        if columns and field.name not in columns:
            continue
        c = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            if field.dataType.precision == 20 and field.dataType.scale == 0:
                size = F.lit(20)
            else:
                raise RefusedError("unsupported: decimal")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            size = F.lit(32)
        elif isinstance(field.dataType, T.BooleanType):
            size = F.lit(5)
        elif isinstance(field.dataType, T.BinaryType):
            size = F.octet_length(c)
        else:
            size = F.octet_length(c.cast("string"))
        cost = cost + F.when(c.isNull(), F.lit(0)).otherwise(size)
    return cost


def page_within(df: DataFrame, keys: list[str], columns: list[str], after: list | None, size: int, max_row_bytes: int) -> DataFrame:
    """A page that is refused as a whole, look-ahead row included, if a row is over the bound."""
    p = page(df, keys, columns, after, size)
    most = p.agg(F.max(row_bytes(p.drop("ahead"))).alias("m")).first()["m"] or 0
    if most > max_row_bytes:
        raise RefusedError("unsafe: row bytes")
    return p


def byte_budget(df: DataFrame) -> DataFrame:
    """rows, total_bytes, max_row_bytes."""
    b = row_bytes(df)
    return df.select(b.alias("b")).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("total_bytes"), F.coalesce(F.max("b"), F.lit(0)).alias("max_row_bytes"))


def batched(df: DataFrame, keys: list[str], size: int, rows_in_range: int = ROWS_IN_RANGE) -> DataFrame:
    """df with batch_sequence (from 0 in key order) and row_in_batch, without one global sort task."""
    out = running(df, keys, {"__at": F.lit(1)}, rows_in_range)
    return out.withColumn("batch_sequence", F.floor(F.col("__at") / size).cast("long")).withColumn("row_in_batch", (F.col("__at") % size).cast("int")).drop("__at")
