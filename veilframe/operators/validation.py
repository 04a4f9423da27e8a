"""Proof that a target is its source with the planned columns masked and nothing else."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import canonical
from ..plans.registry import Registry
from .order import ROWS_IN_RANGE, running
from .paging import RefusedError

ISSUES = "status string, code string, column string, n long"
KEY_TYPES = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType, T.DateType, T.StringType)


def key_types(df: DataFrame, keys: list[str]) -> None:
    for k in keys:
        t = df.schema[k].dataType
        if not (isinstance(t, KEY_TYPES) or isinstance(t, T.DecimalType) and t.scale == 0):
            raise RefusedError("unsupported: key type")


def compare_rows(source: DataFrame, target: DataFrame, keys: list[str], planned: list[str]) -> DataFrame:
    """Issues (status, code, column, n) of one full outer join: keys on one side only, NULL-ness that
    differs, values that weren't masked. Spark sorts and merges both sides, or hashes a small one."""
    key_types(source, keys)
    s = source.select(*keys, *[F.col(c).alias(f"s_{c}") for c in planned], F.lit(1).alias("in_s"))
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in planned], F.lit(1).alias("in_t"))
    j = s.join(t, keys, "full_outer")
    both = F.col("in_s").isNotNull() & F.col("in_t").isNotNull()
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    issue = lambda code, column, cond: F.struct(F.lit("fail").alias("status"), F.lit(code).alias("code"), F.lit(column).alias("column"), n(cond).alias("n"))
    found = [issue("key_mismatch", "", F.col("in_s").isNull() | F.col("in_t").isNull())]
    for c in planned:
        a, b = F.col(f"s_{c}"), F.col(f"t_{c}")
        found += [issue("conflicting_evidence", c, both & (a.isNull() != b.isNull())), issue("unchanged_value", c, both & a.isNotNull() & (a == b))]
    return j.agg(F.array(*found).alias("x")).select(F.inline("x")).where("n > 0")


def sum_issues(issues: DataFrame, most_groups: int | None = None) -> DataFrame:
    out = issues.groupBy("status", "code", "column").agg(F.sum("n").alias("n"))
    if most_groups is not None and out.select("status", "code").distinct().count() > most_groups:
        raise RefusedError("unsafe: too many kinds of issue")
    return out


def key_order_issues(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are NULL or not unique, without a global order."""
    null = df.where(" OR ".join(f"`{k}` IS NULL" for k in keys)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("error").alias("status"), F.lit("null_key").alias("code"), F.lit("").alias("column"), "n")
    twice = df.groupBy(*keys).count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit("error").alias("status"), F.lit("repeated_key").alias("code"), F.lit("").alias("column"), "n")
    return null.unionByName(twice).where("n > 0")


def schema_issues(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns in any order: names and types that only one side has, and types that may hold NULL on one
    side only as far as the values show it (Parquet reads every column as nullable)."""
    of = lambda df: {(f.name, f.dataType.simpleString()) for f in df.schema}
    diff = of(source) ^ of(target)
    return source.sparkSession.createDataFrame([("fail", "schema_mismatch", "", len(diff))] if diff else [], ISSUES)


def constraint_issues(target: DataFrame, registry: Registry, table: str, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """What the registry promises and the target breaks: unknown constraints, NULL in required columns, repeated
    unique groups, whole foreign keys without a parent (for parents that are given; the table may be its own)."""
    spark, t = target.sparkSession, registry.table(table)
    if not t.covered:
        return spark.createDataFrame([("fail", "incomplete_coverage", "", 1)], ISSUES)
    out = spark.createDataFrame([], ISSUES)
    if t.required:  # all columns in one pass
        null = lambda c: F.sum(F.col(f"`{c}`").isNull().cast("long"))
        each = [F.struct(F.lit("fail").alias("status"), F.lit("null_value").alias("code"), F.lit(c).alias("column"), F.coalesce(null(c), F.lit(0)).alias("n")) for c in t.required]
        out = out.unionByName(target.agg(F.array(*each).alias("x")).select(F.inline("x")))
    for group in t.unique:
        whole = target.where(" AND ".join(f"`{c}` IS NOT NULL" for c in group))
        twice = whole.groupBy(*[F.col(f"`{c}`") for c in group]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
        out = out.unionByName(twice.select(F.lit("fail").alias("status"), F.lit("repeated_unique").alias("code"), F.lit(group[0]).alias("column"), "n"))
    for k in t.foreign_keys:
        parent = target if k.parent.lower() == table.lower() else (parents or {}).get(k.parent)
        if parent is not None:
            lost = orphans(target, parent, list(k.columns), list(k.parent_columns)).agg(F.count(F.lit(1)).alias("n"))
            out = out.unionByName(lost.select(F.lit("fail").alias("status"), F.lit("orphan").alias("code"), F.lit(k.columns[0]).alias("column"), "n"))
    return out.where("n > 0")


def all_orphans(tables: dict[str, DataFrame], registry: Registry) -> DataFrame:
    """table, column, n: for each registered foreign key of the given tables, rows without a parent."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([], "table string, column string, n long")
    for name in tables:
        for k in registry.table(name).foreign_keys:
            if k.parent in tables:
                lost = orphans(tables[name], tables[k.parent], list(k.columns), list(k.parent_columns)).agg(F.count(F.lit(1)).alias("n"))
                out = out.unionByName(lost.select(F.lit(name).alias("table"), F.lit(k.columns[0]).alias("column"), "n"))
    return out


def multiset_equal(a: list, b: list) -> bool:
    return Counter(map(repr, a)) == Counter(map(repr, b))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other side has fewer times, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def validate(source: DataFrame, target: DataFrame, keys: list[str], planned: list[str], row_limit: int = 0, strict: bool = True, registry: Registry | None = None, table: str = "", parents: dict[str, DataFrame] | None = None) -> tuple[DataFrame, bool]:
    """All issues, and whether the target passes. With a registry, its promises are checked too."""
    if strict and row_limit:
        raise RefusedError("unsupported: a strict validation covers all rows")
    spark = source.sparkSession
    found = schema_issues(source, target)
    a, b = source.count(), target.count()
    more = [("fail", "row_count_mismatch", "", abs(a - b))] if a != b else []
    if row_limit and a + b > row_limit:
        more.append(("warning", "partial_coverage", "", a + b - row_limit))
    found = found.unionByName(spark.createDataFrame(more, ISSUES))
    for df in (source, target):
        found = found.unionByName(key_order_issues(df, keys))
    if not any(m[1] == "partial_coverage" for m in more) and set(planned) <= set(target.columns):
        found = found.unionByName(compare_rows(source, target, keys, planned))
    if registry is not None:
        found = found.unionByName(constraint_issues(target, registry, table, parents))
    total = sum_issues(found)
    failed = total.where("status <> 'warning'" if not strict else "true").limit(1).count() > 0
    return total, not failed and bool(planned)


def orphans(child: DataFrame, parent: DataFrame, child_columns: list[str], parent_columns: list[str]) -> DataFrame:
    """Child rows with a whole foreign key that no parent has."""
    c = child
    for x in child_columns:
        c = c.where(F.col(x).isNotNull())
    p = parent.select(*[F.col(x).alias(f"p_{x}") for x in parent_columns]).distinct()
    return c.join(p, [F.col(a) == F.col(f"p_{b}") for a, b in zip(child_columns, parent_columns, strict=True)], "left_anti")


def independent_check(source: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The same facts by another way: inner join, equal and NULL counts, distinct counts on both sides."""
    j = source.select(key, *[F.col(c).alias(f"s_{c}") for c in columns]).join(target.select(key, *[F.col(c).alias(f"t_{c}") for c in columns]), key)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        aggs += [F.sum(F.when(F.col(f"s_{c}") == F.col(f"t_{c}"), 1).otherwise(0)).alias(f"{c}_equal"), F.sum(F.col(f"t_{c}").isNull().cast("int")).alias(f"{c}_nulls"), F.count_distinct(f"s_{c}").alias(f"{c}_source_distinct"), F.count_distinct(f"t_{c}").alias(f"{c}_target_distinct")]
    return j.agg(*aggs)


def row_digest(df: DataFrame, table: str, columns: list[str], kinds: dict[str, str]) -> F.Column:
    """SHA-256 over length-prefixed table, and for each column its name, kind and canonical value; values without
    a canonical form are refused."""
    be32 = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    raw = lambda x: F.concat(be32(F.octet_length(x)), x)
    field = lambda x: raw(F.encode(x, "UTF-8"))
    parts = [field(F.lit(table))]
    for c in columns:
        t = df.schema[c].dataType
        v = canonical(F.col(f"`{c}`"), t)
        v = v if isinstance(t, T.BinaryType) else F.encode(v, "UTF-8")
        parts += [field(F.lit(c)), field(F.lit(kinds.get(c, "text"))), F.when(v.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), raw(v)))]
    return F.sha2(F.concat(*parts), 256)


def content_digest(df: DataFrame, table: str, keys: list[str], columns: list[str], kinds: dict[str, str] | None = None, rows_in_block: int = 4096, rows_in_range: int = ROWS_IN_RANGE) -> DataFrame:
    """digest, n_rows of a whole table in key order (rows of equal keys: in the order of their hashes).

    A tree of hashes: rows, blocks of rows, as many blocks again, the whole; so no task orders all rows,
    and the last step reads one hash for 16 million rows."""
    d = df.select(*keys, row_digest(df, table, columns, kinds or {}).alias("__h"))
    d = running(d, [*keys, "__h"], {"__at": F.lit(1)}, rows_in_range).select(F.col("__at").alias("i"), F.col("__h").alias("h"), F.lit(1).cast("long").alias("n"))
    for _ in range(2):
        number = F.floor(F.col("i") / rows_in_block).cast("long")
        d = d.groupBy(number.alias("k")).agg(_hash_of("i"), F.sum("n").alias("n")).select(F.col("k").alias("i"), "h", "n")
    return d.agg(_hash_of("i").alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def _hash_of(order: str) -> Column:
    return F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"])), 256).alias("h")


def strictly_increasing(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rows that don't come after their predecessor in the group."""
    w = Window.partitionBy(group).orderBy(value)
    return df.withColumn("last_", F.lag(value).over(w)).where(F.col("last_").isNotNull() & (F.col(value) <= F.col("last_"))).drop("last_")
