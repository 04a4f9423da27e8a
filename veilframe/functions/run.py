"""Run SQL text over a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

INPUT = "input__"


def over(df: DataFrame, sql: str, **more: DataFrame) -> DataFrame:
    """sql with ``input__`` (and the names in more) standing for DataFrames; analysed at once, run lazily."""
    spark, tag = df.sparkSession, uuid.uuid4().hex
    names = {INPUT: df} | more
    for name, x in names.items():
        x.createOrReplaceTempView(f"{name}_{tag}")
        sql = sql.replace(name, f"{name}_{tag}")
    try:
        return spark.sql(sql)
    finally:
        for name in names:
            spark.catalog.dropTempView(f"{name}_{tag}")
