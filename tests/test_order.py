"""Orders over several ranges of a table too large for one sample, and digests that don't depend on the layout."""

import pytest
from pyspark.sql import functions as F

from veilframe.operators import order, paging, validation
from veilframe.streaming import apply

N = 600_000


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('large')}/t"
    spark.range(N).select((F.col("id") * 7 + 3).alias("id"), F.concat(F.lit("u"), F.col("id")).alias("c")).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("rows_in_range", [40_000, 700_000])
def test_ordinals_of_a_large_table(large, rows_in_range):
    b = paging.batched(large, ["id"], 64, rows_in_range)
    wrong = b.where((F.col("batch_sequence") * 64 + F.col("row_in_batch")) * 7 + 3 != F.col("id"))
    assert wrong.count() == 0 and b.count() == N and b.columns == ["id", "c", "batch_sequence", "row_in_batch"]


def test_receipts_and_progress_of_a_large_table(large):
    b = paging.batched(large, ["id"], 64, 50_000)
    r = apply.planned_receipts(b, "r", F.col("c").isNotNull())
    assert tuple(r.agg(F.count("*"), F.sum("affected_rows"), F.max("batch_sequence")).first()) == (N // 64, N, N // 64 - 1)
    last = apply.progress_events(r.unionByName(r.withColumn("run_id", F.lit("s")))).orderBy("run_id", F.desc("checkpoint_sequence"))
    assert [tuple(x)[1:4] for x in last.where(f"checkpoint_sequence = {N // 64}").collect()] == [(N // 64, N, N // 64)] * 2
    assert apply.transition_issues(apply.progress_events(r)).isEmpty()


def test_resume_of_a_large_table(large):
    masked = large.withColumn("c_masked", F.concat(F.lit("m"), "c"))
    target = masked.select("id", F.when(F.col("id") < 7 * 100_000 + 3, F.col("c_masked")).otherwise(F.col("c")).alias("c"))
    assert apply.resume_issues(large, masked, target, ["id"], ["c"], 100_000).isEmpty()


def test_one_digest_for_one_content(large):
    of = lambda d, n: tuple(validation.content_digest(d, "t", ["id"], ["id", "c"], {}, 512, n).first())
    first = of(large, 60_000)
    assert first[1] == N
    for d, n in ((large, 60_000), (large, 600_000), (large.repartition(9), 60_000), (large.coalesce(1), 45_000)):
        assert of(d, n) == first
    assert of(large.withColumn("c", F.when(F.col("id") == 3, "x").otherwise(F.col("c"))), 60_000) != first


def test_keys_of_several_columns_with_nulls(spark):
    rows = [(a, b) for a in (None, "", "a", "é", "b") for b in (None, 2.5, -1.0, float("nan"))]
    d = spark.createDataFrame(rows, "a string, b double")
    got = order.running(d, ["a", "b"], {"at": F.lit(1)}, 3).orderBy("at").drop("at").collect()
    assert list(map(str, got)) == list(map(str, d.orderBy("a", "b").collect()))
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")] * 2, "id int, c string")
    of = lambda d: validation.content_digest(d, "t", ["id"], ["c"], {}, 2, 2).first()["digest"]
    assert of(twice) == of(twice.orderBy(F.desc("c")))
    assert order.running(d.limit(0), ["a"], {"at": F.lit(1)}).isEmpty()
