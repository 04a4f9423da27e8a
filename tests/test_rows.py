import pytest
from pyspark.sql import functions as F

from veilframe.operators import changes, paging, validation
from veilframe.operators.paging import RefusedError


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(i, f"v{i}" if i % 3 else None) for i in range(200)], "id long, c string")


def test_pages_cover_all_rows_once(spark, people):
    seen, after = [], None
    while True:
        rows = paging.page(people, ["id"], ["c"], after, 64).orderBy("id").collect()
        seen += [r["id"] for r in rows if not r["ahead"]]
        if not any(r["ahead"] for r in rows):
            break
        after = [seen[-1]]
    assert seen == list(range(200))


def test_composite_keys(spark):
    d = spark.createDataFrame([(a, b) for a in range(4) for b in range(4)], "a int, b int")
    assert [tuple(r)[:2] for r in paging.page(d, ["a", "b"], [], [1, 2], 3).orderBy("a", "b").collect()] == [(1, 3), (2, 0), (2, 1), (2, 2)]


def test_samples(spark, people):
    values, more = paging.sample(people, "c", 5)
    assert values.count() == 5 and more
    big = spark.createDataFrame([("x" * ((1 << 20) + 1),)], "c string")
    with pytest.raises(RefusedError):
        paging.sample(big, "c", 5)
    assert paging.sample(people.where("c IS NULL"), "c", 5)[1] is False


def test_row_bytes_and_bounded_pages(spark):
    d = spark.createDataFrame([(1, "é", None, True), (2, None, 1.5, None)], "id int, s string, f double, b boolean")
    assert [r[0] for r in d.select(paging.row_bytes(d)).collect()] == [1 + 2 + 5, 1 + 32]
    long = spark.createDataFrame([(i, "x" * i) for i in range(1, 12)], "id int, s string")
    assert paging.page_within(long, ["id"], ["s"], None, 5, 20).count() == 6
    with pytest.raises(RefusedError):
        paging.page_within(long, ["id"], ["s"], [5], 5, 11)


def test_batches(spark, people):
    rows = paging.batched(people, ["id"], 64).collect()
    assert all(r["batch_sequence"] == r["id"] // 64 and r["row_in_batch"] == r["id"] % 64 for r in rows)


def masked(people):
    return people.withColumn("c_masked", F.concat(F.lit("m"), "c"))


def test_lockstep_and_apply(spark, people, tmp_path):
    changes.require_lockstep(people, people, ["id"], ["c"])
    for target in (people.where("id > 0"), people.unionByName(spark.createDataFrame([(999, "x")], people.schema)), people.withColumn("c", F.when(F.col("id") == 4, "other").otherwise(F.col("c")))):
        with pytest.raises(RefusedError):
            changes.require_lockstep(people, target, ["id"], ["c"])
    with pytest.raises(RefusedError):
        changes.require_lockstep(people.limit(0), people.limit(0), ["id"], ["c"])
    c = changes.row_changes(masked(people), ["id"], ["c"])
    assert c.count() == people.where("c IS NOT NULL").count()
    path = f"{tmp_path}/out"
    assert changes.apply_changes(people, c, ["id"], ["c"], path) == c.count()
    out = spark.read.parquet(path)
    issues, ok = validation.validate(people, out, ["id"], ["c"])
    assert ok, issues.collect()


def test_a_moved_row_stops_everything(spark, people, tmp_path):
    c = changes.row_changes(masked(people), ["id"], ["c"])
    moved = people.withColumn("c", F.when(F.col("id") == 4, "other").otherwise(F.col("c")))
    with pytest.raises(RefusedError):
        changes.apply_changes(moved, c, ["id"], ["c"], f"{tmp_path}/out")
    assert not (tmp_path / "out").exists()
    same = c.withColumn("replacement_c", F.col("expected_c"))
    with pytest.raises(RefusedError):
        changes.apply_changes(people, same, ["id"], ["c"], f"{tmp_path}/out")


def codes(issues):
    return {(r["code"], r["column"]): r["n"] for r in issues.collect()}


def test_validator_finds_each_kind(spark, people):
    good = masked(people).select("id", F.col("c_masked").alias("c"))
    bad = good.where("id <> 7").withColumn("c", F.when(F.col("id") == 8, "v8").when(F.col("id") == 9, "x").when(F.col("id") == 10, None).otherwise(F.col("c"))).unionByName(spark.createDataFrame([(-1, "q")], good.schema))
    issues, ok = validation.validate(people, bad, ["id"], ["c"])
    assert not ok and codes(issues) == {("key_mismatch", ""): 2, ("unchanged_value", "c"): 1, ("conflicting_evidence", "c"): 2}
    issues, ok = validation.validate(people, good.where("id < 100"), ["id"], ["c"])
    assert not ok and codes(issues)[("row_count_mismatch", "")] == 100
    twice, ok = validation.validate(people, good.unionByName(good.where("id = 3")), ["id"], ["c"])
    assert not ok and ("repeated_key", "") in codes(twice)
    assert not validation.validate(people, good.withColumn("more", F.lit(1)), ["id"], ["c"])[1]
    with pytest.raises(RefusedError):
        validation.validate(people, good, ["id"], ["c"], row_limit=5)
    with pytest.raises(RefusedError):
        validation.compare_rows(people.withColumn("id", F.col("id").cast("double")), good, ["id"], ["c"])
    assert not validation.validate(people, good, ["id"], ["c"], row_limit=5, strict=False)[0].isEmpty()


def test_empty_tables_pass(spark, people):
    assert validation.validate(people.limit(0), people.limit(0), ["id"], ["c"])[1]


def test_issue_groups_are_bounded(spark):
    d = spark.createDataFrame([("fail", f"c{i}", "", 1) for i in range(5)], validation.ISSUES)
    with pytest.raises(RefusedError):
        validation.sum_issues(d, 4)


def test_orphans_and_multisets(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, p int")
    assert [r["id"] for r in validation.orphans(child, spark.createDataFrame([(1,)], "k int"), ["p"], ["k"]).collect()] == [2]
    assert validation.multiset_equal([1, 1, 2], [2, 1, 1]) and not validation.multiset_equal([1, 2], [1, 1, 2])


def test_content_digest_sees_order_free_content(spark, people):
    of = lambda d: tuple(validation.content_digest(d, "t", ["id"], ["id", "c"], {}, 16).first())
    assert of(people) == of(people.orderBy(F.desc("id")).repartition(7))
    assert of(people) != of(people.withColumn("c", F.coalesce("c", F.lit(""))))
    assert of(people.limit(0))[1] == 0
