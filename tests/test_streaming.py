import pytest
from pyspark.sql import functions as F

from veilframe.functions.digest import MaskPlan
from veilframe.operators import masking
from veilframe.operators.paging import RefusedError
from veilframe.streaming import apply

P = MaskPlan("fake_email", "parquet/t/mail", "k1", bytes(32))


def mask(batch):
    m = masking.mask_column(batch, "mail", P)
    return masking.require_masked(m, ["mail"]).select("id", F.col("mail_masked").alias("mail"))


@pytest.fixture
def source(spark, tmp_path):
    path = f"{tmp_path}/source"
    spark.createDataFrame([(i, f"u{i}@example.com") for i in range(90)], "id int, mail string").repartition(3).write.parquet(path)
    return path


def test_run_stop_and_resume(spark, source, tmp_path):
    run = apply.Run(spark, f"{tmp_path}/run", "r1")
    stopped = []

    def hook(stage, n):
        if stage == "after_write" and n == 1 and not stopped:
            stopped.append(n)
            raise RuntimeError("stop")

    with pytest.raises(Exception):  # noqa: B017
        run.start(source, "t", mask, hook=hook)
    assert run.receipts().count() == 1
    run.start(source, "t", mask, hook=hook)
    assert tuple(run.status().first()) == (3, 90, 2)
    s, t = spark.read.parquet(source), run.target()
    assert t.count() == 90 and t.join(s, ["id", "mail"]).count() == 0
    assert apply.transition_issues(run.progress()).isEmpty() and apply.reconcile(run.progress(), run.receipts()).isEmpty()
    run.start(source, "t", mask)  # nothing left to do
    assert run.receipts().count() == 3


def test_refused_rows_write_nothing(spark, tmp_path):
    path = f"{tmp_path}/source"
    spark.createDataFrame([(1, "no address")], "id int, mail string").write.parquet(path)
    run = apply.Run(spark, f"{tmp_path}/run", "r1")
    with pytest.raises(Exception):  # noqa: B017
        run.start(path, "t", mask)
    assert run.receipts().isEmpty() and not (tmp_path / "run" / "target").exists()


def test_tampered_records_are_seen(spark, source, tmp_path):
    run = apply.Run(spark, f"{tmp_path}/run", "r1")
    run.start(source, "t", mask)
    less = run.receipts().where("batch_sequence <> 1")
    assert apply.reconcile(run.progress(), less).count() == 1
    wrong = run.progress().withColumn("rows_committed", F.when(F.col("checkpoint_sequence") == 2, 1).otherwise(F.col("rows_committed")))
    assert not apply.transition_issues(wrong).isEmpty()
    assert {r["table_name"]: r["rows"] for r in apply.apply_summary(run.receipts()).collect()} == {"t": 90}


def test_budget_states_and_keys():
    b = apply.Budget(1000, 1 << 26, 1 << 20, 64, 0)
    b.check(900, 1000)
    for row, total in ((1001, 10), (900, 1 << 20)):
        with pytest.raises(RefusedError):
            b.check(row, total)
    with pytest.raises(RefusedError):
        apply.Budget(1000, 1 << 26, 1 << 20, 64, 1).check(1, 1)
    assert apply.next_state("created", "running", 3, 3) == "running"
    for now, then, n in (("complete", "running", 3), ("created", "nowhere", 3), ("created", "running", 2)):
        with pytest.raises(RefusedError):
            apply.next_state(now, then, n, 3)
    assert apply.key_check(bytes(32), "a") != apply.key_check(bytes(32), "b") != apply.key_check(bytes([1]) * 32, "b")


def test_a_bad_file_writes_nothing_in_any_order(spark, tmp_path):
    for k, parts in enumerate((([(1, "a@b.org")], [(2, "no address")]), ([(2, "no address")], [(1, "a@b.org")]), ([], [(2, "no address")]))):
        path = f"{tmp_path}/s{k}"
        for rows in parts:
            spark.createDataFrame(rows, "id int, mail string").coalesce(1).write.mode("append").parquet(path)
        run = apply.Run(spark, f"{tmp_path}/run{k}", "r1")
        with pytest.raises(Exception):  # noqa: B017
            run.start(path, "t", mask)
        assert run.receipts().isEmpty() and not (tmp_path / f"run{k}" / "target").exists()


def test_batches_with_nothing_to_write_take_no_sequence(spark, tmp_path):
    path = f"{tmp_path}/s"
    for rows in ([(1, None), (2, None)], [(3, "c@d.org"), (4, None)], [], [(5, "e@f.org")]):
        spark.createDataFrame(rows, "id int, mail string").coalesce(1).write.mode("append").parquet(path)
    run = apply.Run(spark, f"{tmp_path}/run", "r1")
    run.start(path, "t", mask, columns=["mail"])
    assert sorted((r["batch_sequence"], r["batch_id"], r["affected_rows"]) for r in run.receipts().collect()) == [(0, "r1-0", 1), (1, "r1-1", 1)]
    assert run.target().count() == 5 and run.progress().agg(F.max("rows_processed")).first()[0] == 5
    assert apply.transition_issues(run.progress()).isEmpty() and apply.reconcile(run.progress(), run.receipts()).isEmpty()
    rows, more = apply.receipt_page(run.receipts(), -1, 1)
    assert len(rows) == 1 and more
    with pytest.raises(RefusedError):
        apply.receipt_page(run.receipts().where("batch_sequence > 0"), -1, 5)


BINDING = apply.Binding.of("plan", bytes(32), "k1", ("t", 1))


def gates(log, refuse=""):
    def call(name):
        def f():
            log.append(name)
            if name == refuse:
                raise RefusedError(f"unsafe: {name}")

        return f

    return apply.Gates(call("approve"), call("preflight"), apply.Budget(10_000, 1 << 30, 1 << 30, 64, 0))


def test_gates_come_before_any_write(spark, source, tmp_path):
    run = apply.Run(spark, f"{tmp_path}/run", "r1")
    for refuse, seen in (("approve", ["approve"]), ("preflight", ["approve", "preflight"])):
        log = []
        with pytest.raises(RefusedError):
            run.execute(source, "t", mask, ["id"], ["mail"], gates(log, refuse), BINDING)
        assert log == seen and not (tmp_path / "run").exists()
    with pytest.raises(RefusedError):
        run.execute(source, "receipt", mask, ["id"], ["mail"], gates([]), BINDING)
    with pytest.raises(RefusedError):
        run.execute(source, "t", mask, ["id"], ["other"], gates([]), BINDING)
    out = run.execute(source, "t", mask, ["id"], ["mail"], gates([]), BINDING)
    assert out == {"state": "complete", "batches": 3, "missing_batches": 0, "rows_receipted": 90, "rows_committed": 90, "rows_processed": 90}
    with pytest.raises(RefusedError):
        run.execute(source, "t", mask, ["id"], ["mail"], gates([]), BINDING)


def test_a_stopped_run_resumes_with_the_same_binding(spark, source, tmp_path):
    run = apply.Run(spark, f"{tmp_path}/run", "r1")
    for stage in ("after_write", "after_receipt"):
        def hook(at, n, stage=stage):
            if at == stage and n == 1:
                raise RuntimeError("stop")

        go = run.execute if stage == "after_write" else run.resume
        with pytest.raises(Exception):  # noqa: B017
            go(source, "t", mask, ["id"], ["mail"], gates([]), BINDING, hook=hook)
        assert run.manifest()["state"] == "interrupted"
    with pytest.raises(RefusedError):
        run.resume(source, "t", mask, ["id"], ["mail"], gates([]), apply.Binding.of("plan", bytes([1]) * 32, "k1", ("t", 1)))
    out = run.resume(source, "t", mask, ["id"], ["mail"], gates([]), BINDING)
    assert out["batches"] == 3 and out["rows_committed"] == 90 and apply.transition_issues(run.progress()).isEmpty()
    with pytest.raises(RefusedError):
        apply.Run(spark, f"{tmp_path}/run", "other").manifest()


def test_a_target_that_fails_is_final(spark, source, tmp_path):
    run = apply.Run(spark, f"{tmp_path}/run", "r1")
    with pytest.raises(RefusedError, match="unchanged_value"):
        run.execute(source, "t", lambda d: d, ["id"], ["mail"], gates([]), BINDING)
    assert run.manifest()["state"] == "validation_failed"
    with pytest.raises(RefusedError):
        run.resume(source, "t", mask, ["id"], ["mail"], gates([]), BINDING)
    with pytest.raises(RefusedError):
        run.move("running")


def test_records_of_another_shape_or_without_a_run_are_refused(spark, tmp_path):
    r = apply.Run(spark, str(tmp_path / "a"), "r1")
    r.check_records()
    spark.createDataFrame([("r1", 0)], "run_id string, batch_sequence int").write.parquet(r.receipts_at)
    with pytest.raises(RefusedError, match="another shape"):
        r.check_records()
    r = apply.Run(spark, str(tmp_path / "b"), "r1")
    r._append(r.receipts_at, apply.RECEIPT, "r1", 0, "r1-0", "t", 1, 1, 1, apply._now(), 0, 1)
    with pytest.raises(RefusedError, match="without a run"):
        r.check_records()
    apply.Run(spark, str(tmp_path / "b"), "r2").check_records()  # another run's records don't matter
