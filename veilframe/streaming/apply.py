"""Masking in bounded batches with receipts and progress, resumable after any stop.

A file stream reads the source; each micro-batch is masked, written to its own folder of the target and
then receipted. A batch is replayed into the same folder, so a stop between data and receipt changes nothing
and the result is exact. Receipts and progress are append-only Parquet tables beside the target.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import running
from ..operators.paging import RefusedError, byte_budget
from ..plans.plan import RESERVED
from ..plans.registry import Registry

RECEIPT = "run_id string, batch_sequence long, batch_id string, table_name string, affected_rows long, outcome int, receipt_version int, created_at timestamp, source_batch long, rows long"
PROGRESS = "run_id string, checkpoint_sequence long, kind string, table_ordinal int, rows_processed long, rows_committed long, committed_batches long, batch_id string, affected_rows long, business_complete boolean, created_at timestamp, source_batch long"
MANIFEST = "run_id string, sequence long, state string, plan_id string, key_check string, settings string, created_at timestamp"
OUTCOMES = ("committed", "unknown", "commit_failed", "failed_before_commit", "audit_incomplete")
#: Manifest states; the last four are final.
STATES = ("created", "running", "interrupted", "validating", "business_complete", "complete", "validation_failed", "commit_unknown", "refused")
FINAL = frozenset(STATES[5:])


@dataclass(frozen=True)
class Budget:
    """Every bound is said, none has a default."""

    max_row_bytes: int
    max_process_bytes: int
    max_disk_bytes: int
    page_rows: int
    queue: int

    def check(self, row_bytes: int, total_bytes: int) -> None:
        if min(self.max_row_bytes, self.max_process_bytes, self.max_disk_bytes, self.page_rows) <= 0 or self.queue != 0:
            raise RefusedError("invalid: budget")
        if row_bytes > self.max_row_bytes or 4 * row_bytes * self.page_rows + (16 << 20) > self.max_process_bytes or 3 * total_bytes > self.max_disk_bytes:
            raise RefusedError("unsafe: budget")


def key_check(key: bytes, key_id: str) -> str:
    """Shows on resume that the key is the same one, without telling it."""
    return hmac.new(key, b"key-check-v1\0" + key_id.encode(), hashlib.sha256).hexdigest()


def next_state(now: str, then: str, sequence: int, expected: int) -> str:
    if now in FINAL or sequence != expected or then not in STATES:
        raise RefusedError("conflict: manifest")
    return then


@dataclass(frozen=True)
class Gates:
    """What must hold before a run may write; each is called in this order and raises to refuse."""

    approve: Callable[[], object]
    preflight: Callable[[], object]
    budget: Budget


@dataclass(frozen=True)
class Binding:
    """What a run is bound to; a resumed run must bring the same."""

    plan_id: str
    key_check: str
    settings: str

    @classmethod
    def of(cls, plan_id: str, key: bytes, key_id: str, settings: object) -> Binding:
        return cls(plan_id, key_check(key, key_id), hashlib.sha256(repr(settings).encode()).hexdigest())


class Run:
    """One run's folder: target (a folder for each batch), receipt, progress and manifest.

    Empty input gives no batch and no receipt. A batch whose planned values are all NULL is copied, counts as
    processed, and takes neither a sequence nor a receipt. Rows that can't be masked stop the run before
    anything is written, whatever file they are in."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str):
        self.spark, self.folder, self.run_id = spark, folder.rstrip("/"), run_id
        self.data, self.receipts_at, self.progress_at, self.manifest_at = (f"{self.folder}/{x}" for x in ("target", "receipt", "progress", "manifest"))

    def _there(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _table(self, path: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def _append(self, path: str, schema: str, *values: object) -> None:
        self.spark.createDataFrame([values], schema).coalesce(1).write.mode("append").parquet(path)

    def receipts(self) -> DataFrame:
        return self._table(self.receipts_at, RECEIPT).where(F.col("run_id") == self.run_id)

    def progress(self) -> DataFrame:
        return self._table(self.progress_at, PROGRESS).where(F.col("run_id") == self.run_id)

    def target(self) -> DataFrame:
        return self.spark.read.parquet(self.data).drop("batch")

    def check_records(self) -> None:
        """The records that are there have exactly the declared columns, and no part of them is missing."""
        for path, schema in ((self.receipts_at, RECEIPT), (self.progress_at, PROGRESS), (f"{self.manifest_at}/{self.run_id}", MANIFEST)):
            if self._there(path):
                stored = self.spark.read.option("recursiveFileLookup", "true").parquet(path).schema
                if [(f.name, f.dataType) for f in stored] != [(f.name, f.dataType) for f in self.spark.createDataFrame([], schema).schema]:
                    raise RefusedError("conflict: records have another shape")
        known = self._there(f"{self.manifest_at}/{self.run_id}")
        if not known and not (self.receipts().isEmpty() and self.progress().isEmpty()):
            raise RefusedError("conflict: records without a run")

    # ---- manifest

    def manifest(self) -> dict:
        """The latest state; not_found if the run was never begun."""
        at = f"{self.manifest_at}/{self.run_id}"
        last = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(at).orderBy(F.desc("sequence")).limit(1).collect() if self._there(at) else []
        if not last:
            raise RefusedError("not_found: run")
        return last[0].asDict()

    def move(self, then: str, binding: Binding | None = None) -> None:
        """Write the next state. Its folder is named by its sequence and made once, so of two writers one is refused."""
        try:
            now = self.manifest()
        except RefusedError:
            now = None
        if now is None and (binding is None or then != "created"):
            raise RefusedError("not_found: run")
        sequence = 0 if now is None else now["sequence"] + 1
        state = then if now is None else next_state(now["state"], then, sequence, now["sequence"] + 1)
        bound = binding or Binding(now["plan_id"], now["key_check"], now["settings"])
        row = self.spark.createDataFrame([(self.run_id, sequence, state, bound.plan_id, bound.key_check, bound.settings, _now())], MANIFEST)
        try:
            row.coalesce(1).write.mode("errorifexists").parquet(f"{self.manifest_at}/{self.run_id}/{sequence:08d}")
        except AnalysisException as e:
            raise RefusedError("conflict: manifest") from e

    # ---- batches

    def start(self, source_path: str, table: str, mask: Callable[[DataFrame], DataFrame], files_per_batch: int = 1, hook: Callable[[str, int], None] = lambda stage, n: None, columns: list[str] | None = None) -> None:
        """Process all that is there, then stop. mask must refuse rows that it can't mask; columns are the
        planned ones (without them every row counts as written)."""
        whole = self.spark.read.parquet(source_path)
        mask(whole)  # a dry run over all rows: what mask refuses is refused before a byte is written
        stream = self.spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_path)
        # the run's state is read once and kept
        seen = {r["source_batch"] for r in self.receipts().select("source_batch").collect()}
        last = self.progress().agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("checkpoint_sequence", "rows_processed", "rows_committed", "committed_batches")]).first().asDict()
        skipped = {r["source_batch"] for r in self.progress().where("kind = 'progress'").select("source_batch").collect()}
        if len(seen) > last["committed_batches"]:  # stopped between a receipt and its progress
            lost = self.receipts().where(F.col("batch_sequence") >= last["committed_batches"]).orderBy("batch_sequence").collect()
            for r in lost:
                self._progress(last, "batch", r["rows"], r["affected_rows"], r["source_batch"])

        def each(batch: DataFrame, n: int) -> None:
            if n in seen or n in skipped:
                return  # replayed after its receipt was written
            hook("before_write", n)
            mask(batch).write.mode("overwrite").parquet(f"{self.data}/batch={n}")
            hook("after_write", n)
            written = self.spark.read.schema(batch.schema).parquet(f"{self.data}/batch={n}")
            some = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull() if columns else F.lit(True)
            got = written.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(some.cast("long")), F.lit(0)).alias("affected")).first()
            if got["affected"]:
                sequence = last["committed_batches"]
                self._append(self.receipts_at, RECEIPT, self.run_id, sequence, f"{self.run_id}-{sequence}", table, got["affected"], 1, 1, _now(), n, got["rows"])
                seen.add(n)
                hook("after_receipt", n)
                self._progress(last, "batch", got["rows"], got["affected"], n)
            elif got["rows"]:
                self._progress(last, "progress", got["rows"], 0, n)

        q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()

    def _progress(self, last: dict, kind: str, rows: int, affected: int, source_batch: int | None, complete: bool = False) -> None:
        last["checkpoint_sequence"] += 1
        last["rows_processed"] += rows
        last["rows_committed"] += affected
        last["committed_batches"] += kind == "batch"
        name = f"{self.run_id}-{last['committed_batches'] - 1}" if kind == "batch" else None
        self._append(self.progress_at, PROGRESS, self.run_id, last["checkpoint_sequence"], kind, 0, last["rows_processed"], last["rows_committed"], last["committed_batches"], name, affected, complete, _now(), source_batch)

    # ---- a whole run

    def execute(self, source_path: str, table: str, mask: Callable[[DataFrame], DataFrame], keys: list[str], columns: list[str], gates: Gates, binding: Binding, files_per_batch: int = 1, hook: Callable[[str, int], None] = lambda stage, n: None, registry: Registry | None = None) -> dict:
        """Structure, reserved names, approval, preflight, budget, dry run; then batches, strict validation and
        the final state. Gives the summary; a refusal before the first batch leaves no trace of the run."""
        source = self.spark.read.parquet(source_path)
        if not keys or not columns or not set(keys) | set(columns) <= set(source.columns):
            raise RefusedError("invalid: structure")
        if table.lower() in RESERVED:
            raise RefusedError("invalid: reserved table")
        gates.approve()
        gates.preflight()
        size = byte_budget(source).first()
        gates.budget.check(size["max_row_bytes"], size["total_bytes"])
        mask(source)
        self.check_records()
        if self._there(f"{self.manifest_at}/{self.run_id}"):
            raise RefusedError("conflict: run exists")
        self.move("created", binding)
        return self._finish(source_path, table, mask, keys, columns, files_per_batch, hook, registry)

    def resume(self, source_path: str, table: str, mask: Callable[[DataFrame], DataFrame], keys: list[str], columns: list[str], gates: Gates, binding: Binding, files_per_batch: int = 1, hook: Callable[[str, int], None] = lambda stage, n: None, registry: Registry | None = None) -> dict:
        """Go on with a stopped run: same binding, a state that isn't final, records that agree."""
        now = self.manifest()
        if now["state"] in FINAL:
            raise RefusedError("conflict: the run is final")
        if Binding(now["plan_id"], now["key_check"], now["settings"]) != binding:
            raise RefusedError("conflict: binding")
        gates.approve()
        gates.preflight()
        self.check_records()
        behind = reconcile(self.progress(), self.receipts()).where("receipt_rows = 0 OR progress_rows > 0")  # a receipt may be one step ahead
        if not transition_issues(self.progress()).isEmpty() or not behind.isEmpty():
            raise RefusedError("conflict: records")
        return self._finish(source_path, table, mask, keys, columns, files_per_batch, hook, registry)

    def _finish(self, source_path, table, mask, keys, columns, files_per_batch, hook, registry) -> dict:
        from ..operators.validation import validate

        self.move("running")
        try:
            self.start(source_path, table, mask, files_per_batch, hook, columns)
        except Exception:
            self.move("interrupted")
            raise
        self.move("validating")
        source = self.spark.read.parquet(source_path)
        target = self.target() if self._there(self.data) else source.limit(0)
        issues, ok = validate(source, target, keys, columns, registry=registry, table=table)
        if not ok:
            self.move("validation_failed")
            raise RefusedError("validation: " + "; ".join(sorted(f"{r['code']} x {r['n']}" for r in issues.collect())))
        last = self.progress().agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("checkpoint_sequence", "rows_processed", "rows_committed", "committed_batches")]).first().asDict()
        self._progress(last, "boundary", 0, 0, None, True)
        self.move("business_complete")
        out = self.summary()
        if out["missing_batches"] or out["rows_committed"] != out["rows_receipted"] or out["rows_processed"] != source.count():
            raise RefusedError("conflict: records")  # complete only if the audit agrees
        self.move("complete")
        return out | {"state": "complete"}

    def summary(self) -> dict:
        """Receipts beside progress; missing_batches counts gaps in the sequences from 0."""
        r = self.receipts().agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("affected_rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("batch_sequence"), F.lit(-1)).alias("last")).first()
        p = self.progress().agg(F.coalesce(F.max("rows_processed"), F.lit(0)).alias("done"), F.coalesce(F.max("rows_committed"), F.lit(0)).alias("rows")).first()
        return {"state": self.manifest()["state"], "batches": r["batches"], "missing_batches": r["last"] + 1 - r["batches"], "rows_receipted": r["rows"], "rows_committed": p["rows"], "rows_processed": p["done"]}

    def status(self) -> DataFrame:
        return receipt_summary(self.receipts())


def _now() -> datetime:
    return datetime.now(UTC)


def receipt_page(receipts: DataFrame, after: int, size: int) -> tuple[list, bool]:
    """The next receipts after a sequence, and whether there are more; a gap is refused."""
    if not 1 <= size <= 1000:
        raise RefusedError("invalid: page request")
    rows = receipts.where(F.col("batch_sequence") > after).orderBy("batch_sequence").limit(size + 1).collect()
    if [r["batch_sequence"] for r in rows] != list(range(after + 1, after + 1 + len(rows))):
        raise RefusedError("conflict: receipts")
    return rows[:size], len(rows) > size


def receipt_summary(receipts: DataFrame) -> DataFrame:
    return receipts.agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("affected_rows"), F.lit(0)).alias("rows"), F.max("batch_sequence").alias("last_batch"))


def of_known_runs(records: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose run exists, and those whose run doesn't."""
    runs = manifests.select("run_id").distinct()
    return records.join(runs, "run_id", "left_semi"), records.join(runs, "run_id", "left_anti")


def apply_summary(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("table_name").agg(F.count(F.lit(1)).alias("batches"), F.sum("affected_rows").alias("rows"), F.max("batch_sequence").alias("last_batch"))


def planned_receipts(batched: DataFrame, run_id: str, writes: F.Column) -> DataFrame:
    """What a run would receipt: batches with something to write, numbered without gaps."""
    b = batched.groupBy("batch_sequence").agg(F.sum(writes.cast("long")).alias("affected_rows")).where("affected_rows > 0")
    n = running(b, ["batch_sequence"], {"at": F.lit(1)}).select(F.col("at").alias("batch_sequence"), "affected_rows")
    return n.select(F.lit(run_id).alias("run_id"), "batch_sequence", F.concat(F.lit(f"{run_id}-"), F.col("batch_sequence").cast("string")).alias("batch_id"), "affected_rows")


def progress_events(receipts: DataFrame) -> DataFrame:
    """What a run has done after each batch: sums over all runs in key order, less what went before the run."""
    r = running(receipts, ["run_id", "batch_sequence"], {"rows_": F.col("affected_rows"), "batches_": F.lit(1)})
    first = r.groupBy("run_id").agg(F.min("rows_").alias("rows_0"), F.min("batches_").alias("batches_0"))
    done = r.join(first, "run_id")
    return done.select("run_id", (F.col("batch_sequence") + 1).alias("checkpoint_sequence"), (F.col("rows_") - F.col("rows_0") + F.col("affected_rows")).alias("rows_committed"), (F.col("batches_") - F.col("batches_0") + 1).alias("committed_batches"), "batch_id", "affected_rows")


def transition_issues(progress: DataFrame) -> DataFrame:
    """Progress that doesn't follow from its predecessor."""
    w = Window.partitionBy("run_id").orderBy("checkpoint_sequence")
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(0))
    p = progress.withColumn("s_", before("checkpoint_sequence")).withColumn("r_", before("rows_committed")).withColumn("b_", before("committed_batches"))
    step = F.when(F.col("kind") == "batch", 1).otherwise(0) if "kind" in progress.columns else F.lit(1)
    wrong = (F.col("checkpoint_sequence") != F.col("s_") + 1) | (F.col("rows_committed") != F.col("r_") + F.col("affected_rows")) | (F.col("committed_batches") != F.col("b_") + step)
    return p.where(wrong).drop("s_", "r_", "b_")


def reconcile(progress: DataFrame, receipts: DataFrame) -> DataFrame:
    """Batches that progress and receipts don't agree on, from either side."""
    p = progress.where("kind = 'batch'") if "kind" in progress.columns else progress
    p = p.select(F.col("run_id").alias("p_run"), (F.col("committed_batches") - 1).alias("p_seq"), F.col("affected_rows").alias("p_rows"), F.col("batch_id").alias("p_id"))
    j = p.join(receipts, [F.col("p_run") == F.col("run_id"), F.col("p_seq") == F.col("batch_sequence")], "full_outer")
    return j.where(F.col("p_run").isNull() | F.col("run_id").isNull() | (F.col("p_rows") != F.col("affected_rows")) | (F.col("p_id") != F.col("batch_id"))).select(F.coalesce("p_run", "run_id").alias("run_id"), F.coalesce("p_seq", "batch_sequence").alias("batch_sequence"), F.coalesce("p_rows", F.lit(0)).alias("progress_rows"), F.coalesce("affected_rows", F.lit(0)).alias("receipt_rows"))


def resume_issues(source: DataFrame, masked: DataFrame, target: DataFrame, keys: list[str], columns: list[str], rows_done: int) -> DataFrame:
    """Rows of the target that are neither masked (before the checkpoint) nor original (after it), by kind."""
    from ..operators.paging import batched

    order = batched(source.select(*keys, *[F.col(c).alias(f"s_{c}") for c in columns]), keys, 1).withColumnRenamed("batch_sequence", "at_").drop("row_in_batch")
    j = order.join(masked.select(*keys, *[F.col(f"{c}_masked").alias(f"m_{c}") for c in columns]), keys, "left").join(target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in columns], F.lit(1).alias("in_t")), keys, "full_outer")
    done = F.col("at_") < rows_done
    bad = F.lit(False)
    for c in columns:
        bad = bad | ~F.col(f"t_{c}").eqNullSafe(F.when(done, F.col(f"m_{c}")).otherwise(F.col(f"s_{c}")))
    kind = F.when(F.col("in_t").isNull(), "missing").when(F.col("at_").isNull(), "extra").when(bad & done, "not_masked").when(bad, "changed")
    return j.select(kind.alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
