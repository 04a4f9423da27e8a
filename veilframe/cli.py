"""Command line: scan, mask, validate, approve, revoke, stream, resume, status, version.

Nothing that is printed holds a value: only positions, categories and counts. Exit 0: done; 1: refused or
incomplete; 2: bad arguments. resume: 3 may be tried again, 4 conflict, 5 commit unknown, 6 unsupported,
7 not found, 8 unsafe, 9 validation failed.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .functions.digest import MaskError, MaskPlan
from .operators import changes, masking, validation
from .operators.paging import RefusedError, limited
from .plans import plan as plans
from .plans.approval import Record, Store, load_trust
from .plans.registry import GateError, Registry, preflight
from .sources import catalog, readers
from .streaming.apply import Binding, Budget, Gates, Run

VERSION = "0.1"


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilframe")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "mask", "validate", "approve", "revoke", "stream", "resume"):
        c = sub.add_parser(name)
        c.add_argument("--source", required=True)
        c.add_argument("--target", required=True)
        c.add_argument("--scope", action="append", required=True, metavar="TABLE.COLUMN")
        c.add_argument("--key-column", action="append", required=True, metavar="TABLE.COLUMN")
        c.add_argument("--strategy", default="redact")
        c.add_argument("--key-file")
        c.add_argument("--key-id", default="k1")
        c.add_argument("--sample-limit", type=int, default=128)
        c.add_argument("--batch-size", type=int, default=64)
        c.add_argument("--reviewed", action="append", default=[], metavar="TABLE.COLUMN")
        c.add_argument("--approvals")
        c.add_argument("--trust-file")
        c.add_argument("--signing-key-file")
        c.add_argument("--signer", default="")
        c.add_argument("--valid-for", type=int, default=24 * 3600)
        c.add_argument("--apply", action="store_true")
        c.add_argument("--limit-per-table", type=int, default=0, help="preview only this many rows a table, in key order")
        c.add_argument("--out")
        c.add_argument("--constraints", default="", metavar="FILE", help="JSON, or the SQLite database that the tables come from")
        if name in ("stream", "resume"):
            c.add_argument("--run-folder", required=True)
            c.add_argument("--run-id", required=True)
            for bound in ("page-rows", "max-row-bytes", "max-process-bytes", "max-disk-bytes"):
                c.add_argument(f"--{bound}", type=int, required=True)
    s = sub.add_parser("status")
    s.add_argument("--run-folder", required=True)
    s.add_argument("--run-id", required=True)
    sub.add_parser("version")
    return p


def _pairs(items: list[str]) -> list[tuple[str, str]]:
    out = [tuple(x.split(".", 1)) for x in items]
    if any(len(x) != 2 or not all(x) for x in out):
        raise GateError("invalid: scope")
    return out


def _plan(spark: SparkSession, a: argparse.Namespace):
    plans.distinct_paths(a.source, a.target)
    runtime = plans.Runtime(tuple(plans.Scope(*x) for x in _pairs(a.scope)), a.strategy, a.sample_limit, a.batch_size)
    keys: dict[str, tuple[str, ...]] = {}
    for t, c in _pairs(a.key_column):
        keys[t] = (*keys.get(t, ()), c)
    registry = catalog.scoped(catalog.sqlite(a.constraints), keys) if catalog.is_sqlite(a.constraints) else plans.from_file(a.constraints, keys, runtime.tables)
    source = {t: readers.parquet(spark, a.source, t, tuple(runtime.tables)) for t in runtime.tables}
    reviewed: dict[str, dict[str, str]] = {}
    for t, c in _pairs(a.reviewed):
        reviewed.setdefault(t, {})[c] = "sensitive"
    return plans.build(source, registry, runtime, a.target, reviewed=reviewed), runtime, registry, source


def _masked(a: argparse.Namespace, df: DataFrame, table: str, columns: list[str], keys: list[str]) -> DataFrame:
    key = readers.key_from_file(a.key_file) if a.key_file else None
    out = df
    for c in columns:
        p = MaskPlan(a.strategy, f"parquet/{table}/{c}", a.key_id, key or bytes(32)) if key or a.strategy in ("null", "blank", "redact") else None
        if p is None:
            raise GateError("invalid: this strategy needs a key file")
        out = masking.mask_column(out, c, p)
    return masking.require_masked(out, columns)


#: Exits of resume by category; others may be tried again.
EXITS = {"conflict": 4, "unknown": 5, "unsupported": 6, "not_found": 7, "unsafe": 8, "validation": 9}


def _streamed(spark: SparkSession, a: argparse.Namespace, plan: plans.Plan, runtime: plans.Runtime, registry: Registry, source: dict[str, DataFrame], scopes: tuple, now: int) -> int:
    """One table in receipted batches; the run's folder holds its target."""
    if len(runtime.tables) != 1 or not a.key_file:
        raise GateError("unsupported: a streamed run has one table and a key file")
    t = runtime.tables[0]
    keys, columns = list(registry.table(t).keys), runtime.columns(t)

    def mask(batch: DataFrame) -> DataFrame:
        m = _masked(a, batch, t, columns, keys)
        return m.select(*[m[f"{c}_masked"].alias(c) if c in columns else m[c] for c in batch.columns])

    def approve() -> None:
        if not (a.approvals and a.trust_file):
            raise GateError("refused: a streamed run needs an approval")
        try:
            Store(a.approvals, load_trust(a.trust_file)).lookup(plan.plan_id, a.target, scopes, now)
        except GateError as e:
            raise GateError("approval: none that holds") from e

    budget = Budget(a.max_row_bytes, a.max_process_bytes, a.max_disk_bytes, a.page_rows, 0)
    gates = Gates(approve, lambda: preflight(registry, t, columns), budget)
    binding = Binding.of(plan.plan_id, readers.key_from_file(a.key_file), a.key_id, (budget, runtime))
    r = Run(spark, a.run_folder, a.run_id)
    if a.command == "resume":
        r.manifest()
    go = r.resume if a.command == "resume" else r.execute
    out = go(f"{a.source.rstrip('/')}/{t}.parquet", t, mask, keys, columns, gates, binding, registry=registry)
    print(f"table 0: {out['rows_committed']} rows in {out['batches']} batches, {out['state']}")
    return 0


def run(argv: list[str], spark: SparkSession | None = None, now: int | None = None) -> int:
    try:
        a = _arguments().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0) and 2
    if a.command == "version":
        print(VERSION)
        return 0
    spark = spark or SparkSession.builder.appName("veilframe").getOrCreate()
    now = int(time.time()) if now is None else now
    try:
        if a.command == "status":
            r = Run(spark, a.run_folder, a.run_id).status().first()
            try:
                state = Run(spark, a.run_folder, a.run_id).manifest()["state"]
            except RefusedError:
                state = "none"
            print(f"batches {r['batches']} rows {r['rows']} state {state}")
            return 0
        plan, runtime, registry, source = _plan(spark, a)
        scopes = tuple((s.table, s.column) for s in runtime.scopes)
        if a.command == "scan":
            for k, (_, _, verdict) in enumerate(plan.verdicts):
                print(f"scope {k}: {verdict}")
            print(f"plan {plan.plan_id}")
            return 0
        if a.command in ("approve", "revoke"):
            record = Record(plan.plan_id, scopes, a.target, now, now + a.valid_for, a.signer)
            store = Store(a.approvals, load_trust(a.trust_file))
            getattr(store, a.command)(record, Path(a.signing_key_file).read_bytes())
            print(f"{a.command}d {plan.plan_id}")
            return 0
        if a.command in ("stream", "resume"):
            return _streamed(spark, a, plan, runtime, registry, source, scopes, now)
        for k, t in enumerate(runtime.tables):
            keys, columns = list(registry.table(t).keys), runtime.columns(t)
            target = readers.parquet(spark, a.target, t, tuple(runtime.tables))
            if a.command == "validate":
                issues, ok = validation.validate(source[t], target, keys, columns, registry=registry, table=t)
                for r in issues.collect():
                    print(f"table {k}: {r['status']} {r['code']} {r['n']}")
                if not ok:
                    return 1
                print(f"table {k}: passed")
                continue
            if a.limit_per_table and a.apply:
                raise GateError("unsupported: applying covers all rows")
            changes.require_lockstep(source[t], target, keys, columns)
            rows = changes.row_changes(_masked(a, limited(source[t], keys, a.limit_per_table), t, columns, keys), keys, columns)
            if not a.apply:
                print(f"table {k}: {rows.count()} rows would change")
                continue
            if not (a.approvals and a.trust_file and a.out):
                raise GateError("unsafe: applying needs an approval and an output folder")
            Store(a.approvals, load_trust(a.trust_file)).lookup(plan.plan_id, a.target, scopes, now)
            plans.recheck(plan, _plan(spark, a)[0])  # the input may have changed since it was scanned
            print(f"table {k}: {changes.apply_changes(target, rows, keys, columns, f'{a.out}/{t}.parquet')} rows changed")
        return 0
    except (GateError, MaskError, RefusedError) as e:
        print(f"refused: {e}", file=sys.stderr)
        return EXITS.get(str(e).split(":")[0], 3) if a.command == "resume" else 1


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
