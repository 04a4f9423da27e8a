"""Scopes, settings and plans. A plan's id binds what was seen, what will be done and how."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from ..operators import detection
from ..operators.masking import STRATEGIES
from .registry import GateError, Registry, preflight, table_info


@dataclass(frozen=True)
class Scope:
    table: str
    column: str


@dataclass(frozen=True)
class Runtime:
    scopes: tuple[Scope, ...]
    strategy: str = "redact"
    sample_limit: int = 128
    batch_size: int = 64
    workers: int = 1

    def __post_init__(self):
        if not self.scopes or len(set(self.scopes)) != len(self.scopes):
            raise GateError("invalid: scopes")
        if any(not s.table or not s.column or "\0" in s.table + s.column for s in self.scopes):
            raise GateError("invalid: scope name")
        if not (1 <= self.sample_limit <= 10_000 and 1 <= self.batch_size <= 1000 and 1 <= self.workers <= 16):
            raise GateError("invalid: limits")
        if self.strategy not in STRATEGIES:
            raise GateError("invalid: strategy")
        if any(s.table.lower() in RESERVED for s in self.scopes):
            raise GateError("invalid: reserved table")

    def columns(self, table: str) -> list[str]:
        return [s.column for s in self.scopes if s.table == table]

    @property
    def tables(self) -> list[str]:
        return list(dict.fromkeys(s.table for s in self.scopes))


#: Tables that the engine itself keeps.
RESERVED = frozenset({"run", "receipt", "manifest", "progress"})


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def schema_digest(frames: dict[str, DataFrame], registry: Registry) -> str:
    return digest({t: [sorted((f.name, f.dataType.simpleString(), f.nullable) for f in df.schema), asdict(registry.table(t))] for t, df in frames.items()})


def snapshot(df: DataFrame) -> str:
    """The files that a table was read from, with size and time of change; taken before and after a run, it
    shows a changed input, a file that was rewritten under its name included."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    found = []
    for f in df.inputFiles():
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        s = p.getFileSystem(conf).getFileStatus(p)
        found.append((f, s.getLen(), s.getModificationTime()))
    return digest(sorted(found))


@dataclass(frozen=True)
class Plan:
    runtime: Runtime
    verdicts: tuple[tuple[str, str, str], ...]
    snapshot_digest: str
    target_id: str
    schema_digest: str
    revision: str = "plan-v1"

    @property
    def config_digest(self) -> str:
        return digest(asdict(self.runtime))

    @property
    def plan_id(self) -> str:
        return digest([self.revision, self.snapshot_digest, self.target_id, self.schema_digest, self.config_digest, self.verdicts])


def build(source: dict[str, DataFrame], registry: Registry, runtime: Runtime, target_id: str, settings: detection.Settings | None = None, reviewed: dict[str, dict[str, str]] | None = None) -> Plan:
    """Scan the scopes and make a plan. Missing evidence outranks unsafe columns; unknown is never safe."""
    settings = settings or detection.Settings(sample_limit=runtime.sample_limit)
    missing = [s for s in runtime.scopes if s.table not in source or s.column not in source[s.table].columns]
    if missing:
        raise GateError("incomplete: scope not found")
    found = []
    for t in runtime.tables:
        rows = detection.read_verdicts(detection.verdicts(source[t], runtime.columns(t), settings, reviewed=(reviewed or {}).get(t)))
        found += [(t, r["column_name"], r["verdict"]) for r in rows]
    if any(v == "unknown" for _, _, v in found):
        raise GateError("incomplete: unknown columns")
    for t in runtime.tables:
        preflight(registry, t, runtime.columns(t))
    return Plan(runtime, tuple(sorted(found)), digest([snapshot(source[t]) for t in runtime.tables]), target_id, schema_digest({t: source[t] for t in runtime.tables}, registry))


def recheck(plan: Plan, again: Plan) -> None:
    if plan != again:
        raise GateError("conflict: the plan no longer holds")


def from_file(path: str, keys: dict[str, tuple[str, ...]], tables: list[str]) -> Registry:
    """A registry declared in JSON: {"tables": {name: {"keys": [...], "unique": [[...]], "foreign_keys":
    [{"columns": [...], "parent": name, "parent_columns": [...]}], "checks": [text], "triggers": false,
    "required": [...]}}}.

    Tables that the file doesn't name stay uncovered, so every gate refuses them."""
    try:
        declared = json.loads(Path(path).read_text())["tables"] if path else {}
        return Registry({t: table_info(t, declared.get(t), keys.get(t, ())) for t in dict.fromkeys([*declared, *tables])})
    except (OSError, ValueError, KeyError, TypeError, AttributeError) as e:
        raise GateError("invalid: constraint file") from e


def distinct_paths(source: str, target: str) -> None:
    if os.path.realpath(source) == os.path.realpath(target):
        raise GateError("invalid: source and target are one")
