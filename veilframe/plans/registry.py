"""Constraints of tables, which Parquet doesn't carry, and the gates that a plan must pass."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .ddl import mentions


class GateError(ValueError):
    """category: what."""


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class TableInfo:
    name: str
    keys: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    checks: tuple[str, ...] = ()
    indexes: tuple[tuple[str, ...], ...] = ()
    triggers: bool = False
    covered: bool = False  #: whether all kinds of constraint could be read; if not, nothing is taken as absent
    required: tuple[str, ...] = ()  #: columns beside the keys that hold no NULL


@dataclass(frozen=True)
class Registry:
    tables: dict[str, TableInfo] = field(default_factory=dict)

    def table(self, name: str) -> TableInfo:
        if name not in self.tables:
            raise GateError("not_found: table")
        return self.tables[name]

    def incoming(self, name: str) -> list[tuple[str, ForeignKey]]:
        return [(t.name, k) for t in self.tables.values() for k in t.foreign_keys if k.parent.lower() == name.lower()]


def table_info(name: str, declared: dict | None, keys: tuple[str, ...] = ()) -> TableInfo:
    """A table as it is declared; undeclared ones are uncovered. Keys given twice must agree."""
    if declared is None:
        return TableInfo(name, keys)
    unknown = set(declared) - {"keys", "unique", "foreign_keys", "checks", "indexes", "triggers", "required"}
    own = tuple(declared.get("keys", keys))
    if unknown or keys and own != keys:
        raise GateError("invalid: constraint file")
    foreign = tuple(ForeignKey(tuple(k["columns"]), k["parent"], tuple(k["parent_columns"])) for k in declared.get("foreign_keys", ()))
    groups = {x: tuple(map(tuple, declared.get(x, ()))) for x in ("unique", "indexes")}
    return TableInfo(name, own, groups["unique"], foreign, tuple(declared.get("checks", ())), groups["indexes"], bool(declared.get("triggers", False)), True, tuple(declared.get("required", ())))


def preflight(registry: Registry, table: str, columns: list[str]) -> None:
    """Refuse columns whose change could break what the database guarantees."""
    t = registry.table(table)
    low = {c.lower() for c in columns}
    holds = lambda cols: bool(low & {c.lower() for c in cols})
    if not t.covered:
        raise GateError("incomplete: constraints unknown")
    if not t.keys:
        raise GateError("unsupported: no key")
    if holds(t.keys):
        raise GateError("unsupported: key column")
    if t.triggers:
        raise GateError("unsupported: triggers")
    if any(holds(u) for u in t.unique):
        raise GateError("unsafe: unique column")
    if any(mentions(c, x) for c in t.checks for x in columns):
        raise GateError("unsupported: check constraint")
    if any(holds(k.columns) for k in t.foreign_keys):
        raise GateError("unsupported: foreign key column")
    if any(holds(k.parent_columns) for _, k in registry.incoming(table)):
        raise GateError("unsupported: referenced column")


#: The star schema of the test data.
TPCH = Registry({t.name: replace(t, covered=True) for t in (
    TableInfo("region", ("r_regionkey",)),
    TableInfo("nation", ("n_nationkey",), (), (ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),)),
    TableInfo("customer", ("c_custkey",), (("c_name",),), (ForeignKey(("c_nationkey",), "nation", ("n_nationkey",)),)),
    TableInfo("supplier", ("s_suppkey",), (("s_name",),), (ForeignKey(("s_nationkey",), "nation", ("n_nationkey",)),)),
    TableInfo("part", ("p_partkey",)),
    TableInfo("orders", ("o_orderkey",), (), (ForeignKey(("o_custkey",), "customer", ("c_custkey",)),)),
    TableInfo("lineitem", (), (), (ForeignKey(("l_orderkey",), "orders", ("o_orderkey",)),)),
    TableInfo("documents", ("doc_id",)), TableInfo("events", ("event_id",)), TableInfo("pages", ("page_id",)),
)})
