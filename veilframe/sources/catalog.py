"""Constraints read out of a database's own catalogue, as a registry for the gates and the validator.

Only metadata is read, by the driver: its size follows the number of columns, not of rows. What can't be told
for sure (partial, descending, prefix or expression indexes, unclear definitions) leaves a table uncovered, and
uncovered tables are refused by every gate."""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Callable, Iterable
from itertools import groupby
from operator import itemgetter
from pathlib import Path

from pyspark.sql import SparkSession

from ..plans import ddl
from ..plans.registry import ForeignKey, GateError, Registry, TableInfo
from .readers import jdbc, sqlite_url

MAGIC = b"SQLite format 3\0"
#: Gives the rows of a query.
Rows = Callable[[str], Iterable[tuple]]


def is_sqlite(path: str) -> bool:
    if not Path(path).is_file():
        return False
    with open(path, "rb") as f:
        return f.read(len(MAGIC)) == MAGIC


def sqlite(path: str) -> Registry:
    """All tables of a SQLite file, which is opened read-only. Hidden and generated columns are refused."""
    sqlite_url(path)  # the same checks of the path
    db = sqlite3.connect(f"{Path(path).as_uri()}?mode=ro", uri=True)
    try:
        db.execute("BEGIN")  # one state of the catalogue
        tables = dict(db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name"))
        triggers = {t.lower() for (t,) in db.execute("SELECT tbl_name FROM sqlite_master WHERE type = 'trigger'")}
        return _with_parent_keys({t: _sqlite_table(db, t, text or "", t.lower() in triggers) for t, text in tables.items()})
    except sqlite3.Error as e:
        raise GateError("incomplete: catalogue") from e
    finally:
        db.close()


def _sqlite_table(db: sqlite3.Connection, table: str, text: str, triggers: bool) -> TableInfo:
    columns = db.execute("SELECT name, \"notnull\", pk, hidden FROM pragma_table_xinfo(?) ORDER BY cid", (table,)).fetchall()
    if any(hidden for *_, hidden in columns):
        raise GateError("unsupported: hidden column")
    keys = tuple(name for name, _, pk, _ in sorted(columns, key=itemgetter(2)) if pk)
    found, clear = ddl.checks(text)
    unique, indexes = [], []
    for name, is_unique, origin, partial in db.execute("SELECT name, \"unique\", origin, partial FROM pragma_index_list(?) ORDER BY seq", (table,)).fetchall():
        parts = db.execute("SELECT name, \"desc\" FROM pragma_index_xinfo(?) WHERE key ORDER BY seqno", (name,)).fetchall()
        if partial or any(column is None or down for column, down in parts):
            clear = False
            continue
        group = tuple(column for column, _ in parts)
        indexes.append(group)
        if is_unique and origin != "pk":
            unique.append(group)
    keyed = db.execute("SELECT id, \"table\", \"from\", \"to\" FROM pragma_foreign_key_list(?) ORDER BY id, seq", (table,)).fetchall()
    foreign = [_foreign(rows) for rows in _grouped((f"{i:09d}", child, parent, column) for i, parent, child, column in keyed)]
    required = tuple(name for name, not_null, pk, _ in columns if not_null and not pk)
    return TableInfo(table, keys, tuple(unique), tuple(foreign), tuple(map(ddl.normalized, found)), tuple(indexes), triggers, clear, required)


def _grouped(rows: Iterable[tuple]) -> list[list[tuple]]:
    """Rows that follow each other under one name."""
    return [list(g) for _, g in groupby(rows, key=itemgetter(0))]


def _foreign(rows: list[tuple]) -> ForeignKey:
    """One key from rows (name, column, parent, parent's column or None)."""
    return ForeignKey(tuple(r[1] for r in rows), rows[0][2], tuple(r[3] for r in rows if r[3] is not None))


def _with_parent_keys(tables: dict[str, TableInfo]) -> Registry:
    """Foreign keys that name no column of their parent mean its key; one that can't be told leaves its table uncovered."""
    low = {t.lower(): x for t, x in tables.items()}
    out = {}
    for name, t in tables.items():
        keys, clear = [], t.covered
        for k in t.foreign_keys:
            parent = low.get(k.parent.lower())
            there = k.parent_columns or (parent.keys if parent else ())
            clear &= parent is not None and len(there) == len(k.columns)
            keys.append(ForeignKey(k.columns, parent.name if parent else k.parent, there))
        out[name] = TableInfo(name, t.keys, t.unique, tuple(keys), t.checks, t.indexes, t.triggers, clear, t.required)
    return Registry(out)


def jdbc_rows(spark: SparkSession, url: str, options: dict[str, str]) -> Rows:
    """Queries through Spark's JDBC reader, under the same refusals as table reads."""
    return lambda query: [tuple(r) for r in jdbc(spark, url, f"({query}) q_", options).collect()]


def mysql(rows: Rows, schema: str) -> Registry:
    """All base tables of a MySQL schema from information_schema (names, five queries, no data)."""
    if not re.fullmatch(r"[0-9A-Za-z$_]{1,64}", schema):
        raise GateError("invalid: schema name")
    s = f"'{schema}'"
    columns = _by_table(rows(f"SELECT c.table_name AS t, c.column_name AS c, c.is_nullable AS n, c.extra AS e, c.ordinal_position AS o FROM information_schema.columns c JOIN information_schema.tables b ON b.table_schema = c.table_schema AND b.table_name = c.table_name WHERE c.table_schema = {s} AND b.table_type = 'BASE TABLE'"))
    indexes = _by_table(rows(f"SELECT table_name AS t, index_name AS i, seq_in_index AS o, non_unique AS n, column_name AS c, collation AS d, sub_part AS p FROM information_schema.statistics WHERE table_schema = {s}"))
    foreign = _by_table(rows(f"SELECT u.table_name AS t, u.constraint_name AS i, u.ordinal_position AS o, u.column_name AS c, u.referenced_table_name AS p, u.referenced_column_name AS r, r.unique_constraint_schema AS s FROM information_schema.key_column_usage u JOIN information_schema.referential_constraints r ON r.constraint_schema = u.constraint_schema AND r.constraint_name = u.constraint_name AND r.table_name = u.table_name WHERE u.table_schema = {s}"))
    checks = _by_table(rows(f"SELECT t.table_name AS t, t.constraint_name AS i, c.check_clause AS c FROM information_schema.table_constraints t JOIN information_schema.check_constraints c ON c.constraint_schema = t.constraint_schema AND c.constraint_name = t.constraint_name WHERE t.table_schema = {s} AND t.constraint_type = 'CHECK'"))
    triggers = {t for (t,) in rows(f"SELECT event_object_table AS t FROM information_schema.triggers WHERE event_object_schema = {s}")}
    out = {}
    for table, described in columns.items():
        described = sorted(described, key=itemgetter(3))
        if any("GENERATED" in (extra or "").upper().replace("DEFAULT_GENERATED", "") for _, _, extra, _ in described):
            raise GateError("unsupported: hidden column")
        clear, keys, unique, groups = True, (), [], []
        for parts in _grouped(sorted(indexes.get(table, ()), key=itemgetter(0, 1))):
            if any(column is None or direction == "D" or prefix is not None for _, _, _, column, direction, prefix in parts):
                clear = False
                continue
            group = tuple(p[3] for p in parts)
            groups.append(group)
            if parts[0][0] == "PRIMARY":
                keys = group
            elif not int(parts[0][2]):
                unique.append(group)
        links = _grouped(sorted(foreign.get(table, ()), key=itemgetter(0, 1)))
        clear &= all(r[-1] == schema for rows_ in links for r in rows_)  # parents in another schema can't be seen
        fks = tuple(_foreign([(name, column, parent, of) for name, _, column, parent, of, _ in rows_]) for rows_ in links)
        bodies = tuple(ddl.normalized(c) for _, c in sorted(checks.get(table, ())))
        required = tuple(c for c, nullable, _, _ in described if nullable == "NO" and c not in keys)
        out[table] = TableInfo(table, keys, tuple(unique), fks, bodies, tuple(groups), table in triggers, clear, required)
    return _with_parent_keys(out)


def _by_table(rows: Iterable[tuple]) -> dict[str, list[tuple]]:
    out: dict[str, list[tuple]] = {}
    for table, *rest in rows:
        out.setdefault(table, []).append(tuple(rest))
    return out


def scoped(registry: Registry, keys: dict[str, tuple[str, ...]]) -> Registry:
    """The registry, if the keys that are given for its tables are the ones that it knows."""
    for table, given in keys.items():
        if given != registry.table(table).keys:
            raise GateError("invalid: key columns")
    return registry
