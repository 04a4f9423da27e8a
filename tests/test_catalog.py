import sqlite3

import pytest

from veilframe.operators import validation
from veilframe.plans.registry import ForeignKey, GateError, preflight
from veilframe.sources import catalog

SCHEMA = """
CREATE TABLE town (code TEXT NOT NULL, land INTEGER NOT NULL, name TEXT, PRIMARY KEY (land, code));
CREATE TABLE people (
  id INTEGER PRIMARY KEY, email TEXT UNIQUE, "full name" TEXT NOT NULL, age INT CHECK  (age  > 0 /* years */),
  land INTEGER, code TEXT, boss INTEGER REFERENCES people, note TEXT,
  FOREIGN KEY (land, code) REFERENCES TOWN (land, code));
CREATE INDEX by_name ON people ("full name", age);
CREATE TABLE log (id INTEGER PRIMARY KEY, what TEXT);
CREATE TRIGGER t AFTER UPDATE ON LOG BEGIN SELECT 1; END;
CREATE TABLE odd (id INTEGER PRIMARY KEY, a TEXT, b TEXT);
CREATE UNIQUE INDEX part ON odd (a) WHERE b IS NULL;
CREATE TABLE down (id INTEGER PRIMARY KEY, a TEXT);
CREATE INDEX d ON down (a DESC);
CREATE TABLE lower_ (id INTEGER PRIMARY KEY, a TEXT);
CREATE INDEX e ON lower_ (lower(a));
CREATE TABLE far (id INTEGER PRIMARY KEY, x INT REFERENCES nowhere);
"""


@pytest.fixture
def db(tmp_path):
    path = tmp_path / "a base.db"
    with sqlite3.connect(path) as c:
        c.executescript(SCHEMA)
    c.close()
    return str(path)


def test_sqlite(db):
    r = catalog.sqlite(db)
    p = r.table("people")
    assert p.keys == ("id",) and p.unique == (("email",),) and p.required == ("full name",) and p.covered and not p.triggers
    assert p.checks == ("age > 0",)
    assert set(p.foreign_keys) == {ForeignKey(("land", "code"), "town", ("land", "code")), ForeignKey(("boss",), "people", ("id",))}
    assert ("full name", "age") in p.indexes
    assert r.table("town").keys == ("land", "code") and r.table("log").triggers
    assert [t for t in r.tables if not r.table(t).covered] == ["down", "far", "lower_", "odd"]


@pytest.mark.parametrize(("table", "column", "why"), [("people", "email", "unique"), ("people", "AGE", "check"), ("people", "code", "foreign key"), ("people", "id", "key column"), ("town", "code", "key column"), ("log", "what", "triggers"), ("odd", "b", "constraints unknown"), ("nothing", "x", "not_found")])
def test_gates_by_the_catalogue(db, table, column, why):
    with pytest.raises(GateError, match=why):
        preflight(catalog.sqlite(db), table, [column])
    preflight(catalog.sqlite(db), "people", ["note", "full name"])


def test_refusals(db, tmp_path):
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE g (id INTEGER PRIMARY KEY, a INT, b INT AS (a + 1))")
    c.close()
    with pytest.raises(GateError, match="hidden"):
        catalog.sqlite(db)
    (tmp_path / "text").write_text("no database")
    assert catalog.is_sqlite(db) and not catalog.is_sqlite(str(tmp_path / "text")) and not catalog.is_sqlite("")
    for bad in (str(tmp_path / "none"), "rel.db", str(tmp_path)):
        with pytest.raises(GateError):
            catalog.sqlite(bad)
    (tmp_path / "broken").write_bytes(catalog.MAGIC + b"x" * 200)
    with pytest.raises(GateError, match="incomplete"):
        catalog.sqlite(str(tmp_path / "broken"))
    with pytest.raises(GateError, match="key columns"):
        catalog.scoped(catalog.Registry({"a": catalog.TableInfo("a", ("id",))}), {"a": ("other",)})


def test_reading_changes_nothing(db):
    before = open(db, "rb").read()
    catalog.sqlite(db)
    assert open(db, "rb").read() == before


@pytest.fixture
def information_schema():
    """The queries run as they are, over tables with the columns that the server has."""
    c = sqlite3.connect(":memory:")
    c.execute("ATTACH ':memory:' AS information_schema")
    rows = {
        "tables (table_schema, table_name, table_type)": [("shop", t, "BASE TABLE") for t in ("people", "town", "odd")] + [("shop", "seen", "VIEW"), ("else", "people", "BASE TABLE")],
        "columns (table_schema, table_name, column_name, is_nullable, extra, ordinal_position)": [("shop", "people", "email", "YES", "", 2), ("shop", "people", "id", "NO", "auto_increment", 1), ("shop", "people", "at", "NO", "DEFAULT_GENERATED", 3), ("shop", "people", "town", "YES", None, 4), ("shop", "town", "code", "NO", "", 1), ("shop", "odd", "id", "NO", "", 1), ("shop", "odd", "a", "YES", "", 2), ("shop", "seen", "x", "YES", "", 1), ("else", "people", "hidden", "NO", "", 1)],
        "statistics (table_schema, table_name, index_name, seq_in_index, non_unique, column_name, collation, sub_part)": [("shop", "people", "PRIMARY", 1, 0, "id", "A", None), ("shop", "people", "u", 2, 0, "at", "A", None), ("shop", "people", "u", 1, 0, "email", "A", None), ("shop", "town", "PRIMARY", 1, 0, "code", "A", None), ("shop", "odd", "PRIMARY", 1, 0, "id", "A", None), ("shop", "odd", "p", 1, 1, "a", "A", 10)],
        "key_column_usage (table_schema, constraint_schema, table_name, constraint_name, ordinal_position, column_name, referenced_table_name, referenced_column_name)": [("shop", "shop", "people", "f", 1, "town", "town", "code"), ("shop", "shop", "people", "PRIMARY", 1, "id", None, None)],
        "referential_constraints (constraint_schema, constraint_name, table_name, unique_constraint_schema)": [("shop", "f", "people", "shop")],
        "table_constraints (table_schema, constraint_schema, table_name, constraint_name, constraint_type)": [("shop", "shop", "people", "c", "CHECK"), ("shop", "shop", "people", "PRIMARY", "PRIMARY KEY")],
        "check_constraints (constraint_schema, constraint_name, check_clause)": [("shop", "c", "(`at`   > 0)")],
        "triggers (event_object_schema, event_object_table)": [("shop", "town")],
    }
    for head, data in rows.items():
        c.execute(f"CREATE TABLE information_schema.{head}")
        c.executemany(f"INSERT INTO information_schema.{head.split()[0]} VALUES ({', '.join('?' * len(data[0]))})", data)
    yield lambda query: c.execute(query).fetchall()
    c.close()


def test_mysql(information_schema):
    r = catalog.mysql(information_schema, "shop")
    p = r.table("people")
    assert sorted(r.tables) == ["odd", "people", "town"]
    assert p.keys == ("id",) and p.unique == (("email", "at"),) and p.required == ("at",) and p.covered
    assert p.checks == ("(`at` > 0)",) and p.foreign_keys == (ForeignKey(("town",), "town", ("code",)),)
    assert r.table("town").triggers and not r.table("odd").covered
    with pytest.raises(GateError, match="schema name"):
        catalog.mysql(information_schema, "x' OR '1")
    with pytest.raises(GateError, match="referenced|key column"):
        preflight(r, "town", ["code"])


def test_required_columns_are_validated(spark):
    d = spark.createDataFrame([(1, "a", None), (2, None, None)], "id int, `full name` string, land int")
    r = catalog.Registry({"p": catalog.TableInfo("p", ("id",), covered=True, required=("full name", "land"))})
    got = {(x["code"], x["column"], x["n"]) for x in validation.constraint_issues(d, r, "p").collect()}
    assert got == {("null_value", "full name", 1), ("null_value", "land", 2)}
    assert validation.constraint_issues(d.limit(0), r, "p").isEmpty()
