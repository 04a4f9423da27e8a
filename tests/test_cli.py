import json

import pytest

from veilframe import cli
from veilframe.plans.approval import public_key


@pytest.fixture
def world(spark, tmp_path):
    d = spark.createDataFrame([(i, f"u{i}@example.com", i) for i in range(60)], "id int, email string, other int")
    for side in ("a", "b"):
        d.write.parquet(f"{tmp_path}/{side}/people.parquet")
    (tmp_path / "constraints").write_text(json.dumps({"tables": {"people": {"keys": ["id"], "unique": [["other"]]}}}))
    (tmp_path / "key").write_bytes(bytes(40))
    (tmp_path / "sign").write_bytes(bytes([7]) * 32)
    (tmp_path / "trust").write_text(json.dumps({"version": 1, "keys": [{"signer_key_id": "ann", "public_key_hex": public_key(bytes([7]) * 32).hex()}]}))
    base = ["--source", f"{tmp_path}/a", "--target", f"{tmp_path}/b", "--scope", "people.email", "--key-column", "people.id", "--strategy", "fake_email", "--key-file", f"{tmp_path}/key", "--approvals", f"{tmp_path}/ok", "--trust-file", f"{tmp_path}/trust", "--signing-key-file", f"{tmp_path}/sign", "--signer", "ann", "--constraints", f"{tmp_path}/constraints"]
    return tmp_path, base


def test_whole_way(spark, world, capsys):
    tmp, base = world
    assert cli.run(["scan", *base], spark) == 0 and "scope 0: sensitive" in capsys.readouterr().out
    assert cli.run(["mask", *base], spark) == 0 and "60 rows would change" in capsys.readouterr().out
    assert cli.run(["mask", *base, "--limit-per-table", "7"], spark) == 0 and "7 rows would change" in capsys.readouterr().out
    assert cli.run(["mask", *base, "--limit-per-table", "7", "--apply", "--out", f"{tmp}/out"], spark) == 1
    assert cli.run(["mask", *base, "--apply", "--out", f"{tmp}/out"], spark) == 1  # not approved
    assert cli.run(["approve", *base], spark, 1000) == 0
    assert cli.run(["mask", *base, "--apply", "--out", f"{tmp}/out"], spark, 1000 + 25 * 3600) == 1  # expired
    assert cli.run(["mask", *base, "--apply", "--out", f"{tmp}/out"], spark, 2000) == 0
    done = [x if x != f"{tmp}/b" else f"{tmp}/out" for x in base]
    assert cli.run(["validate", *done], spark) == 0 and cli.run(["validate", *base], spark) == 1
    assert cli.run(["revoke", *base], spark, 1000) == 0
    assert cli.run(["mask", *base, "--apply", "--out", f"{tmp}/out2"], spark, 2000) == 1
    text = capsys.readouterr()
    assert "@example" not in text.out + text.err


def test_arguments(spark, world):
    tmp, base = world
    assert cli.run(["mask"], spark) == 2 and cli.run(["version"], spark) == 0
    assert cli.run(["scan", *["x" if b == "people.email" else b for b in base]], spark) == 1
    assert cli.run(["scan", *[b.replace("email", "other") if b == "people.email" else b for b in base]], spark) == 1  # unknown isn't safe
    assert cli.run(["status", "--run-folder", f"{tmp}/none", "--run-id", "r"], spark) == 0


def test_constraints_are_declared_or_nothing_goes(spark, world, capsys):
    tmp, base = world
    bare = base[: base.index("--constraints")]
    assert cli.run(["mask", *bare], spark) == 1 and "constraints unknown" in capsys.readouterr().err
    for table, what in (({"keys": ["id"], "unique": [["email"]]}, "unique column"), ({"keys": ["id"], "checks": ["length(email) > 3"]}, "check constraint"), ({"keys": ["id"], "triggers": True}, "triggers"), ({"keys": ["other"]}, "constraint file"), ({"keys": ["id"], "foreign_keys": [{"columns": ["email"], "parent": "x", "parent_columns": ["y"]}]}, "foreign key column")):
        (tmp / "constraints").write_text(json.dumps({"tables": {"people": table}}))
        assert cli.run(["mask", *base], spark) == 1 and what in capsys.readouterr().err
    (tmp / "constraints").write_text("not json")
    assert cli.run(["scan", *base], spark) == 1


def test_repeated_keys_are_refused(spark, world, capsys):
    tmp, base = world
    for side in ("a", "b"):
        spark.createDataFrame([(5, "twice@example.com", 99)], "id int, email string, other int").write.mode("append").parquet(f"{tmp}/{side}/people.parquet")
    assert cli.run(["mask", *base], spark) == 1 and "keys NULL or repeated" in capsys.readouterr().err


def test_streamed_run_and_its_exits(spark, world, capsys, monkeypatch):
    tmp, base = world
    run = [*base, "--run-folder", f"{tmp}/run", "--run-id", "r1", "--page-rows", "64", "--max-row-bytes", "4096", "--max-process-bytes", str(1 << 30), "--max-disk-bytes", str(1 << 30)]
    assert cli.run(["resume", *run], spark) == 7  # never begun
    assert cli.run(["stream", *run], spark) == 1  # not approved
    assert cli.run(["approve", *base], spark, 1000) == 0
    assert cli.run(["stream", *[x if x != "4096" else "3" for x in run]], spark, 2000) == 1  # rows over the budget
    real, stop = cli.Run.start, []

    def start(self, *a, **k):
        if not stop:
            stop.append(1)
            raise cli.RefusedError("interrupted: test")
        return real(self, *a, **k)

    monkeypatch.setattr(cli.Run, "start", start)
    assert cli.run(["stream", *run], spark, 2000) == 1
    (tmp / "key2").write_bytes(bytes([1]) * 40)
    assert cli.run(["resume", *[x if x != f"{tmp}/key" else f"{tmp}/key2" for x in run]], spark, 2000) == 4  # another key
    assert cli.run(["resume", *run], spark, 1000 + 25 * 3600) == 3  # the approval has ended
    assert cli.run(["resume", *run], spark, 2000) == 0
    assert cli.run(["status", "--run-folder", f"{tmp}/run", "--run-id", "r1"], spark) == 0
    out = capsys.readouterr()
    assert "rows 60" in out.out and "state complete" in out.out and "@example" not in out.out + out.err
    assert cli.run(["resume", *run], spark, 2000) == 4  # final
    made = spark.read.parquet(f"{tmp}/run/target")
    assert made.count() == 60 and made.where("email LIKE '%example.com'").isEmpty()


def test_constraints_from_a_database(spark, world, capsys):
    import sqlite3

    tmp, base = world
    for body, code, what in (("id INTEGER PRIMARY KEY, email TEXT, other INT", 0, ""), ("id INTEGER PRIMARY KEY, email TEXT UNIQUE, other INT", 1, "unique column"), ("id INT, email TEXT, other INTEGER PRIMARY KEY", 1, "key columns")):
        (tmp / "base.db").unlink(missing_ok=True)
        with sqlite3.connect(tmp / "base.db") as c:
            c.execute(f"CREATE TABLE people ({body})")
        c.close()
        now = [x if x != f"{tmp}/constraints" else f"{tmp}/base.db" for x in base]
        assert cli.run(["mask", *now], spark) == code and what in capsys.readouterr().err
