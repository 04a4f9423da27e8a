import pytest

from veilframe.plans import approval as ap
from veilframe.plans import ddl, plan
from veilframe.plans.registry import ForeignKey, GateError, Registry, TableInfo, preflight


def test_signatures_follow_the_rfc():
    vectors = [  # RFC 8032, section 7.1, tests 1 and 2
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ]
    for secret, public, message, signature in vectors:
        s, m = bytes.fromhex(secret), bytes.fromhex(message)
        assert ap.public_key(s).hex() == public and ap.sign(s, m).hex() == signature
        assert ap.verify(bytes.fromhex(public), m, bytes.fromhex(signature)) and not ap.verify(bytes.fromhex(public), m + b"x", bytes.fromhex(signature))


def test_approvals(tmp_path):
    secret = bytes(32)
    store = ap.Store(str(tmp_path), {"alice": ap.public_key(secret)})
    r = ap.Record("p" * 64, (("t", "c"), ("t", "d")), "target", 1000, 5000, "alice")
    with pytest.raises(GateError):
        store.lookup(r.plan_id, "target", r.scopes, 2000)
    store.approve(r, secret)
    assert store.lookup(r.plan_id, "target", r.scopes, 2000) == r
    assert store.lookup(r.plan_id, "target", r.scopes, 1000 - 300) == r
    for target, scopes, now in (("other", r.scopes, 2000), ("target", r.scopes[::-1], 2000), ("target", r.scopes, 5000), ("target", r.scopes, 600)):
        with pytest.raises(GateError):
            store.lookup(r.plan_id, target, scopes, now)
    store.revoke(r, secret)
    with pytest.raises(GateError):
        store.lookup(r.plan_id, "target", r.scopes, 2000)


def test_forged_records(tmp_path):
    secret, other = bytes(32), bytes([1]) * 32
    trusted = {"alice": ap.public_key(secret)}
    r = ap.Record("p" * 64, (("t", "c"),), "target", 1000, 5000, "alice")
    raw = ap.encode(r, secret)
    assert ap.decode(raw, trusted) == r
    for bad in (raw.replace(b"5000", b"9000"), ap.encode(r, other), raw + b" ", b"x" + raw, b""):
        with pytest.raises(GateError):
            ap.decode(bad, trusted)
    (tmp_path / f"{r.plan_id}.2.approval").write_bytes(b"broken")
    with pytest.raises(GateError):
        ap.Store(str(tmp_path), trusted).lookup(r.plan_id, "target", r.scopes, 2000)


def test_check_texts():
    assert ddl.checks("CREATE TABLE t (id INT CHECK (id > 0), b TEXT /* CHECK (x) */ CHECK(b <> 'CHECK (y)' AND (b IN ('a')))) -- CHECK (z)") == (["id > 0", "b <> 'CHECK (y)' AND (b IN ('a'))"], True)
    assert ddl.checks("CREATE TABLE t (b TEXT CHECK (b <> 'open") == ([], False)
    assert ddl.checks("a CHECK b")[1] is False
    assert ddl.mentions('"Em""ail" > 1', 'em"ail') and not ddl.mentions("'email' = x", "email") and ddl.mentions("'broken", "anything")
    assert ddl.normalized("a  >\n 'x  y'") == "a > 'x  y'"


@pytest.mark.parametrize("more,column,category", [
    ({"triggers": True}, "c", "unsupported"), ({"unique": (("c",),)}, "C", "unsafe"), ({"checks": ("c <> ''",)}, "c", "unsupported"), ({"foreign_keys": (ForeignKey(("c",), "p", ("k",)),)}, "c", "unsupported"),
    ({"covered": False}, "c", "incomplete"), ({}, "id", "unsupported"), ({"keys": ()}, "c", "unsupported"),
])
def test_gates(more, column, category):
    t = TableInfo(**({"name": "t", "keys": ("id",), "covered": True} | more))
    with pytest.raises(GateError, match=category):
        preflight(Registry({"t": t}), "t", [column])
    preflight(Registry({"t": TableInfo("t", ("id",), indexes=(("c",),), covered=True)}), "t", ["c"])


def test_incoming_references():
    r = Registry({"t": TableInfo("t", ("id",), covered=True), "u": TableInfo("u", ("id",), (), (ForeignKey(("tc",), "T", ("C",)),))})
    with pytest.raises(GateError):
        preflight(r, "t", ["c"])


def test_runtime_limits():
    s = (plan.Scope("t", "c"),)
    for bad in ({"scopes": ()}, {"scopes": s * 2}, {"sample_limit": 0}, {"batch_size": 1001}, {"workers": 17}, {"strategy": "magic"}, {"scopes": (plan.Scope("Receipt", "c"),)}):
        with pytest.raises(GateError):
            plan.Runtime(**({"scopes": s} | bad))


def test_plans(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(i, f"u{i}@example.com", "x") for i in range(40)], "id int, mail string, other string").write.parquet(path)
    d = {"t": spark.read.parquet(path)}
    r = Registry({"t": TableInfo("t", ("id",), covered=True)})
    run = plan.Runtime((plan.Scope("t", "mail"),), "fake_email")
    a, b = (plan.build(d, r, run, "target") for _ in range(2))
    plan.recheck(a, b)
    assert len(a.plan_id) == 64 and plan.build(d, r, run, "other").plan_id != a.plan_id
    with pytest.raises(GateError):
        plan.recheck(a, plan.build(d, r, run, "other"))
    with pytest.raises(GateError, match="incomplete"):
        plan.build(d, r, plan.Runtime((plan.Scope("t", "other"),)), "target")
    with pytest.raises(GateError, match="incomplete"):
        plan.build(d, r, plan.Runtime((plan.Scope("t", "absent"),)), "target")
    with pytest.raises(GateError):
        plan.distinct_paths(path, f"{path}/../t")
