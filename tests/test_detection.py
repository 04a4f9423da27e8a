import pytest
import regex as re

from veilframe.functions import formats as f
from veilframe.functions.dialect import SPARK
from veilframe.functions.run import INPUT, over
from veilframe.operators import detection as det
from veilframe.operators.paging import RefusedError


def hits(spark, rule, values):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [bool(r[0]) for r in over(d, f"SELECT {f.RULES[rule](SPARK, 'v')}, i FROM {INPUT} ORDER BY i").collect()]


CASES = {
    "email": (["a@b.co", "a.b+c_d@x-y.example.com", "a@[1.2.3.4]", "a@[::1]"], ["a@b", "a@-b.co", "a@b_c.co", ".a@b.co", "a..b@c.co", "x" * 65 + "@b.co", "a@b.c", "a@@b.co", ""]),
    "url": (["http://a.com", "HTTPS://a.b.co:8080/x?y#z", "http://1.2.3.4/", "http://[::1]:80/a", "http://u:p@a.com"], ["ftp://a.com", "http://", "https://?", "http://a", "http://a.com:0", "http://a.com:65536", "http://a.com:", "http://a b.com", "http://a.com/%zz"]),
    "ip_address": (["1.2.3.4", "255.255.255.255", "::", "::1", "1:2:3:4:5:6:7:8", "fe80::1:2", "::ffff:1.2.3.4", "1:2:3:4:5:6:7::"], ["1.2.3", "1.2.3.256", "01.2.3.4", "fe80::1%eth0", "1:2:3:4:5:6:7:8:9", "1::2::3", "g::1", ":::"]),
    "uuid": (["550e8400-e29b-41d4-a716-446655440000"], ["550e8400-e29b-01d4-a716-446655440000", "550e8400-e29b-61d4-a716-446655440000", "550e8400e29b41d4a716446655440000", "550e8400-e29b-41d4-c716-446655440000"]),
    "cn_date": (["2024-02-29", "2024/12/01", "2024年2月9日", "0001-01-01"], ["2023-02-29", "2024-2-9", "2024年02月09日", "01/02/2024", "0000-01-01", "2024-13-01"]),
    "cn_id_card": (["110101200002290018"], ["110101200002300018", "110101189912310010", "11010120000229001", "999999200002290018"]),
    "cn_mobile": (["13912345678", "+8613912345678", "8613912345678"], ["12912345678", "+13912345678", "1391234567", "139123456789"]),
    "cn_bank_card": (["4111111111111111", "6222021234567894"], ["4111111111111112", "0000000000000000", "79927398713"]),
    "cn_postal_code": (["100000"], ["10000", "1000000", "10000a"]),
    "cn_uscc": (["91110000123456789Q"], ["91110000123456789A", "00110000123456789Q", "91999999123456789Q"]),
    "cn_city": (["北京", "北京市", "Beijing City", "Xi'an", "xi an", "广西壮族自治区", "Tibet"], ["苏州", "Paris", "市", "北京市市"]),
    "cn_person_name": (["王明", "欧阳星河", "欧阳明", "李子"], ["普明", "成都", "王", "欧阳星河明", "王a"]),
    "cn_address": (["北京市朝阳区和平路8号", "上海市徐汇区天钥桥路2号楼501室", "三里屯街道1号"], ["城市道路管理", "街道通知", "社区1号公告", "区县1号", "ABC路1号", "北京市", "3栋2单元501室", "!!路1号"]),
}


@pytest.mark.parametrize("rule", CASES)
def test_rules(spark, rule):
    good, bad = CASES[rule]
    assert dict(zip(good + bad, hits(spark, rule, good + bad), strict=True)) == dict.fromkeys(good, True) | dict.fromkeys(bad, False)


def by_grammar(value):
    """The address rule as its grammar says it: words first, then one pattern over the classes of the words.

    P: place word, H: house number with its unit, U: unit alone, c: any other Chinese character, x: the rest."""
    places = set(f.ADDRESS_ADMIN + f.ADDRESS_ROAD + f.ADDRESS_BUILDING)
    either = "|".join(sorted({*places, *f.ADDRESS_UNIT}, key=len, reverse=True))
    units = "|".join(sorted(f.ADDRESS_UNIT, key=len, reverse=True))
    word = re.compile(rf"(?P<H>[0-9{f.ADDRESS_NUMERALS}]++(?:{units}))|(?P<W>{either})|(?P<c>\p{{Han}})|(?P<x>.)", re.S)
    classes = "".join(("P" if m[0] in places else "U") if m.lastgroup == "W" else m.lastgroup for m in word.finditer(value))
    return 4 <= len(value) <= 120 and bool(re.fullmatch(r"(?:c+P)+c*H[HU]*", classes))


def test_address_pattern_against_its_grammar(spark):
    import random

    r = random.Random(4)
    pieces = ["北", "和平", "三", "里", "市", "区", "路", "街", "街道", "大道", "大厦", "号", "室", "单元", "1", "12", "二十", "楼", "〇", "a"]
    values = list({"".join(r.choices(pieces, k=r.randint(2, 8))) for _ in range(4000)}) + ["和平路" * 5 + "1号", "北京市和平路1号2单元三楼"]
    got = hits(spark, "cn_address", values)
    assert [v for v, g in zip(values, got, strict=True) if g != by_grammar(v)] == []
    assert any(got)


def evidence(spark, name, values, **settings):
    d = spark.createDataFrame([(v,) for v in values], f"`{name}` string").withColumnRenamed(name, name)
    return {r["rule"]: r for r in det.evidence(d, [name], det.Settings(**settings)).collect()}


def mails(n):
    return [f"u{i}@example.com" for i in range(n)]


def test_thresholds(spark):
    assert evidence(spark, "c", mails(18) + ["x", "y"])["email"]["verdict"] == "sensitive"
    assert evidence(spark, "c", mails(17) + ["x", "y", "z"])["email"]["verdict"] == "unknown"
    e = evidence(spark, "c", mails(19) + mails(19) + [None, "  ", ""])["email"]  # distinct, without blanks
    assert e["total"] == 19 and e["verdict"] == "unknown" and "insufficient_evidence" in e["reasons"]


def test_context(spark):
    phones = [f"138{i:08d}" for i in range(30)]
    assert evidence(spark, "user_mobile", phones)["cn_mobile"]["eligible"]
    assert not evidence(spark, "value", phones)["cn_mobile"]["eligible"]
    assert not evidence(spark, "order_mobile", phones)["cn_mobile"]["eligible"]
    e = evidence(spark, "phone", mails(30))
    assert all("conflicting_evidence" in r["reasons"] and r["verdict"] == "unknown" for r in e.values())


def test_null_only_and_empty(spark):
    assert evidence(spark, "email", [None, None])["email"]["total"] == 0
    assert evidence(spark, "email", [])["email"]["verdict"] == "unknown"


def test_tokens():
    assert det.context_tokens("userEmail2Address_id") == ["user", "email2", "address", "id"]
    assert det.context_tokens("UPDATE-Date") == ["update", "date"]
    rule = next(r for r in det.RULE_TABLE if r.name == "cn_mobile")
    assert det.context_implies(rule, "用户手机号") and not det.context_implies(rule, "订单手机号") and not det.context_implies(rule, "mobiles")


def test_priorities(spark):
    d = spark.createDataFrame([(m,) for m in mails(30)], "mail string")
    got = lambda **k: tuple(det.verdicts(d, ["mail"], **k).first())[1:]
    assert got() == ("sensitive", "email", "rule") and got(skip=("mail",))[2] == "skip"
    assert got(skip=("mail",), reviewed={"mail": "sensitive"})[2] == "reviewed" and got(reviewed={"mail": "sensitive"}, override={"mail": "unknown"})[2] == "override"


def test_evaluation(spark):
    rows = [("r", True, True), ("r", True, False), ("r", False, True), ("q", False, False)]
    out = {r["rule"]: r for r in det.evaluation(spark.createDataFrame(rows, "rule string, expected boolean, found boolean")).collect()}
    assert out["r"]["precision"] == 0.5 and out["r"]["recall"] == 0.5 and out["q"]["precision"] is None


def test_only_text_and_dates_match(spark):
    import datetime

    rows = [(13800138000 + i, f"1380013{8000 + i}", datetime.date(2000, 1, 1) + datetime.timedelta(i)) for i in range(30)]
    d = spark.createDataFrame(rows, "mobile long, phone string, birth date")
    got = {r["column_name"]: r["verdict"] for r in det.verdicts(d, ["mobile", "phone", "birth"]).collect()}
    assert got == {"mobile": "unknown", "phone": "sensitive", "birth": "sensitive"}
    hits = det.evidence(d, ["mobile"]).collect()
    assert all(r["hits"] == 0 and r["total"] == 30 for r in hits)


def test_names_that_need_quotes(spark):
    for name in ("my mail", "e.mail", "mail`; --", "'mail'"):
        d = spark.createDataFrame([(f"u{i}@example.com",) for i in range(30)], [name])
        assert [tuple(r)[:2] for r in det.verdicts(d, [name]).collect()] == [(name, "sensitive")]
        assert det.whole_value_matches(d, name).columns[0] == name


def test_samples_that_are_too_large_are_refused(spark):
    d = spark.createDataFrame([("x" * ((1 << 20) + 1),), ("a",)], "c string")
    with pytest.raises(RefusedError, match="sample bytes"):
        det.read_verdicts(det.verdicts(d, ["c"]))


@pytest.mark.parametrize("one_in", [1, 3, 50, 4096])
def test_samples_are_the_least_values(spark, one_in):
    import random

    r = random.Random(one_in)
    rows = [(r.choice([None, f"v{r.randint(0, 5000):05}", "", " "]), r.choice("abc"), f"{i:06}") for i in range(6000)]
    d = spark.createDataFrame(rows, "many string, few string, all_ string")
    got = over(d, det.samples_sql(SPARK, INPUT, d.columns, 40, one_in=one_in))
    want = {(c, v) for k, c in enumerate(d.columns) for v in sorted({x[k] for x in rows if x[k] is not None})[:40] if v.strip()}
    assert sorted((x["column_name"], x["value"]) for x in got.collect()) == sorted(want)
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_samples_shuffle_a_part_of_the_values(spark):
    d = spark.range(200_000).selectExpr("sha2(CAST(id AS string), 256) AS h")
    plan = over(d, det.samples_sql(SPARK, INPUT, ["h"], 20, one_in=100))
    assert plan.count() == 20
    node = plan.selectExpr("count(*)")._jdf.queryExecution()
    bound = sorted(r[0] for r in d.where("pmod(xxhash64(h), 100) = 0").collect())[19]
    assert d.where(d.h <= bound).count() < 200_000 / 20 and "BroadcastHashJoin" in node.executedPlan().toString()
