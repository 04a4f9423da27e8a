"""Each keyed mask once more in plain Python, from the definition of seeds and draws; nothing is shared with the SQL
but the lists that a mask chooses from."""

import hashlib
import hmac
from datetime import date, timedelta

import pytest

from veilframe.functions import formats as f
from veilframe.functions.digest import KINDS, MaskPlan
from veilframe.operators import masking as m

KEY = bytes(range(40))


def mac(key, message):
    return hmac.new(key, message, hashlib.sha256).digest()


class Draws:
    def __init__(self, plan, value):
        raw = value if isinstance(value, bytes) else value.encode()
        bound = "|".join(f"{len(x.encode())}:{x}" for x in (plan.strategy, "1", plan.scope, "v1", plan.key_id)).encode()
        self.key = plan.key
        size = lambda b: len(b).to_bytes(4, "big")
        self.seed = mac(plan.key, bytes([KINDS[plan.kind]]) + size(raw) + raw + size(bound) + bound + b"typed-lexical-v1")

    def below(self, n, label):
        return int.from_bytes(mac(self.seed, label.encode())[:8], "big") % n

    def digits(self, n, label):
        return "".join(str(self.below(10, f"{label}_{i}")) for i in range(n))

    def byte(self, i):
        return mac(self.key, self.seed + i.to_bytes(8, "big"))


def id_card(d, v, a):
    body = m.MASK_AREAS[d.below(3, f"id_area_{a}")] + str(1980 + d.below(26, f"id_year_{a}"))
    body += "".join(f"{1 + d.below(n, f'{label}_{a}'):0{w}}" for label, n, w in (("id_month", 12, 2), ("id_day", 28, 2), ("id_sequence", 999, 3)))
    return body + next(c for c in "0123456789X" if (sum(int(x) * 2 ** (17 - i) for i, x in enumerate(body)) + (10 if c == "X" else int(c))) % 11 == 1)


def luhn(number):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(number))) % 10 == 0


def bank_card(d, v, a):
    body = str(1 + d.below(9, f"bank_first_{a}")) + d.digits(len(v) - 2, f"bank_body_{a}")
    return next(body + c for c in "0123456789" if luhn(body + c))


def uscc(d, v, a):
    abc = f.USCC_ALPHABET
    body = "91" + m.MASK_USCC_AREAS[d.below(3, f"uscc_area_{a}")] + "".join(abc[d.below(31, f"uscc_{a}_{i}")] for i in range(9))
    return next(body + c for c in abc if (sum(abc.index(x) * 3**i for i, x in enumerate(body)) + abc.index(c)) % 31 == 0)


def mobile(d, v, a):
    return v[:-11] + m.MASK_MOBILE[d.below(4, f"mobile_prefix_{a}")] + d.digits(8, f"mobile_tail_{a}")


def city(d, v, a):
    at = (d.below(7, "city") + a) % 7
    if v[0] > "z":
        return m.MASK_CITIES[at] + ("市" if v.endswith("市") else "")
    name = m.MASK_PINYIN[at]
    return (name.capitalize() if v[0].isupper() else name) + (v[-5:] if v.lower().endswith(" city") else "")


def person(d, v, a):
    double = v[:2] in m.MASK_COMPOUND
    first = m.MASK_COMPOUND[d.below(4, f"compound_{a}")] if double else m.MASK_SURNAMES[d.below(len(m.MASK_SURNAMES), f"surname_{a}")]
    return first + "".join(m.MASK_GIVEN[d.below(11, f"given_{a}_{i}")] for i in range(len(v) - 1 - double))


def address(d, v, a):
    return f"合成区{m.MASK_STREETS[d.below(3, f'street_{a}')]}{1 + d.below(9999, f'house_{a}')}号"


def day(d, v, a):
    t = date(1995, 1, 1) + timedelta(1 + d.below(8760, f"date_{a}"))
    return f"{t:%Y/%m/%d}" if "/" in v else f"{t.year}年{t.month}月{t.day}日" if "年" in v else t.isoformat()


def scrambled(d, v, a):
    out = ""
    for i, c in enumerate(v):
        abc = next((x for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", m.MASK_HAN) if c in x), None)
        first = d.byte(i)[0]
        foreign = "一" <= c <= "鿿"
        out += abc[(abc.index(c) + 1 + first % (len(abc) - 1)) % len(abc)] if abc else m.MASK_HAN[first % len(m.MASK_HAN)] if foreign else c
    return out


MASKS = {
    "fake_email": (lambda d, v, a: d.seed.hex()[:32] + "@masked.invalid", ["ann@example.com", "b.c@x-y.example.org"]),
    "cn_id_card": (id_card, ["110101200002290018"]),
    "cn_bank_card": (bank_card, ["4111111111111111", "6222021234567894"]),
    "cn_uscc": (uscc, ["91110000123456789Q"]),
    "cn_mobile": (mobile, [*(f"139{i:08}" for i in range(40)), "+8613912345678", "8613912345678"]),
    "cn_postal_code": (lambda d, v, a: d.digits(6, f"postal_{a}"), [f"{i:06}" for i in range(100000, 100040)]),
    "cn_city": (city, ["北京", "上海市", "Hangzhou", "chengdu City", "beijing", "重庆市", "广州", "深圳", "Shenzhen city"]),
    "cn_person_name": (person, ["王明", "欧阳星河", "李子", "司马光", *("王" + c for c in m.MASK_GIVEN)]),
    "cn_address": (address, [f"北京市东城区和平路{i}号" for i in range(1, 40)]),
    "cn_date": (day, ["2024-02-29", "2024/02/29", "2024年2月9日", "1900-01-01"]),
    "format_random": (scrambled, ["aZ 9-x", "天地龙, 1 z!", "0123456789", "…q"]),
}


@pytest.mark.parametrize("name", MASKS)
def test_masks_by_definition(spark, name):
    one, values = MASKS[name]
    p = MaskPlan(name, "parquet/t/c", "k1", KEY)
    d = spark.createDataFrame(list(enumerate(values)), "id int, c string")
    got = [(r["c_masked"], r["c_error"]) for r in m.mask_column(d, "c", p).orderBy("id").collect()]
    want = [next(x for x in (one(Draws(p, v), v, a) for a in range(8)) if x != v) for v in values]
    assert got == [(x, None) for x in want]


def test_bytes_by_definition(spark):
    p = MaskPlan("format_random", "parquet/t/c", "k1", KEY, "bytes")
    values = [b"\0", bytes(range(100)), b"x" * 32, b"y" * 33]
    d = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "id int, c binary")
    got = [bytes(r["c_masked"]) for r in m.mask_column(d, "c", p).orderBy("id").collect()]
    assert got == [b"".join(Draws(p, v).byte(i) for i in range(4))[: len(v)] for v in values]


@pytest.mark.parametrize(("name", "kind", "want"), [("redact", "text", "***REDACTED***"), ("redact", "int", "0"), ("redact", "bool", "false"), ("blank", "text", ""), ("null", "text", None)])
def test_unkeyed_masks(spark, name, kind, want):
    d = spark.createDataFrame([(1, "a"), (2, None)], "id int, c string")
    if kind != "text":
        d = d.selectExpr("id", "CASE WHEN c = 'a' THEN 7 END AS c") if kind == "int" else d.selectExpr("id", "CASE WHEN c = 'a' THEN true END AS c")
    got = m.mask_column(d, "c", MaskPlan(name, "s", "k", KEY, kind)).orderBy("id").collect()
    assert [str(r["c_masked"]).lower() if kind == "bool" and r["c_masked"] is not None else r["c_masked"] if r["c_masked"] is None else str(r["c_masked"]) for r in got] == [want, None]
    assert [r["c_error"] for r in got] == [None, None]
