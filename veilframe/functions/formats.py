"""Predicates over one text value: the format rules of detection and the input checks of masking."""

from __future__ import annotations

from .dialect import Spark

# ------------------------------------------------------------------ fixed values of the public formats and of the rule set
ID_AREAS = "110101 110105 110108 120101 310101 310115 440103 440106 440304 330106 320102 510107 420106 610113 500106".split()
USCC_AUTHORITIES = "110000 120000 310000 500000 440100 440300 330100 320100 510100 420100 610100 350100".split()
MOBILE_PREFIXES = (
    "130 131 132 133 134 135 136 137 138 139 150 151 152 153 155 156 157 158 159 "
    "170 171 173 175 176 177 178 180 181 182 183 184 185 186 187 188 189 191 193 195 196 198 199"
).split()
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
USCC_CATEGORIES = "11 51 52 53 59 91 92 93 Y1".split()
CITIES = (
    "北京 beijing 上海 shanghai 广州 guangzhou 深圳 shenzhen 杭州 hangzhou 西安 xian 成都 chengdu 重庆 chongqing "
    "广东 guangdong 浙江 zhejiang 江苏 jiangsu 四川 sichuan 陕西 shaanxi 湖北 hubei 福建 fujian 山东 shandong "
    "河南 henan 河北 hebei 湖南 hunan 安徽 anhui 江西 jiangxi 辽宁 liaoning 天津 tianjin 广西 guangxi 广西壮族 "
    "内蒙古 neimenggu innermongolia 新疆 xinjiang 新疆维吾尔 宁夏 ningxia 宁夏回族 西藏 xizang tibet"
).split()
CITY_SUFFIXES = "特别行政区 自治区 自治州 地区 省 市 province city shi sheng".split()
SURNAMES = (
    "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾田董袁潘于蒋蔡余杜叶程苏"
    "魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤成"
)
COMPOUND_SURNAMES = "欧阳 司马 上官 诸葛 令狐 慕容 皇甫 尉迟 长孙 宇文".split()
ADDRESS_ADMIN = "特别行政区 自治区 自治州 地区 省 市 区 县 镇 乡 街道".split()
ADDRESS_ROAD = "大道 大街 路 街 巷 弄 胡同".split()
ADDRESS_BUILDING = "大厦 公寓 小区 广场".split()
ADDRESS_UNIT = "单元 号 栋 幢 座 楼 室 房 层 院".split()
ADDRESS_NUMERALS = "零一二三四五六七八九十百千万两〇"

_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_HOST = rf"(?:{_LABEL}\.)+[A-Za-z]{{2,63}}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = "[0-9A-Fa-f]{1,4}"
_V6 = "(?:" + "|".join(
    [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{1,7}}:", rf":(?::{_H}){{1,7}}", "::"]
    + [rf"(?:{_H}:){{{i}}}(?::{_H}){{1,{7 - i}}}" for i in range(1, 7)]
    + [rf"(?:{_H}:){{6}}{_V4}", rf"::(?:{_H}:){{0,5}}{_V4}"]
    + [rf"(?:{_H}:){{{i}}}:(?:{_H}:){{0,{5 - i}}}{_V4}" for i in range(1, 6)]
) + ")"
_ATEXT = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
_PORT = "0*(?:[1-9][0-9]{0,3}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])"
_PART = r"(?:[^\s\x00-\x1f\x7f%?#]|%[0-9A-Fa-f]{2})*"


def listed(x: str, words: list[str]) -> str:
    return f"{x} IN ({', '.join(repr(w) for w in words)})"


def weighted(d: Spark, s: str, alphabet: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"(instr('{alphabet}', substr({s}, {i + 1}, 1)) - 1) * {w}" for i, w in enumerate(weights)) + ")"


def id_check(d: Spark, s: str) -> str:
    return f"substr('{ID_CHECKS}', {weighted(d, s, '0123456789', ID_WEIGHTS)} % 11 + 1, 1)"


def uscc_check(d: Spark, s: str) -> str:
    return f"substr('{USCC_ALPHABET}', (31 - {weighted(d, s, USCC_ALPHABET, USCC_WEIGHTS)} % 31) % 31 + 1, 1)"


def luhn_sum(d: Spark, s: str, doubled_last: bool) -> str:
    """Luhn sum of a digit string; whether the last digit is doubled."""
    n = d.chars_in(s)
    v = f"(instr('0123456789', substr({s}, {n} - i_, 1)) - 1)"
    twice = f"(i_ % 2 = {0 if doubled_last else 1})"
    return d.total(d.each(d.upto("0", f"{n} - 1"), "i_", f"CASE WHEN {twice} THEN ({v} * 2) % 10 + CASE WHEN {v} >= 5 THEN 1 ELSE 0 END ELSE {v} END"))


def luhn_digit(d: Spark, s: str) -> str:
    return f"CAST((10 - {luhn_sum(d, s, True)} % 10) % 10 AS string)" if d.name == "spark" else f"CAST((10 - {luhn_sum(d, s, True)} % 10) % 10 AS varchar)"


def real_date(y: str, m: str, day: str, first_year: int) -> str:
    """Calendar validity of three integer expressions."""
    leap = f"(({y} % 4 = 0 AND {y} % 100 <> 0) OR {y} % 400 = 0)"
    last = f"CASE WHEN {m} IN (4, 6, 9, 11) THEN 30 WHEN {m} = 2 THEN CASE WHEN {leap} THEN 29 ELSE 28 END ELSE 31 END"
    return f"({y} >= {first_year} AND {m} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND {last})"


def _int(x: str) -> str:
    return f"CAST(nullif({x}, '') AS int)"


def email(d: Spark, s: str) -> str:
    host = rf"(?:{_HOST}|\[(?:{_V4}|{_V6})\])"
    local = f"instr({s}, '@') - 1"
    return f"({d.bytes_in(s)} <= 254 AND {local} BETWEEN 1 AND 64 AND {d.bytes_in(s)} - ({local}) <= 254 AND {d.match(s, rf'^{_ATEXT}(?:[.]{_ATEXT})*@{host}\z')})"


def mask_email(d: Spark, s: str) -> str:
    """The narrower address that the email mask takes: no underscore in the local part."""
    atom = r"[A-Za-z0-9!#$%&'*+/=?^`{|}~-]+"
    return f"({d.bytes_in(s)} <= 254 AND instr({s}, '@') <= 65 AND {d.match(s, rf'^{atom}(?:[.]{atom})*@{_LABEL}(?:[.]{_LABEL})+\z')})"


def url(d: Spark, s: str) -> str:
    return d.match(s, rf"^(?i:https?)://(?:[^\s/?#@]*@)?(?:{_HOST}|{_V4}|\[{_V6}\])(?::{_PORT})?(?:/{_PART})?(?:\?[^\s#]*)?(?:#{_PART.replace('?#', '')})?\z")


def ip_address(d: Spark, s: str) -> str:
    return d.match(s, rf"^(?:{_V4}|{_V6})\z")


def uuid(d: Spark, s: str) -> str:
    return d.match(s, r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\z")


def date_layout(d: Spark, s: str, layout: str, first_year: int) -> str:
    if layout == "han":
        f = [f"regexp_extract({s}, {d.text('^([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日')}, {i})" for i in (1, 2, 3)]
        shape = d.match(s, r"^[0-9]{4}年[1-9][0-9]?月[1-9][0-9]?日\z")
    else:
        f = [f"substr({s}, {a}, {n})" for a, n in ((1, 4), (6, 2), (9, 2))]
        shape = d.match(s, rf"^[0-9]{{4}}[{layout}][0-9]{{2}}[{layout}][0-9]{{2}}\z")
    return f"(CASE WHEN {shape} THEN {real_date(*map(_int, f), first_year)} ELSE false END)"


def cn_date(d: Spark, s: str, first_year: int = 1) -> str:
    return "(" + " OR ".join(date_layout(d, s, x, first_year) for x in ("-", "/", "han")) + ")"


def cn_id_card(d: Spark, s: str) -> str:
    born = real_date(*(f"CAST(substr({s}, {a}, {n}) AS int)" for a, n in ((7, 4), (11, 2), (13, 2))), 1900)
    return f"(CASE WHEN {d.match(s, r'^[0-9]{17}[0-9Xx]\z')} THEN {born} AND {listed(f'substr({s}, 1, 6)', ID_AREAS)} AND substr({s}, 15, 3) <> '000' AND upper(substr({s}, 18, 1)) = {id_check(d, s)} ELSE false END)"


def cn_mobile(d: Spark, s: str) -> str:
    return d.match(s, rf"^(?:[+]86|86)?(?:{'|'.join(MOBILE_PREFIXES)})[0-9]{{8}}\z")


def cn_bank_card(d: Spark, s: str) -> str:
    return f"(CASE WHEN {d.match(s, r'^[1-9][0-9]{15,18}\z')} THEN {luhn_sum(d, s, False)} % 10 = 0 ELSE false END)"


def cn_postal_code(d: Spark, s: str) -> str:
    return d.match(s, r"^[0-9]{6}\z")


def cn_uscc(d: Spark, s: str) -> str:
    areas = "|".join(USCC_AUTHORITIES + ID_AREAS)
    return f"(CASE WHEN {d.match(s, rf'^(?:{'|'.join(USCC_CATEGORIES)})(?:{areas})[{USCC_ALPHABET}]{{10}}\z')} THEN substr({s}, 18, 1) = {uscc_check(d, s)} ELSE false END)"


def cn_city(d: Spark, s: str) -> str:
    plain = f"regexp_replace(lower({s}), {d.text(r'[ \t\n\r\'’_-]')}, ''" + (", 'g')" if d.name == "duckdb" else ")")
    return d.match(plain, rf"^(?:{'|'.join(CITIES)})(?:{'|'.join(CITY_SUFFIXES)})?\z")


def cn_person_name(d: Spark, s: str) -> str:
    han = r"\p{IsHan}" if d.name == "spark" else r"\p{Han}"
    return f"({d.match(s, rf'^(?:(?:{'|'.join(COMPOUND_SURNAMES)}){han}{{1,2}}|[{SURNAMES}]{han}{{1,3}})\z')} AND NOT {cn_city(d, s)})"


def cn_address(d: Spark, s: str) -> str:
    """An ordered address as one pattern for the JVM: possessive groups make it read left to right, the
    longest marker first, without going back; other engines have no such groups."""
    if d.name != "spark":
        raise NotImplementedError("the address rule needs possessive groups")
    longest = lambda words: "(?>" + "|".join(sorted(words, key=len, reverse=True)) + ")"
    place, unit = longest(ADDRESS_ADMIN + ADDRESS_ROAD + ADDRESS_BUILDING), longest(ADDRESS_UNIT)
    house = rf"(?>[0-9{ADDRESS_NUMERALS}]++{unit})"
    stem = rf"(?:(?!{house})(?!{place})(?!{unit})\p{{IsHan}})"
    return f"({d.chars_in(s)} BETWEEN 4 AND 120 AND {d.match(s, rf'^(?:{stem}++(?!{house}){place})++{stem}*+{house}(?:{house}|{unit})*+\z')})"


RULES = {
    "email": email, "url": url, "ip_address": ip_address, "uuid": uuid, "cn_date": cn_date, "cn_id_card": cn_id_card, "cn_mobile": cn_mobile,
    "cn_bank_card": cn_bank_card, "cn_postal_code": cn_postal_code, "cn_uscc": cn_uscc, "cn_city": cn_city, "cn_person_name": cn_person_name, "cn_address": cn_address,
}
