"""Masking strategies as SQL expressions over one column, and their fail-closed application.

Each strategy gives a masked value and, for values that it must refuse, a category (invalid,
unsupported, unsafe). NULL stays NULL. All but null, blank and redact are keyed: a value's seed is an
HMAC over its kind, canonical form and plan, and every choice is drawn under that seed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats as f
from ..functions.dialect import SPARK, Spark
from ..functions.digest import MaskError, MaskPlan, draw, hmac_hex, row_pads, seed_hex
from ..functions.run import INPUT, over

#: The domain of made-up addresses; reserved, so never a real one.
MASK_DOMAIN = "masked.invalid"
REDACTED = "***REDACTED***"
ATTEMPTS = 8
# What the masks of Chinese formats choose from.
MASK_AREAS, MASK_USCC_AREAS, MASK_MOBILE = ["110101", "310101", "440103"], ["110000", "310000", "440300"], ["139", "188", "150", "176"]
MASK_CITIES = ["北京", "上海", "广州", "深圳", "杭州", "成都", "重庆"]
MASK_PINYIN = ["beijing", "shanghai", "guangzhou", "shenzhen", "hangzhou", "chengdu", "chongqing"]
MASK_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林"
MASK_COMPOUND = ["欧阳", "司马", "上官", "诸葛"]
MASK_GIVEN = "星河明月清云华光秋宁安"
MASK_STREETS = ["示例路", "虚构街", "样本巷"]
MASK_HAN = "天地玄黄宇宙洪荒日月盈昃辰宿列张山川草木风云光明华夏星海新梦"


@dataclass(frozen=True)
class Strategy:
    """valid: category to refuse with and predicate over the input; output: expression of an attempt."""

    kinds: tuple[str, ...]
    refuse: str
    valid: str
    output: str  #: may use ik, ok (the row's pads), seed, and attempt__ (the attempt as text)
    retries: bool = True


def _label(d: Spark, *parts: str) -> str:
    """A label: text parts, of which those in braces are expressions."""
    return d.cat(*(p[1:-1] if p.startswith("{") else d.text(p) for p in parts))


def _digits(d: Spark, name: str, n: str) -> str:
    as_text = "string" if d.name == "spark" else "varchar"
    return d.joined(d.each(d.upto("0", f"{n} - 1"), "j_", f"CAST({draw(d, _label(d, name + '_', '{attempt__}', '_', '{CAST(j_ AS ' + as_text + ')}'), 10)} AS {as_text})"))


def strategy(d: Spark, name: str, s: str, plan: MaskPlan) -> Strategy:
    t = lambda label: _label(d, label + "_", "{attempt__}")
    as_text = "string" if d.name == "spark" else "varchar"
    text = lambda x: f"CAST({x} AS {as_text})"
    han = r"\p{IsHan}" if d.name == "spark" else r"\p{Han}"
    if name == "fake_email":
        return Strategy(("text",), "invalid", f.mask_email(d, s), d.cat("substr(seed, 1, 32)", d.text("@" + MASK_DOMAIN)), False)
    if name == "cn_id_card":
        first = d.cat(
            d.pick(MASK_AREAS, draw(d, t("id_area"), 3)), text(f"1980 + {draw(d, t('id_year'), 26)}"),
            *(f"lpad({text(f'1 + {draw(d, t(x), n)}')}, {w}, '0')" for x, n, w in (("id_month", 12, 2), ("id_day", 28, 2), ("id_sequence", 999, 3))),
        )
        return Strategy(("text",), "invalid", f.cn_id_card(d, s), let(d, first, "b_", d.cat("b_", f.id_check(d, "b_"))))
    if name == "cn_mobile":
        country = f"CASE WHEN {s} LIKE '+86%' THEN '+86' WHEN length({s}) = 13 THEN '86' ELSE '' END"
        return Strategy(("text",), "invalid", f.cn_mobile(d, s), d.cat(country, d.pick(MASK_MOBILE, draw(d, t("mobile_prefix"), 4)), _digits(d, "mobile_tail", "8")))
    if name == "cn_bank_card":
        first = d.cat(text(f"1 + {draw(d, t('bank_first'), 9)}"), _digits(d, "bank_body", f"(length({s}) - 2)"))
        return Strategy(("text",), "invalid", f.cn_bank_card(d, s), let(d, first, "b_", d.cat("b_", f.luhn_digit(d, "b_"))))
    if name == "cn_uscc":
        body = d.joined(d.each(d.upto("0", "8"), "j_", f"substr('{f.USCC_ALPHABET}', 1 + {draw(d, _label(d, 'uscc_', '{attempt__}', '_', '{' + text('j_') + '}'), 31)}, 1)"))
        first = d.cat("'91'", d.pick(MASK_USCC_AREAS, draw(d, t("uscc_area"), 3)), body)
        return Strategy(("text",), "invalid", f.cn_uscc(d, s), let(d, first, "b_", d.cat("b_", f.uscc_check(d, "b_"))))
    if name == "cn_postal_code":
        return Strategy(("text",), "invalid", f.cn_postal_code(d, s), _digits(d, "postal", "6"))
    if name == "cn_city":
        pinyin = "|".join(MASK_PINYIN)
        valid = d.match(s, rf"^(?:(?:{'|'.join(MASK_CITIES)})市?|(?i:(?:{pinyin})(?: city)?))\z")
        is_han = d.match(s, rf"^{han}")
        # the city drawn, and of the following ones the first that differs
        at = f"({draw(d, d.text('city'), 7)} + CAST(attempt__ AS int)) % 7"
        suffix = f"CASE WHEN {is_han} THEN CASE WHEN {s} LIKE '%市' THEN '市' ELSE '' END WHEN lower({s}) LIKE '% city' THEN substr({s}, length({s}) - 4, 5) ELSE '' END"
        latin = d.pick(MASK_PINYIN, "c_")
        name_ = f"CASE WHEN {is_han} THEN {d.pick(MASK_CITIES, 'c_')} WHEN {d.match(s, '^[A-Z]')} THEN {d.cat(f'upper(substr({latin}, 1, 1))', f'substr({latin}, 2)')} ELSE {latin} END"
        return Strategy(("text",), "unsupported", valid, let(d, at, "c_", d.cat(name_, suffix)))
    if name == "cn_person_name":
        compound = d.match(s, rf"^(?:{'|'.join(MASK_COMPOUND)}){han}{{1,2}}\z")
        valid = d.match(s, rf"^(?:(?:{'|'.join(MASK_COMPOUND)}){han}{{1,2}}|[{MASK_SURNAMES}]{han}{{1,3}})\z")
        surname = f"CASE WHEN {compound} THEN {d.pick(MASK_COMPOUND, draw(d, t('compound'), 4))} ELSE substr('{MASK_SURNAMES}', 1 + {draw(d, t('surname'), len(MASK_SURNAMES))}, 1) END"
        n = f"(length({s}) - CASE WHEN {compound} THEN 2 ELSE 1 END)"
        given = d.joined(d.each(d.upto("0", f"{n} - 1"), "j_", f"substr('{MASK_GIVEN}', 1 + {draw(d, _label(d, 'given_', '{attempt__}', '_', '{' + text('j_') + '}'), len(MASK_GIVEN))}, 1)"))
        return Strategy(("text",), "unsupported", valid, d.cat(surname, given))
    if name == "cn_address":
        valid = d.match(s, rf"^{han}{{2,32}}(?:路|街|大道|巷)[0-9]{{1,4}}号\z")
        return Strategy(("text",), "unsupported", valid, d.cat("'合成区'", d.pick(MASK_STREETS, draw(d, t("street"), 3)), text(f"1 + {draw(d, t('house'), 9999)}"), "'号'"))
    if name == "cn_date":
        day = d.days("1995-01-01", f"1 + {draw(d, t('date'), 365 * 24)}")
        iso = d.date_text(day)
        parts = [f"substr(d_, {a}, {n})" for a, n in ((1, 4), (6, 2), (9, 2))]
        slashed = d.cat(parts[0], "'/'", parts[1], "'/'", parts[2])
        spoken = d.cat(parts[0], "'年'", text(f"CAST({parts[1]} AS int)"), "'月'", text(f"CAST({parts[2]} AS int)"), "'日'")
        return Strategy(("text", "date"), "unsupported", f.cn_date(d, s, 1900), let(d, iso, "d_", f"CASE WHEN {s} LIKE '%/%' THEN {slashed} WHEN {s} LIKE '%年%' THEN {spoken} ELSE d_ END"))
    if name == "format_random":
        return _format_random(d, s, plan)
    raise MaskError(f"invalid: unknown strategy {name}")


def let(d: Spark, value: str, var: str, body: str) -> str:
    """body with var for value, which is computed once."""
    return f"element_at({d.each(f'array({value})', var, body)}, 1)" if d.name == "spark" else f"list_extract({d.each(f'[{value}]', var, body)}, 1)"


def _format_random(d: Spark, s: str, plan: MaskPlan) -> Strategy:
    if plan.kind == "bytes":
        block = lambda i: hmac_hex(d, plan.key, d.cat(d.unhex("seed"), d.be64(i)))
        n = f"octet_length({s})"
        hexed = d.joined(d.each(d.upto("0", f"CAST(floor(({n} + 31) / 32) AS int) - 1"), "j_", block("j_")))
        plain = f"substr({hexed}, 1, 2 * {n})"
        flipped = d.cat("substr(f_, 1, 1)", "substr('1032547698badcfe', instr('0123456789abcdef', substr(f_, 2, 1)), 1)", "substr(f_, 3)")
        return Strategy(("bytes",), "unsupported", "true", d.unhex(let(d, plain, "f_", f"CASE WHEN f_ = {d.hexed(s)} THEN {flipped} ELSE f_ END")), False)
    classes = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"]
    draw_ = d.byte_at(hmac_hex(d, plan.key, d.cat(d.unhex("seed"), d.be64("i_ - 1"))))
    han = r"\p{IsHan}" if d.name == "spark" else r"\p{Han}"
    other = lambda abc: f"substr('{abc}', 1 + (instr('{abc}', c_) - 1 + 1 + {draw_} % {len(abc) - 1}) % {len(abc)}, 1)"
    char = f"substr({s}, i_, 1)"
    body = " ".join(f"WHEN instr('{abc}', c_) > 0 THEN {other(abc)}" for abc in classes)
    body = f"CASE {body} WHEN {d.match('c_', han)} THEN CASE WHEN instr('{MASK_HAN}', c_) > 0 THEN {other(MASK_HAN)} ELSE substr('{MASK_HAN}', 1 + {draw_} % {len(MASK_HAN)}, 1) END ELSE c_ END"
    out = d.joined(d.each(d.upto("1", f"length({s})"), "i_", let(d, char, "c_", body)))
    known = d.match(s, rf"^[a-zA-Z0-9\s\p{{P}}\p{{S}}\x{{0085}}\p{{Z}}{han}]*\z")
    return Strategy(("text",), "unsupported", known, f"CASE WHEN {s} = '' THEN {s} ELSE {out} END", False)


STRATEGIES = ("null", "blank", "redact", "format_random", "fake_email", "cn_id_card", "cn_mobile", "cn_bank_card", "cn_uscc", "cn_postal_code", "cn_city", "cn_person_name", "cn_address", "cn_date")
_ZERO = {"text": f"'{REDACTED}'", "int": "0", "uint": "0", "float": "0", "decimal": "0", "bool": "false"}


def masked_select(d: Spark, relation: str, columns: list[str], column: str, plan: MaskPlan) -> str:
    """SELECT columns, <column>_masked, <column>_error FROM relation.

    A date column is masked in its ISO form. The seed and its pads are projected once, below the draws.
    """
    name, s = plan.strategy, column
    if name not in STRATEGIES:
        raise MaskError(f"invalid: unknown strategy {name}")
    keep = ", ".join(columns)
    if name == "null":
        bad = "'unsafe'" if not plan.nullable else "CAST(NULL AS %s)" % ("string" if d.name == "spark" else "varchar")
        return f"SELECT {keep}, CAST(NULL AS {'string' if d.name == 'spark' else 'varchar'}) AS {s}_masked, CASE WHEN {s} IS NULL THEN NULL ELSE {bad} END AS {s}_error FROM {relation}"
    if name in ("blank", "redact"):
        if name == "blank" and plan.kind not in ("text", "bytes") or name == "redact" and plan.kind not in (*_ZERO, "bytes"):
            raise MaskError("unsupported: kind")
        value = "''" if name == "blank" else _ZERO.get(plan.kind, d.blob(""))
        value = d.blob("") if plan.kind == "bytes" else value
        same = "NULL" if name == "blank" or plan.kind == "bytes" else f"CASE WHEN {s} = {value} THEN 'unsafe' END"
        return f"SELECT {keep}, CASE WHEN {s} IS NOT NULL AND {same} IS NULL THEN {value} END AS {s}_masked, CASE WHEN {s} IS NOT NULL THEN {same} END AS {s}_error FROM {relation}"
    st = strategy(d, name, s, plan)
    if plan.kind not in st.kinds:
        raise MaskError("unsupported: kind")
    fixed = plan.strategy == "fake_email" and plan.length and plan.length < 33 + len(MASK_DOMAIN)
    seed = seed_hex(d, s, plan)
    inner, outer = row_pads(d, "seed")
    needs_pads = "ik" in st.output
    pads = f", {inner} AS ik, {outer} AS ok" if needs_pads else ""
    src = f"SELECT *{pads} FROM (SELECT *, CASE WHEN {s} IS NOT NULL THEN {seed} END AS seed, CASE WHEN {s} IS NULL THEN NULL ELSE {st.valid} END AS fits FROM {relation}) a_"
    attempts = ATTEMPTS if st.retries else 1
    if not st.retries:
        out = st.output
    elif d.name == "spark":  # the next attempt is computed only where the last gave the source value
        out = f"aggregate(sequence(0, {attempts - 1}), CAST(NULL AS string), (o_, n_) -> coalesce(o_, nullif({st.output.replace('attempt__', 'CAST(n_ AS string)')}, {s})))"
    else:
        tries = d.each(f"range({attempts})", "n_", st.output.replace("attempt__", "CAST(n_ AS varchar)"))
        out = f"list_extract(list_filter({tries}, lambda o_: o_ <> {s}), 1)"
    if plan.length and plan.kind == "text":
        wide = f"WHEN {d.chars_in('m_')} > {plan.length} THEN 'unsafe'" if not fixed else "WHEN true THEN 'unsafe'"
    else:
        wide = ""
    empty = f"AND {s} <> ''" if name == "format_random" and plan.kind == "text" else ""
    error = f"CASE WHEN {s} IS NULL THEN NULL WHEN NOT fits THEN '{st.refuse}' WHEN m_ IS NULL THEN 'unsafe' WHEN m_ = {s} {empty} THEN 'unsafe' {wide} END"
    return f"SELECT {keep}, CASE WHEN {error} IS NULL THEN m_ END AS {s}_masked, {error} AS {s}_error FROM (SELECT *, CASE WHEN fits THEN {out} END AS m_ FROM ({src}) b_) c_"


def mask_column(df: DataFrame, column: str, plan: MaskPlan, keep: list[str] | None = None) -> DataFrame:
    """keep columns (all by default), <column>_masked and <column>_error.

    Columns go by neutral names below, so any name will do: with blanks, dots or quotes, or one that the
    masks use themselves."""
    keep = keep or df.columns
    names = {c: f"in{i}_" for i, c in enumerate(dict.fromkeys([*keep, column]))}
    dated = lambda c: F.date_format(c, "yyyy-MM-dd") if plan.kind == "date" else c
    source = df.select(*[(dated(F.col(SPARK.ident(c))) if c == column else F.col(SPARK.ident(c))).alias(n) for c, n in names.items()])
    out = over(source, masked_select(SPARK, INPUT, [names[c] for c in keep], names[column], plan))
    return out.select(*[F.col(names[c]).alias(c) for c in keep], *[F.col(f"{names[column]}_{x}").alias(f"{column}_{x}") for x in ("masked", "error")])


def violations(masked: DataFrame, columns: list[str]) -> DataFrame:
    """column, code, n: what was refused. Run it before anything is written."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(SPARK.ident(f"{c}_error")).alias("code")) for c in columns])).alias("x")
    return masked.select(each).where("x.code IS NOT NULL").groupBy(F.col("x.column").alias("column"), F.col("x.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def require_masked(masked: DataFrame, columns: list[str]) -> DataFrame:
    """Refuse (with categories and counts, never values) unless every value could be masked."""
    bad = violations(masked, columns).collect()
    if bad:
        raise MaskError("; ".join(sorted(f"{r['code']}: {r['column']} x {r['n']}" for r in bad)))
    return masked


def mapping_table(*pairs: DataFrame) -> DataFrame:
    """First writer wins over (fingerprint, masked, turn) tables: one masked value for each fingerprint."""
    every = pairs[0]
    for p in pairs[1:]:
        every = every.unionByName(p)
    return every.groupBy("fingerprint").agg(F.min_by("masked", F.struct("turn", "masked")).alias("masked"))
