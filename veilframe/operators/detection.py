"""Rule-based detection of sensitive columns: evidence for each rule, conflicts, and a verdict.

A rule is a format predicate over whole values plus what the column's name says. Unknown is never
"safe". One aggregation over the sampled distinct values gives all rules' hits for all columns.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.dialect import SPARK, Spark
from ..functions.formats import RULES
from ..functions.run import INPUT, over
from .paging import MAX_SAMPLE_BYTES, MAX_VALUE_BYTES, RefusedError

#: Bounds of a sample, for one value and for all.
TOO_LARGE = "unsafe: sample bytes"
VALUE = "value"
_DEALS = ("order", "transaction", "订单", "交易", "流水")


@dataclass(frozen=True)
class Rule:
    name: str
    contexts: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    required: bool = False  #: the name must say so, the format alone is too weak


# What column names say about a field.
RULE_TABLE = (
    Rule("email", ("email", "mail")),
    Rule("url", ("url", "uri", "link", "website", "site", "web")),
    Rule("ip_address", ("ip",)),
    Rule("uuid", ("uuid", "guid")),
    Rule("cn_date", ("date", "birth", "birthday", "dob")),
    Rule("cn_id_card"),
    Rule("cn_mobile", ("phone", "mobile", "tel", "telephone", "cell", "msisdn", "手机号", "手机号码", "联系电话"), _DEALS, True),
    Rule("cn_bank_card", ("bank", "card", "银行卡", "卡号"), _DEALS, True),
    Rule("cn_postal_code", ("postal", "postcode", "zip", "邮编", "邮政编码"), _DEALS, True),
    Rule("cn_uscc", ("uscc", "统一社会信用代码", "社会信用代码")),
    Rule("cn_city", ("city", "province", "region", "城市", "省", "省份", "地区", "自治区", "所在地"), (), True),
    Rule("cn_person_name", ("name", "姓名", "名字", "人名", "联系人"), (), True),
    Rule("cn_address", ("address", "addr", "street", "地址", "住址", "详址"), ("email", "mail", "ip", "url", "uri", "link", "website", "site", "web"), True),
)


@dataclass(frozen=True)
class Settings:
    min_samples: int = 20
    min_ratio: float = 0.9
    sample_limit: int = 128

    def __post_init__(self):
        if not (1 <= self.sample_limit <= 10_000 and self.min_samples >= 1 and 0 < self.min_ratio <= 1):
            raise ValueError("invalid detection settings")


def context_tokens(column: str) -> list[str]:
    """Lower-case words of a column name, split at signs and before capitals that follow small letters or digits."""
    words, word, last = [], "", ""
    for c in column:
        kind = unicodedata.category(c)
        if kind[0] == "L" or kind == "Nd":
            if kind == "Lu" and last in ("Ll", "Nd") and word:
                words.append(word)
                word = ""
            word += c
        elif word:
            words.append(word)
            word = ""
        last = kind
    return [w.lower() for w in [*words, word] if w]


def _says(words: tuple[str, ...], tokens: list[str]) -> bool:
    return any(t == w or not w.isascii() and w in t for w in words for t in tokens)


def context_implies(rule: Rule, column: str) -> bool:
    tokens = context_tokens(column)
    return not _says(rule.excludes, tokens) and _says(rule.contexts, tokens)


def _rules(d: Spark) -> list[Rule]:
    return [r for r in RULE_TABLE if d.name == "spark" or r.name != "cn_address"]


BLANK = r"^[\s\p{Z}\x{0085}]*\z"


#: One in so many distinct values, by hash, tells up to which value a column's sample can reach.
ONE_IN = 4096


def samples_sql(d: Spark, relation: str, columns: list[str], limit: int, kinds: dict[str, str] | None = None, one_in: int = ONE_IN) -> str:
    """column_name, kind, value: each column's least ``limit`` distinct values that aren't NULL, blanks left out after the cut.

    Not all distinct values are shuffled: the limit-th of some of them is no less than the limit-th of all, so a
    first scan of one in ``one_in`` gives a bound (one row a column, broadcast) beyond which the second leaves rows out."""
    of = lambda c: d.text((kinds or {}).get(c, "text"))
    least = lambda rows: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY value) AS n_ FROM (SELECT DISTINCT * FROM ({rows}) u_) v_) w_ WHERE n_ <= {limit}"
    if d.name == "spark":  # one scan for all columns
        rows = f"SELECT column_name, kind, value FROM (SELECT stack({len(columns)}, {', '.join(f'{d.text(c)}, {of(c)}, CAST({d.ident(c)} AS string)' for c in columns)}) AS (column_name, kind, value) FROM {relation}) st_ WHERE value IS NOT NULL"
        top = f"SELECT column_name AS of_, max(value) AS top_ FROM ({least(f'SELECT column_name, value FROM ({rows}) r_ WHERE pmod(xxhash64(value), {one_in}) = 0')}) t_ GROUP BY column_name HAVING count(*) = {limit}"
        rows = f"SELECT /*+ BROADCAST(b_) */ column_name, kind, value FROM ({rows}) r_ LEFT JOIN ({top}) b_ ON column_name = of_ WHERE top_ IS NULL OR value <= top_"
    else:
        rows = " UNION ALL ".join(f"SELECT {d.text(c)} AS column_name, {of(c)} AS kind, CAST({d.ident(c)} AS varchar) AS value FROM {relation} WHERE {d.ident(c)} IS NOT NULL" for c in columns)
    return f"SELECT column_name, kind, value FROM ({least(rows)}) s_ WHERE NOT {d.match('value', BLANK)}"


def column_kinds(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """text, date or other; only text can match a rule, and dates the rule for dates."""
    types = {f.name: f.dataType.typeName() for f in df.schema}
    return {c: {"string": "text", "varchar": "text", "char": "text", "date": "date"}.get(types[c], "other") for c in columns}


def evidence_sql(d: Spark, relation: str, columns: list[str], settings: Settings = Settings(), kinds: dict[str, str] | None = None) -> str:
    """column_name, rule, hits, total, format_strong, context_implied, eligible, reasons, conflict, verdict."""
    rules = _rules(d)
    hits = ", ".join(f"sum(CASE WHEN kind {"IN ('text', 'date')" if r.name == 'cn_date' else "= 'text'"} AND {RULES[r.name](d, 'value')} THEN 1 ELSE 0 END) AS h_{r.name}" for r in rules)
    total = "count(*)"
    if d.name == "spark":  # a sample that is too large is refused when it is read
        total = f"if(max(octet_length(value)) > {MAX_VALUE_BYTES} OR sum(octet_length(value)) > {MAX_SAMPLE_BYTES}, raise_error('{TOO_LARGE}'), count(*))"
    wide = f"SELECT column_name, {total} AS total, {hits} FROM ({samples_sql(d, relation, columns, settings.sample_limit, kinds)}) s_ GROUP BY column_name"
    says = [(c, i, r) for c in columns for i, r in enumerate(rules)]
    rows = ", ".join(f"({d.text(c)}, {i}, {d.text(r.name)}, {str(context_implies(r, c)).lower()}, {str(r.required).lower()})" for c, i, r in says)
    facts = f"SELECT * FROM (VALUES {rows}) AS v_(column_name, rule_no, rule, context_implied, required)"
    hit = "CASE rule " + " ".join(f"WHEN '{r.name}' THEN h_{r.name}" for r in rules) + " END"
    strong = f"(total >= {settings.min_samples} AND CAST(hits AS double) / total >= CAST({settings.min_ratio} AS double))"
    eligible = "(format_strong AND (NOT required OR context_implied))"
    flag = lambda x: f"sum(CASE WHEN {x} THEN 1 ELSE 0 END) OVER (PARTITION BY column_name)"
    reasons = d.cat(
        f"CASE WHEN total < {settings.min_samples} THEN 'insufficient_evidence;' ELSE '' END",
        "CASE WHEN total = 0 OR hits = 0 THEN 'unsupported;' ELSE '' END",
        f"CASE WHEN hits > 0 AND total >= {settings.min_samples} AND CAST(hits AS double) / total < CAST({settings.min_ratio} AS double) THEN 'insufficient_evidence;' ELSE '' END",
        "CASE WHEN format_strong AND required AND NOT context_implied THEN 'insufficient_evidence;' ELSE '' END",
        "CASE WHEN conflict THEN 'conflicting_evidence;' ELSE '' END",
    )
    # a conflict: two eligible rules, or a rule that the name implies but the values don't, beside another rule whose format holds
    lone = "sum(CASE WHEN context_implied AND NOT eligible AND (strong_n - CASE WHEN format_strong THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY column_name)"
    return f"""
SELECT column_name, rule, CAST(hits AS bigint) AS hits, CAST(total AS bigint) AS total, format_strong, context_implied, eligible, {reasons} AS reasons, conflict,
  CASE WHEN total >= {settings.min_samples} AND NOT conflict AND eligible_n = 1 THEN 'sensitive' ELSE 'unknown' END AS verdict
FROM (SELECT *, total >= {settings.min_samples} AND (eligible_n > 1 OR {lone} > 0) AS conflict
  FROM (SELECT *, {flag('eligible')} AS eligible_n, {flag('format_strong')} AS strong_n
    FROM (SELECT *, {eligible} AS eligible
      FROM (SELECT *, {strong} AS format_strong
        FROM (SELECT f_.column_name, f_.rule_no, f_.rule, f_.context_implied, f_.required, coalesce(w_.total, 0) AS total, coalesce({hit}, 0) AS hits
          FROM ({facts}) f_ LEFT JOIN ({wide}) w_ ON f_.column_name = w_.column_name) e0) e1) e2) e3) e4"""


def evidence(df: DataFrame, columns: list[str], settings: Settings = Settings()) -> DataFrame:
    return over(df, evidence_sql(SPARK, INPUT, columns, settings, column_kinds(df, columns)))


def verdicts(df: DataFrame, columns: list[str], settings: Settings = Settings(), override: dict[str, str] | None = None, reviewed: dict[str, str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """column_name, verdict, rule, source. An override outranks a review, both outrank a skip, all outrank rules."""
    spark = df.sparkSession
    forced = {c: (v, "skip") for c, v in dict.fromkeys(skip, "unknown").items()}
    forced |= {c: (v, "reviewed") for c, v in (reviewed or {}).items()}
    forced |= {c: (v, "override") for c, v in (override or {}).items()}
    open_ = [c for c in columns if c not in forced]
    rows = [(c, v, None, s) for c, (v, s) in forced.items() if c in columns]
    out = spark.createDataFrame(rows, "column_name string, verdict string, rule string, source string")
    if open_:
        e = evidence(df, open_, settings)
        out = out.unionByName(e.groupBy("column_name").agg(*_verdict()).selectExpr("column_name", "verdict", "rule", "CASE WHEN verdict = 'sensitive' THEN 'rule' END AS source"))
    return out


def _verdict():
    from pyspark.sql import functions as F

    return F.max("verdict").alias("v_"), F.when(F.max("verdict") == "unknown", "unknown").otherwise("sensitive").alias("verdict"), F.max(F.when((F.col("verdict") == "sensitive") & F.col("eligible"), F.col("rule"))).alias("rule")


def evaluation(scored: DataFrame) -> DataFrame:
    """rule, tp, fp, fn, precision, recall, f1 from rows (rule, expected boolean, found boolean)."""
    from pyspark.sql import functions as F

    n = lambda e, f: F.sum(F.when((F.col("expected") == e) & (F.col("found") == f), 1).otherwise(0))
    out = scored.groupBy("rule").agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, F.col(a) / b)
    out = out.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn")))
    return out.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def whole_value_matches(df: DataFrame, column: str) -> DataFrame:
    """The column's values with one boolean for each rule."""
    from pyspark.sql import functions as F

    d = df.select(F.col(SPARK.ident(column)).alias("value"))
    out = over(d, f"SELECT value, {', '.join(f'{RULES[r.name](SPARK, VALUE)} AS {r.name}' for r in RULE_TABLE)} FROM {INPUT}")
    return out.withColumnRenamed("value", column)


def read_verdicts(rows: DataFrame) -> list:
    """Collect verdicts; a sample that is too large is refused by category."""
    try:
        return rows.collect()
    except Exception as e:
        if TOO_LARGE in str(e):
            raise RefusedError(TOO_LARGE) from None
        raise
