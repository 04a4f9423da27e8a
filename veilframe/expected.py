"""What detection must find in the test people, written by hand for each column and rule.

These texts share nothing with the rules' own SQL: they are facts about the columns as they were made, counted
over the rows by the database."""

from __future__ import annotations

#: Plain patterns of the made columns, in the words of their making.
MADE = {
    "email": "user[0-9]+@example[.]com",
    "mobile": "138[0-9]{8}",
    "uuid": "550e8400-e29b-41d4-a716-44665544[0-9]{4}",
    "address": "北京市朝阳区和平路[0-9]{1,4}号",
    "city": "(北京|上海市|Hangzhou|chengdu city)",
}
#: The rule that fits the whole column; none of the other rules fits any of its values.
FITS = {"email": "email", "mobile": "cn_mobile", "uuid": "uuid", "address": "cn_address", "city": "cn_city"}
# The rules by name.
RULES = ("email", "url", "ip_address", "uuid", "cn_date", "cn_id_card", "cn_mobile", "cn_bank_card", "cn_postal_code", "cn_uscc", "cn_city", "cn_person_name", "cn_address")


def evidence_of(people: str, columns: tuple[str, ...], least: int = 20, most: int = 128) -> str:
    """Evidence by rule: a column of one kind has as many hits for its rule as it has distinct values (128 at
    most), and with 20 of them it is sensitive; its name says so too."""
    rules = ", ".join(f"('{r}')" for r in RULES)
    parts = [
        f"""SELECT '{c}' AS column_name, rule, CASE WHEN rule = '{FITS[c]}' THEN n ELSE 0 END AS hits, n AS total,
  rule = '{FITS[c]}' AND n >= {least} AS format_strong, rule = '{FITS[c]}' AS context_implied, rule = '{FITS[c]}' AND n >= {least} AS eligible,
  CASE WHEN n < {least} THEN 'insufficient_evidence;' ELSE '' END || CASE WHEN rule = '{FITS[c]}' THEN '' ELSE 'unsupported;' END AS reasons,
  false AS conflict, CASE WHEN n >= {least} THEN 'sensitive' ELSE 'unknown' END AS verdict
FROM (SELECT least({most}, count(DISTINCT {c}) FILTER (regexp_full_match({c}, '{MADE[c]}'))) AS n FROM {people}) n_, (VALUES {rules}) r_(rule)"""
        for c in columns
    ]
    return " UNION ALL ".join(parts)


def verdicts_of(people: str) -> str:
    """Rules for three columns, a review that outranks them, and a skip."""
    parts = [f"SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) >= 20 THEN 'sensitive' ELSE 'unknown' END AS verdict, CASE WHEN count(DISTINCT {c}) >= 20 THEN '{FITS[c]}' END AS rule, CASE WHEN count(DISTINCT {c}) >= 20 THEN 'rule' END AS source FROM {people} WHERE regexp_full_match({c}, '{MADE[c]}')" for c in ("email", "mobile", "uuid")]
    return " UNION ALL ".join([*parts, "SELECT 'note', 'sensitive', NULL, 'reviewed'", "SELECT 'city', 'unknown', NULL, 'skip'"])


def evaluation_of(people: str) -> str:
    """All addresses, numbers and cities are found; nicknames, expected as uuid, are addresses of mail where there is one."""
    rows = ", ".join(f"('{r}')" for r in ("email", "cn_mobile", "cn_id_card", "uuid", "cn_city"))
    return f"""SELECT rule, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
  CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END AS f1
FROM (SELECT rule, CASE WHEN rule = 'uuid' THEN 0 ELSE n END AS tp, CASE WHEN rule = 'email' THEN nicknames ELSE 0 END AS fp, CASE WHEN rule = 'uuid' THEN n ELSE 0 END AS fn
  FROM (SELECT count(*) AS n, count(nickname) AS nicknames FROM {people}) n_, (VALUES {rows}) r_(rule)) x_"""
