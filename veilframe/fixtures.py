"""Columns with checkable identifiers, derived from integer keys; the same SQL text runs on both engines."""

from __future__ import annotations

from .functions import formats as f
from .functions.dialect import Spark


def people_sql(d: Spark, table: str = "customer", key: str = "c_custkey") -> str:
    text = lambda x: f"CAST({x} AS {'string' if d.name == 'spark' else 'varchar'})"
    k = key
    pad = lambda x, n: f"lpad({text(x)}, {n}, '0')"
    ymd = f"replace({d.date_text('born')}, '-', '')"
    names, cities = ["王星河", "李明", "欧阳清云", "张华光"], ["北京", "上海市", "Hangzhou", "chengdu city"]
    return f"""
SELECT k AS id, email, mobile, postal, {d.date_text('born')} AS birth_text, born AS birth_date, {d.cat('id17', f.id_check(d, 'id17'))} AS id_card,
  {d.cat('card', f.luhn_digit(d, 'card'))} AS bank_card, {d.cat('uscc17', f.uscc_check(d, 'uscc17'))} AS uscc, address, ip, uuid, city, person_name, nickname, link
FROM (SELECT *, {d.cat("'110101'", ymd, pad('1 + k % 999', 3))} AS id17, {d.cat("'62'", pad('10000000000000 + k', 14))} AS card, {d.cat("'91110000'", pad('k', 9))} AS uscc17
  FROM (SELECT {k} AS k, {d.cat("'user'", text(k), "'@example.com'")} AS email, {d.cat("'138'", pad(k, 8))} AS mobile, {pad(f'(100000 + {k} * 137) % 1000000', 6)} AS postal,
      {d.days('1970-01-01', f'CAST({k} % 14000 AS int)')} AS born, {d.cat("'北京市朝阳区和平路'", text(f'1 + {k} % 9999'), "'号'")} AS address,
      {d.cat("'10.'", text(f'{k} % 256'), "'.'", text(f'({k} + 1) % 256'), "'.'", text(f'({k} + 2) % 256'))} AS ip,
      {d.cat("'550e8400-e29b-41d4-a716-44665544'", pad(f'{k} % 10000', 4))} AS uuid, {d.pick(cities, f'CAST({k} % 4 AS int)')} AS city, {d.pick(names, f'CAST({k} % 4 AS int)')} AS person_name,
      CASE WHEN {k} % 20 = 0 THEN NULL ELSE {d.cat("'r'", pad(f'{k} % 100', 3), "'@example.com'")} END AS nickname,
      {d.cat("'https://shop'", text(f'{k} % 50'), "'.example.com:8080/p/'", text(k), "'?q=1'")} AS link
    FROM {table}) p0) p1"""
