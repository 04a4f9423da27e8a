"""SQL text for two engines: Spark runs it, and DuckDB, as an independent executor, checks it.

Operators that must give equal bytes everywhere (keyed digests, checksums, detection rules) are written
once as expressions over this small vocabulary. Both engines get plain built-in functions: on Spark
everything stays in the JVM.
"""

from __future__ import annotations


class Spark:
    name = "spark"
    han = r"\\p{IsHan}"

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def ident(self, name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    def blob(self, hexed: str) -> str:
        return f"unhex('{hexed}')"

    def unhex(self, x: str) -> str:
        return f"unhex({x})"

    def hexed(self, x: str) -> str:
        return f"lower(hex({x}))"

    def raw(self, x: str) -> str:
        return f"encode({x}, 'UTF-8')"

    def cat(self, *x: str) -> str:
        return f"concat({', '.join(x)})"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def be32(self, x: str) -> str:
        return f"unhex(lpad(hex({x}), 8, '0'))"

    def be64(self, x: str) -> str:
        return f"unhex(lpad(hex({x}), 16, '0'))"

    def bytes_in(self, x: str) -> str:
        return f"octet_length({x})"

    def chars_in(self, x: str) -> str:
        return f"char_length({x})"

    def xor_pad(self, seed: str, byte: str) -> str:
        """A 32-byte key (hex) as a 64-byte HMAC pad."""
        mask = f"CAST(conv('{byte * 8}', 16, -10) AS bigint)"
        parts = [f"lpad(hex(CAST(conv(substr({seed}, {1 + 16 * i}, 16), 16, -10) AS bigint) ^ {mask}), 16, '0')" for i in range(4)]
        return f"unhex(concat({', '.join(parts)}, '{byte * 32}'))"

    def u64_mod(self, hexed: str, n: int) -> str:
        return f"CAST(CAST(conv(substr({hexed}, 1, 16), 16, 10) AS decimal(20,0)) % {n} AS int)"

    def byte_at(self, hexed: str, i: int = 0) -> str:
        return f"CAST(conv(substr({hexed}, {2 * i + 1}, 2), 16, 10) AS int)"

    def match(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.text(pattern)})"

    def each(self, items: str, var: str, body: str) -> str:
        return f"transform({items}, {var} -> {body})"

    def fold(self, items: str, start: str, acc: str, var: str, body: str) -> str:
        return f"aggregate({items}, {start}, ({acc}, {var}) -> {body})"

    def upto(self, a: str, b: str) -> str:
        """a to b, both included; empty if b < a."""
        return f"if({b} < {a}, CAST(array() AS array<int>), sequence(CAST({a} AS int), CAST({b} AS int)))"

    def joined(self, items: str) -> str:
        return f"array_join({items}, '')"

    def pick(self, words: list[str], index: str) -> str:
        return f"element_at(array({', '.join(map(self.text, words))}), {index} + 1)"

    def total(self, items: str) -> str:
        return f"aggregate({items}, 0, (a_, x_) -> a_ + x_)"

    def days(self, start: str, n: str) -> str:
        return f"date_add(date'{start}', {n})"

    def date_text(self, d: str) -> str:
        return f"date_format({d}, 'yyyy-MM-dd')"


class Duck(Spark):
    name = "duckdb"
    han = r"\p{Han}"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def ident(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def blob(self, hexed: str) -> str:
        return f"from_hex('{hexed}')"

    def unhex(self, x: str) -> str:
        return f"from_hex({x})"

    def raw(self, x: str) -> str:
        return f"encode({x})"

    def cat(self, *x: str) -> str:
        return "(" + " || ".join(x) + ")"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def be32(self, x: str) -> str:
        return f"from_hex(lpad(to_hex(CAST({x} AS bigint)), 8, '0'))"

    def be64(self, x: str) -> str:
        return f"from_hex(lpad(to_hex(CAST({x} AS bigint)), 16, '0'))"

    def bytes_in(self, x: str) -> str:
        return f"strlen({x})"

    def chars_in(self, x: str) -> str:
        return f"length({x})"

    def xor_pad(self, seed: str, byte: str) -> str:
        return f"CAST(xor(CAST(from_hex({seed} || '{'00' * 32}') AS BIT), CAST(from_hex('{byte * 64}') AS BIT)) AS BLOB)"

    def u64_mod(self, hexed: str, n: int) -> str:
        return f"CAST(CAST('0x' || substr({hexed}, 1, 16) AS UBIGINT) % {n} AS int)"

    def byte_at(self, hexed: str, i: int = 0) -> str:
        return f"CAST('0x' || substr({hexed}, {2 * i + 1}, 2) AS int)"

    def match(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.text(pattern)})"

    def each(self, items: str, var: str, body: str) -> str:
        return f"list_transform({items}, lambda {var}: {body})"

    def fold(self, items: str, start: str, acc: str, var: str, body: str) -> str:
        raise NotImplementedError

    def upto(self, a: str, b: str) -> str:
        return f"range(CAST({a} AS int), CAST({b} AS int) + 1)"

    def joined(self, items: str) -> str:
        return f"array_to_string({items}, '')"

    def pick(self, words: list[str], index: str) -> str:
        return f"list_extract([{', '.join(map(self.text, words))}], {index} + 1)"

    def total(self, items: str) -> str:
        return f"coalesce(list_sum({items}), 0)"

    def days(self, start: str, n: str) -> str:
        return f"(date '{start}' + CAST({n} AS int))"

    def date_text(self, d: str) -> str:
        return f"strftime({d}, '%Y-%m-%d')"


SPARK, DUCK = Spark(), Duck()
