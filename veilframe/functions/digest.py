"""Keyed digests: HMAC-SHA256 composed of sha2, typed seeds of values, and keyed draws."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from .dialect import Spark

#: Kind ids of the data model; the id byte is part of every seed. Fixed values.
KINDS = {"null": 0, "text": 1, "bytes": 2, "int": 3, "uint": 4, "float": 5, "decimal": 6, "bool": 7, "date": 8, "datetime": 9, "instant": 10}
_MARK = "typed-lexical-v1"


class MaskError(ValueError):
    """A refusal; its text names a category and never holds a value."""


@dataclass(frozen=True)
class MaskPlan:
    """What a column's seed is bound to."""

    strategy: str
    scope: str  #: dialect/table/column
    key_id: str
    key: bytes
    kind: str = "text"
    version: str = "1"
    normalization: str = "v1"
    nullable: bool = True
    length: int = 0

    def __post_init__(self):
        if len(self.key) < 32:
            raise MaskError("invalid: a key needs 32 bytes or more")
        if not (self.scope and self.key_id and self.normalization):
            raise MaskError("invalid: scope, key id and normalization are required")
        if self.kind not in KINDS:
            raise MaskError("invalid: unknown kind")

    @property
    def extra(self) -> bytes:
        return "|".join(f"{len(x.encode())}:{x}" for x in (self.strategy, self.version, self.scope, self.normalization, self.key_id)).encode()


def _pads(key: bytes) -> tuple[str, str]:
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_hex(d: Spark, key: bytes, message: str) -> str:
    """Hex HMAC of a binary expression under a constant key; the pads are literals."""
    inner, outer = _pads(key)
    return d.sha(d.cat(d.blob(outer), d.unhex(d.sha(d.cat(d.blob(inner), message)))))


def seed_hex(d: Spark, payload: str, plan: MaskPlan, kind: str | None = None) -> str:
    """The 32-byte seed of a value (a text expression with its canonical form) as hex."""
    extra = plan.extra
    tail = len(extra).to_bytes(4, "big") + extra + _MARK.encode()
    raw = payload if plan.kind == "bytes" else d.raw(payload)
    size = d.bytes_in(payload) if plan.kind != "bytes" else f"octet_length({payload})"
    return hmac_hex(d, plan.key, d.cat(d.blob(f"{KINDS[kind or plan.kind]:02x}"), d.be32(size), raw, d.blob(tail.hex())))


def row_pads(d: Spark, seed: str) -> tuple[str, str]:
    return d.xor_pad(seed, "36"), d.xor_pad(seed, "5c")


def draw(d: Spark, label: str, n: int, inner: str = "ik", outer: str = "ok") -> str:
    """A number below n drawn under the row's seed; label is a text expression."""
    return d.u64_mod(d.sha(d.cat(outer, d.unhex(d.sha(d.cat(inner, d.raw(label)))))), n)
