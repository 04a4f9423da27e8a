"""Signed approvals of plans: Ed25519 (RFC 8032), a trust set, and an atomic store of records.

The signature code is plain Python for machines without a crypto library; approvals are a few records a
run, signed and checked on the driver. It isn't constant-time: sign on a machine of your own.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from dataclasses import asdict, dataclass
from pathlib import Path

from .registry import GateError

P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, P) % P
_Point = tuple[int, int, int, int]


def _add(a: _Point, b: _Point) -> _Point:
    x, y = (a[1] - a[0]) * (b[1] - b[0]) % P, (a[1] + a[0]) * (b[1] + b[0]) % P
    t, z = 2 * a[3] * b[3] * _D % P, 2 * a[2] * b[2] % P
    e, f, g, h = y - x, z - t, z + t, y + x
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, a: _Point) -> _Point:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, a)
        a, n = _add(a, a), n >> 1
    return out


def _x(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    xx = (y * y - 1) * pow(_D * y * y + 1, -1, P) % P
    x = pow(xx, (P + 3) // 8, P)
    if (x * x - xx) % P:
        x = x * pow(2, (P - 1) // 4, P) % P
    if (x * x - xx) % P or not x and odd:
        return None
    return P - x if x & 1 != odd else x


_BY = 4 * pow(5, -1, P) % P
_BASE: _Point = (_x(_BY, 0), _BY, 1, _x(_BY, 0) * _BY % P)


def _pack(a: _Point) -> bytes:
    z = pow(a[2], -1, P)
    x, y = a[0] * z % P, a[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(s: bytes) -> _Point | None:
    y = int.from_bytes(s, "little")
    odd, y = y >> 255, y & (1 << 255) - 1
    x = _x(y, odd)
    return None if x is None else (x, y, 1, x * y % P)


def _secret(key: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(key).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def _mod(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % L


def public_key(secret: bytes) -> bytes:
    return _pack(_times(_secret(secret)[0], _BASE))


def sign(secret: bytes, message: bytes) -> bytes:
    a, prefix = _secret(secret)
    pub = _pack(_times(a, _BASE))
    r = _mod(prefix, message)
    big = _pack(_times(r, _BASE))
    return big + ((r + _mod(big, pub, message) * a) % L).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(public), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    left, right = _times(s, _BASE), _add(r, _times(_mod(signature[:32], public, message), a))
    return not ((left[0] * right[2] - right[0] * left[2]) % P or (left[1] * right[2] - right[1] * left[2]) % P)


# ------------------------------------------------------------------ records

MAGIC = "approval-v1"
SKEW_S, MOST_BYTES = 300, 1 << 20


@dataclass(frozen=True)
class Record:
    plan_id: str
    scopes: tuple[tuple[str, str], ...]  #: in the plan's order
    target_id: str
    issued_at: int
    expires_at: int
    signer: str
    revoked: bool = False

    def payload(self) -> bytes:
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def encode(record: Record, secret: bytes) -> bytes:
    body = record.payload()
    return f"{MAGIC}\n{sign(secret, MAGIC.encode() + b'\n' + body).hex()}\n".encode() + body


def decode(raw: bytes, trusted: dict[str, bytes]) -> Record:
    """The one valid form of a record by a trusted signer, or a refusal."""
    try:
        magic, signature, body = raw.split(b"\n", 2)
        d = json.loads(body)
        r = Record(**d | {"scopes": tuple(map(tuple, d["scopes"]))})
        ok = magic.decode() == MAGIC and len(raw) <= MOST_BYTES and r.payload() == body and verify(trusted[r.signer], MAGIC.encode() + b"\n" + body, bytes.fromhex(signature.decode()))
    except (ValueError, KeyError, TypeError):
        ok = False
    if not ok:
        raise GateError("unsafe: approval not authentic")
    return r


def load_trust(path: str) -> dict[str, bytes]:
    d = json.loads(Path(path).read_text())
    if d.get("version") != 1:
        raise GateError("invalid: trust file")
    keys = {k["signer_key_id"]: bytes.fromhex(k["public_key_hex"]) for k in d["keys"]}
    if len(keys) != len(d["keys"]) or any(len(k) != 32 for k in keys.values()):
        raise GateError("invalid: trust file")
    return keys


class Store:
    """A folder with one file a record, written by temporary file, fsync and rename."""

    def __init__(self, folder: str, trusted: dict[str, bytes]):
        self.folder, self.trusted = Path(folder), trusted
        self.folder.mkdir(parents=True, exist_ok=True)

    def _put(self, name: str, raw: bytes) -> None:
        fd, tmp = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(fd, "wb") as f:
            f.write(raw)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, self.folder / name)
        at = os.open(self.folder, os.O_RDONLY)
        os.fsync(at)
        os.close(at)

    def approve(self, record: Record, secret: bytes) -> None:
        self._put(f"{record.plan_id}.{record.issued_at}.approval", encode(record, secret))

    def revoke(self, record: Record, secret: bytes) -> None:
        self.approve(Record(**asdict(record) | {"revoked": True, "scopes": record.scopes, "issued_at": record.issued_at + 1}), secret)

    def lookup(self, plan_id: str, target_id: str, scopes: tuple[tuple[str, str], ...], now: int) -> Record:
        """The newest record of the plan, if it holds now; an unreadable candidate refuses all."""
        found = [decode(p.read_bytes(), self.trusted) for p in sorted(self.folder.glob(f"{plan_id}.*.approval"))]
        if not found:
            raise GateError("not_found: approval")
        r = max(found, key=lambda x: x.issued_at)
        if r.revoked or r.plan_id != plan_id or r.target_id != target_id or r.scopes != scopes or not r.issued_at - SKEW_S <= now < r.expires_at:
            raise GateError("unsafe: approval doesn't hold")
        return r
