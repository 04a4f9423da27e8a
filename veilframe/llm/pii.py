"""PII: format-preserving Feistel pseudonyms.

Values are found in the whole text, validated (Luhn, mod 97, calendar, numbering plan, octets) and
replaced by another valid value of the same format. A value is written as a number below the
size N of its format, and a keyed Feistel network P (blake2b rounds, cycle walking) permutes those
numbers. The pseudonym is P^-1(P(x) + 1 mod N): also a keyed permutation, but one that leaves no
value as it is. So equal values get equal pseudonyms in all documents, different values different
ones, and the holder of the key can undo it (``restore``). Separators, case, check digits, an email's
domain, a card's first digit and a phone's country stay; check digits are made anew.

Kinds: email, iban, card, ssn, phone, ip, date. Numbers that fail validation stay.

Defined results: null text stays null and has no finds; every whole text is scanned; repeated rows
give repeated results; empty tables give empty tables; ``pseudonymize`` passes all other columns through.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
#: For tests and queries; an owner of real data passes a secret key.
DEMO_KEY = b"veilframe demonstration key, not secret"
KEY_FILE = "VEILFRAME_KEY_FILE"
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)

# ---------------------------------------------------------------- the permutation


def _feistel(key: bytes, tweak: bytes, n: int, x: int, back: bool) -> int:
    """A keyed permutation of 0..n-1; cycle walking keeps it inside."""
    a = isqrt(n - 1) + 1 if n > 1 else 1
    b = -(-n // a)
    while True:
        left, right = x % a, x // a
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            given, size = (right, a) if r % 2 == 0 else (left, b)
            f = int.from_bytes(hashlib.blake2b(b"%b|%d|%d|%d" % (tweak, n, r, given), key=key, digest_size=64).digest(), "big")
            f = -f if back else f
            if r % 2 == 0:
                left = (left + f) % size
            else:
                right = (right + f) % size
        x = right * a + left
        if x < n:
            return x


def permute(key: bytes, tweak: str, n: int, x: int, step: int = 1) -> int:
    """step 1 makes the pseudonym, step -1 undoes it."""
    if n < 2:
        return x
    t = tweak.encode()
    return _feistel(key, t, n, (_feistel(key, t, n, x, False) + step) % n, True)


Code = tuple[int, int]  # a digit of a mixed-radix number, and its radix


def _permuted(key: bytes, tweak: str, codes: list[Code], step: int) -> list[int]:
    n, x = 1, 0
    for v, radix in codes:
        n, x = n * radix, x * radix + v
    y, out = permute(key, tweak, n, x, step), []
    for _, radix in reversed(codes):
        y, v = divmod(y, radix)
        out.append(v)
    return out[::-1]


# ---------------------------------------------------------------- formats: each returns the pseudonym, or None if the value isn't valid


def luhn(digits: str) -> int:
    """0 if the last digit is right."""
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def _refill(text: str, digits: str) -> str:
    """Put digits, in order, where text has digits."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _email(key: bytes, s: str, step: int) -> str | None:
    local, _, domain = s.rpartition("@")
    kinds = [(c, "a", 26) if "a" <= c <= "z" else (c, "A", 26) if "A" <= c <= "Z" else (c, "0", 10) for c in local if c.isalnum()]
    if not kinds:
        return None
    new = iter(_permuted(key, f"email|{domain.lower()}", [(ord(c) - ord(base), radix) for c, base, radix in kinds], step))
    bases = iter(kinds)
    return "".join(chr(ord(next(bases)[1]) + next(new)) if c.isalnum() else c for c in local) + "@" + domain


def _card(key: bytes, s: str, step: int) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or d[0] == "0" or luhn(d) or len(set(d)) == 1:
        return None
    body = d[0] + "".join(map(str, _permuted(key, f"card|{d[0]}", [(int(c), 10) for c in d[1:-1]], step)))
    return _refill(s, body + str((10 - luhn(body + "0")) % 10))


def _ssn(key: bytes, s: str, step: int) -> str | None:
    a, g, n = map(int, s.split("-"))
    if a in (0, 666) or a >= 900 or not g or not n:
        return None
    a, g, n = _permuted(key, "ssn", [(a - 1 - (a > 666), 898), (g - 1, 99), (n - 1, 9999)], step)
    a += 1
    return f"{a + (a >= 666):03d}-{g + 1:02d}-{n + 1:04d}"


def _phone(key: bytes, s: str, step: int) -> str | None:
    d = re.sub(r"\D", "", s)
    if s.startswith("+") and not (d[0] == "1" and len(d) == 11):
        if not 8 <= len(d) <= 15 or d[0] == "0":
            return None
        return _refill(s, d[:2] + "".join(map(str, _permuted(key, f"phone|{d[:2]}|{len(d)}", [(int(c), 10) for c in d[2:]], step))))
    head, d = d[:-10], d[-10:]
    if head not in ("", "1") or d[0] < "2" or d[3] < "2":
        return None
    codes = [(int(c) - 2, 8) if i in (0, 3) else (int(c), 10) for i, c in enumerate(d)]
    new = _permuted(key, "phone|1", codes, step)
    return _refill(s, head + "".join(str(v + 2 * (i in (0, 3))) for i, v in enumerate(new)))


def _ip(key: bytes, s: str, step: int) -> str | None:
    parts = s.split(".")
    if any(len(p) > 1 and p[0] == "0" or int(p) > 255 for p in parts):
        return None
    return ".".join(map(str, _permuted(key, "ip", [(int(p), 256) for p in parts], step)))


def _date(key: bytes, s: str, step: int) -> str | None:
    sep = next(c for c in s if not c.isdigit())
    p = s.split(sep)
    if len(p[0]) == 4:
        order = (0, 1, 2)
    elif sep == "." or int(p[0]) > 12:
        order = (2, 1, 0)
    else:
        order = (2, 0, 1)
    try:
        day = datetime.date(*(int(p[i]) for i in order))
    except ValueError:
        return None
    n = (LAST_DAY - FIRST_DAY).days + 1
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    # What is written must show its own reading: walk on to the next date that reads the same way.
    short = min(len(p[order[1]]), len(p[order[2]])) == 1
    day_first = order == (2, 1, 0) and sep != "."
    x = (day - FIRST_DAY).days
    while True:
        x = permute(key, "date", n, x, step)
        new = FIRST_DAY + datetime.timedelta(x)
        if (not short or new.day < 10 or new.month < 10) and (not day_first or new.day > 12):
            break
    form = "d" if short else "02d"
    fields = {order[0]: f"{new.year:04d}", order[1]: format(new.month, form), order[2]: format(new.day, form)}
    return sep.join(fields[i] for i in range(3))


def _iban(key: bytes, s: str, step: int) -> str | None:
    d = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(d) <= 34 or number(d[4:] + d[:4]) % 97 != 1:
        return None
    kinds = [("0", 10) if c.isdigit() else ("A", 26) for c in d[4:]]
    new = _permuted(key, f"iban|{d[:2]}", [(ord(c) - ord(b), r) for c, (b, r) in zip(d[4:], kinds, strict=True)], step)
    body = "".join(chr(ord(b) + v) for v, (b, _) in zip(new, kinds, strict=True))
    it = iter(d[:2] + f"{98 - number(body + d[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(it) for c in s)


_FORMATS: dict[str, Callable[[bytes, str, int], str | None]] = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}
_PATTERNS = {
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![A-Za-z0-9_.-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9_-])"),
    "ssn": re.compile(r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])"),
    "phone": re.compile(r"(?<![A-Za-z0-9_+])(?:\+[0-9](?:[ ().-]{0,2}[0-9]){7,14}|(?:1[ .-])?\([2-9][0-9]{2}\)[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}|(?:1[ .-])?[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4})(?![A-Za-z0-9_])"),
    "ip": re.compile(r"(?<![A-Za-z0-9_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9_]|\.[0-9])"),
    "date": re.compile(r"(?<![A-Za-z0-9_])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?!(?![Tt][0-9]{2})[A-Za-z0-9_])"),
}
#: Groups among which a card or an IBAN may lie, with others before or behind it.
_CARD_RUN = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_IBAN_RUN = re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]+(?: [A-Z0-9]+)*(?![A-Za-z0-9])")
_GROUP = re.compile(r"[A-Z0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin and text[begin - 1] in _LOCAL:
            begin -= 1
        local = text[begin:at].lstrip(".%+-")
        domain = _DOMAIN.match(text, at + 1)
        if local and domain and re.search("[A-Za-z0-9]", local):
            yield at - len(local), domain.end() - (domain[0].endswith("-"))
        at = text.find("@", at + 1)


def _card_windows(text: str, usual: bool) -> Iterator[tuple[int, int]]:
    """Stretches of 13 to 19 digits from group to group; usual ones are solid or begin with four digits, then groups of 4 to 6, the last of 3 to 6."""
    for m in _CARD_RUN.finditer(text):
        if m.end() - m.start() < 13:
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        if text[max(0, m.start() - 1) : m.start()] and (text[m.start() - 1].isascii() and text[m.start() - 1].isalnum() or text[m.start() - 1] in "_.-"):
            while groups and (one := groups.pop(0)) and text[one[1] : one[1] + 1] == "-":
                pass
        if text[m.end() : m.end() + 1] and (text[m.end()].isascii() and text[m.end()].isalnum() or text[m.end()] in "_-"):
            while groups and (one := groups.pop()) and text[one[0] - 1 : one[0]] == "-":
                pass
        for a in range(len(groups)):
            digits = 0
            for b in range(a, len(groups)):
                digits += (size := groups[b][1] - groups[b][0])
                if digits > 19 or b > a and text[groups[b][0] - 1] != text[groups[a][1]]:
                    break
                sizes = [j - i for i, j in groups[a : b + 1]]
                shape = a == b or sizes[0] == 4 and all(4 <= x <= 6 for x in sizes[1:-1]) and 3 <= size <= 6
                if digits >= 13 and (shape if usual else not shape and min(sizes) >= 3):
                    yield groups[a][0], groups[b][1]


def _iban_windows(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN_RUN.finditer(text):
        if m.end() - m.start() < 15:
            continue
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        for a, (i, _) in enumerate(groups):
            for _, j in groups[a : a + 10]:
                if j - i >= 15 and _PATTERNS["iban"].fullmatch(text, i, j):
                    yield i, j


def _overlaps(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether one of these spans overlaps i to j."""
    starts, ends = zip(*sorted(spans), strict=True) if spans else ((), ())
    return lambda i, j: (k := bisect_left(starts, j)) > 0 and ends[k - 1] > i


def _claim(text: str, kind: str, windows: Iterator[tuple[int, int]], key: bytes, step: int, out: list[tuple[int, int, str, str]]) -> None:
    """Add the valid windows that overlap nothing in out; leftmost first, of one start the longest."""
    hit, end, tried = _overlaps([s[:2] for s in out]), 0, []
    for i, j in sorted(windows, key=lambda w: (w[0], -w[1])):
        if i < end or hit(i, j):
            continue
        if (new := pseudonym(kind, text[i:j], key, step)) is None:
            tried.append((i, j))
            continue
        # A window that was tried before must stay invalid, or ``restore`` would find that one: walk on.
        tried = [(a, b) for a, b in tried if b > i]
        while any(pseudonym(kind, text[a:i] + new[max(0, a - i) : b - i] + text[j : max(j, b)], key, step) is not None for a, b in tried):
            new = pseudonym(kind, new, key, step)
        out.append((i, j, kind, new))
        end = j


@lru_cache(100_000)
def pseudonym(kind: str, value: str, key: bytes, step: int = 1) -> str | None:
    return _FORMATS[kind](key, value, step)


def find(text: str, key: bytes = DEMO_KEY, step: int = 1) -> list[tuple[int, int, str, str]]:
    """start, end, kind, pseudonym; leftmost first, none overlapping.

    IBANs and cards in their usual groups come first, whatever digits or capitals stand beside them; then of
    all kinds the leftmost, of one start the longest; then what other groups of digits hold a card.
    """
    spans = [(i, j, "email") for i, j in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, p in _PATTERNS.items():
            spans += [(m.start(), m.end(), kind) for m in p.finditer(text)]
    out: list[tuple[int, int, str, str]] = []
    in_email = _overlaps([s[:2] for s in spans if s[2] == "email"])
    free = lambda windows: (w for w in windows if not in_email(*w))
    if _DIGIT.search(text):
        _claim(text, "iban", free(_iban_windows(text)), key, step, out)
        _claim(text, "card", free(_card_windows(text, True)), key, step, out)
    hit, end = _overlaps([s[:2] for s in out]), 0
    for i, j, kind in sorted(spans, key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if i >= end and not hit(i, j) and (new := pseudonym(kind, text[i:j], key, step)) is not None:
            out.append((i, j, kind, new))
            end = j
    if _DIGIT.search(text):
        _claim(text, "card", free(_card_windows(text, False)), key, step, out)
    return sorted(out)


def replace(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for i, j, _, new in found:
        out += [text[at:i], new]
        at = j
    return "".join(out) + text[at:] if out else text


def restore(text: str, key: bytes = DEMO_KEY) -> str:
    """Undo ``replace(text, find(text, key))``."""
    return replace(text, find(text, key, -1))


def key_from_environment() -> bytes:
    """The key in the file that VEILFRAME_KEY_FILE names, read on the driver; DEMO_KEY where it is unset."""
    path = os.environ.get(KEY_FILE)
    if not path:
        return DEMO_KEY
    key = Path(path).read_bytes()
    if len(key) < 32:
        raise ValueError(f"{KEY_FILE}: a key has 32 bytes at least")
    return key


def pseudonymize(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """docs with the values in its column text replaced; n_chars (if there) follows, other columns stay."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if t is None else replace(t, find(t, key)) for t in b.column(at).to_pylist()]
            out = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if size is not None:
                old = b.column(size).to_pylist()
                out = out.set_column(size, b.schema.field(size), pa.array([n if t is None else len(t) for n, t in zip(old, new, strict=True)], b.schema.field(size).type))
            yield out

    return docs.mapInArrow(run, docs.schema)


SCHEMA = "doc_id long, text string, spans string, " + ", ".join(f"n_{k} long" for k in KINDS)


def report(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """Per document: new text, kind:start:end of the finds in the old text, and counts by kind."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [find(t or "", key) for t in texts]
            new = [None if t is None else replace(t, f) for t, f in zip(texts, found, strict=True)]
            spans = [",".join(f"{k}:{i}:{j}" for i, j, k, _ in f) for f in found]
            counts = [pa.array([sum(x[2] == k for x in f) for f in found], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array(spans, pa.string()), *counts], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "CAST(text AS string) text").mapInArrow(run, SCHEMA)
