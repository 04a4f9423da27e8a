"""Secret scans with a recursive decoding worklist.

The whole text is scanned by the base patterns. Then a worklist unwraps layers: percent-encoded characters,
\\uXXXX and \\xXX escapes (both decoded within all that a find may consist of around them), base64 (standard and
URL-safe, also beside other characters, also broken into lines) and, inside base64, gzip, zlib or bzip2 data.
Each decoded layer is scanned again and searched for further layers, until nothing new appears; a
layer with the content and the origin of one seen before isn't unwrapped again, which ends cycles (equal
content from elsewhere is: each occurrence has its own spans and counts as a layer). Each layer knows, for
each of its characters, the span of the original text it stems from, so a find in a layer
is reported as a span of the original text. Base finds always stay.

Defined results: null text counts as empty text; every whole text is scanned; repeated rows give
repeated results; an empty table gives an empty table. Layers that aren't UTF-8 are read byte by byte;
``n_layers`` counts the encoded words of those that are text or hold a find. Compressed data is unfolded with all its members
and what follows them. If it is more than ``MAX_LAYER`` bytes, it is scanned in overlapping parts and
counted in ``n_oversize``: only an encoded run longer than the overlap may be cut at a part's edge.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

KINDS = ("assign", "access", "hex")
MAX_LAYER = 64 << 20
STEP = 1 << 16
MIN_BASE64 = 16

# The base patterns.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What every assignment must hold; a cheap test that spares most texts the slow pattern.
_HINT = re.compile(r"[:=]")

#: What a find may consist of before and after it is decoded; an encoded character is decoded in its whole run,
#: so a find that is encoded only in part is seen too.
#: Lines that may be one base64 run stay together.
_RUN = re.compile(r"""[A-Za-z0-9_.~+/=:%\\"'\x20-]+(?:(?<=[A-Za-z0-9+/_%\\-]{16})\r?\n(?=[A-Za-z0-9+/_%\\-]{4})[A-Za-z0-9_.~+/=:%\\"'\x20-]+)*""")
_ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_BASE64)
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:\r?\n[A-Za-z0-9+/_-]{4,}+)+={0,2}" % MIN_BASE64)
_SIGN = re.compile(r"[/_-]")
_ONE_PERCENT = re.compile(r"%([0-9A-Fa-f]{2})")
_ENCODED = re.compile("|".join(f"(?:{p.pattern})" for p in (_ONE_PERCENT, _ONE_ESCAPE, _BASE64)))

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """The base finds of one layer, by start, then kind."""
    out: list[Span] = []
    if _HINT.search(text):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class Layer:
    """A decoded text and, for runs of its characters, where they stem from in the original text."""

    def __init__(self, text: str, starts: list[int], begin: list[int], end: list[int], linear: bool = False):
        self.text, self.starts, self.begin, self.end, self.linear = text, starts, begin, end, linear
        self.oversize = False
        self.tokens = 1  #: encoded words that it was decoded from

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Of characters i to j (exclusive)."""
        if self.linear:
            return i, j
        a, b = bisect_right(self.starts, i) - 1, bisect_right(self.starts, j - 1) - 1
        return self.begin[a], self.end[b]

    def origin(self) -> tuple:
        return tuple(map(tuple, (self.starts, self.begin, self.end)))


def _layer(pieces: list[tuple[bytes, int, int]], up: Layer) -> Layer | None:
    """A layer from bytes and the spans of the layer above that they came from; what isn't UTF-8 is read byte by byte."""
    if not (raw := b"".join(p for p, _, _ in pieces)):
        return None
    text, wide = _text(raw)
    if len(pieces) == 1:
        b, e = up.span(*pieces[0][1:])
        return Layer(text, [0], [b], [e])
    at_byte, starts, begin, end = 0, [], [], []
    owner: list[int] = []
    for k, (p, _, _) in enumerate(pieces):
        owner.extend([k] * len(p))
    for i, ch in enumerate(text):
        size = len(ch.encode()) if wide else 1
        a, b = pieces[owner[at_byte]], pieces[owner[at_byte + size - 1]]
        s = up.span(a[1], b[2])
        if not starts or (begin[-1], end[-1]) != s:
            starts.append(i)
            begin.append(s[0])
            end.append(s[1])
        at_byte += size
    return Layer(text, starts, begin, end)


def _text(raw: bytes) -> tuple[str, bool]:
    """Text, and whether it is UTF-8."""
    try:
        return raw.decode("utf-8"), True
    except UnicodeDecodeError:
        return raw.decode("latin-1"), False


def _readable(text: str) -> bool:
    return sum(c.isprintable() or c in "\t\n\r" for c in text) >= 0.95 * len(text)


_MAGIC = {b"\x1f\x8b": lambda: zlib.decompressobj(31), b"\x78": lambda: zlib.decompressobj(15), b"BZh": bz2.BZ2Decompressor}
#: What tells compressed data from chance, wherever it starts.
_INSIDE = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY")


def _next(data: bytes, at: int) -> int:
    return m.start() if (m := _INSIDE.search(data, at)) else len(data)


def _packed(data: bytes) -> bool:
    return data.startswith(tuple(_MAGIC)) or _next(data, 0) < len(data)


def _members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Unfolded bytes of all members, beside or after other bytes; bytes that can't be unfolded come as they are."""
    d = None
    for data in chunks:
        while data:
            if d is None:
                if (make := next((m for magic, m in _MAGIC.items() if data.startswith(magic)), None)) is None:
                    at = _next(data, 1)
                    yield data[:at]
                    data = data[at:]
                    continue
                d = make()
            try:
                out = d.decompress(data, STEP)
            except (zlib.error, OSError, EOFError, ValueError):
                d, at = None, _next(data, 1)
                yield data[:at]
                data = data[at:]
                continue
            while True:
                if out:
                    yield out
                if d.eof:
                    data, d = d.unused_data, None
                    break
                data = getattr(d, "unconsumed_tail", b"")
                if len(out) < STEP and not data:
                    break
                try:
                    out = d.decompress(data, STEP)
                except (zlib.error, OSError, EOFError, ValueError):
                    d, at = None, _next(data, 1) if data else 0
                    yield data[:at]
                    data = data[at:]
                    break


def _unfold(raw: bytes) -> tuple[Iterable[bytes], bool]:
    """The innermost bytes of compressed data, and whether they are too many for one layer."""
    seen: set[bytes] = set()
    data = raw
    while _packed(data) and data not in seen:  # compressed data inside compressed data
        seen.add(data)
        stream, got = _members([data]), bytearray()
        for c in stream:
            got += c
            if len(got) > MAX_LAYER:
                break
        else:
            data = bytes(got)
            continue
        head, heads, stream = bytes(got), set(), chain([bytes(got)], stream)
        while _packed(head) and head not in heads:
            heads.add(head)
            stream = _members(stream)
            head = next(stream, b"")
            stream = chain([head], stream)
        return stream, True
    return [data], False


def _parts(stream: Iterable[bytes]) -> Iterator[bytes]:
    """The stream in parts of MAX_LAYER bytes that overlap by a sixteenth."""
    held, fresh = bytearray(), False
    for c in stream:
        held += c
        fresh = True
        while len(held) > MAX_LAYER:
            yield bytes(held[:MAX_LAYER])
            del held[: MAX_LAYER - MAX_LAYER // 16]
    if fresh:
        yield bytes(held)


def _decoded_base64(token: str) -> bytes:
    """The token's bytes; a character too many at its end is left out."""
    body = token.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4))


class Based(Layer):
    """A layer whose byte i stems from the characters at 8 i / 6 of a run; places are computed, not kept."""

    def __init__(self, raw: bytes, at: Sequence[int], up: Layer):
        text, self.wide = _text(raw)
        super().__init__(text, [], [], [])
        self.at, self.up = at, up

    def span(self, i: int, j: int) -> tuple[int, int]:
        size = (lambda x: len(x.encode())) if self.wide else len
        a = size(self.text[:i])
        b = a + size(self.text[i:j]) - 1
        return self.up.span(self.at[a * 8 // 6], self.at[(b * 8 + 7) // 6] + 1)

    def origin(self) -> tuple:
        return ("base64", *self.up.span(self.at[0], self.at[-1] + 1), len(self.at))


def _runs(text: str) -> Iterator[tuple[str, Sequence[int]]]:
    """What may be base64, with the place of each character: runs, and lines of runs as one."""
    for m in _BASE64.finditer(text):
        yield m[0], range(m.start(), m.end())
    if "\n" in text:
        for m in _LINES.finditer(text):
            at = [i for i, c in enumerate(m[0], m.start()) if c not in "\r\n"]
            yield "".join(text[i] for i in at), at


def _based(run: str, at: Sequence[int], up: Layer) -> Iterator[Layer]:
    """The layers of a run. Encoded data may start anywhere in it, behind other characters: each of the four
    alignments shows what starts at any of its places, but for compressed data without a strong mark, which is
    looked for at the run's start and behind each sign that may be a separator."""
    weak = {0}
    for m in _SIGN.finditer(run, 0, max(0, len(run) - MIN_BASE64)):
        if _zlib(run[m.end() : m.end() + 4]):
            weak.add(m.end())
    for k in sorted({*range(min(4, len(run) - MIN_BASE64 + 1)), *weak}):
        raw, places = _decoded_base64(run[k:]), at[k:]
        start = 0 if k in weak and raw.startswith(tuple(_MAGIC)) else _next(raw, 0)
        if start < len(raw):
            inner, big = _unfold(raw[start:])
            if big or inner != [raw[start:]]:
                for part in _parts(inner):
                    if got := _layer([(part, places[start * 8 // 6], places[-1] + 1)], up):
                        got.oversize, big = big, False
                        yield got
                raw = raw[:start]  # what comes before is read as it is
        if k < 4 and raw:
            got = Based(raw, places, up)
            if k == 0 and _readable(got.text) or scan(got.text) or _ENCODED.search(got.text):  # else there is nothing in it
                yield got


def _zlib(start: str) -> bool:
    head = _decoded_base64(start)
    return head[:1] == b"\x78" and int.from_bytes(head[:2], "big") % 31 == 0


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers directly inside."""
    text = layer.text
    if "%" in text:
        for m in _RUN.finditer(text):
            if not _ONE_PERCENT.search(m[0]):
                continue
            pieces, at = [], m.start()
            for e in _ONE_PERCENT.finditer(m[0]):
                s = m.start() + e.start()
                pieces += [(c.encode(), i, i + 1) for i, c in enumerate(text[at:s], at)]
                pieces.append((bytes([int(e[1], 16)]), s, s + 3))
                at = s + 3
            pieces += [(c.encode(), i, i + 1) for i, c in enumerate(text[at : m.end()], at)]
            if got := _layer(pieces, layer):
                got.tokens = _tokens(_ONE_PERCENT, m[0])
                yield got
    if "\\" in text:
        for m in _RUN.finditer(text):
            if not _ONE_ESCAPE.search(m[0]):
                continue
            units, at = [], m.start()
            for e in _ONE_ESCAPE.finditer(m[0]):
                s, t = m.start() + e.start(), m.start() + e.end()
                units += [(c, i, i + 1) for i, c in enumerate(text[at:s], at)]
                c = chr(int(e[1] or e[2], 16))
                if units and "\ud800" <= units[-1][0] < "\udc00" <= c < "":  # a pair of surrogates
                    high, begin, _ = units.pop()
                    c, s = chr(0x10000 + ((ord(high) & 0x3FF) << 10 | ord(c) & 0x3FF)), begin
                units.append((c, s, t))
                at = t
            units += [(c, i, i + 1) for i, c in enumerate(text[at : m.end()], at)]
            if got := _layer([(c.encode("utf-8", "replace"), i, j) for c, i, j in units], layer):
                got.tokens = _tokens(_ONE_ESCAPE, m[0])
                yield got
    for run, at in _runs(text):
        yield from _based(run, at, layer)


def _tokens(encoded: re.Pattern, run: str) -> int:
    return sum(encoded.search(w) is not None for w in run.split())


def find(text: str) -> tuple[list[Span], list[Span], int, int]:
    """Base finds; all finds; layers that are text or hold a find; layers too large for one piece."""
    base = scan(text)
    found, layers, oversize = set(base), 0, 0
    seen: set[tuple] = set()
    finds: dict[str, list[Span]] = {text: base}
    work = [unwrap(Layer(text, [], [], [], linear=True))]
    while work:
        if (x := next(work[-1], None)) is None:
            work.pop()
            continue
        oversize += x.oversize
        short = len(x.text) <= STEP
        known = (x.text if short else hashlib.blake2b(x.text.encode("utf-8", "replace")).digest(), x.origin())
        if known in seen:
            continue
        seen.add(known)
        if (got := finds.get(x.text)) is None:
            got = scan(x.text)
            if short:
                finds[x.text] = got
        layers += x.tokens * (bool(got) or _readable(x.text))
        found.update((k, *x.span(i, j)) for k, i, j in got)
        work.append(unwrap(x))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted(found, key=order), layers, oversize


SCHEMA = "doc_id long, base string, spans string, n_assign long, n_access long, n_hex long, n_layers long, n_oversize long"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: base finds and all finds as kind:start:end lists, base counts, layers."""
    ship(docs.sparkSession)

    def row(text: str | None) -> tuple:
        base, found, layers, oversize = find(text or "")
        said = lambda spans: ",".join(f"{k}:{i}:{j}" for k, i, j in spans)
        return said(base), said(found), *(sum(s[0] == k for s in base) for k in KINDS), layers, oversize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [row(t) for t in b.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.string()] * 2 + [pa.int64()] * 5, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
