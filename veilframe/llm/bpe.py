"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The driver compiles frequent words with their id sequences into a minimal acyclic automaton
(equal suffixes share states). Each edge carries how many words sort before it, so a walk
gives a word's number, and that number points into an array of output ids. The arrays lie in one
file that Spark sends to every node once and that all Python workers there memory-map.
Words outside the lexicon are merged exactly, by the tokenizer's ranks; a worker remembers results
in a bounded cache. The lexicon only saves time: ids are the same with any lexicon.

The default lexicon holds the tokenizer's own frequent words, those vocabulary entries that are one
whole word of its pattern; ``words`` adds more (``frequent_words`` counts them over all documents).

Defined results: null text encodes as empty text (0 ids); every whole text is encoded; the special
token's string in a text is that token, as the tokenizers library has it; repeated rows give
repeated rows; empty tables give empty tables; the other input columns are dropped.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, ship

CACHE_WORDS = 300_000
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# ---------------------------------------------------------------- words of a text

# The pattern of byte-level BPE, with white space as Unicode has it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: For Latin texts without the number signs that \w takes for letters.
_LATIN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_LATIN = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")
_full = None


def words_of(text: str) -> list[str]:
    if text.isascii():
        return _ASCII.findall(text)
    if not _NOT_LATIN.search(text):
        return _LATIN.findall(text)
    global _full
    if _full is None:
        import regex

        _full = regex.compile(_PATTERN)
    return _full.findall(text)


# ---------------------------------------------------------------- the automaton


def compile_lexicon(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted words: states equal in finality and edges are one."""
    register: dict[tuple, int] = {}
    finals: list[int] = []
    edges: list[tuple[tuple[int, int], ...]] = []
    counts: list[int] = []

    def frozen(final: bool, out: list[tuple[int, int]]) -> int:
        key = (final, tuple(out))
        if (at := register.get(key)) is None:
            at = register[key] = len(finals)
            finals.append(int(final))
            edges.append(key[1])
            counts.append(final + sum(counts[t] for _, t in out))
        return at

    path: list[list] = [[False, []]]  # open states along the last word: finality, frozen edges
    last = b""
    words = sorted(entries)
    for w in [*words, None]:
        same = 0 if w is None else len(os.path.commonprefix([last, w]))
        for depth in range(len(last), same, -1):
            final, out = path.pop()
            path[-1][1].append((last[depth - 1], frozen(final, out)))
        if w is None:
            break
        path.extend([False, []] for _ in w[same:])
        path[-1][0] = True
        last = w
    root = frozen(*path[0])
    keys, targets, before = [], [], []
    for s, out in enumerate(edges):
        n = finals[s]
        for b, t in out:
            keys.append(s << 8 | b)
            targets.append(t)
            before.append(n)
            n += counts[t]
    ids = [entries[w] for w in words]
    return {
        "root": np.array([root], np.int64), "final": np.array(finals, np.uint8), "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int64), "before": np.array(before, np.int64),
        "out_at": np.cumsum([0, *map(len, ids)]).astype(np.int64), "out": np.array([i for x in ids for i in x], "<u4"),
    }


def look_up(lex: dict[str, np.ndarray], words: list[bytes]) -> list[bytes | None]:
    """Walk all words through the automaton at once; the ids' bytes, or None for unseen words."""
    n = len(words)
    if not n or not len(lex["keys"]):
        return [None] * n
    length = np.fromiter(map(len, words), np.int64, n)
    text = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(length) - length
    state, number = np.full(n, int(lex["root"][0])), np.zeros(n, np.int64)
    alive = np.flatnonzero(length > 0)
    lost = np.zeros(n, bool)
    step = 0
    while len(alive):
        key = state[alive] << 8 | text[start[alive] + step]
        at = np.minimum(np.searchsorted(lex["keys"], key), len(lex["keys"]) - 1)
        ok = lex["keys"][at] == key
        lost[alive[~ok]] = True
        alive, at = alive[ok], at[ok]
        number[alive] += lex["before"][at]
        state[alive] = lex["targets"][at]
        step += 1
        alive = alive[length[alive] > step]
    found = ~lost & (lex["final"][state] == 1)
    out, at = lex["out"], lex["out_at"]
    return [out[at[k] : at[k + 1]].tobytes() if f else None for f, k in zip(found.tolist(), number.tolist(), strict=True)]


# ---------------------------------------------------------------- exact merging


def merge(symbols: list[int], ranks: dict[int, int]) -> list[int]:
    """Merge the lowest-ranked pair, the leftmost first, until none is left."""
    if len(symbols) > 48:
        return _merge_long(symbols, ranks)
    ids = symbols
    none = 1 << 62
    get = ranks.get
    got = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
    while got:
        best = min(got)
        if best == none:
            break
        i = got.index(best)
        ids[i : i + 2] = [best & 0xFFFFF]
        del got[i]
        if i:
            got[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
        if i < len(got):
            got[i] = get(ids[i] << 20 | ids[i + 1], none)
    return ids


def _merge_long(ids: list[int], ranks: dict[int, int]) -> list[int]:
    n = len(ids)
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = r & 0xFFFFF, -1
        k = after[i] = after[j]
        if k < n:
            prior[k] = i
        for x, y in ((prior[i], i), (i, k)):
            if x >= 0 and y < n and (q := ranks.get(ids[x] << 20 | ids[y])) is not None:
                heapq.heappush(heap, (q, x, ids[x], ids[y]))
    return [x for x in ids if x >= 0]


# ---------------------------------------------------------------- building and loading


def build(tokenizer: str, words: Iterable[str] = ()) -> str:
    """Compile a tokenizers file and a lexicon into one file of arrays; its path."""
    j = json.load(open(tokenizer, encoding="utf-8"))
    alphabet = byte_alphabet()
    vocab = {w: i for w, i in j["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in j["added_tokens"]}
    as_bytes = {i: bytes(alphabet[c] for c in w) for w, i in vocab.items() if all(c in alphabet for c in w)}
    pairs = []
    for m in j["model"]["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        pairs.append((vocab[a], vocab[b], vocab[a + b]))
    first = np.zeros(256, np.int64)
    for c, b in alphabet.items():
        first[b] = vocab[c]
    ranks = {a << 20 | b: k << 20 | c for k, (a, b, c) in reversed(list(enumerate(pairs)))}
    entries: dict[bytes, list[int]] = {}
    for w in [*(x.decode("utf-8", "replace") for x in as_bytes.values()), *words]:
        if w and "�" not in w and words_of(w) == [w]:
            entries[w.encode()] = merge([int(first[b]) for b in w.encode()], ranks)
    size = 1 + max([*as_bytes, *special.values()])
    table = [as_bytes.get(i, b"") for i in range(size)]
    for s, i in special.items():
        table[i] = s.encode()
    arrays = compile_lexicon(entries) | {
        "pairs": np.array(pairs, np.int64), "first": first, "token_at": np.cumsum([0, *map(len, table)]).astype(np.int64), "tokens": np.frombuffer(b"".join(table), np.uint8),
        "special": np.frombuffer(json.dumps(special).encode(), np.uint8),
    }
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [at, str(a.dtype), list(a.shape)]
        at += (a.nbytes + 63) // 64 * 64
    top = json.dumps(head).encode()
    blob = len(top).to_bytes(8, "little") + top
    blob += bytes(-len(blob) % 64)
    body = b"".join(a.tobytes() + bytes(-a.nbytes % 64) for a in arrays.values())
    path = f"{tempfile.mkdtemp()}/bpe_{hashlib.sha256(blob + body).hexdigest()[:24]}.bin"
    with open(path, "wb") as f:
        f.write(blob + body)
    return path


def load(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        n = int.from_bytes(f.read(8), "little")
        head = json.loads(f.read(n))
    base = (8 + n + 63) // 64 * 64
    return {k: np.memmap(path, dt, "r", base + at, tuple(shape)) if np.prod(shape) else np.zeros(shape, dt) for k, (at, dt, shape) in head.items()}


class Codec:
    """A worker's view of a compiled file."""

    def __init__(self, path: str):
        a = load(path)
        self.lex = {k: np.asarray(a[k]) for k in ("root", "final", "keys", "targets", "before", "out_at", "out")}
        self.ranks = {}
        for k, (x, y, z) in reversed(list(enumerate(a["pairs"].tolist()))):
            self.ranks[x << 20 | y] = k << 20 | z
        self.first = a["first"].tolist()
        at, raw = a["token_at"].tolist(), a["tokens"].tobytes()
        self.tokens = [raw[i:j] for i, j in zip(at, at[1:])]
        self.special = json.loads(bytes(a["special"]))
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.special_ids = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        new = list(words)
        raw = [w.encode() for w in new]
        first = self.first
        for w, r, ids in zip(new, raw, look_up(self.lex, raw), strict=True):
            self.known[w] = np.array(merge([first[b] for b in r], self.ranks), "<u4").tobytes() if ids is None else ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        cut = []
        for t in texts:
            if self.split and any(s in t for s in self.special):
                cut.append([(p, None) if p in self.special else (None, words_of(p)) for p in self.split.split(t) if p])
            else:
                cut.append([(None, words_of(t))])
        known = self.known
        missing = {w for c in cut for s, ws in c if s is None for w in ws if w not in known}
        if len(known) + len(missing) > CACHE_WORDS:
            known.clear()
            missing = {w for c in cut for s, ws in c if s is None for w in ws}
        self._learn(missing)
        get = known.__getitem__
        return [b"".join(self.special_ids[s] if ws is None else b"".join(map(get, ws)) for s, ws in c) for c in cut]

    def decode(self, ids: bytes) -> str:
        get = self.tokens.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def _codec(name: str) -> Codec:
    if name not in _codecs:
        _codecs[name] = Codec(SparkFiles.get(name))
    return _codecs[name]


def _slices(column: pa.ChunkedArray | pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Texts of about so many bytes at a time, whole; the number of the first."""
    size = np.asarray(pc.binary_length(column).fill_null(0))
    block = np.cumsum(size) // most
    for k in np.unique(block):
        at = np.flatnonzero(block == k)
        yield int(at[0]), [t or "" for t in column.slice(int(at[0]), len(at)).to_pylist()]


def round_trip(docs: DataFrame, tokenizer: str, words: Iterable[str] = ()) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the text decoded from the ids."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    path = build(tokenizer, words)
    name = os.path.basename(path)
    sent = spark.sparkContext.__dict__.setdefault("_veilframe_files", set())
    if name not in sent:  # the name holds the content's hash; Spark refuses a name from two paths
        spark.sparkContext.addFile(path)
        sent.add(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for b in batches:
            for at, texts in _slices(b.column(1)):
                ids = codec.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def frequent_words(docs: DataFrame, top: int = 50_000) -> list[str]:
    """The most frequent blank-led words, counted over all documents.

    At most ``top`` words reach the driver, from however many tasks: the least count that keeps so few is read
    off a histogram of counts (some thousand steps of a few per cent) before any word moves. Which words
    are in the lexicon makes encoding faster or slower, never different."""
    w = docs.select(F.explode(F.split(F.coalesce(docs["text"].cast("string"), F.lit("")), " ")).alias("w")).where(F.length("w").between(1, 64))
    counts = materialize(w.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w", F.floor(F.log(F.col("c")) * 32).cast("int").alias("step")), "word_counts")
    room, least = top, None
    for step, n in sorted(((r["step"], r["count"]) for r in counts.groupBy("step").count().collect()), reverse=True):
        if n > room:
            break
        room, least = room - n, step
    rows = [] if least is None else counts.where(F.col("step") >= least).select("w").collect()
    release(docs.sparkSession, counts)
    return [p for r in sorted(rows) for p in words_of(f" {r['w']}")]
