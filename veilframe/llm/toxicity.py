"""Toxicity: a noisy channel undoes disguised spelling, then the restored text is scored.

1. A character trigram model is counted over all documents (each partition adds up one array).
2. Tokens that look disguised (any sign or digit among letters, a letter twice or more in a row, single
   characters with any white space between) and the parts of such tokens between separators become a lattice: each character stands for itself, for the letters that it
   may replace, for nothing (separators), and a run of one letter for one or two. Viterbi
   decoding under the character model finds the likeliest spellings. Tokens over ``PIECE`` characters
   are decoded in overlapping pieces, and all shorter words in those count.
3. Words of the restored text and their beginnings get log-odds weights from a bounded sample of
   ``sample`` labelled training rows. Weights of one half of it, applied to the other, fit the
   logistic curve over a document's strongest words, so the curve knows how far weights hold.

Labels are read only for rows whose crc32(doc_id as text) mod 3 isn't 1. Labels, lang, source and
doc_id are never inputs of a score; the length of a document doesn't change it.

Defined results: null and empty texts score as texts without words; each whole text is read; repeated
rows are scored again; null labels are left out; without labels every score is 0.5; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

# What signs and digits may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "^": "a",
}
SEPARATORS = frozenset(".-_*~'`,:;/\\·•#%&=​­")
PUNCTUATION = ".,;:!?\"'()[]{}*#%&$<>|/\\_-~`+=«»…“”„’‘"
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
RUN = re.compile(r"(\w)\1", re.U)
JOINT = re.compile(r"[\s.,;:?/\\_=&#~-]+")
PIECE = 64  #: characters decoded at once; longer tokens come in pieces that overlap by half
A = 28  #: letters a to z, 26 other letters, 27 a word's edge


def _fold(c: str) -> str:
    return unicodedata.normalize("NFD", c.lower())[:1]


#: Of each Latin-1 byte (others come as '?'), its letter; accents are folded.
_CODE = np.array([ord(f) - 97 if (f := _fold(chr(b))) and "a" <= f <= "z" else 26 if chr(b).isalpha() else 27 for b in range(256)], np.int64)


def count_trigrams(texts: list[str]) -> np.ndarray:
    s = "\n".join(texts)
    c = _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    if len(c) < 3:
        return np.zeros(A**3, np.int64)
    return np.bincount(c[:-2] * (A * A) + c[1:-1] * A + c[2:], minlength=A**3)


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a letter after two, counted over all documents."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(A**3, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                total += count_trigrams([t or "" for t in b.column(0).slice(at, 256).to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(A**3, np.int64), 0
        for b in batches:
            for m in b.column(0).to_pylist():
                total, n = total + np.frombuffer(m, np.int64), n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "m binary").repartition(8).mapInArrow(added, "m binary").collect()
    n = sum((np.frombuffer(bytes(r["m"]), np.int64) for r in rows), np.zeros(A**3, np.int64)).reshape(A, A, A).astype(float)
    unigram = (n.sum((0, 1)) + 1) / (n.sum() + A)
    bigram = (n.sum(0) + 20 * unigram) / (n.sum(0).sum(1, keepdims=True) + 20)
    return np.log((n + 10 * bigram[None]) / (n.sum(2, keepdims=True) + 10))


# ---------------------------------------------------------------- decoding


class Decoder:
    SWAP, DROP, KEEP = -1.0, -0.5, -6.0  #: costs of a replaced sign, a dropped one, and one left as it is
    BEAM, BEST = 24, 3

    def __init__(self, model: np.ndarray):
        self.p = model.tolist()
        self.decode = lru_cache(200_000)(self._decode)

    def _choices(self, token: str) -> list[list[tuple[str, float]]]:
        """The lattice: for each character or run, what it may stand for."""
        out, i = [], 0
        while i < len(token):
            c, j = token[i], i + 1
            while j < len(token) and token[j] == c:
                j += 1
            if c.isalpha():
                out.append([(c, 0.0), (c + c, 0.0)] if j - i >= 2 else [(c, 0.0)])
            else:
                n = 1 if j - i >= 3 else j - i
                for _ in range(n):
                    own = [(x, self.SWAP) for x in LEET.get(c, "")]
                    own += [("", self.DROP)] if c in SEPARATORS or not own else []
                    out.append([*own, ("\x00", self.KEEP)] if c in LEET else own)
            i = j
        return out

    def _decode(self, token: str) -> tuple[str, ...]:
        """The likeliest spellings, best first: Viterbi over the last two letters, a few paths each."""
        p, edge = self.p, 27
        states: dict[tuple[int, int], list[tuple[float, str]]] = {(edge, edge): [(0.0, "")]}
        for choices in self._choices(token):
            after: dict[tuple[int, int], list[tuple[float, str]]] = {}
            for (a, b), paths in states.items():
                for said, cost in choices:
                    x, y, s = a, b, cost
                    for c in said:
                        f = _fold(c)
                        k = ord(f) - 97 if "a" <= f <= "z" else 26
                        s += p[x][y][k]
                        x, y = y, k
                    after.setdefault((x, y), []).extend((q + s, w + said) for q, w in paths)
            best = sorted(((max(v)[0], k) for k, v in after.items()), reverse=True)[: self.BEAM]
            states = {k: sorted(after[k], reverse=True)[: self.BEST] for _, k in best}
        ends = sorted(((s + p[a][b][edge], w.replace("\x00", "")) for (a, b), v in states.items() for s, w in v), reverse=True)
        return tuple(dict.fromkeys(w for _, w in ends if w))[: self.BEST]


def _core(token: str) -> str:
    t = token.rstrip(PUNCTUATION).lstrip(".,;:?\"'()[]{}*#%&<>/\\_-~`=«»…“”„’‘")
    return t if t[:1] not in "$!|+" or t[1:2].isalpha() else t.lstrip(PUNCTUATION)


_decoders: dict[bytes, Decoder] = {}


def _decoder(characters: np.ndarray) -> Decoder:
    """A worker's decoder for these probabilities; later tasks find what earlier ones have decoded."""
    key = hashlib.blake2b(np.ascontiguousarray(characters).tobytes()).digest()
    if key not in _decoders:
        _decoders.clear()
        _decoders[key] = Decoder(characters)
    return _decoders[key]


def words_of(text: str, decoder: Decoder) -> set[str]:
    """Lower-case words of the restored text; of disguised tokens the likeliest spellings."""
    low = text.lower()
    out: set[str] = set()
    odd: list[str] = []
    long: list[str] = []
    spaced: list[str] = []
    runs = RUN.search(low) is not None
    for t in set(low.split()):
        c = t if t.isalpha() else _core(t)
        if c.isalpha():
            out.add(c)
            if runs and RUN.search(c):
                odd.append(c)
        elif c:
            out.update(x for x in re.split(r"[\W\d_]+", c) if x)
            if any(map(str.isalpha, c)):
                if len(c) <= PIECE:
                    odd.append(c)
                else:
                    long.append(t)
                odd += [x for x in JOINT.split(c) if len(x) <= PIECE and x != c and any(map(str.isalpha, x)) and (not x.isalpha() or RUN.search(x))]
            if t[-1] in "$!|+(" and len(t) <= PIECE and len(t) - len(t.rstrip(PUNCTUATION)) == 1:
                odd.append(t)  # the last sign may be a letter
    for t in odd:
        if sum(map(str.isdigit, t)) <= 0.6 * len(t):
            out.update(decoder.decode(t))
    for m in SPACED.finditer(low):
        spaced.append("".join(m[0].split()))
    for run, least in [*((x, 4) for x in long), *((x, 3) for x in spaced)]:
        for at in range(0, len(run), PIECE // 2):  # overlapping pieces of long runs
            for w in decoder.decode(run[at : at + PIECE]):
                out.add(w)
                out.update(w[i:j] for i in range(len(w)) for j in range(i + least, (len(w) if least == 3 else min(len(w), i + 14)) + 1))
    return out


def features(word: str) -> tuple[str, ...]:
    """A word, and its beginnings, which families of words share."""
    n = len(word)
    return (word, f"{word[:4]}~", f"{word[:5]}~", f"{word[:6]}~") if n > 5 else (word, f"{word[:4]}~") if n > 4 else (word,)


# ---------------------------------------------------------------- learning and scoring


@dataclass(frozen=True)
class Config:
    sample: int = 15_000  #: labelled training rows to learn from, at most about
    words: int = 50_000  #: weights kept, at most
    prior: float = 10.0  #: rows that a word's share of toxic rows is drawn to the mean by
    least: float = 0.3  #: smallest weight (log odds over the mean's) that counts
    top: int = 3  #: strongest words of a document that count
    hold: int = 3
    held: int = 1


@dataclass
class Model:
    characters: np.ndarray
    weights: dict[str, float]
    curve: np.ndarray  #: of the strongest word, the next ones, and a constant
    config: Config = field(default_factory=Config)


def strongest(words: set[str], weights: dict[str, float], config: Config) -> tuple[float, float]:
    """The strongest word's weight, and those of the next ones added up."""
    get = weights.get
    own = sorted((v for w in words if (v := max(get(f, 0.0) for f in features(w))) > 0), reverse=True)[: config.top]
    return (own[0], sum(own[1:])) if own else (0.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a slight pull to 0."""
    z = np.column_stack([x, np.ones(len(x))])
    a = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        g = z.T @ (y - p) - 1e-2 * a
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(a))
        step = np.linalg.solve(h, g)
        a += step
        if abs(step).max() < 1e-8:
            break
    return a


def fit(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Model | None:
    characters = character_model(docs)
    rest = F.crc32(F.col("doc_id").cast("string")) % config.hold
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (rest != config.held))
    n = known.count()
    if not n:
        return None
    step = -(-n // config.sample)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    # about config.sample ids at most, so small enough to broadcast
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(characters)
        for b in batches:
            words = [list(words_of(t or "", decoder)) for t in b.column(1).to_pylist()]
            fold = [hash(i) % 2 for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(fold, pa.int32()), pa.array(words, pa.list_(pa.string()))], ["y", "fold", "words"])

    sample = materialize(rows.mapInArrow(run, "y int, fold int, words array<string>"), "toxicity_sample")
    sizes = {(r["y"], r["fold"]): r["n"] for r in sample.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = sample.select("y", "fold", F.array_distinct(F.flatten(F.transform("words", lambda w: F.array_compact(F.array(w, *[F.when(F.length(w) > k, F.concat(F.substring(w, 1, n), F.lit("~"))) for k, n in ((4, 4), (5, 5), (5, 6))]))))).alias("f"))
    one = lambda y, fold: F.count(F.when((F.col("y") == y) & (F.col("fold") == fold), 1))
    counts = each.select("y", "fold", F.explode("f").alias("f")).groupBy("f").agg(*[one(y, k).alias(f"n{y}{k}") for y in (0, 1) for k in (0, 1)])
    size = lambda y, folds: sum(sizes.get((y, k), 0) for k in folds)

    def weight(folds: tuple[int, ...]):
        n1, n0 = (sum((F.col(f"n{y}{k}") for k in folds), F.lit(0)) for y in (1, 0))
        base = (size(1, folds) + 0.5) / (size(1, folds) + size(0, folds) + 1)
        p = (n1 + config.prior * base) / (n1 + n0 + config.prior)
        return F.log(p / (1 - p)) - math.log(base / (1 - base))

    table = counts.where("n10 + n11 > 0").select("f", *[weight(k).alias(f"w{i}") for i, k in enumerate(((0,), (1,), (0, 1)))])
    table = table.where(F.greatest("w0", "w1", "w2") >= config.least).orderBy(F.desc(F.greatest("w0", "w1", "w2")), "f").limit(config.words).collect()
    half = [{r["f"]: r[f"w{i}"] for r in table if (r[f"w{i}"] or 0) >= config.least} for i in range(3)]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [strongest(set(ws), half[1 - k], config) for k, ws in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([v[i] for v in x], pa.float64()) for i in (0, 1))], ["y", "x0", "x1"])

    seen = sample.mapInArrow(evidence, "y int, x0 double, x1 double").groupBy("y", F.round("x0", 2).alias("x0"), F.round("x1", 2).alias("x1")).count().collect()
    x0, x1, y = (np.repeat([float(r[k]) for r in seen], [r["count"] for r in seen]) for k in ("x0", "x1", "y"))
    x = np.column_stack([x0, x1])
    return Model(characters, half[2], _logistic(x, y), config)


def score_text(text: str, model: Model, decoder: Decoder) -> float:
    x = strongest(words_of(text, decoder), model.weights, model.config)
    z = model.curve[0] * x[0] + model.curve[1] * x[1] + model.curve[2]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, held_out, score."""
    model = fit(docs, labels, config)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded: config.words weights and A^3 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        decoder = _decoder(m.characters) if m else None
        for b in batches:
            s = [score_text(t or "", m, decoder) if m else 0.5 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % config.hold == config.held, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score")
