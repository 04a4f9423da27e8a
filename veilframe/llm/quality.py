"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

1. Statistics of every whole text (one pass over the texts; a few dozen numbers a document).
2. They are standardised over all documents and mapped to D random cosines, which approximate a
   Gaussian kernel.
3. Every partition sums its part of the normal equations over the labelled training rows; sums of
   partitions are added up in groups, and the driver solves one D x D system.
4. Scores of training rows that the ridge didn't see are counted in bins, and pool-adjacent-violators
   turns them into a monotone map to probabilities.

Training rows are those whose crc32(doc_id as text) mod 5 isn't 0 (``hold``); of them remainder 4
calibrates. Labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts have all-zero statistics and get a score; a repeated row is
scored again; labels that are null are left out; without any labelled training row every score is
0.5; an empty table gives an empty table; other input columns pass through ``classify`` untouched.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, fresh, keyed, materialize, release, ship

#: Byte classes whose shares are features; fixed values.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".", b",", b"!", b"?", b"#*$%&", b"|", b"<>{}[]=+\\", b"'\"", b":;-()/", bytes(range(128, 256)),
)
_MASK = np.array([[c in k for k in CLASSES] for c in range(256)], float)
N_FEATURES = len(CLASSES) + 14


@dataclass(frozen=True)
class Config:
    dims: int = 256  #: random cosines
    gamma: float = 0.5  #: kernel width over standardised statistics: exp(-gamma |x - y|^2 / features)
    ridge: float = 1.0
    seed: int = 7
    bins: int = 1000  #: of raw scores, for the calibration
    hold: int = 5


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist / len(raw)
    seen = share[share > 0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    count = Counter(words)
    windows = list(zip(words, words[1:], words[2:]))
    ends = Counter(w[-1] for w in words)
    letters = max(1.0, float(hist @ _MASK[:, 0] + hist @ _MASK[:, 1]))
    return [
        *(share @ _MASK).tolist(),
        float(np.log1p(n)), float(np.log1p(len(lines))), (len(raw) - hist[32] - hist[10]) / n / 10, len(count) / n ** 0.8,
        max(count.values()) / n, sum(map(operator.eq, words, words[1:])) / n, 1 - len(set(windows)) / max(1, len(windows)), 1 - len(set(lines)) / len(lines),
        sum(map(bytes.isupper, words)) / n, float(hist @ _MASK[:, 1]) / letters, float(-(seen * np.log2(seen)).sum()) / 8, min(1.0, max(map(len, words)) / 100),
        sum(v for k, v in ends.items() if k in b"#*$%&!|") / n, float(np.log1p(n / len(lines))),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, th (which tells texts of one doc_id apart) and the text's statistics, x."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t or "") for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "th", "x"])

    return docs.select(*keyed(docs), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, th long, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  #: of the cosines
    config: Config
    at: np.ndarray  #: raw scores
    value: np.ndarray  #: calibrated scores there

    def cosines(self, x: np.ndarray) -> np.ndarray:
        c = self.config
        r = np.random.default_rng(c.seed)
        w = r.normal(size=(N_FEATURES, c.dims - 1)) * np.sqrt(2 * c.gamma / N_FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ w + r.uniform(0, 2 * np.pi, c.dims - 1)
        return np.hstack([np.cos(z) * np.sqrt(2 / (c.dims - 1)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.at, self.value)


def pool_adjacent_violators(n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted isotonic regression of the means y/n, by merging neighbours that fall."""
    blocks: list[list[float]] = []
    for k, (w, s) in enumerate(zip(n.tolist(), y.tolist(), strict=True)):
        blocks.append([w, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, c2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + s2, blocks[-1][2] + c2]
    return np.concatenate([np.full(int(c), s / w) for w, s, c in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", config: Config = Config()) -> Model | None:
    """Fit on all labelled training rows; what reaches the driver is bounded by dims, groups and bins."""
    one = stats.agg(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(N_FEATURES) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if one["m0"] is None:
        return None
    scale = np.array([one[f"s{i}"] for i in range(N_FEATURES)])
    model = Model(np.array([one[f"m{i}"] for i in range(N_FEATURES)]), np.where(scale > 1e-9, scale, 1.0), np.zeros(config.dims), config, np.zeros(1), np.zeros(1))
    rest = F.crc32(F.col("doc_id").cast("string")) % config.hold
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (rest != 0))
    rows = materialize(stats.join(known, "doc_id").select("x", "y", (rest == config.hold - 1).alias("calibrates")), "quality_rows")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((config.dims, config.dims + 1))
        for b in batches:
            z = model.cosines(_matrix(b.column(0)))
            total += z.T @ np.hstack([z, b.column(1).to_numpy()[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(config.dims * (config.dims + 1)), 0
        for b in batches:
            for m in b.column(0).to_pylist():
                total, n = total + np.frombuffer(m), n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = rows.where(~F.col("calibrates")).select("x", "y").mapInArrow(sums, "m binary").repartition(8).mapInArrow(added, "m binary").collect()
    total = sum((np.frombuffer(bytes(r["m"])) for r in parts), np.zeros(config.dims * (config.dims + 1))).reshape(config.dims, -1)
    if not total[-1, -2]:
        return None
    model.weights = np.linalg.solve(total[:, :-1] + config.ridge * np.eye(config.dims), total[:, -1])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.clip(model.raw(_matrix(b.column(0))), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(r * config.bins).astype(np.int64)), b.column(1)], ["bin", "y"])

    seen = rows.where("calibrates").select("x", "y")
    binned = seen.mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    release(rows.sparkSession, rows)
    if not binned:  # too few rows for a calibration of their own
        model.at, model.value = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    # two pseudo-rows, one of either label, at the ends keep the map off exact 0 and 1
    model.at = np.array([-0.5, *[r["bin"] / config.bins for r in binned], 1.5])
    model.value = pool_adjacent_violators(np.array([1, *[r["n"] for r in binned], 1.0]), np.array([0, *[r["y"] for r in binned], 1.0]))
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", config: Config = Config()) -> DataFrame:
    """doc_id, held_out, score."""
    stats = materialize(document_statistics(docs), "quality_stats")
    model = fit(stats, labels, label, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.full(b.num_rows, 0.5) if model is None else model.score(_matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % config.hold == 0, F.lit(False))
    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, config: Config = Config()) -> DataFrame:
    """The rows of docs whose score is at least ``least``, all columns as they were, whatever their names.

    The statistics of each text are computed once; the rows that go are told by doc_id (which may be null) and
    by their text's hash. Null and empty texts are scored like others, repeated rows go or stay together,
    and without labels all rows stay."""
    stats = materialize(document_statistics(docs), "quality_stats")
    model = fit(stats, labels, "quality", config)
    if model is None:
        release(docs.sparkSession, stats)
        return docs
    doc_id, th = fresh("rejected_id", docs), fresh("rejected_th", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = model.score(_matrix(b.column(2))) < least if b.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], [doc_id, th]).filter(pa.array(bad))

    rejected = materialize(stats.mapInArrow(run, f"`{doc_id}` long, `{th}` long").distinct(), "rejected")
    release(docs.sparkSession, stats)
    few = F.broadcast(rejected) if rejected.count() <= BROADCAST_IDS else rejected
    at, hashed = keyed(docs)
    return docs.join(few, at.eqNullSafe(F.col(doc_id)) & (hashed == F.col(th)), "left_anti")
