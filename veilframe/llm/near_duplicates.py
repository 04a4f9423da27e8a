"""MinHash near-duplicate groups with tensored banding.

1. One pass makes each document's shingle set (64-bit hashes of ``words`` consecutive words), the set's
   128-bit fingerprint, and 2 * ``side`` short bands: ``side`` in a first and ``side`` in a second
   collection, of ``rows`` minhashes each. Documents with equal sets are one class from here on.
2. The table keys are all pairs of a band of the first and one of the second collection: side^2 tables
   from 2 * side * rows minhashes, about the square root of what side^2 own bands would take. A band that
   no other set has can't be part of a shared key, so only bands that several sets have are combined.
3. In each bucket the member whose bands most sets share is the pivot; the others are compared with it
   on the full sets. Buckets whose members then lie in one component are done.
4. Members of the other buckets ("open" sets) are compared exactly, across components, by prefixes: their
   shingles are ordered from rare to common, and two sets similar enough share a shingle among the first
   few of each, at places that leave room for the overlap they need. Shingles of one component only can't
   link two, so they come first and are never joined. No bucket is capped and no link between open sets
   is missed; n near copies cost n comparisons with pivots, and sets that only look alike cost none.
5. Components of the confirmed links give each document the smallest doc_id it is linked with.

Two sets of similarity s share a table with probability (1 - (1 - s^rows)^side)^2: at s = 0.8, the
default misses 4 in 10,000 single links, at 0.85 fewer than 1 in 10,000.

Defined results: texts that are null or without words have an empty set and are linked with nothing
(component_id is their own doc_id); with fewer words than a shingle has, the whole sequence is the one
shingle; repeated rows get equal results, so that all or none of them are kept; rows of one doc_id with
different texts are different documents; a null doc_id is never a component's smallest: such a row is kept
only if nothing it is linked with has a doc_id; empty tables give empty tables; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, fresh, keyed, materialize, parts, release, ship
from .components import components

CACHE_WORDS = 200_000


@dataclass(frozen=True)
class MinHash:
    words: int = 5
    percent: int = 80  #: least similarity of linked sets
    side: int = 12  #: bands in each collection
    rows: int = 3  #: minhashes in a band
    seed: int = 3


class _WordHash(dict):
    """64-bit hashes of words; emptied when large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_hash = _WordHash()
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty for a text without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), 1)], np.uint64)
    h = np.fromiter(map(_hash.__getitem__, w), np.uint64, len(w))
    n = len(w) - words + 1
    x = h[:n].copy()
    for k in range(1, words):
        x *= _MIX[0]
        x ^= x >> np.uint64(32)
        x += h[k : k + n]
    x *= _MIX[1]
    x ^= x >> np.uint64(29)
    return np.unique(x)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Bands:
    def __init__(self, config: MinHash):
        r = np.random.default_rng(config.seed)
        n = 2 * config.side * config.rows
        self.config = config
        self.factor = r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = r.integers(0, 1 << 63, n, dtype=np.uint64)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Bands of the first, then of the second collection; each knows its number."""
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(x), 4096):
            y = x[at : at + 4096] * self.factor[:, None] + self.plus[:, None]
            y ^= y >> np.uint64(31)
            y *= _MIX[0]
            least = np.minimum(least, y.min(1))
        c = self.config
        m = least.reshape(2 * c.side, c.rows)
        out = np.arange(1, 2 * c.side + 1, dtype=np.uint64) * _MIX[1]
        for k in range(c.rows):
            out = (out ^ m[:, k]) * _MIX[0]
            out ^= out >> np.uint64(33)
        return out.view(np.int64)


def fingerprint(x: np.ndarray) -> tuple[int, int]:
    h = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64)
    return int(h[0]), int(h[1])


def signatures(docs: DataFrame, config: MinHash) -> DataFrame:
    """doc_id, th, n (set size), h1, h2 (fingerprint of the set), u, v (bands; null for empty sets)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(config)
        for b in batches:
            n, h1, h2, u, v = [], [], [], [], []
            for t in b.column(2).to_pylist():
                x = shingle_set(t or "", config.words)
                y = bands.of(x) if len(x) else None
                n.append(len(x))
                for out, value in zip((h1, h2), fingerprint(x) if len(x) else (None, None), strict=True):
                    out.append(value)
                u.append(None if y is None else y[: config.side])
                v.append(None if y is None else y[config.side :])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (n, h1, h2)), pa.array(u, longs), pa.array(v, longs)], ["doc_id", "th", "n", "h1", "h2", "u", "v"])

    return docs.select(*keyed(docs), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, th long, n long, h1 long, h2 long, u array<long>, v array<long>")


def _by_size(df: DataFrame, n: int) -> DataFrame:
    """Broadcast so many ids only if they are few."""
    return F.broadcast(df) if n <= BROADCAST_IDS else df


def _packed_sets(docs: DataFrame, sets: DataFrame, involved: DataFrame, config: MinHash) -> DataFrame:
    """sid and the compressed text of one document of each involved set, found by doc_id and text hash."""
    wanted = materialize(sets.join(involved, "sid", "left_semi").select("sid", F.col("one.doc_id").alias("wanted_id"), F.col("one.th").alias("wanted_th"), "h1", "h2"), "wanted")
    rows = docs.select(*keyed(docs), docs["text"].cast("string").alias("text"))
    found = rows.join(_by_size(wanted, wanted.count()), F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("th") == F.col("wanted_th")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            sid, packed = [], []
            for s, h1, h2, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if fingerprint(shingle_set(t or "", config.words)) == (h1, h2):
                    sid.append(s)
                    packed.append(z.compress((t or "").encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(packed, pa.binary())], ["sid", "z"])

    out = materialize(found.select("sid", "h1", "h2", "text").mapInArrow(run, "sid long, z binary").groupBy("sid").agg(F.min("z").alias("z")), "packed_sets")  # repeated rows
    release(docs.sparkSession, wanted)
    return out


def _unpacked(z: zstandard.ZstdDecompressor, packed: bytes, words: int) -> np.ndarray:
    return shingle_set(z.decompress(packed).decode("utf-8", "surrogatepass"), words)


def confirmed(pairs: DataFrame, packed: DataFrame, config: MinHash) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        last: tuple[int | None, np.ndarray] = (None, np.zeros(0))
        for b in batches:
            good = []
            for a, za, zb in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if last[0] != a:
                    last = (a, _unpacked(z, za, config.words))
                good.append(similar(last[1], _unpacked(z, zb, config.words), config.percent))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(packed.select(F.col("sid").alias("b"), F.col("z").alias("zb")), "b").join(packed.select(F.col("sid").alias("a"), F.col("z").alias("za")), "a")
    return both.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def buckets(sets: DataFrame) -> DataFrame:
    """key, sid, n, pivot, pn: members of the tables' buckets with several members, and their pivots.

    Counting combines before the shuffle, and the joins back may split a large key, so a bucket that
    holds a third of all sets is no single task's work."""
    bands = sets.select("sid", "n", F.explode(F.concat(F.transform("u", lambda x: F.struct(F.lit(True).alias("first"), x.alias("band"))), F.transform("v", lambda x: F.struct(F.lit(False).alias("first"), x.alias("band"))))).alias("x")).select("sid", "n", "x.first", "x.band")
    shared = bands.groupBy("first", "band").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    side = lambda first: F.collect_list(F.when(F.col("first") == first, F.col("band")))  # noqa: E731  at most config.side
    own = bands.join(shared, ["first", "band"]).groupBy("sid", "n").agg(side(True).alias("u"), side(False).alias("v"), F.sum("c").alias("met"))
    own = materialize(own.where("size(u) > 0 AND size(v) > 0"), "shared_bands")
    keyed = own.repartition(4 * parts(sets.sparkSession), "sid").select("sid", "n", "met", "v", F.explode("u").alias("u")).select("sid", "n", "met", "u", F.explode("v").alias("v")).select(F.xxhash64("u", "v").alias("key"), "sid", "n", "met")
    least = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("met", (-F.col("sid")).alias("minus"), "n")).alias("p")).where("c > 1")
    met = keyed.join(least.select("key", (-F.col("p.minus")).alias("pivot"), F.col("p.n").alias("pn")), "key")
    out = materialize(met.select("key", "sid", "n", "pivot", "pn"), "buckets")
    release(sets.sparkSession, own)
    return out


def open_sets(met: DataFrame, stars: DataFrame) -> DataFrame:
    """sid, comp: the sets of buckets that lie in several components."""
    named = met.select("key", "sid").join(stars.select(F.col("a").alias("sid"), F.col("b").alias("c")), "sid", "left").select("key", "sid", F.coalesce("c", "sid").alias("comp"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return named.join(mixed, "key", "left_semi").select("sid", "comp").distinct()


def prefixes(opened: DataFrame, packed: DataFrame, config: MinHash) -> DataFrame:
    """sid, comp, n, token, i: the shingles that can be the first one of two similar sets of different
    components, and their place (from 0) in the set's order from rare to common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                x = [_unpacked(z, y, config.words) for y in s.column(2).to_pylist()]
                n = np.fromiter(map(len, x), np.int64, len(x))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(s.column(i).to_numpy(), n)) for i in (0, 1)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(x).view(np.int64))], ["sid", "comp", "n", "token"])

    rows = materialize(opened.join(packed, "sid").select("sid", "comp", "z").mapInArrow(run, "sid long, comp long, n long, token long"), "open_shingles")
    several = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token", "c")
    least = lambda of: F.ceil(F.lit(config.percent) * F.col(of) / F.lit(100))
    lists = rows.join(several, "token").groupBy("sid", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("x"))  # one set's shingles
    places = lists.select("sid", "comp", "n", (F.col("n") - F.size("x")).alias("rare"), F.expr("transform(x, (y, i) -> struct(i, y.token AS token))").alias("x"))
    cut = places.withColumn("x", F.slice("x", F.lit(1), F.greatest(F.col("n") - least("n") + 1 - F.col("rare"), F.lit(0)).cast("int")))
    out = materialize(cut.select("sid", "comp", "n", "rare", F.explode("x").alias("y")).select("sid", "comp", "n", F.col("y.token").alias("token"), (F.col("rare") + F.col("y.i")).alias("i")), "prefixes")
    release(opened.sparkSession, rows)
    return out


def prefix_pairs(rows: DataFrame, config: MinHash) -> DataFrame:
    """a, b: sets of different components that may be similar. Of a pair, the smaller set needs its shared
    shingle earlier than the larger, which spares pairs that share only common shingles."""
    p = config.percent
    x = rows.where(f"(100 + {p}) * (n - i) >= 2 * {p} * n").select("token", F.col("sid").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("i").alias("ia"))
    y = rows.select("token", F.col("sid").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    fits = f"ca <> cb AND (na < nb OR na = nb AND a < b) AND 100 * na >= {p} * nb AND (100 + {p}) * least(na - ia, nb - ib) >= {p} * (na + nb)"
    return x.join(y, (x["token"] == y["token"]) & F.expr(fits)).select("a", "b").distinct()


def set_links(docs: DataFrame, sets: DataFrame, config: MinHash) -> DataFrame:
    """a, b: for each set but the least of its component, that least set."""
    spark = docs.sparkSession
    met = buckets(sets)
    packed = _packed_sets(docs, sets, met.select("sid").distinct(), config)
    near = met.where((F.col("sid") != F.col("pivot")) & (100 * F.least("n", "pn") >= config.percent * F.greatest("n", "pn")))
    found = materialize(confirmed(near.select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct(), packed, config), "confirmed")
    stars = components(found)
    opened = materialize(open_sets(met, stars), "open_sets")
    release(spark, met, found)
    if not opened.isEmpty():
        rows = prefixes(opened, packed, config)
        found = materialize(confirmed(prefix_pairs(rows, config), packed, config), "confirmed")
        release(spark, rows)
        if not found.isEmpty():
            before, stars = stars, components(stars.unionByName(found))
            release(spark, before)
        release(spark, found)
    release(spark, packed, opened)
    return stars


def labelled(docs: DataFrame, config: MinHash) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, th, n, component_id, kept: a row for each row of docs; and the tables that this reads."""
    spark = docs.sparkSession
    rows = materialize(signatures(docs, config), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    one = rows.where("n > 0").groupBy("h1", "h2").agg(F.min("n").alias("n"), F.min(F.struct(first.alias("one"), "u", "v")).alias("m"))
    sets = materialize(one.select(F.monotonically_increasing_id().alias("sid"), "h1", "h2", "n", "m.one", "m.u", "m.v"), "sets")
    stars = set_links(docs, sets, config)
    root = sets.select("sid", "h1", "h2", F.col("one.doc_id").alias("doc")).join(stars.select(F.col("a").alias("sid"), F.col("b").alias("c")), "sid", "left").withColumn("root", F.coalesce("c", "sid"))
    least = materialize(root.groupBy("root").agg(F.min("doc").alias("component_id")), "least_ids")  # read back, so that a join may split a large component
    named = materialize(root.select("h1", "h2", "root").join(least, "root").select("h1", "h2", "component_id"), "classes")
    release(spark, sets, stars, least)
    out = rows.select("doc_id", "th", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "th", "n", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept")), [rows, named]


def near_duplicates(docs: DataFrame, config: MinHash = MinHash()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return labelled(docs, config)[0].select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def keep_one(docs: DataFrame, config: MinHash = MinHash()) -> DataFrame:
    """docs with one document of each group (see above for null and repeated ids), all columns as they were."""
    doc_id, th = fresh("gone_id", docs), fresh("gone_th", docs)
    rows, read = labelled(docs, config)
    gone = materialize(rows.where("NOT kept").select(F.col("doc_id").alias(doc_id), F.col("th").alias(th)).distinct(), "near_copies")
    release(docs.sparkSession, *read)
    at, hashed = keyed(docs)
    return docs.join(_by_size(gone, gone.count()), at.eqNullSafe(F.col(doc_id)) & (hashed == F.col(th)), "left_anti")
