"""Suffix-array dedup by a depth-limited radix sort.

Every byte that lies in a string of ``window`` bytes which also starts anywhere else (in the same or
another document) is removed. Suffixes are ordered only through the first ``window`` bytes, by
most-significant-digit passes; groups that are still together after the last digit are exactly the
repeated windows, and groups of one leave at once:

1. First digit: a window's *anchor*, the 32-byte string in it whose hash is smallest (the leftmost of
   equals), with its offset. Equal windows have equal anchors at equal offsets, and neighbouring
   windows share them, so one row stands for a *block* of windows (65 on average).
   Anchors that occur once are done: none of their windows is repeated.
2. Second digit: the block's whole content. Blocks that occur twice are repeated with all their windows.
3. Further digits, only for single blocks beside others of their anchor: their windows are ordered by four
   digits of a quarter of the window each, within the anchor's group. A group with more than
   ``GROUP`` blocks is spread by the windows' contents instead, so no task gathers an unbounded group.

Digits are compared by 64-bit fingerprints, always together with the anchor's.

Defined results: null text counts as empty (0 bytes, nothing removed); texts shorter than a window lose
nothing; repeated rows are copies of each other and lose all that is long enough; an empty table gives an
empty table; offsets are bytes of the UTF-8 form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, release, ship

ANCHOR = 32
DIGITS = 4
GROUP = 4096
BROADCAST_DOCS = 1_000_000
_B = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (np.uint64(_B), np.uint64(pow(_B, -1, 1 << 64))))
        return self.up, self.down


_powers = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _M1
    x = (x ^ x >> np.uint64(29)) * _M2
    return x ^ x >> np.uint64(32)


class Prints:
    """Fingerprints of any substrings of a byte string."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers.of(len(raw) + 1)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def _leftmost_least(h: np.ndarray, w: int) -> np.ndarray:
    """Where the least of each w consecutive values is, the leftmost of equals; by doubling."""
    n = len(h) - w + 1
    at, low, size = np.arange(len(h)), h, 1
    while size * 2 <= w:
        right = low[size:] < low[:-size]
        low, at = np.where(right, low[size:], low[:-size]), np.where(right, at[size:], at[:-size])
        size *= 2
    right = low[w - size : w - size + n] < low[:n]
    return np.where(right, at[w - size : w - size + n], at[:n])


def blocks(raw: bytes, window: int) -> tuple[np.ndarray, ...]:
    """anchor, block (fingerprints), start, number of windows, anchor's offset in the first one."""
    a = np.frombuffer(raw, np.uint8)
    if len(a) < window:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    p = Prints(a)
    i = np.arange(len(a) - ANCHOR + 1)
    h = p.of(i, i + ANCHOR)
    at = _leftmost_least(h, window - ANCHOR + 1)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    end = np.append(start[1:], len(at))
    offset = at[start] - start
    block = _mix(p.of(start, end - 1 + window) ^ (offset.astype(np.uint64) + np.uint64(1)) * np.uint64(_B))
    return h[at[start]].view(np.int64), block.view(np.int64), start, end - start, offset


def repeated_windows(group: np.ndarray, offset: np.ndarray, n: np.ndarray, weight: np.ndarray, contents: list[bytes], window: int) -> np.ndarray:
    """The third step: of the blocks' windows, listed block by block, which are repeated.

    group: the anchor; offset: of the anchor in the first window; weight: how often the block occurs.
    """
    length = np.fromiter(map(len, contents), np.int64, len(contents))
    begin = np.cumsum(length) - length
    prints = Prints(np.frombuffer(b"".join(contents), np.uint8))
    owner = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    key = group[owner].astype(np.uint64) * np.uint64(_B) + (offset[owner] - j).astype(np.uint64)
    at, heavy = begin[owner] + j, np.minimum(weight, 2)[owner]
    left = np.arange(len(owner))
    step = -(-window // DIGITS)
    for d in range(DIGITS):
        digit = prints.of(at[left] + d * step, at[left] + min(window, (d + 1) * step))
        order = np.lexsort((digit, key))
        left, key, digit = left[order], key[order], digit[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (digit[1:] != digit[:-1])]) if len(left) else np.zeros(0, bool)
        rank = np.cumsum(new) - 1
        many = np.bincount(rank, heavy[left])[rank] > 1 if len(left) else np.zeros(0, bool)
        left, key = left[many], rank[many].astype(np.uint64)
    out = np.zeros(len(owner), bool)
    out[left] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


BLOCK = "did long, th int, anchor long, block long, start int, n int, off int"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"), F.hash(text).alias("th"), text.cast("binary").alias("raw"))


def _all_blocks(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                s = b.slice(at, 128)
                got = [blocks(r, window) for r in s.column(2).to_pylist()]
                sizes = [len(g[0]) for g in got]
                cols = [np.concatenate([g[i] for g in got]) for i in range(5)]
                ids = [np.repeat(s.column(i).to_numpy(), sizes) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[0], pa.int64()), pa.array(ids[1], pa.int32()), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 3, strict=True))], ["did", "th", "anchor", "block", "start", "n", "off"])

    return _keyed(docs).select("did", "th", "raw").mapInArrow(run, BLOCK)


def _with_texts(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of lists (did, th, ...) with the raw text; the texts that no list needs stay where they are."""
    wanted = lists.select("did", "th").distinct()
    n = wanted.count()
    rows = _keyed(docs)
    few = rows.join(F.broadcast(wanted), ["did", "th"], "left_semi") if n <= BROADCAST_DOCS else rows
    return few.join(lists, ["did", "th"])


def repeated_spans(docs: DataFrame, window: int = 200) -> DataFrame:
    """did, th, spans: of each document with repeated windows, the begin and end of what they cover."""
    spark = docs.sparkSession
    ship(spark)
    every = materialize(_all_blocks(docs, window), "blocks")
    # what a join reads is written first, so that Spark may split the rows of an anchor that very many blocks have
    common = materialize(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "repeated_anchors")
    met = materialize(every.join(common, "anchor"), "repeated_blocks")
    release(spark, every, common)
    # how often each block occurs, and one occurrence that can show its content
    shown = materialize(met.groupBy("anchor", "block").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("did", "th", "start", "n", "off")).alias("one")), "shown_blocks")
    found = materialize(met.join(shown.select("anchor", "block", "c"), ["anchor", "block"]).select("did", "th", "start", "n", "c"), "counted_blocks")
    release(spark, met)
    whole = found.where("c > 1").select("did", "th", F.col("start").alias("s"), (F.col("start") + F.col("n") - 1 + window).alias("e"))
    sizes = shown.groupBy("anchor").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    cuts = shown.join(sizes, "anchor").groupBy("one.did", "one.th").agg(F.collect_list(F.struct("anchor", "c", "one.start", "one.n", "one.off", (F.col("size") > GROUP).alias("hot"))).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                s = b.slice(at, 256)
                for did, th, raw, cs in zip(*(s.column(i).to_pylist() for i in range(4)), strict=True):
                    rows += [(did, th, x["anchor"], x["c"], x["start"], x["n"], x["off"], x["hot"], raw[x["start"] : x["start"] + x["n"] - 1 + window]) for x in cs]
                cols = list(zip(*rows, strict=True)) or [()] * 9
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["did", "th", "anchor", "c", "start", "n", "off", "hot", "content"])

    content = _with_texts(docs, cuts).select("did", "th", "raw", "cuts").mapInArrow(cut, "did long, th int, anchor long, c long, start int, n int, off int, hot boolean, content binary")
    content = materialize(content.dropDuplicates(["anchor", "did", "th", "start"]), "contents")
    parts = spans_of_groups(content.where("NOT hot"), window).unionByName(spans_of_hot(content.where("hot"), window))
    parts = materialize(parts, "part_spans")
    release(spark, content, shown)
    out = materialize(whole.unionByName(parts).groupBy("did", "th").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")  # a set: copies of a row have equal spans
    release(spark, found, parts)
    return out


def spans_of_groups(content: DataFrame, window: int) -> DataFrame:
    """Spans of the repeated windows of single blocks; whole anchor groups at a time."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        did, th, anchor, c, start, n, off, raw = zip(*held, strict=True)
        number = np.array(n)
        flags = np.split(repeated_windows(np.array(anchor), np.array(off), number, np.array(c), list(raw), window), np.cumsum(number)[:-1])
        rows = [(did[k], th[k], start[k] + i, start[k] + j - 1 + window) for k, f in enumerate(flags) if c[k] == 1 for i, j in _runs(f)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64(), *[pa.int32()] * 3], strict=True)], ["did", "th", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        windows = 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if windows > 100_000 and row[2] != held[-1][2]:
                    yield flush(held)
                    held, windows = [], 0
                held.append(row)
                windows += row[5]
        if held:
            yield flush(held)

    rows = content.select("did", "th", "anchor", "c", "start", "n", "off", "content").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, "did long, th int, s int, e int")


def spans_of_hot(content: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many blocks: windows meet by their contents, counted before they are shuffled."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for did, th, anchor, c, start, n, off, raw in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                i = np.arange(n)
                print_ = Prints(np.frombuffer(raw, np.uint8)).of(i, i + window).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, did)), pa.array(np.full(n, th, np.int32)), pa.array(np.full(n, anchor)), pa.array(np.full(n, c)), pa.array((start + i).astype(np.int32)), pa.array((off - i).astype(np.int32)), pa.array(print_)], ["did", "th", "anchor", "c", "s", "o", "w"])

    rows = content.select("did", "th", "anchor", "c", "start", "n", "off", "content").mapInArrow(spread, "did long, th int, anchor long, c long, s int, o int, w long")
    many = rows.groupBy("anchor", "o", "w").agg(F.sum("c").alias("all")).where("all > 1").select("anchor", "o", "w")
    return rows.where("c = 1").join(many, ["anchor", "o", "w"], "left_semi").select("did", "th", "s", (F.col("s") + window).alias("e"))


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, window: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    spans = repeated_spans(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                raws, n, removed, runs, kept = s.column(1).to_pylist(), [], [], [], []
                for raw, x in zip(raws, s.column(2).to_pylist(), strict=True):
                    u = _union(x or [])
                    edges = [0, *(p for r in u for p in r), len(raw)]
                    kept.append(b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
                    n.append(len(raw))
                    removed.append(sum(j - i for i, j in u))
                    runs.append(len(u))
                yield pa.RecordBatch.from_arrays([s.column(0), *(pa.array(c, pa.int64()) for c in (n, removed, runs)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return _joined(docs, spans).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, raw, spans; only texts that lose something move, if their ids are few enough to broadcast."""
    rows = _keyed(docs)
    n = spans.count()
    if n > BROADCAST_DOCS:
        return rows.join(spans, ["did", "th"], "left").select("doc_id", "raw", "spans")
    ids = F.broadcast(spans.select("did", "th"))
    touched = rows.join(ids, ["did", "th"], "left_semi").join(spans, ["did", "th"], "left").select("doc_id", "raw", "spans")
    rest = rows.join(ids, ["did", "th"], "left_anti").select("doc_id", "raw", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return touched.unionByName(rest)


def cleaned(docs: DataFrame, window: int = 200) -> DataFrame:
    """docs without the repeated bytes of their column text; a character of which a byte went goes whole,
    n_chars (if there) follows, the other columns stay as they were. Null texts stay null."""
    spans = repeated_spans(docs, window)
    if spans.isEmpty():
        return docs
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    did, th = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))), F.hash(text)
    k_did, k_th, k_spans = (fresh(x, docs) for x in ("span_did", "span_th", "span_list"))
    key = spans.select(F.col("did").alias(k_did), F.col("th").alias(k_th), F.col("spans").alias(k_spans))
    ids = F.broadcast(key.select(k_did, k_th)) if spans.count() <= BROADCAST_DOCS else key.select(k_did, k_th)
    on = [did == F.col(k_did), th == F.col(k_th)]
    names, schema = docs.columns, docs.schema
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for t, x in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                raw, u = t.encode(), _union(x)
                edges = [0, *(p for r in u for p in r), len(raw)]
                new.append("".join(raw[i:j].decode("utf-8", "ignore") for i, j in zip(edges[::2], edges[1::2], strict=True)))
            out = b.select(range(len(names))).set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if size is not None:
                out = out.set_column(size, b.schema.field(size), pa.array(map(len, new), b.schema.field(size).type))
            yield out

    touched = docs.join(ids, on, "left_semi").join(key, on).select(*[docs[c] for c in names], k_spans).mapInArrow(run, schema)
    return touched.unionByName(docs.join(ids, on, "left_anti"))
