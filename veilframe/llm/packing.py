"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are words (runs without ASCII white space) unless a column of token counts is named. A document
longer than the largest capacity is cut into pieces that follow each other, so nothing is dropped.
Pieces are dealt over blocks of bounded content, and each block is packed on its own:

* pieces go in falling length to the open bin that they fill best;
* if none has room, a new bin is opened: for every permitted capacity the pieces still to come are
  laid in greedily on trial, and the capacity with the least cost per token is opened;
* at the end every bin is downsized to the least capacity that holds its contents.

A block holds about ``block_tokens`` tokens, so memory is bounded and what blocks lose at their ends is
below one bin in each. Blocks are drawn from the row, not the key: neither a repeated doc_id nor a
length that many rows share gathers rows in one task.

Defined results: null and empty texts have 0 tokens and give one row without a bin; a repeated row is
packed again; an empty table gives an empty table; the input's other columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_CLASS, materialize, parts, ship

SCHEMA = "doc_id long, piece int, start long, n_tokens long, bin_id long, bin_offset long, capacity long"


@dataclass(frozen=True)
class Packing:
    capacities: tuple[int, ...] = (512, 1024, 2048, 4096, 8192)
    bin_cost: float = 64.0  #: of any bin, beside one for each token of its capacity
    block_tokens: int = 1_000_000
    row_tokens: int = 8  #: what a row counts beside its tokens, so that a block's rows are bounded, too

    def cost(self, capacity: int) -> float:
        return capacity + self.bin_cost


def n_words(text: Column) -> Column:
    t = F.btrim(text, F.lit(WS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"{WS_CLASS}+"))).cast("long")


def pack_lengths(lengths: list[int], config: Packing) -> tuple[list[int], list[int], list[int]]:
    """For lengths in falling order: bin and offset of each, and the capacity of each bin."""
    left = Counter(lengths)  # pieces not laid yet
    sizes = sorted(left)
    free: list[int] = []  # of open bins, sorted, with their bins beside
    bins: dict[int, list[int]] = {}
    filled: list[int] = []
    capacity: list[int] = []
    at, offset = [], []
    limits = sorted(config.capacities)

    def trial(room: int) -> int:
        """What greedy filling would leave of the room."""
        used: Counter[int] = Counter()
        k = bisect_right(sizes, room) - 1
        while k >= 0 and room >= sizes[0]:
            n = min(left[sizes[k]] - used[sizes[k]], room // sizes[k])
            room -= n * sizes[k]
            used[sizes[k]] += n
            k = min(k - 1, bisect_right(sizes, room) - 1)
        return room

    for n in lengths:
        left[n] -= 1
        if not left[n]:
            del sizes[bisect_left(sizes, n)]
        k = bisect_left(free, n)
        if k < len(free):
            room = free[k]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room], free[k]
        else:
            room = min((c for c in limits if c >= n), key=lambda c: (config.cost(c) / (c - trial(c - n)), -c))
            b = len(filled)
            filled.append(0)
            capacity.append(room)
        at.append(b)
        offset.append(filled[b])
        filled[b] += n
        room -= n
        if room:
            if room not in bins:
                insort(free, room)
                bins[room] = []
            bins[room].append(b)
    return at, offset, [limits[bisect_left(limits, n)] for n in filled]


def pack(docs: DataFrame, config: Packing = Packing(), length: str | None = None) -> DataFrame:
    """doc_id, piece, start (in the document), n_tokens, bin_id, bin_offset, capacity."""
    spark = docs.sparkSession
    ship(spark)
    most = max(config.capacities)
    n = F.coalesce(F.col(length).cast("long"), F.lit(0)) if length else n_words(F.coalesce(docs["text"].cast("string"), F.lit("")))
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"), F.monotonically_increasing_id().alias("row")), "packing_lengths")
    pieces = rows.where("n > 0").select("doc_id", "row", "n", F.explode(F.expr(f"sequence(0, CAST((n - 1) DIV {most} AS int))")).alias("piece"))
    pieces = pieces.select("doc_id", "row", "piece", (F.col("piece").cast("long") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most).alias("n_tokens"))
    size = rows.agg(F.sum(F.col("n") + config.row_tokens).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // config.block_tokens))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["n_tokens", "doc_id", "piece", "row"], ascending=[False, True, True, True])
        at, offset, capacity = pack_lengths(p["n_tokens"].tolist(), config)
        return pd.DataFrame({"doc_id": p["doc_id"], "piece": p["piece"], "start": p["start"], "n_tokens": p["n_tokens"], "bin_id": [(key[0] << 24) + b for b in at], "bin_offset": offset, "capacity": [capacity[b] for b in at]})

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))
    packed = dealt.repartition(max(1, min(parts(spark), blocks)), "block").groupBy("block").applyInPandas(run, SCHEMA)
    none = rows.where("n = 0").selectExpr("doc_id", "0 AS piece", "0L AS start", "0L AS n_tokens", "CAST(NULL AS long) AS bin_id", "CAST(NULL AS long) AS bin_offset", "CAST(NULL AS long) AS capacity")
    return packed.unionByName(none)
