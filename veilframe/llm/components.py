"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, ship

#: So many links (16 MB) are settled in one task; more take distributed rounds. Both give the same result.
LINKS_OF_A_TASK = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node but the least of its component, and that least node."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(node))
    while True:  # hook the larger root below the smaller one, then shorten the ways
        p, q = least[x], least[y]
        if np.array_equal(p, q):
            break
        np.minimum.at(least, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(least, up := least[least]):
            least = up
    below = least != np.arange(len(node))
    return node[below], node[least[below]]


def _in_one_task(edges: DataFrame) -> DataFrame:
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = [[b.column(i).to_numpy() for i in (0, 1)] for b in batches]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in links)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in roots(a, b)], ["a", "b"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "a long, b long")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a: a node, b: a neighbour; m: the least of both; every group is aggregated before it is shuffled
    if large:
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = both.where("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60, in_one_task: int = LINKS_OF_A_TASK) -> DataFrame:
    """a, b: each linked node a but the least of its component, with that least node b.

    ``edges`` has long columns a and b, repeated and reversed rows included. Rounds end when all links lead
    straight to roots; a round reads and writes the links only, and nothing reaches the driver but their
    number and whether some are left. No links: an empty table.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.count() <= in_one_task:
        before, now = now, materialize(_in_one_task(now), "links")
        release(spark, before)
        return now
    for _ in range(rounds):
        before, now = now, materialize(_stars(_stars(now, True), False), "links")
        release(spark, before)
        several = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if several.isEmpty() and now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            return now  # every node has one root, and no root has one of its own
    raise RuntimeError("links did not settle")
