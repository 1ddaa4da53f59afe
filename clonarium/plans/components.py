"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonarium.plans.store import drop_stash, ship, stash

#: Links up to which one task solves the whole table. Its nodes are numbers of 8 bytes or short names, so it takes a few hundred MB at most.
SMALL = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def least_members(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each node's component, for nodes 0 to n - 1: minima over links, then pointers to pointers, until nothing moves."""
    least = np.arange(n)
    while True:
        before = least
        least = before.copy()
        low = np.minimum(before[u], before[v])
        for ends in (u, v, before[u], before[v]):
            np.minimum.at(least, ends, low)
        while True:
            jumped = least[least]
            if (jumped == least).all():
                break
            least = jumped
        if (least == before).all():
            return least


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [b for b in batches if b.num_rows]
    if not links:
        return
    kind = links[0].schema.field(0).type
    u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in links]) for i in (0, 1))
    nodes = np.unique(np.concatenate([u, v]))
    least = least_members(np.searchsorted(nodes, u), np.searchsorted(nodes, v), len(nodes))
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    for lo in range(0, len(moved), 10_000):
        some = moved[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some], kind), pa.array(nodes[least[some]], kind)], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) -> (u, v): each node that is not the smallest of its component, with that smallest node.

    Nodes are numbers or text. Up to ``SMALL`` links are solved by one task, which is the same result in one job; beyond that by steps that
    keep components as they are, and whose number grows with the logarithm of the longest path.
    The edge table is written to the shared folder after each round, so a lost executor costs one round at most.
    Hubs: minima are pre-aggregated before the shuffle, and the join back is one that adaptive execution can split.
    """
    edges = stash(links.where("u <> v").select("u", "v").distinct(), "edges")
    before = _state(edges)
    if before[0] <= SMALL:
        ship(links.sparkSession)
        out = stash(edges.coalesce(1).mapInArrow(_at_once, edges.schema), "edges")
        drop_stash(edges)
        return out
    while True:
        after = stash(_small_star(_large_star(edges)), "edges")
        now = _state(after)
        drop_stash(edges)
        if now == before:
            return after
        edges, before = after, now
