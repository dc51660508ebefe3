"""Connected components by alternating large and small stars, on tables only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorloom.llm.common import Scratch


#: Links that one task may hold; more are united by stars.
IN_ONE_TASK = 1_000_000


def _forest(batches):
    """(a, b) -> (node, component), the least node of each tree, in one task."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    pairs = np.concatenate(parts, axis=1)
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(pairs.shape)
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """(a long, b long) links -> (node long, component long): the smallest node reachable.

    Only nodes with a link to another are returned. Null ends and loops are ignored, repeated links
    count once, no links give no rows.
    """
    lo, hi = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    some = edges.where("a is not null and b is not null and a <> b").select(hi, lo)
    if some.count() <= in_one_task:  # beyond, a node that a third of all links touch is pre-aggregated or split by the skew join
        return scratch.keep(some.coalesce(1).mapInArrow(_forest, "node long, component long"))
    now = scratch.keep(some.distinct())
    state = _state(now)
    while state[0]:
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        mid = scratch.keep(large)
        least = mid.groupBy("a").agg(F.min("b").alias("m"))
        small = mid.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = scratch.keep(small.where("a <> b").distinct())
        scratch.drop(now, mid)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.union(now.select(F.col("b"), F.col("b")).distinct())
