"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import workspace

#: Edges up to which one task, which holds 16 bytes of each and some ten times that to work, connects them all.
ONE_TASK = 1 << 20


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node each is connected to) of the edges a[i]-b[i]."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    name = np.arange(len(nodes))
    while True:
        low = np.minimum(name[x], name[y])
        after = name.copy()
        for side in (name[x], name[y], x, y):  # the names of both ends first, so that whole groups move
            np.minimum.at(after, side, low)
        while not np.array_equal(shorter := after[after], after):
            after = shorter
        if np.array_equal(after, name):
            return nodes, nodes[name]
        name = after


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for every node of `edges` (a, b), the smallest node it is connected to.

    Alternates two steps that keep components and shrink distances: every node
    links its larger neighbours to its smallest one, then its smaller ones.
    Each round groups by node with partial aggregation of the minimum and
    writes the edges to the shared folder; nothing is gathered per component,
    and the edges of a hub stay where they are (workspace.lookup).
    Up to ONE_TASK edges, counted first, a single task does it in memory.
    Null ends and loops are ignored; an empty table gives an empty one.
    """
    pairs = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()
    pairs = workspace.written(pairs, "edges")
    if pairs.count() <= ONE_TASK:
        return pairs.coalesce(1).mapInArrow(_in_one_task, "node bigint, component bigint")
    before = None
    for _ in range(rounds):
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if state["n"] == 0 or before == (state["n"], state["h"]):
            break
        before = (state["n"], state["h"])
        n = state["n"]
        # Large star: of each node with all its neighbours, the larger ones go to the smallest.
        both = pairs.unionByName(pairs.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = workspace.lookup(pairs, least, ["a"], "n", n).selectExpr("m AS a", "b").where("a <> b").distinct()
        large = workspace.written(large, "edges")
        # Small star: of each node with its smaller neighbours, these and itself go to the smallest.
        least = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = workspace.lookup(large, least, ["b"], "n", n).selectExpr("m AS a", "a AS b").where("a <> b")
        pairs = workspace.written(small.unionByName(least.selectExpr("m AS a", "b")).distinct(), "edges")
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    found = pairs.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [tuple(batch.column(i).to_numpy() for i in (0, 1)) for batch in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ((), ())))
    nodes, names = connected(a, b)
    for low in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[low : low + (1 << 16)]) for x in (nodes, names)], ["node", "component"])
