"""Connected components of an edge table by contraction: forests inside tasks, then a smaller graph of their roots.

A level makes a forest of the edges of every task, with the node of lowest rank in each tree as its root. A node that several
tasks gave different roots connects these roots: such edges are the next level's graph, dealt anew. A node occurs once in a task,
so a hub is as many rows as there are tasks. Ranks are hashes that differ by level, so that of a path, too, a third of the
nodes goes with every level. In the end roots are followed from level to level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.cluster import small, stored
from mixloom.llm.hashing import mixed

MAX_LEVELS = 100
# Edges of a task whose forest is made at once; more are several forests.
FOREST_EDGES = 1 << 20


def forest(a: np.ndarray, b: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, root, rank of the root) of all nodes of the edges."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    rank = mixed(nodes.view(np.uint64) + np.uint64(level)).view(np.int64)
    order = np.argsort(rank, kind="stable")
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    ends = place[ends]
    one, two = ends[: len(a)], ends[len(a) :]
    top = np.arange(len(nodes))
    while True:
        low, high = np.minimum(top[one], top[two]), np.maximum(top[one], top[two])
        apart = low < high
        if not apart.any():
            break
        np.minimum.at(top, high[apart], low[apart])
        while not np.array_equal(top, top[top]):
            top = top[top]
    return nodes[order], nodes[order][top], rank[order][top]


def _forests(edges: DataFrame, level: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            a, b = (np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in forest(a, b, level)], ["node", "root", "rank"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= FOREST_EDGES:
                yield made()
                held, size = [], 0
        if size:
            yield made()

    return edges.mapInArrow(run, "node bigint, root bigint, rank bigint")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; component: the smallest node that can be reached.

    Self loops, repeated edges and nulls are ignored.
    """
    ends = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    graph = edges.select(ends[0].alias("a"), ends[1].alias("b")).where("a <> b")
    levels = []
    for level in range(MAX_LEVELS):
        found = _forests(graph, level).groupBy("node")
        first = F.min(F.struct("rank", "root"))["root"].alias("top")
        found = stored(found.agg(first, F.collect_set("root").alias("roots")))
        levels.append(found.select("node", "top"))
        several = found.where(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("top").alias("b"))
        several = several.where("a <> b")
        if not several.limit(1).collect():
            break
        graph = several.repartition("b")
    else:
        raise RuntimeError("components did not settle")
    whole = levels[0]
    for found in levels[1:]:
        later = found.select(F.col("node").alias("_root"), F.col("top").alias("_top"))
        whole = whole.join(small(later), F.col("top") == F.col("_root"), "left")
        whole = whole.select("node", F.coalesce("_top", "top").alias("top"))
    whole = stored(whole) if len(levels) > 1 else whole
    least = stored(whole.groupBy("top").agg(F.min("node").alias("component")))
    return whole.join(small(least), "top").select("node", "component")
