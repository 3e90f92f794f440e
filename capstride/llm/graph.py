"""Connected components of an edge table by local contraction and alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

#: Edges (16 bytes each) that a task contracts at once.
CHUNK_EDGES = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars that connect what the edges (a, b) connect: nodes and the least node of each one's component, roots left out."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def contracted(edges: DataFrame, chunk: int = CHUNK_EDGES) -> DataFrame:
    """Fewer edges (a, b) with the same components: each task replaces runs of `chunk` edges by stars, as a combiner does."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in ("a", "b")]
            for low in range(0, batch.num_rows, chunk):
                held.append([x[low : low + chunk] for x in now])
                n += len(held[-1][0])
                if n >= chunk:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    def out(held):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held)))], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (a, b) are stars: each a has one b, and no b is an a."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root"))
    )
    ups = nodes.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return not ups.where("up > 1 or up > 0 and root > 0").limit(1).count()


def components(edges: DataFrame, rounds: int = 60, chunk: int = CHUNK_EDGES) -> DataFrame:
    """(node, component): each node of `edges` (a, b: long) with the smallest node it reaches.

    Tasks first replace their edges by stars; what spans several tasks is solved by distributed steps, which join and
    aggregate by node with map-side minima, so that no neighbourhood is gathered in one task.  The edges are staged after
    each step.  Loops and repeated edges do no harm; an empty table gives none.
    """
    edges = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # once where they are; what one task then contracts at once is solved there, the rest with those that share a root
    near = stage(contracted(edges, chunk), "edges")
    few = near.count() < chunk
    edges = stage(contracted(near.coalesce(1), chunk) if few else contracted(near.repartition("b"), chunk).distinct(), "edges")
    discard(near)
    for _ in range(rounds):
        if few or _settled(edges):
            break
        # large star: what is larger than a node moves to the least of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = stage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        # small star: a node and what is smaller move to the least of these
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = stage(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(edges, large)
        edges = small
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def relabel(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """Add links (a, b) to known components (node, component); only what the links touch is solved again."""
    if label is None:
        return components(links)
    known = label.select(F.col("node").alias("known"), "component")
    ends = links.join(known, links.a == known.known, "left").select(F.coalesce("component", "a").alias("a"), "b")
    ends = ends.join(known, ends.b == known.known, "left").select("a", F.coalesce("component", "b").alias("b"))
    moved = stage(components(ends.distinct()), "moved").select("node", F.col("component").alias("new"))
    old = label.join(moved.withColumnRenamed("node", "of"), F.col("component") == F.col("of"), "left").select("node", F.coalesce("new", "component").alias("component"))
    return old.unionByName(moved.join(label, "node", "left_anti").select("node", F.col("new").alias("component")))
