"""Exact top-k inner products by ball-tree branch and bound.

Candidates are dealt to shards of bounded size by a hash of their id.  A shard builds a ball tree: a node has a centre,
a radius and the smallest id below it, and no candidate below it can score more than q.c + |q| r.  A block of queries
descends a tree together; each query visits the child with the larger bound first and leaves a node out as soon as the
bound is below its k-th score so far (or equals it, when all ids below are larger).  The k-th score is shared between
shards: a first round searches one shard a query, and its k-th (score, id) goes with the query to all other shards.

Query blocks meet every shard: that is the stated query set against all rows, in blocks.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id;
vectors meet vectors of their own length only; equal scores rank by the smaller id; repeated ids are candidates of
their own, except that a query skips all rows of its own id; fewer than k candidates give fewer rows; an empty table
gives none.  Scores are exact: products below 2^53 are made of doubles, larger ones of Python integers; what a long can't
hold becomes its least or largest value.  Components beyond the doubles after scaling count as the largest double.
Empty vectors have no component to score and take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, read, stage

K = 5
SCALE = 256
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 512, 64
_LOW = np.iinfo(np.int64).min + 1


def quantize(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """(id, q): floor(scale * x) of each component, a whole number as a double; rows without a whole vector are left out."""
    x = F.col(vector_column).cast("array<double>")
    most = 1.7976931348623157e308
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= most))
    # doubles of 2^53 and more are whole
    whole = lambda v: F.when(F.abs(v) * scale < 2.0**53, F.floor(v * scale).cast("double")).otherwise(F.greatest(F.least(v * scale, F.lit(most)), F.lit(-most)))
    return vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & (F.size(vector_column) > 0)).where(finite).select(
        F.col(id_column).cast("long").alias("id"), F.transform(x, whole).alias("q")
    )


class BallTree:
    """A ball tree over rows of whole numbers; nodes are arrays, leaves are runs of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(ids))
        self.x = rows.astype(np.float64)
        self.nodes: list[tuple] = []  # begin, end, left, right, least id
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._build(ids, 0, len(ids), leaf)
        self.ids, self.x = ids[self.order], self.x[self.order]
        self.centre, self.radius = np.array(self.centres), np.array(self.radii)
        self.reach = np.sqrt((self.centre**2).sum(1)) + self.radius

    def _build(self, ids: np.ndarray, begin: int, end: int, leaf: int) -> int:
        own = self.order[begin:end]
        x = self.x[own]
        centre = x.mean(0)
        apart = x - centre
        me = len(self.nodes)
        self.centres.append(centre)
        self.radii.append(float(np.sqrt((apart**2).sum(1).max())))
        self.nodes.append((begin, end, -1, -1, int(ids[own].min())))
        if end - begin > leaf and self.radii[me] > 0:
            # along the line between two far points
            a = apart[np.argmax((apart**2).sum(1))]
            b = apart[np.argmax(((apart - a) ** 2).sum(1))]
            along = np.argsort(apart @ (a - b), kind="stable")
            self.order[begin:end] = own[along]
            middle = (begin + end) // 2
            left, right = self._build(ids, begin, middle, leaf), self._build(ids, middle, end, leaf)
            self.nodes[me] = (begin, end, left, right, self.nodes[me][4])
        return me


class Search:
    """The best k of each query so far: scores descending, equal scores by ascending id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, score: np.ndarray, best: np.ndarray):
        self.q_ids, self.q = ids, q.astype(np.float64)
        self.norm = np.sqrt((self.q**2).sum(1))
        self.k = k
        self.score = np.full((len(ids), k), _LOW)
        self.best = np.full((len(ids), k), np.iinfo(np.int64).max)
        # the shared k-th (score, id): what ranks behind it is of no use
        self.cut_score, self.cut_id = score.copy(), best.copy()
        self.visited = 0

    def _kth(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (self.score[at, -1] > self.cut_score[at]) | ((self.score[at, -1] == self.cut_score[at]) & (self.best[at, -1] < self.cut_id[at]))
        return np.where(own, self.score[at, -1], self.cut_score[at]), np.where(own, self.best[at, -1], self.cut_id[at])

    def open(self, tree: BallTree, node: int, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which of the queries `at` still need `node`."""
        score, best = self._kth(at)
        limit = score.astype(np.float64)
        # bounds that overflowed leave nothing out; whole numbers that are not equal differ by 1
        return ~(bound < limit) & (~(bound < limit + 1) | (tree.nodes[node][4] <= best))

    def bounds(self, tree: BallTree, node: int, at: np.ndarray) -> np.ndarray:
        # doubles round in proportion to the lengths of the vectors, not to their product
        slack = 1e-6 + 1e-9 * self.norm[at] * tree.reach[node]
        return self.q[at] @ tree.centre[node] + self.norm[at] * tree.radius[node] + slack

    def visit(self, tree: BallTree, node: int, at: np.ndarray, bound: np.ndarray) -> None:
        keep = self.open(tree, node, at, bound)
        at = at[keep]
        if not len(at):
            return
        begin, end, left, right, _ = tree.nodes[node]
        if left < 0:
            self.leaf(tree, begin, end, at)
            return
        a, b = self.bounds(tree, left, at), self.bounds(tree, right, at)
        first = a >= b
        self.visit(tree, left, at[first], a[first])
        self.visit(tree, right, at, b)
        self.visit(tree, left, at[~first], a[~first])

    def leaf(self, tree: BallTree, begin: int, end: int, at: np.ndarray) -> None:
        self.visited += (end - begin) * len(at)
        step = 4096
        for low in range(begin, end, step):
            high = min(end, low + step)
            score = product(self.q[at], tree.x[low:high])
            ids = np.broadcast_to(tree.ids[low:high], score.shape)
            score = np.where(ids == self.q_ids[at][:, None], _LOW, score)
            score, ids = np.concatenate([self.score[at], score], 1), np.concatenate([self.best[at], ids], 1)
            ids = np.where(score == _LOW, np.iinfo(np.int64).max, ids)
            by = np.lexsort((ids, -score), axis=1)[:, : self.k]
            self.score[at] = np.take_along_axis(score, by, 1)
            self.best[at] = np.take_along_axis(ids, by, 1)


_WHOLE = np.frompyfunc(int, 1, 1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of rows of whole numbers, as longs."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    wide = _WHOLE(a).astype(object) @ _WHOLE(b).T.astype(object)
    return np.clip(wide, _LOW + 1, np.iinfo(np.int64).max).astype(np.int64)


_PACKED, _PACKED_ARROW = arrow_schema("shard long, dim int, ids binary, rows binary")
_FOUND, _FOUND_ARROW = arrow_schema("query_id long, vec_id long, score long")


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (shard, dim, id, q), in partitions by shard, as one row for each shard and at most `size` vectors."""

    def run(batches):
        key, ids, parts = None, [], []

        def out():
            x = np.concatenate(parts).reshape(len(ids), -1)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([x.astype(np.float64).tobytes()])],
                schema=_PACKED_ARROW,
            )

        for batch in batches:
            values = batch.column("q")
            for i, (shard, dim, vec) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "dim", "id")))):
                if ids and ((shard, dim) != key or len(ids) >= size):
                    yield out()
                    ids, parts = [], []
                key = (shard, dim)
                ids.append(vec)
                parts.append(values[i].values.to_numpy(zero_copy_only=False))
        if ids:
            yield out()

    by = rows.select("shard", "dim", "id", "q").repartition("shard", "dim").sortWithinPartitions("shard", "dim", "id")
    return by.mapInArrow(run, _PACKED)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows (id, q) of queries against rows (id, q) of candidates."""
    sizes = {}
    placed = []
    for name, df, size in (("c", candidates, shard_rows), ("q", queries, block_rows)):
        df = df.withColumn("dim", F.size("q"))
        sizes[name] = -(-max(1, df.count()) // size)
        shard = F.pmod(F.xxhash64("id", F.lit(name)), F.lit(sizes[name])).cast("long")
        placed.append(stage(packed(df.withColumn("shard", shard), 2 * size), "vectors"))
    shards, blocks = placed
    n = sizes["c"]
    none = np.iinfo(np.int64).max

    def search(batches):
        np.seterr(over="ignore", invalid="ignore")
        tree, trees = None, []
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.float64).reshape(-1, row["dim"])
                if not row["query"]:
                    # a shard may come in two parts; blocks then follow both
                    trees = [*trees, BallTree(ids, x)] if tree == (row["to"], row["dim"]) else [BallTree(ids, x)]
                    tree = (row["to"], row["dim"])
                    continue
                if tree != (row["to"], row["dim"]):
                    continue  # no candidates of this length in the shard
                score, best = np.full(len(ids), _LOW), np.full(len(ids), none)
                cuts = {c["query_id"]: (c["score"], c["vec_id"]) for c in row["cuts"] or ()}
                for i, q in enumerate(ids.tolist()):
                    if q in cuts:
                        score[i], best[i] = cuts[q]
                found, every = Search(ids, x, k, score, best), np.arange(len(ids))
                for t in trees:
                    found.visit(t, 0, every, found.bounds(t, 0, every))
                i, j = np.nonzero(found.score > _LOW)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i]), pa.array(found.best[i, j]), pa.array(found.score[i, j])], schema=_FOUND_ARROW
                )

    def meet(pairs: DataFrame) -> DataFrame:
        # a shard, then the blocks that visit it: neither is copied for the other
        nothing = F.lit(None).cast("array<struct<query_id: long, score: long, vec_id: long>>").alias("cuts")
        rows = shards.select(F.col("shard").alias("to"), "dim", F.lit(False).alias("query"), "ids", "rows", nothing)
        rows = rows.unionByName(pairs.select("to", "dim", F.lit(True).alias("query"), "ids", "rows", "cuts" if "cuts" in pairs.columns else nothing))
        return rows.repartition("to", "dim").sortWithinPartitions("to", "dim", "query").mapInArrow(search, _FOUND)

    home = F.pmod(F.col("shard"), F.lit(n))
    first = stage(meet(blocks.withColumn("to", home)), "first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k)
    block = F.pmod(F.xxhash64("query_id", F.lit("q")), F.lit(sizes["q"])).cast("long")
    cuts = kth.groupBy(block.alias("shard")).agg(F.collect_list(F.struct("query_id", "score", "vec_id")).alias("cuts"))
    others = blocks.join(cuts, "shard", "left").withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))).where(F.col("to") != home)
    rest = meet(others)
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 best others of each vector whose id is divisible by 50."""
    rows = stage(quantize(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "quantized")
    return top_k(rows, rows.where("id % 50 = 0"))


OP2_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i, len(v) AS d FROM q),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM c a JOIN c b ON a.i = b.i AND a.d = b.d AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0 GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
