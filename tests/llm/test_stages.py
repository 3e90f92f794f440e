"""What stays staged, and how much of a large group is moved or compared."""

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp
from capstride.llm import buckets, common, graph, lines

OPEN = "bucket long, node long, component long, weight long, main long, n long, others long, fact struct<sim: long>"


def staged(spark):
    return set(os.listdir(common.shared_dir(spark).removeprefix("file://")))


def test_nothing_stays(spark):
    """Line dedup and near-dedup leave one small table each, of what goes."""
    docs = common.read(spark, "/root/testdata/sf0.001", "documents")
    for step in (cp.line_dedup, cp.near_dedup):
        before = staged(spark)
        out = step(spark, docs, "/root/testdata/sf0.001")
        assert [x.rpartition("-")[0] for x in staged(spark) - before] == ["gone"]
        assert out.count() <= docs.count()


def test_alone(spark):
    before = staged(spark)
    outer = common.alone(lambda: common.alone(lambda: common.stage(spark.range(5)).where("id > 1")).where("id > 2"), "kept")
    assert sorted(r.id for r in outer.collect()) == [3, 4] and len(staged(spark) - before) == 1


def test_few_edges_are_one_task(spark, monkeypatch):
    """What one task contracts at once takes no distributed steps, however many partitions it lies in."""
    monkeypatch.setattr(graph, "_settled", None)
    edges = spark.createDataFrame([(i, i + 1) for i in range(2000)], "a long, b long").repartition(50)
    assert {r.component for r in graph.components(edges).collect()} == {0}


def test_blocks_move_rows_once(spark):
    """Rows of a bucket that is one block come once, and all its pairs meet once."""
    rows = [(b, n, n, 0, -1, 30 + 10 * b, 30 + 10 * b, (0,)) for b in (0, 1) for n in range(30 + 10 * b)]

    def solve(bucket, parts):
        node, q, m, may = buckets.meeting(parts)
        return [np.array([bucket]), np.array([sum(p.num_rows for p in parts)]), np.array([int(may.sum())])]

    def found(block):
        out = buckets.in_blocks(spark.createDataFrame(rows, OPEN), [F.col("fact.sim").alias("sim")], solve, names=("bucket", "rows", "pairs"), block=block)
        return {r.bucket: (r.rows, r.pairs) for r in out.groupBy("bucket").agg(F.sum("rows").alias("rows"), F.sum("pairs").alias("pairs")).collect()}

    assert found(64) == {0: (30, 435), 1: (40, 780)} and {b: n for b, (_, n) in found(16).items()} == {0: 435, 1: 780}


def test_large_groups_are_led(spark):
    """A bucket with many nodes has a round first, so that blocks get none of a group that hangs together; others have none."""
    live = common.stage(spark.createDataFrame([(1, n, (n,)) for n in range(300)] + [(2, n, (n,)) for n in range(1000, 1040)], "bucket long, node long, fact struct<n: long>"))
    for led, asked, left in ((100, 299, {2}), (1000, 0, {1, 2})):
        pairs_of, rest_of = [], []

        def verify(pairs):
            pairs_of.append(pairs.count())
            return pairs.withColumn("linked", F.lit(True))

        def rest(open_):
            rest_of.append({r.bucket for r in open_.collect()})
            return open_.groupBy("bucket").agg(F.min("node").alias("least")).join(open_, "bucket").select(F.col("node").alias("a"), F.col("least").alias("b"))

        label = buckets.bucket_components(live, verify, None, lambda x, y: F.lit(True), lambda x, y: F.lit(0), rest=rest, most_rounds=1, led=led)
        live = common.stage(spark.createDataFrame([(1, n, (n,)) for n in range(300)] + [(2, n, (n,)) for n in range(1000, 1040)], "bucket long, node long, fact struct<n: long>"))
        assert sum(pairs_of) == asked and rest_of == [left]
        assert len({r.component for r in label.collect()}) == 2


def test_block_pairs_know_how_alike(spark):
    """Pairs out of blocks come with what wide sketches say of them, as likely() would."""
    rng = np.random.default_rng(5)
    base = rng.choice(list("abcdefgh "), 300)
    texts = ["".join(base)] + ["".join(np.where(np.arange(300) == 20 * k + 7, "z", base)) for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = lambda x, y: lines.may_link(x.view(np.uint64), y.view(np.uint64), 10)
    wide = buckets.packed_buckets(docs, lambda batch: lines.line_rows(batch, 10), near, lines.SKETCH).where("wide is not null").select("node", "wide")
    own = dict(wide.collect())
    sims = {n: s for part in docs.toArrow().to_batches() for _, ns, ss, *_ in lines.line_rows(part, 10) for n, s in zip(ns.tolist(), ss.view(np.int64).tolist())}
    rows = [(1, n, n, 0, -1, 4, 4, (sims[n],)) for n in own]
    for r in lines.block_company(spark.createDataFrame(rows, OPEN), near, wide).collect():
        x, y = (pa.array([own[k]], pa.binary()) for k in (r.a, r.b))
        assert r.dense == 0 and r.apart == lines.WIDE - lines.agreement(x, y, 10)[0]
