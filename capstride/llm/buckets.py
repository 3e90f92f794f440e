"""Components of verified links between nodes that share a bucket, without pairing all members of a bucket."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, mix, stage
from .graph import relabel

#: Up to so many rows, and entries of their arrays, the small side of a join goes to every executor; above, both are
#: shuffled.  Rows and entries are a few longs each, so that this is some 50 MB at most.  Results do not depend on it.
BROADCAST_ROWS, BROADCAST_ENTRIES = 250_000, 1_000_000
#: Growth of a round's meetings of a node, and of the leaders of a bucket.
MEETINGS, LEADERS = 4, 8
#: Rounds before rest().
ROUNDS = 2
#: In buckets of at most so many nodes, every two are told apart at once; of larger ones, all nodes stay.
SEARCHED = 64
#: Rows of a bucket in one step above which they are dealt by node, when there are sims.
COMPANY = 8
#: Asking nodes, and asked ones, of a block.
BLOCK = 512


def beside(rows: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join `small` (whole numbers, and arrays of these) to `rows`: broadcast if its checked size allows, else by shuffling both."""
    arrays = [F.col(f.name) for f in small.schema if isinstance(f.dataType, T.ArrayType)]
    entries = sum((F.coalesce(F.size(c), F.lit(0)) for c in arrays), F.lit(0))
    n, total = small.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.sum(entries)).first()
    few = n <= BROADCAST_ROWS and (total or 0) <= BROADCAST_ENTRIES
    return rows.join(F.broadcast(small) if few else small, on, how)


def company(bucket: np.ndarray, node: np.ndarray, sim: np.ndarray | None = None) -> list[np.ndarray]:
    """Rows (bucket, node[, sim], n) that one step of a task sends to shared_buckets().

    What meets within the step is shared for sure: such rows have n = 0 and are dealt by node.  One row of the bucket
    stands for them, with n = 2; all others have n = 1.  So however common a bucket is, its own task gets one row of a
    step, or at most COMPANY rows with sims, as these are compared there.
    """
    by = np.lexsort((node, bucket))
    rows = [x[by] for x in ((bucket, node) if sim is None else (bucket, node, sim))]
    b, n = rows[:2]
    if not len(b):
        return [*rows, np.zeros(0, np.int64)]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])
    rows = [x[new] for x in rows]
    meets = _sizes(rows[0]) > (1 if sim is None else COMPANY)
    first = np.flatnonzero(meets)
    first = first[np.concatenate([[True], rows[0][first][1:] != rows[0][first][:-1]])] if len(first) else first
    at = np.concatenate([np.arange(len(meets)), first])
    return [*[x[at] for x in rows], np.concatenate([np.where(meets, 0, 1), np.full(len(first), 2)])]


def _sizes(b: np.ndarray) -> np.ndarray:
    """For each row of sorted buckets, its bucket's number of rows."""
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(b)))
    return np.repeat(count, count)


def shared_buckets(rows: DataFrame, near: Callable | None = None) -> DataFrame:
    """Of rows as company() makes them, (bucket, node[, sim, other]) of buckets with two nodes or more.

    With `near`, which tells of two arrays of 64-bit sims who may be linked, a bucket of at most SEARCHED rows gives
    instead the pairs (node, other) in it that may be linked: most buckets of many lines are chance meetings.  Rows and
    pairs may come twice; `other` is null in rows of larger buckets.  Partitions stream in order.
    """
    columns = ("bucket", "node", "n") + (("sim",) if near is not None else ())
    names = ["bucket", "node"] + (["sim", "other"] if near is not None else [])

    def run(batches):
        held = big = None  # rows of the last bucket, to be judged with what follows; a bucket of which rows are out
        for batch in batches:
            now = [batch.column(c).to_numpy() for c in columns]
            sure = now[2] == 0
            if sure.any():
                yield out([x[sure] for x in now])
                now = [x[~sure] for x in now]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            if last or len(now[0]) <= 4 * SEARCHED:
                held = [x[last:] for x in now]
                yield from judged([x[:last] for x in now], big)
            else:
                # one large bucket fills what is held: all its nodes have company
                held, big = [x[-1:] for x in now], now[0][-1]
                yield out([x[:-1][now[2][:-1] == 1] for x in now])
        if held is not None:
            yield from judged(held, big)

    def judged(now, big):
        b, n, stands = now[:3]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1]) | (stands[1:] != stands[:-1])
        now = [x[new] for x in now]
        b, n, stands = now[:3]
        if not len(b):
            return
        size = _sizes(b)
        # others of a row that stands for several are not here to be compared
        group = np.cumsum(np.concatenate([[0], b[1:] != b[:-1]]))
        small = (np.bincount(group, stands == 2)[group] == 0) & (size <= SEARCHED) if near is not None else np.zeros(len(b), bool)
        if big is not None:
            small &= b != big
        keep = (size > 1) & ~small
        if big is not None:
            keep |= b == big
        keep &= stands == 1
        yield out([x[keep] for x in now])
        for step in range(1, SEARCHED) if small.any() else ():
            at = np.flatnonzero((b[step:] == b[:-step]) & small[step:])
            if not len(at):
                break
            at = at[near(now[3][at], now[3][at + step])]
            if len(at):
                yield out([b[at], n[at], b[at], now[3][at]], n[at + step])

    def out(now, other=None):
        arrays = [pa.array(x) for c, x in zip(columns, now) if c != "n"]
        if near is not None:
            arrays.append(pa.nulls(len(arrays[0]), pa.int64()) if other is None else pa.array(other))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    place = F.when(F.col("n") == 0, F.xxhash64("node")).otherwise(F.col("bucket"))
    by = rows.select(*columns).repartition(place).sortWithinPartitions("bucket", "node", "n")
    return by.mapInArrow(run, ", ".join(f"{c} long" for c in names))


_RECORD = np.dtype([("low", "<u4"), ("high", "<u2"), ("node", "<i8"), ("sim", "<u8")])
#: Runs of buckets a partition, of which a task holds one at a time.
RUNS = 4


def packed_buckets(docs: DataFrame, keyed: Callable, near: Callable, width: int = 0) -> DataFrame:
    """What shared_buckets() gives, of the rows (keys of 48 bits, nodes, sims) that keyed(batch of `docs`) yields.

    Rows travel as packed records, one string of bytes for each run of buckets, and are sorted in workers: a row of its
    own takes Spark more than ten times as long.  Pairs have bucket and sim 0.  With a `width`, keyed() also yields nodes
    and arrays of so many bytes for each, which come back once as rows (node, wide) among the others.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # numbers of runs that Spark deals evenly over the partitions
    dealt = spark.range(64 * RUNS * parts).select(F.col("id").cast("int").alias("run"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("part")).collect()
    of: dict[int, list[int]] = {}
    for r in dealt:
        if len(of.setdefault(r["part"], [])) < RUNS:
            of[r["part"]].append(r["run"])
    places = np.array([run for runs in of.values() for run in runs], np.int32)

    wides = np.dtype([("node", "<i8"), ("wide", f"V{width}")])

    def deal(by_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = (mix(by_key) % np.uint64(len(places))).astype(np.int64)
        return to, np.argsort(to.astype(np.uint16) if len(places) < 65536 else to, kind="stable")

    def dealt_rows(to: np.ndarray, rows: np.ndarray, wide: bool) -> pa.RecordBatch:
        used, first = np.unique(to, return_index=True)
        at = np.append(first, len(rows)).tolist()
        packed = pa.array([rows[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(places[used]), pa.array([wide] * len(used), pa.bool_()), packed], names=["run", "wide", "rows"])

    def pack(batches):
        for batch in batches:
            for keys, nodes, sims, *more in keyed(batch):
                to, by = deal(keys)
                rows = np.empty(len(keys), _RECORD)
                rows["low"], rows["high"] = keys[by] & np.uint64(0xFFFFFFFF), keys[by] >> np.uint64(32)
                rows["node"], rows["sim"] = nodes[by], sims[by]
                yield dealt_rows(to[by], rows, False)
                if width and len(more[0]):
                    to, by = deal(more[0].astype(np.uint64))
                    rows = np.empty(len(by), wides)
                    rows["node"], rows["wide"] = more[0][by], np.ascontiguousarray(more[1][by]).view(f"V{width}")[:, 0]
                    yield dealt_rows(to[by], rows, True)

    def run(batches):
        last, held = None, []
        for batch in batches:
            for place, wide, rows in zip(*(batch.column(c).to_pylist() for c in ("run", "wide", "rows"))):
                if (place, wide) != last and held:
                    yield from (once if last[1] else met)(held)
                    held = []
                last = place, wide
                held.append(rows)
        if held:
            yield from (once if last[1] else met)(held)

    def once(held):
        rows = np.frombuffer(b"".join(held), wides)
        nodes, first = np.unique(rows["node"], return_index=True)
        none = pa.nulls(len(nodes), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(nodes), none, none, pa.array(rows["wide"][first].tolist(), pa.binary())], names=names)

    def met(held):
        rows = np.frombuffer(b"".join(held), _RECORD)
        bucket = (rows["high"].astype(np.uint64) << np.uint64(32) | rows["low"]).astype(np.int64)
        by = np.lexsort((rows["node"], bucket))
        b, n = bucket[by], rows["node"][by]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])
        b, n, by = b[new], n[new], by[new]
        size = _sizes(b)
        several = size > 1
        b, n, size, sim = b[several], n[several], size[several], rows["sim"][by[several]].view(np.int64)
        large = size > SEARCHED
        if large.any():
            yield out(b[large], n[large], sim[large], pa.nulls(int(large.sum()), pa.int64()))
        b, n, size, sim = b[~large], n[~large], size[~large], sim[~large]
        for step in range(1, SEARCHED):
            at = np.flatnonzero(b[step:] == b[:-step])
            if not len(at):
                break
            at = at[near(sim[at], sim[at + step])]
            zero = np.zeros(len(at), np.int64)
            yield out(zero, n[at], zero, pa.array(n[at + step]))

    def out(b, n, sim, other):
        return pa.RecordBatch.from_arrays([pa.array(b), pa.array(n), pa.array(sim), other] + ([pa.nulls(len(b), pa.binary())] if width else []), names=names)

    names = ["bucket", "node", "sim", "other"] + (["wide"] if width else [])
    packed = docs.mapInArrow(pack, "run int, wide boolean, rows binary").repartition(parts, "run").sortWithinPartitions("run", "wide")
    return packed.mapInArrow(run, "bucket long, node long, sim long, other long" + (", wide binary" if width else ""))


def in_blocks(open_: DataFrame, facts: list, solve: Callable, beside_: DataFrame | None = None, beside_how: str = "inner", names: tuple = ("a", "b"), block: int | None = None) -> DataFrame:
    """(a, b), or other whole numbers `names`, of what solve(bucket, parts) finds in blocks of at most some `block` (BLOCK) asking and `block` other nodes.

    `open_` is what bucket_components() hands to rest(); nodes that are not of a bucket's main component ask all others.
    A part is a batch of rows (node, component, other, asks, ...): the columns `facts`, and those of `beside_` (node, ...).
    Rows of a bucket with n nodes of which f ask are copied f / `block` times, and the asking ones n / `block` times; those of a
    bucket that is one block come once, with null for `asks`.
    """
    block = block or BLOCK
    rows = open_.select("bucket", "node", "component", (F.col("component") != F.col("main")).alias("other"), F.ceil(F.col("n") / block).alias("of"), F.ceil(F.col("others") / block).alias("by"), *facts)
    if beside_ is not None:
        rows = rows.join(beside_, "node", beside_how)
    place = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    several = rows.where("of > 1 or by > 1")
    none = F.lit(0).cast("long")
    once = rows.where("of = 1 and by = 1").select("*", F.lit(None).cast("boolean").alias("asks"), none.alias("i"), none.alias("j"))
    asking = several.where("other").select("*", F.lit(True).alias("asks"), place(1, "by").alias("i"), every("of").alias("j"))
    asked = several.select("*", F.lit(False).alias("asks"), every("by").alias("i"), place(2, "of").alias("j"))

    def run(batches):
        parts, last = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]]).tolist()
            for low, high in zip(edges, edges[1:]):
                if high > low:
                    key = tuple(keys[low].tolist())
                    if key != last and parts:
                        yield out(last[0], parts)
                        parts = []
                    last = key
                    parts.append(batch.slice(low, high - low))
        if parts:
            yield out(last[0], parts)

    def out(bucket, parts) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in solve(bucket, parts)], names=list(names))

    return once.unionByName(asking).unionByName(asked).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def meeting(parts: list[pa.RecordBatch]):
    """Of a block's parts: nodes, the indexes of those that ask and of the others, and which of these two may meet."""
    node, component, other = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("node", "component", "other"))
    asks, once = (np.concatenate([np.asarray(f(p.column("asks"))) for p in parts]) for f in (lambda c: c.fill_null(False), lambda c: c.is_null()))
    q, m = np.flatnonzero(asks | once & other), np.flatnonzero(~asks)
    # two that both ask meet once
    may = (component[q][:, None] != component[m][None, :]) & (~other[m][None, :] | (node[q][:, None] < node[m][None, :]))
    return node, q, m, may


def bucket_components(live: DataFrame, verify: Callable[[DataFrame], DataFrame], facts: DataFrame | None, possible: Callable, likeness: Callable, refine: Callable | None = None, rest: Callable | None = None, label: DataFrame | None = None, most_rounds: int = ROUNDS, led: int = 0) -> DataFrame | None:
    """(node, component) of all linked nodes, or None if nothing is linked; `label` is what is known before.

    `live` is staged rows (bucket, node) of buckets with two nodes or more.  `verify` turns pairs (a, b) into
    (a, b, linked).  `facts` (node, fact) has a struct for each node (None: `live` has the column fact); possible(fact, fact) is a native condition without
    which two nodes can't be linked, so that most pairs of one bucket are never made, and likeness(fact, fact) a native
    estimate of how similar two nodes are.  refine(nodes), if given, has better facts (node, fact) about those nodes that
    one round has left in buckets of several components; nodes that it leaves out can't be linked with any other of them.
    rest(open), if given, finds links (a, b) that connect what is left after `most_rounds` rounds, in place of further rounds:
    between every two nodes of a bucket of `open` (bucket, node, component, main, n, others, fact) that are linked, have
    different components and are not both of the component `main`, n being the bucket's nodes, `others` those not of `main`.
    With rest(), rounds are for buckets with more than `led` others, so that rest() has no square of a large group to do.

    Nodes in large buckets are popular: in a group of near copies, they are the ones most others resemble.  In each
    round, the m most popular nodes of a bucket lead, and a node outside the bucket's main component meets, of the
    leaders of all its buckets that it has not met and is not connected with, the k that it is most like.  Then components
    are computed anew; k and m start at 1 and grow, k more slowly than m.  So a group soon hangs together, and only what
    is similar to none of the leaders meets more of them.  It ends when no two nodes of a bucket are neither met nor
    connected, so that no link is lost.
    """
    if facts is None:
        live = live.withColumn("weight", F.lit(0).cast("long"))
    else:
        counts = live.groupBy("bucket").agg(F.count("*").alias("n"))
        weights = live.join(counts, "bucket").groupBy("node").agg(F.sum("n").alias("weight"))
        live = stage(live.join(weights.join(facts, "node"), "node"), "weighed")
    tried = None
    k = m = 1
    rounds = 0
    while True:
        if label is None:
            tagged = live.withColumn("component", F.col("node"))
        else:
            known = label.withColumnRenamed("node", "known")
            tagged = live.join(known, live.node == known.known, "left").select("bucket", "node", "weight", "fact", F.coalesce("component", "node").alias("component"))
        parts = tagged.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"))
        open_ = stage(tagged.join(mixed.where("parts > 1").select("bucket", F.col("main.component").alias("main"), "n", (F.col("n") - F.col("main.n")).alias("others")), "bucket"), "open")
        discard(live)
        most = open_.agg(F.max("n")).first()[0] or 0
        if not most:
            break
        live = open_.select("bucket", "node", "weight", "fact")
        live._staged_at = open_._staged_at
        if refine is not None and k > 1:
            better, refine = refine(live.select("node").distinct()), None
            live = stage(live.drop("fact").join(better, "node").select("bucket", "node", "weight", "fact"), "refined")
            discard(open_)
            continue
        large = open_ if rest is None or not led else open_.where(F.col("others") > led)
        if rest is not None and (rounds == most_rounds or not large.limit(1).count()):
            links = stage(rest(open_), "links")
            discard(open_)
            return stage(relabel(label, links), "labels") if links.limit(1).count() else label
        rounds += 1
        if facts is None:
            large = large.drop("weight").join(large.groupBy("node").agg(F.sum("n").alias("weight")), "node")
        if m == 1:
            best = F.max(F.struct("weight", "node", "component", "fact")).alias("best")
            leaders = large.groupBy("bucket").agg(best).select("bucket", F.col("best.weight").alias("weight_x"), F.col("best.node").alias("x"), F.col("best.component").alias("of_x"), F.col("best.fact").alias("fact_x"))
        else:
            # limited before the shuffle
            rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("weight"), F.desc("node")))
            leaders = large.withColumn("rank", rank).where(F.col("rank") <= m)
            leaders = leaders.select("bucket", F.col("weight").alias("weight_x"), F.col("node").alias("x"), F.col("component").alias("of_x"), F.col("fact").alias("fact_x"))
        met = large.where("component <> main").join(leaders, "bucket").where((F.col("component") != F.col("of_x")) & possible(F.col("fact"), F.col("fact_x")))
        met = met.select("node", "weight", "x", "weight_x", likeness(F.col("fact"), F.col("fact_x")).alias("like")).distinct()
        ahead = F.struct("weight_x", "x") > F.struct("weight", "node")
        met = met.withColumn("a", F.when(ahead, F.col("x")).otherwise(F.col("node"))).withColumn("b", F.when(ahead, F.col("node")).otherwise(F.col("x")))
        if tried is not None:
            met = met.join(tried, ["a", "b"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("like"), F.desc("weight_x"), F.desc("x")))
        pairs = stage(met.withColumn("rank", rank).where(F.col("rank") <= k).select("a", "b").distinct(), "pairs")
        if not pairs.limit(1).count():
            discard(pairs)
            if m >= most:
                break
            m *= LEADERS
            continue
        found = stage(verify(pairs), "links")
        discard(pairs)
        tried = found.select("a", "b") if tried is None else tried.unionByName(found.select("a", "b"))
        new = found.where("linked").select("a", "b")
        if new.limit(1).count():
            before, label = label, stage(relabel(label, new), "labels")
            discard(before)
        k, m = k * MEETINGS, m * LEADERS
    return label
