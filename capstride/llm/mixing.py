"""Mixing sources to target weights by entropy balancing.

Every document gets a rate min(cap, exp(lambda_s * size / mean_s)): of all rates that make a source's expected
words equal its target, the exponentially tilted ones have the least relative entropy to taking each document once.
The dual is convex with one variable a source, so that safeguarded Newton steps solve all sources at once; each step
is one distributed aggregation over the (source, size) histogram.  Rates then become whole copies by systematic
rounding along the sizes of a source, which keeps the taken words within about one document of the target, and a few
rounds that each move one well-fitting document of a source by one copy close most of the rest.

Defined cases: a null text has size 0; a null source is a source of its own, last in the order; documents of size 0
take 0 words; a source whose target reaches the cap gets the cap for all; an empty table gives an empty result;
other columns are ignored; repeated rows, and rows with equal doc_ids, are separate documents, of which each has copies of
its own; equal rates are rounded in the order of hashes of doc_id and text, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, global_rank, read, stage, word_count

WEIGHTS = (5, 2, 1)
CAP = 3.0
STEPS = 200
#: Rounds that move one document of each source after rounding.
REPAIRS = 3
TOLERANCE = 1e-7
#: Documents of one (source, size) that one ranking task orders.
BIN_ROWS = 20_000


def source_targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add rank, weight and target to rows (source, source_size), one for each source.

    Sources rank by code point, null last, and share the total by weight; a target stops at cap * source_size and the
    excess is shared again by weight until none is above.
    """
    ranked = global_rank(sources.withColumn("__null", F.col("source").isNull()), ["__null", "source"], "rank").drop("__null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stage(ranked.withColumn("weight", weight), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(float(cap))
    level, full = 0.0, -1
    while True:
        # all sources whose cap lies below the present level are full; the others share what these leave
        is_full = limit <= F.lit(level) * F.col("weight")
        n, taken, left = ranked.agg(
            F.count(F.when(is_full, 1)), F.sum(F.when(is_full, limit)), F.sum(F.when(~is_full, F.col("weight")))
        ).first()
        if n == full or not left:
            break
        full, level = n, (total - (taken or 0.0)) / left
    return ranked.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def balance(histogram: DataFrame, targets: DataFrame, cap: float = CAP, steps: int = STEPS) -> DataFrame:
    """Solve the dual: rows (source, lam, mean) for `histogram` (source, size, n) and `targets` (source, source_size, target).

    A Newton step that leaves the bracket of its source is replaced by bisection, so that it always converges: STEPS are
    more than bisections alone take.
    """
    spark = histogram.sparkSession
    used = histogram.where("size > 0")
    base = used.groupBy("source").agg(
        (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least")
    )
    t = F.col("target") / F.col("source_size")
    # at `hi` even the shortest document is at the cap; at `lo` every document's rate is below the target's share
    state = targets.where("source_size > 0").alias("t").join(base.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source"))).select(
        "t.source", "target", "mean", F.lit(0.0).alias("lam"),
        F.when(t <= 0, F.lit(-700.0)).otherwise(F.least(F.lit(-1e-9), F.log(t) * F.col("mean") / F.col("least"))).alias("lo"),
        (F.lit(float(cap)).cast("double") * 0 + F.log(F.lit(float(cap))) * F.col("mean") / F.col("least") + 1e-9).alias("hi"),
        F.lit(False).alias("done"),
    )
    state = stage(state, "dual")
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        rate = F.least(tilt, F.lit(float(cap)))
        slope = F.when(tilt < cap, tilt * x).otherwise(0.0)
        sums = used.alias("h").join(state.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).groupBy("s.source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * F.col("size") * slope).alias("slope")
        )
        gap = F.col("got") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("g.slope") > 0, F.col("lam") - gap / F.col("g.slope"))
        step = state.alias("s").join(sums.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(
            "s.source", "target", "mean", "lam", lo.alias("lo"), hi.alias("hi"), newton.alias("newton"),
            (F.abs(gap) <= F.col("target") * TOLERANCE).alias("done"),
        )
        middle = (F.col("lo") + F.col("hi")) / 2
        inside = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        stuck = F.col("hi") - F.col("lo") <= 1e-12
        before, state = state, stage(step.select(
            "source", "target", "mean",
            F.when(F.col("done"), F.col("lam")).when(inside, F.col("newton")).otherwise(middle).alias("lam"),
            "lo", "hi", (F.col("done") | stuck).alias("done"),
        ), "dual")
        discard(before)
        if not state.where("not done").limit(1).count():
            break
    return state.select("source", "lam", "mean")


def mix(sized: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add source_size, target, rate and copies to rows (doc_id, source, size, text_hash, row, ...), as sizes() makes them."""
    sized = stage(sized, "sizes")
    histogram = stage(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = stage(source_targets(sources, weights, cap), "targets")
    dual = balance(histogram, targets, cap)
    full = F.col("target") >= F.col("source_size") * F.lit(float(cap) * (1 - 1e-12))
    rates = histogram.alias("h").join(targets.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source"))).join(
        dual.alias("d"), F.col("h.source").eqNullSafe(F.col("d.source")), "left"
    ).select(
        "h.source", "h.size", "h.n", "source_size", "target",
        F.when(F.col("h.size") == 0, F.lit(1.0)).when(full, F.lit(float(cap))).otherwise(
            F.least(F.exp(F.least(F.col("lam") * F.col("h.size") / F.col("mean"), F.lit(50.0))), F.lit(float(cap)))
        ).alias("rate"),
        F.ceil(F.col("n") / BIN_ROWS).cast("int").alias("bins"),
    )
    rates = stage(rates, "rates")
    token = F.xxhash64("doc_id")
    placed = sized.alias("x").join(
        rates.alias("r"), F.col("x.source").eqNullSafe(F.col("r.source")) & (F.col("x.size") == F.col("r.size"))
    ).select("x.*", "source_size", "target", "rate", token.alias("token"), F.pmod(token, F.col("bins")).cast("int").alias("bin"))
    # the share that whole copies leave accumulates along (size, bin) within a source
    part = F.col("rate") - F.floor("rate")
    bins = placed.groupBy("source", "size", "bin").agg(F.count("*").alias("bin_n"), F.first("rate").alias("bin_rate"))
    share = F.col("bin_n") * (F.col("bin_rate") - F.floor("bin_rate"))
    along = Window.partitionBy("source").orderBy("size", "bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum(share).over(along), F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bin").orderBy("token", "doc_id", "text_hash", "row"))
    placed = placed.withColumn("rank", rank)
    after = F.floor(F.col("before") + F.col("rank") * part + 0.5)
    extra = after - F.floor(F.col("before") + (F.col("rank") - 1) * part + 0.5)
    joined = placed.alias("p").join(
        bins.alias("b"),
        F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.size") == F.col("b.size")) & (F.col("p.bin") == F.col("b.bin")),
    )
    copies = F.least(F.floor("rate") + extra, F.lit(int(cap))).cast("long")
    return repair(stage(joined.withColumn("copies", copies).select("p.*", "copies").drop("token", "bin", "rank"), "copies"), cap)


def repair(mixed: DataFrame, cap: float = CAP, rounds: int = REPAIRS) -> DataFrame:
    """Bring each source nearer its target: a round adds or drops one copy of the document whose size fits the gap best."""
    for k in range(rounds):
        gaps = mixed.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        change = F.signum("gap").cast("long")
        fits = (F.col("size") > 0) & (F.col("copies") + change).between(0, int(cap)) & (F.col("size") < 2 * F.abs("gap"))
        gaps = mixed.join(gaps.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        best = gaps.where(fits).groupBy("s").agg(
            F.min(F.struct(F.abs(F.col("size") - F.abs("gap")), "doc_id", "text_hash", "row")).alias("best"), F.first(change).alias("change")
        ).select(F.col("best.row").alias("chosen"), "change")
        # one row of each source
        moved = mixed.join(best, F.col("row") == F.col("chosen"), "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
        before, mixed = mixed, moved.drop("chosen", "change")
        if k + 1 < rounds:
            mixed = stage(mixed, "copies")
            discard(before)
    return mixed


def sizes(docs: DataFrame, row=None) -> DataFrame:
    """(doc_id, source, size, text_hash, row) of documents; the size is the number of words, `row` tells rows apart."""
    row = F.monotonically_increasing_id() if row is None else row
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), row.alias("row"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document of `documents`."""
    mixed = mix(sizes(read(spark, sf_dir, "documents")))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate"
    )
