"""Loads of shards, skew, pressure, rates, and figures of load runs.  All native."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native


def shard_loads(rows: DataFrame, shard: str, size: str, flow: str) -> DataFrame:
    """Packets, bytes and distinct flows of each shard."""
    return rows.groupBy(shard).agg(F.count("*").alias("packets"), F.sum(size).alias("bytes"), F.count_distinct(flow).alias("flows"))


def skew(loads: DataFrame, column: str, name: str) -> DataFrame:
    """max * shards * 1000 / total, truncated."""
    return loads.agg(native.milli(F.max(column) * F.count("*"), F.sum(column)).alias(name))


def busiest(loads: DataFrame, shard: str, column: str) -> DataFrame:
    """The shard with most; of equals, the last."""
    return loads.agg(F.max(F.struct(column, shard)).alias("m")).select(f"m.{shard}", f"m.{column}")


def hot_flows(rows: DataFrame, shard: str, flow: str, size: str) -> DataFrame:
    """The flow with most bytes of each shard, and its share in thousandths."""
    by = rows.groupBy(shard, flow).agg(F.sum(size).alias("bytes"), F.count("*").alias("packets"))
    # of equal flows, the smallest id; two aggregations need no sort of a shard
    best = by.groupBy(shard).agg(F.max("bytes").alias("bytes"), F.sum("bytes").alias("total"))
    top = by.join(best, [shard, "bytes"]).groupBy(shard, "bytes", "total").agg(F.min(flow).alias(flow), F.min_by("packets", flow).alias("packets"))
    return top.withColumn("share_milli", native.milli(F.col("bytes"), F.col("total")))


# Fixed values, in thousandths: skew and fill from which shards are watched, hot and saturated; fallback routes.
WATCH_PACKET_SKEW, HOT_PACKET_SKEW = 1800, 3000
WATCH_BYTE_SKEW, HOT_BYTE_SKEW = 2200, 3500
WATCH_FILL, HOT_FILL, SATURATED_FILL = 600, 750, 900
WATCH_FALLBACK = 10


def pressure(snapshot: DataFrame) -> DataFrame:
    """state and warnings of rows (shards, packets, packet_skew, byte_skew, queue_fill, output_fill, fallback, malformed, elephants)."""
    queue, output = F.col("queue_fill"), F.col("output_fill")
    rules = (
        (F.col("shards") <= 1, "single_shard"), (F.col("packet_skew") >= WATCH_PACKET_SKEW, "packet_skew"), (F.col("byte_skew") >= WATCH_BYTE_SKEW, "byte_skew"),
        (F.col("elephants") > 0, "elephant_flow"), (queue >= WATCH_FILL, "worker_queue_pressure"), (output >= WATCH_FILL, "output_queue_pressure"),
        (F.col("fallback") * 1000 >= F.col("packets") * WATCH_FALLBACK, "fallback_routes"), (F.col("malformed") > 0, "malformed_fallback"),
    )
    warnings = F.array_compact(F.array(*[F.when(c & (F.col("packets") > 0), n) for c, n in rules]))
    fill = F.greatest(queue, output)
    state = (
        F.when(F.col("packets") == 0, "idle").when(fill >= SATURATED_FILL, "saturated")
        .when((F.col("packet_skew") >= HOT_PACKET_SKEW) | (F.col("byte_skew") >= HOT_BYTE_SKEW) | (fill >= HOT_FILL), "hot")
        .when(F.size(warnings) == 0, "healthy").otherwise("watch")
    )
    return snapshot.withColumn("state", state).withColumn("warnings", F.concat_ws(",", warnings))


def rates(snapshots: DataFrame, key: str, order: str, at_us: str, column: str) -> DataFrame:
    """Change of a counter by second since the snapshot before; null for the first and for no time between."""
    before = Window.partitionBy(key).orderBy(order)
    elapsed = F.col(at_us) - F.lag(at_us).over(before)
    return snapshots.withColumn("per_second", F.when(elapsed > 0, (F.col(column) - F.lag(column).over(before)) * 1e6 / elapsed))


def run_aggregates(runs: DataFrame) -> DataFrame:
    """Figures of rows (workers, warmup, packets, bytes, elapsed_ms) for each worker count; warmups are left out."""
    per = F.col("packets") * 1000 / F.col("elapsed_ms")
    return runs.where(~F.col("warmup")).groupBy("workers").agg(
        F.count("*").alias("runs"), F.min(per).alias("min_pps"), F.avg(per).alias("avg_pps"), F.median(per).alias("median_pps"), F.max(per).alias("max_pps"),
        F.avg(F.col("bytes") / 1e3 / F.col("elapsed_ms")).alias("avg_mb_s"), F.avg("elapsed_ms").alias("avg_ms"),
    )


def distribution(loads: DataFrame, column: str) -> DataFrame:
    """Extremes, mean and their ratios; max/min is null when the least is 0."""
    low, high, mean = F.min(column), F.max(column), F.avg(column)
    return loads.agg(low.alias("least"), high.alias("most"), mean.alias("average"), (high / mean).alias("max_to_average"), F.when(low != 0, high / low).alias("max_to_min"))


def compare_to_baseline(current: DataFrame, baseline: DataFrame, limit_percent: float = 10.0) -> DataFrame:
    """Change of avg_pps by worker count: missing_baseline, regression below -limit_percent, else ok."""
    rows = current.select("workers", "avg_pps").join(baseline.select("workers", F.col("avg_pps").alias("base_pps")), "workers", "left")
    change = F.when(F.col("base_pps") > 0, (F.col("avg_pps") - F.col("base_pps")) * 100 / F.col("base_pps"))
    status = F.when(change.isNull(), "missing_baseline").when(change < -limit_percent, "regression").otherwise("ok")
    return rows.withColumn("change_percent", change).withColumn("status", status)


def parser_counters(rows: DataFrame) -> DataFrame:
    """Chunks, bytes, messages and errors of the fold's tagged rows."""
    message = F.col("tag") == "message"
    return rows.agg(
        F.count_if(F.col("tag") == "chunk").alias("chunks"), F.coalesce(F.sum(F.when(F.col("tag") == "chunk", F.col("size"))), F.lit(0)).alias("chunk_bytes"),
        F.count_if(message).alias("messages"), *[F.count_if(message & (F.col("protocol") == p)).alias(p) for p in ("http1", "dns", "websocket", "tls")],
        F.count_if(message & (F.col("kind") == "parse_error")).alias("parse_errors"), F.count_if(F.col("tag") == "stream").alias("stream_events"),
        F.coalesce(F.sum(F.when(F.col("tag") == "dropped", F.col("size"))), F.lit(0)).alias("dropped"),
        *[F.count_if(message & (F.col("kind") == "parse_error") & (F.col("protocol") == p)).alias(f"{p}_errors") for p in ("http1", "dns", "websocket", "tls")],
    )


def health(decoded: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: decode counters beside parser counters."""
    from .packets import decode_counters

    return decode_counters(decoded).join(F.broadcast(parser_counters(rows)), F.lit(True))  # one row each


def save_report(runs: DataFrame, path: str) -> None:
    runs.write.mode("overwrite").json(path)


def load_report(spark, path: str) -> DataFrame:
    return spark.read.json(path)
