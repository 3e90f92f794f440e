"""Decode packets, and what follows from decoded rows natively: counters, filters, flow keys, flow aggregates."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native, wire

PACKETS = "packet_no long, ts_sec long, ts_usec int, link_layer string, linktype int, data binary"
_TEXT = ("status", "protocol")
DECODED = (
    "packet_no long, ts_sec long, ts_usec int, link_layer string, linktype int, length long, status string, protocol string, family int,"
    " src binary, dst binary, sport int, dport int, seq long, ack long, flags int, window int, payload binary, stream_id_hex string"
)
_FIELDS = ("status", "protocol", "family", "src", "dst", "sport", "dport", "seq", "ack", "flags", "window", "payload")
_TYPES = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
ERRORS = ("malformed", "unsupported_link")
SWEEP_PACKETS, IDLE_SECONDS = 16_384, 120


def decode(packets: DataFrame) -> DataFrame:
    """One row for each packet with status, addresses, ports, TCP fields, payload and the id of its flow."""

    def run(batches):
        known: dict[tuple, str] = {}
        for b in batches:
            layers, raws = b.column("link_layer").to_pylist(), b.column("data").to_pylist()
            rows = [wire.decode(layer or "unsupported", raw) if raw is not None else {"status": "malformed"} for layer, raw in zip(layers, raws)]
            ids = []
            for r in rows:
                if r.get("sport") is None:
                    ids.append(None)
                    continue
                ends = sorted([(len(r["src"]), r["src"], r["sport"]), (len(r["dst"]), r["dst"], r["dport"])])
                key = (r["protocol"], *ends)
                if key not in known:
                    if len(known) > 500_000:
                        known.clear()
                    known[key] = f"{wire.stream_id(r['protocol'], ends[0][1], ends[0][2], ends[1][1], ends[1][2]):016x}"
                ids.append(known[key])
            columns = [b.column(c) for c in ("packet_no", "ts_sec", "ts_usec", "link_layer", "linktype")]
            columns.append(pa.array([len(x or b"") for x in raws], pa.int64()))
            columns += [pa.array([r.get(f) for r in rows], t) for f, t in zip(_FIELDS, _TYPES)]
            columns.append(pa.array(ids, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DECODED.split(", ")])

    return packets.select("packet_no", "ts_sec", "ts_usec", "link_layer", "linktype", "data").mapInArrow(run, DECODED.replace(", ", ","))


def decode_counters(decoded: DataFrame) -> DataFrame:
    """Packets by status, and decode errors."""
    names = ("parsed", "non_ip", "fragmented", "unsupported_transport", "malformed", "unsupported_link")
    return decoded.agg(
        F.count("*").alias("packets"), *[F.count_if(F.col("status") == n).alias(n) for n in names], F.count_if(F.col("status").isin(*ERRORS)).alias("decode_errors")
    )


def drop_errors(decoded: DataFrame) -> DataFrame:
    return decoded.where(~F.col("status").isin(*ERRORS))


def link_layers(packets: DataFrame) -> DataFrame:
    """link_layer by linktype."""
    known = F.create_map(*[F.lit(x) for kv in wire.LINK_LAYERS.items() for x in kv])
    return packets.withColumn("link_layer", F.coalesce(known[F.col("linktype")], F.lit("unsupported")))


def packet_filter(text: str) -> Column:
    """A predicate over decoded rows from a capture filter: tcp, udp, icmp, [src|dst] host|port|net X, and, or, not, ( )."""
    tokens = re.findall(r"[()]|[^\s()]+", text.lower())
    at = 0

    def side(source: Column, target: Column, which: str | None) -> Column:
        return source if which == "src" else target if which == "dst" else source | target

    def primary() -> Column:
        nonlocal at
        if at >= len(tokens):
            raise ValueError("filter ends early")
        word, at = tokens[at], at + 1
        if word == "(":
            out = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError("missing )")
            at += 1
            return out
        if word in ("not", "!"):
            return ~primary()
        which = None
        if word in ("src", "dst"):
            which, word, at = word, tokens[at], at + 1
        if word in ("tcp", "udp", "icmp", "ip", "ip6") and which is None:
            out = {
                "tcp": F.col("protocol") == "tcp", "udp": F.col("protocol") == "udp", "icmp": F.col("protocol") == "icmpv4",
                "ip": F.col("family") == 4, "ip6": F.col("family") == 6,
            }[word]
            if at < len(tokens) and tokens[at] in ("port", "host", "src", "dst", "net"):
                out = out & primary()
            return F.coalesce(out, F.lit(False))
        value, at = tokens[at], at + 1
        if word == "port":
            out = side(F.col("sport") == int(value), F.col("dport") == int(value), which)
        elif word == "host":
            raw = F.lit(wire.pack_address(value))
            out = side(F.col("src") == raw, F.col("dst") == raw, which)
        elif word == "net":
            import ipaddress

            net = ipaddress.ip_network(value)
            low, high = F.lit(net.network_address.packed), F.lit(net.broadcast_address.packed)
            inside = lambda c: (F.length(c) == len(net.network_address.packed)) & c.between(low, high)
            out = side(inside(F.col("src")), inside(F.col("dst")), which)
        else:
            raise ValueError(f"unknown filter word {word}")
        return F.coalesce(out, F.lit(False))

    def both() -> Column:
        nonlocal at
        out = primary()
        while at < len(tokens) and tokens[at] in ("and", "&&"):
            at += 1
            out = out & primary()
        return out

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(tokens) and tokens[at] in ("or", "||"):
            at += 1
            out = out | both()
        return out

    out = either()
    if at != len(tokens):
        raise ValueError(f"unexpected {tokens[at]}")
    return out


def with_flow(decoded: DataFrame) -> DataFrame:
    """Rows with ports get canonical endpoints a <= b and a direction; equal endpoints are a_to_b."""
    source = F.struct(F.col("family"), F.col("src").alias("address"), F.col("sport").alias("port"))
    target = F.struct(F.col("family"), F.col("dst").alias("address"), F.col("dport").alias("port"))
    return (
        decoded.where(F.col("sport").isNotNull())
        .withColumn("a", F.least(source, target)).withColumn("b", F.greatest(source, target))
        .withColumn("direction", F.when(source <= target, "a_to_b").otherwise("b_to_a"))
        .withColumn("ts_us", F.col("ts_sec") * 1_000_000 + F.col("ts_usec"))
    )


def flows(keyed: DataFrame, by: tuple = ("stream_id_hex",)) -> DataFrame:
    """One row for each flow: times, packets, bytes; last_seen is that of the latest arrival."""
    size = F.coalesce(F.length("payload"), F.lit(0)).cast("long")
    ways = []
    for way in ("a_to_b", "b_to_a"):
        here = F.col("direction") == way
        flag = lambda bit: F.bool_or(here & (F.col("flags").bitwiseAND(bit) != 0))  # noqa: E731, B023
        ways += [
            F.count_if(here).alias(f"packets_{way}"), F.sum(F.when(here, F.col("length")).otherwise(0)).alias(f"bytes_{way}"),
            F.sum(F.when(here, size).otherwise(0)).alias(f"payload_{way}"), F.coalesce(flag(1), F.lit(False)).alias(f"fin_{way}"),
        ]
    out = keyed.groupBy(*by).agg(
        F.min_by("ts_us", "packet_no").alias("first_seen_us"), F.max_by("ts_us", "packet_no").alias("last_seen_us"), F.count("*").alias("packets"),
        F.sum("length").alias("bytes"), F.sum(size).alias("payload_bytes"), *ways, F.coalesce(F.bool_or(F.col("flags").bitwiseAND(4) != 0), F.lit(False)).alias("reset"),
        F.first("protocol").alias("protocol"), F.first("a").alias("a"), F.first("b").alias("b"),
    )
    return out.withColumn("finished", F.col("reset") | F.col("fin_a_to_b") & F.col("fin_b_to_a"))


def running_counts(keyed: DataFrame, by: tuple = ("stream_id_hex",)) -> DataFrame:
    """Each packet with its flow's packets and bytes so far, and whether it is the flow's first."""
    so_far = Window.partitionBy(*by).orderBy("packet_no").rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(so_far)
    return keyed.withColumn("flow_packets", n).withColumn("flow_bytes", F.sum("length").over(so_far)).withColumn("is_new", n == 1)


def epochs(rows: DataFrame, key: str, order: str, ts_us: str, interval: int = SWEEP_PACKETS, timeout_s: int = IDLE_SECONDS, nth: str | None = None) -> DataFrame:
    """Number a key's lives: a new one starts when a sweep between two of its rows found it idle.

    Sweeps run before each row whose arrival number is divisible by `interval`; `nth` names that number (from 1).
    A sweep table has one row for each `interval` rows.
    """
    sweeps = rows.where(F.col(nth) % interval == 0).select(F.col(nth).alias("sweep"), F.col(ts_us).alias("sweep_us"))
    lag = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("__before", F.lag(nth).over(lag)).withColumn("__seen", F.lag(ts_us).over(lag))
    # only pairs of rows with a sweep between them can part; those are joined by the sweep's number
    crossing = rows.where(F.floor(F.col(nth) / interval) > F.floor(F.col("__before") / interval)).select(
        key, order, "__before", "__seen", F.explode(F.sequence(F.floor(F.col("__before") / interval) + 1, F.floor(F.col(nth) / interval))).alias("k")
    )
    idle = crossing.join(sweeps.withColumn("k", F.col("sweep") / interval), "k").where(F.col("sweep_us") - F.col("__seen") > timeout_s * 1_000_000)
    starts = idle.select(key, order).distinct().withColumn("__new", F.lit(1))
    out = rows.drop("__before", "__seen").join(starts, [key, order], "left")
    return out.withColumn("epoch", F.coalesce(F.sum("__new").over(lag.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("__new")


def dump_events(packets: DataFrame) -> DataFrame:
    """Each packet as an event with its bytes in Base64; nothing is decoded."""
    return packets.select(
        "packet_no", "ts_sec", "ts_usec", F.lit("packet").alias("analyzer"), F.lit("raw_packet").alias("event_type"), F.length("data").cast("long").alias("length"),
        "link_layer", "linktype", F.to_json(F.struct(native.base64("data").alias("data_base64"))).alias("fields"),
    )


def capped_flows(keyed: DataFrame, most: int, timeout_s: int = IDLE_SECONDS) -> DataFrame:
    """Add `epoch` and `evicted` as a table of at most `most` flows would give them: exact, and so in one partition.

    A new flow in a full table first ends idle flows, else the one seen longest ago (of equals, the smallest id).
    """
    import heapq

    def run(batches):
        seen: dict[str, int] = {}
        epoch: dict[str, int] = {}
        heap: list[tuple[int, str]] = []
        for b in batches:
            ids, times = b.column("stream_id_hex").to_pylist(), b.column("ts_us").to_pylist()
            lives, ended = [], []
            for s, us in zip(ids, times):
                gone = 0
                if s not in seen:
                    if len(seen) >= most:
                        idle = [k for k, v in seen.items() if us - v > timeout_s * 1_000_000]
                        for k in idle:
                            del seen[k]
                        gone = len(idle)
                        while len(seen) >= most:
                            last, k = heapq.heappop(heap)
                            if seen.get(k) == last:
                                del seen[k]
                                gone += 1
                    epoch[s] = epoch.get(s, -1) + 1
                seen[s] = us
                heapq.heappush(heap, (us, s))
                lives.append(epoch[s])
                ended.append(gone)
            yield pa.RecordBatch.from_arrays([b.column("packet_no"), b.column("stream_id_hex"), pa.array(lives, pa.int64()), pa.array(ended, pa.int64())], names=["packet_no", "stream_id_hex", "epoch", "evicted"])

    rows = keyed.select("packet_no", "stream_id_hex", "ts_us").coalesce(1).sortWithinPartitions("packet_no")
    return rows.mapInArrow(run, "packet_no long, stream_id_hex string, epoch long, evicted long")


def routes(decoded: DataFrame, shards: int) -> DataFrame:
    """shard and fallback_reason: flows go by their id, the rest in turn by packet_no.

    Datagrams of flows with 1024 packets or more are dealt over all shards, for work without state.
    """
    busy = decoded.where("protocol = 'udp' and stream_id_hex is not null").groupBy("stream_id_hex").agg(F.count("*").alias("n")).where("n >= 1024")
    rows = decoded.join(busy.select("stream_id_hex", F.lit(True).alias("striped")), "stream_id_hex", "left")
    turn = F.pmod(F.col("packet_no"), F.lit(shards))
    shard = F.when(F.col("stream_id_hex").isNull() | F.coalesce("striped", F.lit(False)), turn).otherwise(F.pmod(F.xxhash64("stream_id_hex"), F.lit(shards)))
    reason = F.when(F.col("stream_id_hex").isNull(), F.when(F.col("status") == "parsed", "no_ports").otherwise(F.col("status")))
    return rows.withColumn("shard", shard.cast("int")).withColumn("fallback_reason", reason).withColumn("striped", F.coalesce("striped", F.lit(False)))
