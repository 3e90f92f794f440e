"""One ordered pass over each flow: reassembly, inventory events, detection, protocol messages.

The fold runs once for a flow with rows sorted by packet_no; only what needs state from packet to packet is in it.
Its rows carry a `tag`: observation, chunk, stream, message, dropped (its size: messages beyond MESSAGES_PER_CHUNK of a
chunk) or http.  A flow's rows come in batches, so that state, not
rows, bounds its memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import detection, parsers, wire
from ..functions.reassembly import MAX_BYTES, MAX_SEGMENTS, Direction, Step, step

ROWS = (
    "stream_id_hex string, packet_no long, event_no long, tag string, direction string, status string, protocol string, kind string, service string, side string,"
    " confidence int, source string, evidence string, content_kind string, seq long, start long, size long, ordinal long, summary string, id_hex string, data binary, fields string"
)
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
SCHEMA = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in ROWS.split(", ")])
UPDATE_PACKETS, UPDATE_BYTES, MESSAGES_PER_CHUNK = 64, 64 << 10, 512
#: What the fold needs of a keyed row.
INPUT = ("stream_id_hex", "packet_no", "ts_us", "protocol", "direction", "seq", "flags", "payload", "a_port", "b_port")
DNS_SERVICES = ("dns", "mdns", "llmnr", "netbios")


@dataclass
class Flow:
    """All state of a flow."""

    stream: str
    protocol: str
    a_port: int
    b_port: int
    max_segments: int = MAX_SEGMENTS
    max_bytes: int = MAX_BYTES
    update_packets: int = UPDATE_PACKETS
    update_bytes: int = UPDATE_BYTES
    ways: dict = field(default_factory=lambda: {False: Direction(), True: Direction()})
    seen: detection.Evidence | None = None
    lifecycle: str = "open"
    fins: set = field(default_factory=set)
    classes: dict = field(default_factory=lambda: {False: detection.Classes(), True: detection.Classes()})
    logical: dict = field(default_factory=lambda: {False: 0, True: 0})
    parsers: parsers.FlowParsers = field(default_factory=parsers.FlowParsers)
    http: dict = field(default_factory=lambda: {False: parsers.HttpEvents(), True: parsers.HttpEvents()})
    datagrams: dict = field(default_factory=lambda: {False: [0, 0], True: [0, 0]})
    packets: int = 0
    since: list = field(default_factory=lambda: [0, 0])
    told: tuple | None = None
    events: int = 0
    dns_port: bool = False

    def __post_init__(self):
        # a client's own port may be another service's, which then names the flow; its datagrams are read all the same
        self.dns_port = any(detection.PORTS.get((self.protocol, p), ("",))[0] in DNS_SERVICES for p in (self.a_port, self.b_port))

    def row(self, tag: str, no: int, back: bool, **more) -> dict:
        self.events += 1
        return {"stream_id_hex": self.stream, "packet_no": no, "event_no": self.events, "tag": tag, "direction": "b_to_a" if back else "a_to_b", **more}

    def kind(self) -> str:
        both = detection.combine_kinds(self.classes[False].kind(), self.classes[True].kind())
        return detection.adjust_kind(both, self.seen.service)

    @staticmethod
    def facts(did: Step, way: Direction) -> str:
        """A step's marks and its direction's state after it, as JSON."""
        tell = lambda x: "null" if x is None else x
        marks = f'"gap": {str(did.gap).lower()}, "mid_stream": {str(did.mid_stream).lower()}, "waiting": {len(way.waiting)}, "waiting_bytes": {way.waiting_bytes}'
        return f'{{{marks}, "expected": {tell(way.expected)}, "initial": {tell(way.initial)}, "highest": {tell(way.highest)}}}'

    def push(self, no: int, back: bool, seq: int | None, flags: int | None, payload: bytes) -> Iterator[dict]:
        """The rows of one packet, in the order: observation, stream event, datagram message, then chunks with theirs."""
        payload = payload or b""
        if self.protocol == "tcp":
            did = step(self.ways[back], self.ways[not back].waiting_bytes, seq, flags, payload, self.max_segments, self.max_bytes)
            chunks, status = did.chunks, did.status
            yield self.row("observation", no, back, status=status, seq=seq, size=len(payload), fields=self.facts(did, self.ways[back]))
            if status in ("fin", "reset"):
                self.fins |= {True, False} if status == "reset" else {back}
                self.lifecycle = "closed" if len(self.fins) == 2 else "closing"
        else:
            chunks, status = [(None, payload, "datagram")] if payload else [], "datagram"
            yield self.row("observation", no, back, status=status, size=len(payload))
        first = self.seen is None
        self.seen = self.seen or detection.by_port(self.protocol, self.a_port, self.b_port)
        for _, data, _ in chunks:
            self.classes[back].add(data)
            found = detection.by_payload(self.protocol, self.a_port, self.b_port, not back, data)
            if found:
                self.seen = detection.merge(self.seen, found)
        self.packets += 1
        self.since[0] += 1
        self.since[1] += sum(len(c[1]) for c in chunks)
        now = (self.lifecycle, self.kind(), self.seen.service)
        if first or now != self.told or self.since[0] >= self.update_packets or self.since[1] >= self.update_bytes:
            self.told, self.since = now, [0, 0]
            e = self.seen
            yield self.row(
                "stream", no, back, kind="stream_open" if first else "stream_update", status=self.lifecycle, service=e.service, side=e.side,
                confidence=e.confidence, source=e.source, evidence=e.evidence, content_kind=now[1], protocol=self.protocol,
            )
        if self.protocol == "udp" and payload:
            ordinal, start = self.datagrams[back]
            if (self.seen.service in DNS_SERVICES or self.dns_port) and detection.is_dns("udp", payload):
                m = parsers.parse_dns(payload, ordinal, start)
                if m:
                    self.datagrams[back][0] += 1
                    yield self.message(no, back, m)
            self.datagrams[back][1] += len(payload)
        for place, data, source in chunks:
            yield self.row("chunk", no, back, seq=place, source=source, start=self.logical[back], size=len(data), data=data)
            self.logical[back] += len(data)
            if self.protocol == "tcp":
                found = self.parsers.push(back, data, detection.is_tls_record(data))
                for m in found[:MESSAGES_PER_CHUNK]:
                    yield self.message(no, back, m)
                if len(found) > MESSAGES_PER_CHUNK:
                    yield self.row("dropped", no, back, size=len(found) - MESSAGES_PER_CHUNK)
                for e in self.http[back].push(data):
                    yield self.row("http", no, back, kind=e["event_type"], summary=e["summary"], size=e["body_bytes_expected"], fields=json.dumps(e))

    def message(self, no: int, back: bool, m: dict) -> dict:
        mid = wire.message_id(int(self.stream, 16), m["ordinal"], back)
        return self.row(
            "message", no, back, protocol=m["protocol"], kind=m["kind"], status=m["status"], ordinal=m["ordinal"], summary=m["summary"], start=m["logical_start"],
            size=m["logical_end"] - m["logical_start"], source=parsers.event_type(m), id_hex=f"{mid:016x}",
            fields=json.dumps({"header_bytes": m["header_bytes"], "body_bytes": m["body_bytes"], **m["info"]}, sort_keys=True),
        )


def to_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], SCHEMA.field(n).type) for n in _NAMES], schema=SCHEMA)


def fold(keyed: DataFrame, **limits) -> DataFrame:
    """Tagged rows of all flows; a flow's packets are sorted within its partition and streamed through its state."""
    rows = keyed.select(*[F.col(c) for c in INPUT[:-2]], F.col("a.port").alias("a_port"), F.col("b.port").alias("b_port"))

    def run(batches):
        flow, out = None, []
        for b in batches:
            for r in b.to_pylist():
                if flow is None or flow.stream != r["stream_id_hex"]:
                    flow = Flow(r["stream_id_hex"], r["protocol"], r["a_port"], r["b_port"], **limits)
                out += flow.push(r["packet_no"], r["direction"] == "b_to_a", r["seq"], r["flags"], r["payload"])
                if len(out) >= 2048:
                    yield to_batch(out)
                    out = []
        if out:
            yield to_batch(out)

    return rows.repartition("stream_id_hex").sortWithinPartitions("stream_id_hex", "packet_no").mapInArrow(run, ROWS.replace(", ", ","))


def flow_counters(observations: DataFrame) -> DataFrame:
    """TCP counters of each flow from its observations."""
    names = ("init", "in_order", "gap_filled", "fin", "overlap", "retransmission", "out_of_order_buffered", "out_of_order_dropped", "reset", "no_sequence")
    gap = F.get_json_object("fields", "$.gap") == "true"
    return observations.groupBy("stream_id_hex").agg(
        F.count("*").alias("segments"), F.sum("size").alias("payload_bytes"), F.sum(F.when(F.col("status") == "retransmission", F.col("size")).otherwise(0)).alias("retransmitted_bytes"),
        F.sum(F.when(F.col("status") == "out_of_order_dropped", F.col("size")).otherwise(0)).alias("dropped_bytes"), F.max(F.get_json_object("fields", "$.waiting_bytes").cast("long")).alias("peak_waiting_bytes"),
        *[F.count_if(F.col("status") == n).alias(n) for n in names], F.count_if(gap).alias("gaps"), F.count_if(F.get_json_object("fields", "$.mid_stream") == "true").alias("mid_stream_starts"),
        F.max(F.get_json_object("fields", "$.waiting").cast("long")).alias("peak_waiting"),
    )


def chunk_counters(chunks: DataFrame) -> DataFrame:
    """Chunks and bytes of each flow, whole and by what made them: current, buffered and overlap_trimmed."""
    made = lambda s: F.col("source") == s
    sources = ("current", "buffered", "overlap_trimmed")
    return chunks.groupBy("stream_id_hex").agg(
        F.count("*").alias("chunks"), F.sum("size").alias("stream_bytes"), *[F.count_if(made(s)).alias(f"{s}_chunks") for s in sources],
        *[F.sum(F.when(made(s), F.col("size")).otherwise(0)).alias(f"{s}_bytes") for s in sources],
    )


def direction_states(observations: DataFrame) -> DataFrame:
    """Each TCP direction after its last segment: next, initial and highest sequence, and what waits."""
    last = observations.groupBy("stream_id_hex", "direction").agg(F.max_by("fields", F.struct("packet_no", "event_no")).alias("f"))
    names = {"next_seq": "expected", "initial_seq": "initial", "highest_seq": "highest", "waiting": "waiting", "waiting_bytes": "waiting_bytes"}
    return last.select("stream_id_hex", "direction", *[F.get_json_object("f", f"$.{path}").cast("long").alias(n) for n, path in names.items()])


def inventory_counters(rows: DataFrame) -> DataFrame:
    """Streams created, closed and active, and events told, of the fold's tagged rows."""
    told = rows.where("tag = 'stream'").groupBy("stream_id_hex").agg(
        F.max_by("status", F.struct("packet_no", "event_no")).alias("status"), F.count("*").alias("events"), F.count_if(F.col("kind") == "stream_open").alias("opened")
    )
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    closed = F.count_if(F.col("status") == "closed")
    return told.agg(count("opened")("created"), closed.alias("closed"), (F.count("*") - closed).alias("active"), count("events")("events"))


def lone_parser(datagrams: DataFrame) -> DataFrame:
    """The DNS event analyzer, natively: header fields of UDP payloads of 12 bytes or more on port 53."""
    from ..functions.native import number

    rows = datagrams.where((F.col("protocol") == "udp") & ((F.col("sport") == 53) | (F.col("dport") == 53)) & (F.length("payload") >= 12))
    flags = number("payload", 2, 2)
    return rows.select(
        "packet_no", "stream_id_hex", number("payload", 0, 2).alias("id"), (flags >= 32768).alias("response"), F.floor(flags / 2048).bitwiseAND(15).alias("opcode"),
        flags.bitwiseAND(15).alias("rcode"), number("payload", 4, 2).alias("questions"), number("payload", 6, 2).alias("answers"),
        number("payload", 8, 2).alias("authorities"), number("payload", 10, 2).alias("additionals"),
    )


def tls_packets(decoded: DataFrame) -> DataFrame:
    """The TLS event analyzer, natively: record headers at the start of TCP packets' payloads."""
    from ..functions.native import number

    kind, minor = number("payload", 0, 1), number("payload", 2, 1)
    rows = decoded.where((F.col("protocol") == "tcp") & (F.length("payload") >= 5))
    return rows.where(kind.between(20, 23) & (number("payload", 1, 1) == 3) & (minor <= 4)).select(
        "packet_no", "stream_id_hex", kind.alias("content_type"), minor.alias("minor"), number("payload", 3, 2).alias("record_bytes")
    )
