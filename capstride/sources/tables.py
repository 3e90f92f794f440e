"""Captures made of table rows and of patterns: real frames with known contents.

packet_no orders the packets of a capture: the row's own order times SPREAD, plus the packet's place in the row.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wire import UDP, build_frame
from ..operators.packets import PACKETS

SEGMENT, SPREAD = 1400, 1 << 16
_SCHEMA = pa.schema([("packet_no", pa.int64()), ("ts_sec", pa.int64()), ("ts_usec", pa.int32()), ("link_layer", pa.string()), ("linktype", pa.int32()), ("data", pa.binary())])


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Rows (packet_no, time in microseconds, frame) as packets."""
    no, us, data = zip(*rows) if rows else ((), (), ())
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(no, pa.int64()), pa.array([u // 1_000_000 for u in us], pa.int64()), pa.array([u % 1_000_000 for u in us], pa.int32()),
         pa.array(["ethernet"] * n, pa.string()), pa.array([1] * n, pa.int32()), pa.array(data, pa.binary())],
        schema=_SCHEMA,
    )


def _address(net: int, n: int) -> str:
    return f"{net}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}"


def conversation_packets(conversations: DataFrame, shuffled: bool = False) -> DataFrame:
    """A TCP stream for each conversation: assistants answer from the server's side; sequences run on in each direction.

    `shuffled` swaps the second and third segment of each turn that has three.
    """
    turns = conversations.where("conv_id is not null and text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches):
        for b in batches:
            rows = []
            for conv, said in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist()):
                client, server = _address(10, conv), "192.0.2.80"
                port, no = 1024 + conv % 60_000, 0
                seq = {False: 1, True: 1}
                for turn in said:
                    back = turn["role"] == "assistant"
                    text = turn["text"].encode()
                    parts = []
                    for low in range(0, max(1, len(text)), SEGMENT):
                        payload = text[low : low + SEGMENT]
                        parts.append((seq[back], payload))
                        seq[back] += len(payload)
                    if shuffled and len(parts) > 2:
                        parts[1], parts[2] = parts[2], parts[1]
                    for at, payload in parts:
                        ends = (server, client, 8080, port) if back else (client, server, port, 8080)
                        rows.append((conv * SPREAD + no, conv * SPREAD + no, build_frame(*ends, payload, seq=at, flags=("ack",))))
                        no += 1
            yield batch(rows)

    return turns.mapInArrow(run, PACKETS.replace(", ", ","))


def page_packets(pages: DataFrame) -> DataFrame:
    """An HTTP exchange for each page, with a chunked body for odd page_ids and Content-Length for even ones."""

    def run(batches):
        for b in batches:
            rows = []
            for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if page is None or url is None:
                    continue
                host, _, path = url.split("://", 1)[-1].partition("/")
                body = (html or "").encode()
                ask = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
                if page % 2:
                    sized = b"".join(b"%x\r\n%s\r\n" % (len(body[k : k + 1000]), body[k : k + 1000]) for k in range(0, len(body), 1000))
                    reply = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + sized + b"0\r\n\r\n"
                else:
                    reply = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                client, server, port, no = _address(10, page), "192.0.2.80", 1024 + page % 60_000, 0
                for data, ends in ((ask, (client, server, port, 80)), (reply, (server, client, 80, port))):
                    for low in range(0, len(data), SEGMENT):
                        rows.append((page * SPREAD + no, page * SPREAD + no, build_frame(*ends, data[low : low + SEGMENT], seq=1 + low, flags=("ack",))))
                        no += 1
            yield batch(rows)

    return pages.select("page_id", "url", "html").mapInArrow(run, PACKETS.replace(", ", ","))


def dns_query(number: int, name: str) -> bytes:
    labels = b"".join(bytes([len(x)]) + x.encode() for x in name.split("."))
    return struct.pack("!6H", number & 0xFFFF, 0x0100, 1, 0, 0, 0) + labels + b"\0" + struct.pack("!2H", 1, 1)


def event_packets(events: DataFrame) -> DataFrame:
    """A UDP datagram for each event: flow by user, a DNS query of its type, time and order of the event."""
    rows = events.where("event_id is not null and user_id is not null").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))

    def run(batches):
        for b in batches:
            out = []
            for event, user, kind, us in zip(*(c.to_pylist() for c in b.columns)):
                frame = build_frame(_address(10, user), "192.0.2.53", 1024 + user % 60_000, 53, dns_query(event, f"{kind or 'none'}.example"), UDP)
                out.append((event, us or 0, frame))
            yield batch(out)

    return rows.mapInArrow(run, PACKETS.replace(", ", ","))


FIXTURES = ("http-requests", "out-of-order-http", "http-keep-alive", "mixed-services", "udp-elephant", "tcp-elephant")


def _client_hello() -> bytes:
    hello = b"\x03\x03" + bytes(32) + b"\0" + b"\0\x02\x13\x01" + b"\x01\0" + b"\0\0"
    body = b"\x01" + len(hello).to_bytes(3, "big") + hello
    return b"\x16\x03\x01" + len(body).to_bytes(2, "big") + body


def fixture_packets(spark: SparkSession, name: str, n_flows: int, messages: int = 1) -> DataFrame:
    """A synthetic capture of one of the FIXTURES; times are ordinals in microseconds."""
    if name not in FIXTURES:
        raise ValueError(f"unknown fixture {name}")
    per = {"http-requests": 1, "out-of-order-http": 3}.get(name, messages)

    def frame(f: int, i: int, ordinal: int) -> bytes:
        client, port = _address(10, f), 2_048 + f % 60_000
        web, names, bulk = "203.0.113.8", "203.0.113.5", "203.0.113.9"
        tcp = lambda to, dport, seq, data: build_frame(client, to, port, dport, data, seq=seq)
        udp = lambda to, dport, data: build_frame(client, to, port, dport, data, UDP)
        ask = lambda k, pad=0: b"GET /shelf/%07d/book/%07d HTTP/1.1\r\nHost: library.example\r\nX-Pad: %s\r\n\r\n" % (f, k, b"." * pad)
        if name == "http-requests":
            return tcp(web, 80, 1, ask(0))
        if name == "out-of-order-http":
            text = ask(0)
            # thirds of a request: the first, the last, then the one between
            third = (0, 2, 1)[i]
            cuts = [len(text) * k // 3 for k in range(4)]
            return tcp(web, 80, 1 + cuts[third], text[cuts[third] : cuts[third + 1]])
        if name == "http-keep-alive":
            return tcp(web, 80, 1 + i * len(ask(0)), ask(i))
        if name == "mixed-services":
            if ordinal % 3 == 0:
                return tcp(web, 80, 1 + ordinal * len(ask(0)), ask(ordinal))
            if ordinal % 3 == 1:
                return udp(names, 53, dns_query(ordinal, "shelf.example"))
            return tcp(web, 443, 1 + ordinal * len(_client_hello()), _client_hello())
        if name == "udp-elephant":
            return udp(bulk, 443, bytes([0xF3]) * 1200)
        return tcp(bulk, 80, 1 + i * len(ask(0, 900)), ask(i, 900))

    def run(batches):
        for b in batches:
            yield batch([(o, o, frame(o // per, o % per, o)) for o in b.column("id").to_pylist()])

    return spark.range(n_flows * per).mapInArrow(run, PACKETS.replace(", ", ","))
