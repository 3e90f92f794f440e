import gzip

import pytest

from capstride.functions import detection, parsers, transforms, wire
from capstride.functions.reassembly import Direction, step
from capstride.operators.streams import Flow


def feed(segments, **limits):
    d, out = Direction(), []
    for seq, payload, *flags in segments:
        out.append(step(d, 0, seq, flags[0] if flags else 0, payload, **limits))
    return d, out


def test_identifiers():
    a, b = wire.pack_address("10.0.0.1"), wire.pack_address("10.0.0.2")
    stream = wire.stream_id("tcp", a, 1111, b, 80)
    assert f"{stream:016x}" == "90d233025387997c"
    assert f"{wire.message_id(stream, 0, False):016x}" == "409eb141db043aee"
    assert f"{wire.message_id(stream, 0, True):016x}" == "26e600487276b9cd"


@pytest.mark.parametrize(
    "layer, data, status",
    [
        ("ethernet", wire.build_frame("10.0.0.1", "10.0.0.2", 31337, 80, b"x"), "parsed"),
        ("bsd_loopback", b"\0\0\0\2" + wire.build_frame("10.0.0.1", "10.0.0.2", 31337, 80, b"x")[14:], "parsed"),
        ("ethernet", b"\1" * 12 + b"\x08\x06" + bytes(28), "non_ip"),
        ("unsupported", b"\0", "unsupported_link"),
        ("raw_ip", bytes.fromhex("4500000000010000400600000a0000010a000002"), "malformed"),
        ("raw_ip", bytes.fromhex("4500001400012000401100000a0000010a000002"), "fragmented"),
        ("raw_ip", bytes.fromhex("4500001400010000402f00000a0000010a000002"), "unsupported_transport"),
        ("ethernet", b"", "malformed"),
        ("ethernet", wire.build_frame("2001:db8::1", "2001:db8::2", 5, 53, b"x", wire.UDP), "parsed"),
    ],
)
def test_decode_status(layer, data, status):
    assert wire.decode(layer, data)["status"] == status


def test_reassembly():
    d, out = feed([(100, b"abc"), (106, b"gh"), (103, b"def")])
    assert [o.status for o in out] == ["init", "out_of_order_buffered", "gap_filled"]
    assert out[2].chunks == [(103, b"def", "current"), (106, b"gh", "buffered")] and d.expected == 108
    d, out = feed([(100, b"ab"), (105, b"fghij"), (108, b"ijklm"), (102, b"cde")])
    assert [c[1] for c in out[3].chunks] == [b"cde", b"fghij", b"klm"] and d.expected == 113
    d, out = feed([(4294967294, b"ab"), (0, b"c")])
    assert out[1].chunks == [(0, b"c", "current")] and d.expected == 1
    d, out = feed([(100, b"abcdef"), (100, b"abc"), (104, b"efgh")])
    assert [o.status for o in out] == ["init", "retransmission", "overlap"] and out[2].chunks == [(106, b"gh", "overlap_trimmed")]
    assert feed([(100, b"a"), (103, b"bcdef")], max_segments=1, max_bytes=2)[1][1].status == "out_of_order_dropped"
    assert feed([(100, b"a"), (103, b"cd"), (103, b"cd")])[1][2].status == "retransmission"
    d, out = feed([(500, b"", 2)])
    assert out[0].status == "init" and d.expected == 501
    assert feed([(100, b"", 4)])[1][0].status == "reset"


def test_detection():
    rule = lambda b, a=49000, port=31337, proto="tcp": detection.by_payload(proto, a, port, True, b)
    assert rule(b"GET / HTTP/1.1\r\n\r\n") == detection.Evidence("http", "b", 98, "payload", "http_request")
    tls = rule(bytes.fromhex("1603010 02a0100".replace(" ", "")) + b"\0", port=443)
    assert (tls.service, tls.side, tls.source, tls.evidence) == ("https", "b", "port_and_payload", "https_tls_record")
    assert rule(b"GET / HTTP/1.1\r\nUpgrade: WebSocket\r\n\r\n").service == "websocket"
    assert rule(b"\x00\x01\x01\x00\x00\x01" + bytes(6), port=5355, proto="udp").service == "llmnr"
    assert detection.content_kind(b"\x16\x03\x01\0\0") == "binary" and detection.content_kind(b"GET /") == "text" and detection.content_kind(b"") == "unknown"
    assert detection.adjust_kind("binary", "http") == "mixed"


def test_http1():
    p = parsers.Http1()
    body = b"moss and fern"
    head = b"PUT /garden/7 HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % len(body)
    got = p.push(head + body + b"HEAD /pond HTTP/1.1\r\n\r\n" + head + body[:5])
    assert [m["summary"] for m in got] == ["PUT /garden/7", "HEAD /pond"] and got[0]["body_bytes"] == len(body)
    assert got[0]["logical_end"] == got[1]["logical_start"] == len(head + body)
    assert [m["summary"] for m in p.push(body[5:] + b"DELETE /weeds HTTP/1.1\r\n\r\n")] == ["PUT /garden/7", "DELETE /weeds"]
    parts = [b"granite, ", b"basalt", b" and a little slate"]
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in parts) + b"0\r\n\r\n"
    (m,) = parsers.Http1().push(b"HTTP/1.1 203 Borrowed\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked)
    assert m["summary"].startswith("HTTP 203") and m["body_bytes"] == len(chunked) and m["info"]["framing"]["decoded"] == sum(map(len, parts)) and m["info"]["framing"]["chunks"] == 3


def test_websocket_and_flow():
    f = Flow("90d233025387997c", "tcp", 1111, 80)
    ask = b"GET /tide/live HTTP/1.1\r\nUpgrade: websocket\r\nConnection: Upgrade\r\n\r\n"
    said, key = b"high water at nine", bytes([17, 90, 203, 44])
    frame = bytes([0x81, 0x80 | len(said)]) + key + parsers.unmask(said, key)
    rows = [r for no, (seq, b) in enumerate([(1, ask), (1 + len(ask), frame)]) for r in f.push(no, False, seq, 0, b)]
    said = [r["source"] for r in rows if r["tag"] == "message"]
    assert said == ["http1_request", "websocket_frame"] and rows[-1]["summary"] == "WS text 18 bytes high water at nine"


def test_dns():
    from capstride.sources.tables import dns_query

    m = parsers.parse_dns(dns_query(0x1234, "example.com"))
    assert m["summary"] == "DNS query A example.com" and parsers.event_type(m) == "dns_query" and m["info"]["id"] == 0x1234
    answer = b"\x12\x34\x81\x80\0\1\0\1\0\0\0\0" + dns_query(0, "example.com")[12:] + b"\xc0\x0c\0\1\0\1\0\0\0\x3c\0\4" + bytes([93, 184, 216, 34])
    assert parsers.parse_dns(answer)["info"]["answers"][0]["data"] == "93.184.216.34"


def test_transforms():
    run = lambda plan, b, most=1 << 20: transforms.chain(transforms.parse_plan(plan), b, most)[0]
    assert run("url", b"/trail?name=blue%2Dheron%21+north").data == b"/trail?name=blue-heron! north"
    assert run("auto", bytes.fromhex("160303002537420000ff01253744")).status == "noop"
    assert run("gzip", gzip.compress(b"three wet otters")).data == b"three wet otters"
    body = gzip.compress(b"slow%20river+bend")
    chunked = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n%x\r\n%s\r\n0\r\n\r\n" % (len(body), body)
    assert b"slow%20river+bend" in run("chain:chunked|http_gzip", chunked).data
    assert len(run("gzip", gzip.compress(b"a" * 4096)[:-8]).data) > 0
    cut = run("gzip", gzip.compress(b"a" * 128), 16)
    assert len(cut.data) == 16 and cut.truncated
