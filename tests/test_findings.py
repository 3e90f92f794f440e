from capstride.functions import parsers
from capstride.operators import packets, streams
from capstride.sources import tables

CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"5\r\nshelf\r\n" + b"4\r\nbook\r\n" + b"0\r\n\r\n"


def test_chunked_reply_cut_anywhere():
    for cut in range(1, len(CHUNKED)):
        p = parsers.Http1()
        got = p.push(CHUNKED[:cut]) + p.push(CHUNKED[cut:])
        assert [m["summary"] for m in got] == ["HTTP 200 OK"], cut
    p = parsers.Http1()
    assert [m["summary"] for m in p.push(CHUNKED.replace(b"shelf\r\n", b"shelf\rx"))] == ["chunk data is not followed by a newline"]


def test_bodies_cut_between_cr_and_lf(spark):
    """A chunk's carriage return ends a segment: 47 bytes of head, 4 of size and 1,348 of data (in two chunks) make 1,400 with it."""
    pages = spark.createDataFrame([(2 * n + 1, f"http://a.example/{n}", "x" * n) for n in range(1330, 1350)], "page_id long, url string, html string")
    found = streams.fold(packets.with_flow(packets.decode(tables.page_packets(pages)))).where("tag = 'message' AND kind = 'response'")
    got = {(r.n, r.decoded) for r in found.selectExpr("stream_id_hex AS n", "cast(get_json_object(fields, '$.framing.decoded') AS long) AS decoded").collect()}
    assert sorted(d for _, d in got) == list(range(1330, 1350))


def test_dns_from_another_services_port():
    """The client's port 1900 is ssdp's and names the flow; its queries to port 53 are messages nevertheless."""
    flow = streams.Flow("0000000000000001", "udp", 1900, 53)
    query = tables.dns_query(7, "login.example")
    rows = list(flow.push(1, False, None, None, query)) + list(flow.push(2, False, None, None, query))
    assert [r["summary"] for r in rows if r["tag"] == "message"] == ["DNS query A login.example"] * 2
    assert {r["service"] for r in rows if r["tag"] == "stream"} == {"ssdp"}
    lone = streams.Flow("0000000000000002", "udp", 1900, 4000)
    assert not [r for r in lone.push(1, False, None, None, query) if r["tag"] == "message"]
