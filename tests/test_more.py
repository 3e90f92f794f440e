import threading
import urllib.error
import urllib.request

import pytest

from capstride.operators import content, packets, patterns, stats, streams, views
from capstride.plans import server
from capstride.sources import tables


@pytest.fixture(scope="module")
def run(spark):
    decoded = packets.decode(tables.fixture_packets(spark, "mixed-services", 4, 3)).cache()
    keyed = packets.with_flow(decoded).cache()
    return decoded, keyed, streams.fold(keyed).cache()


def test_capped_flows(spark, run):
    _, keyed, _ = run
    got = packets.capped_flows(keyed, 1).orderBy("packet_no").collect()
    assert [r.evicted for r in got][:2] == [0, 1] and sum(r.evicted for r in got) == len({(r.stream_id_hex, r.epoch) for r in got}) - 1
    assert {r.epoch for r in packets.capped_flows(keyed, 1000).collect()} == {0}


def test_routes(run):
    rows = packets.routes(run[0], 4).collect()
    assert len(rows) == 12 and all(0 <= r.shard < 4 and r.fallback_reason is None and not r.striped for r in rows)
    assert len({(r.stream_id_hex, r.shard) for r in rows}) == len({r.stream_id_hex for r in rows})


def test_merge_and_cap(spark):
    rows = [("s", "a_to_b", 1, 0, 4, b"GET "), ("s", "a_to_b", 5, 4, 9, b"/flag"), ("u", "a_to_b", None, 0, 1, b"x"), ("u", "a_to_b", None, 1, 2, b"y")]
    df = spark.createDataFrame(rows, "stream_id_hex string, direction string, seq long, start long, end long, data binary")
    got = sorted((r.stream_id_hex, r.start, r.end, bytes(r.data)) for r in content.merge_adjacent(df).collect())
    assert got == [("s", 0, 9, b"GET /flag"), ("u", 0, 1, b"x"), ("u", 1, 2, b"y")]
    dated = df.selectExpr("*", "if(stream_id_hex = 's', 1, 2) AS packet_no")
    assert {r.stream_id_hex for r in content.keep_newest_streams(dated, 5).collect()} == {"u"}


def test_patterns():
    assert patterns.parse_hex("de ad:be-ef") == b"\xde\xad\xbe\xef"
    found = patterns.compile_patterns(["flag"], ["token=[a-z0-9]+"], ["de ad"])
    assert patterns.find(found, b"\xde\xad token=abc123") == {("binary:0", 0, 2), ("regex:0", 3, 15)}
    assert len(patterns.find(patterns.compile_patterns(["aa"]), b"aaaa")) == 3
    for bad in (lambda: patterns.compile_patterns([""]), lambda: patterns.compile_patterns((), ["(?=x)"]), lambda: patterns.parse_hex("abc")):
        with pytest.raises(ValueError):
            bad()


def test_regex_depends_on_chunks(spark):
    rows = [("s", "a_to_b", 1, 1, b"token=ab"), ("s", "a_to_b", 2, 2, b"c123")]
    df = spark.createDataFrame(rows, "stream_id_hex string, direction string, packet_no long, event_no long, data binary")
    got = {(r.start, r.end) for r in patterns.scan(df, patterns.compile_patterns((), ["token=[a-z0-9]+"])).collect()}
    assert got == {(0, 8), (0, 12)}
    assert {(r.start, r.end) for r in patterns.scan(df, patterns.compile_patterns(["bc"])).collect()} == {(7, 9)}


def test_profiles():
    got = views.load_profiles('{"profiles": [{"id": "HTTP", "ports": [18080, 18080], "services": [" Http "], "priority": 1}]}')
    assert got[-1].ports == (18080,) and got[-1].services == ("http",) and len(got) == len(views.BUILTIN)


def test_server(run):
    decoded, keyed, rows = run
    events = rows.where("tag = 'stream'").selectExpr("*", "struct(packet_no, event_no) AS order")
    view = views.latest(events, "stream_id_hex", "order", ["status", "service", "side", "confidence", "source", "evidence", "content_kind", "protocol"])
    ends = keyed.selectExpr("stream_id_hex", "a.port AS a_port", "b.port AS b_port").distinct()
    chunks = rows.where("tag = 'chunk'")
    found = patterns.scan(chunks, patterns.compile_patterns(["GET"]))
    state = views.with_state(views.with_matches(view.join(ends, "stream_id_hex"), found)).selectExpr("*", "row_number() OVER (ORDER BY view_order) - 1 AS view_index")
    api = server.Api({"view": state, "matches": found.drop("data"), "messages": rows.where("tag = 'message'"), "content": content.ranges(chunks), "health": stats.health(decoded, rows), "deltas": state.selectExpr("view_index AS cursor")})
    http = server.serve(api)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def get(path):
        import json

        with urllib.request.urlopen(f"http://127.0.0.1:{http.server_address[1]}{path}") as r:
            return json.load(r)

    assert get("/health")["packets"] == 12 and get("/health")["messages"] == 12
    page = get("/streams?profile=http&limit=2")
    assert all(r["service"] == "http" for r in page) and page[0]["match_count"] >= 1
    key = page[0]["stream_id_hex"]
    assert get(f"/streams/{key}/content?mode=text")[0]["data"].startswith("GET /shelf/")
    assert get(f"/streams/{key}/messages")[0]["summary"].startswith("GET /shelf/") and get(f"/streams/{key}/matches")
    assert {p["profile"] for p in get("/profiles")} == {p.id for p in views.BUILTIN}
    with pytest.raises(urllib.error.HTTPError):
        get("/streams/0000000000000000")
    http.shutdown()


def test_run_cap(spark):
    rows = [("s", "a_to_b", "p", no, 1, at, at + 1, b"x") for no in (1, 70_000) for at in range(4)] + [("u", "a_to_b", "p", 2, 1, 0, 1, b"x")]
    df = spark.createDataFrame(rows, patterns.MATCHES)
    of = lambda **limits: sorted((r.stream_id_hex, r.packet_no, r.start) for r in patterns.capped(df, **limits).where("stored").collect())
    assert len(of()) == 9 and of(total=0) == []
    assert of(per_stream=3, total=None) == [("s", 1, 0), ("s", 1, 1), ("s", 1, 2), ("u", 2, 0)]
    assert of(per_stream=6, total=6) == [("s", 1, 0), ("s", 1, 1), ("s", 1, 2), ("s", 1, 3), ("s", 70_000, 0), ("u", 2, 0)]


def test_literal_automaton():
    found = patterns.Matcher(patterns.compile_patterns(["he", "she", "he"], (), ["68 65 ff"]))
    assert found.find(b"she\xff") == {("substring:0", 1, 3), ("substring:2", 1, 3), ("substring:1", 0, 3), ("binary:0", 1, 4)}
    assert found.find(b"she he", 4) == {("substring:0", 4, 6), ("substring:2", 4, 6)}
    assert patterns.Matcher([]).find(b"x") == set()


def test_messages_beyond_the_cap():
    flow = streams.Flow("0000000000000001", "tcp", 4000, 80)
    rows = list(flow.push(1, False, 1, 0, b"GET /x HTTP/1.1\r\n\r\n" * 515))
    assert sum(r["tag"] == "message" for r in rows) == 512 and [r["size"] for r in rows if r["tag"] == "dropped"] == [3]


def test_highlights_across_spans(spark):
    big = content.SEGMENT_BYTES
    rows = [("s", "a_to_b", 0, big + 10), ("s", "a_to_b", big + 10, 3 * big)]
    segments = spark.createDataFrame(rows, "stream_id_hex string, direction string, start long, end long")
    hits = spark.createDataFrame([("s", "a_to_b", "p", big - 2, 2 * big + 5)], "stream_id_hex string, direction string, pattern_id string, start long, end long")
    got = sorted((r.start, r.end, r.segment_start) for r in content.highlights(segments, hits).collect())
    assert got == [(big - 2, big + 10, 0), (big + 10, 2 * big + 5, big + 10)]
    assert [(r.kept, r.dropped) for r in content.highlight_counts(segments, hits, 1).collect()] == [(1, 1)]


def test_slice_errors(spark):
    known = spark.createDataFrame([("s",), ("u",)], "stream_id_hex string")
    stored = spark.createDataFrame([("s", 0)], "stream_id_hex string, start long")
    of = lambda *a: content.slice_error(stored, known, *a)
    assert [of("s"), of("u"), of("x"), of("s", 0)] == [None, "no_content", "unknown_stream", "empty_request"]


def test_running_classes():
    from capstride.functions import detection

    data = bytes(range(256)) * 20
    for low, high in ((0, len(data)), (32, 127), (9, 14), (128, 256), (65, 5065)):
        whole, parts = detection.Classes(), detection.Classes()
        whole.add(data[low:high])
        for k in range(low, high, 7):
            parts.add(data[k : min(k + 7, high)])
        assert whole == parts and whole.size == min(4096, high - low)
    assert detection.content_kind(b"a\x01" * 5) == "binary" and detection.content_kind(b"a b\n") == "text"
