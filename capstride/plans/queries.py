"""Queries of the capture operators over the tables, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native
from ..operators import content, packets, patterns, stats, streams, transforms, views
from ..sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_flows(spark, sf_dir, shuffled=True) -> DataFrame:
    return packets.with_flow(packets.decode(tables.conversation_packets(t(spark, sf_dir, "conversations"), shuffled)))


def conversation_chunks(spark, sf_dir) -> DataFrame:
    return streams.fold(conversation_flows(spark, sf_dir)).where("tag = 'chunk'")


def _client(address_column: str = "a"):
    """The row key that a generated client address stands for."""
    return native.number(F.col(f"{address_column}.address"), 1, 3)


# ---- captures made of tables -------------------------------------------------------------------------------------


@query("s8_p9_decode_counters", "SELECT count(*)::BIGINT AS packets, count(*)::BIGINT AS parsed, 0::BIGINT AS decode_errors FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL")
def decode_counters(spark, sf_dir):
    return packets.decode_counters(packets.decode(tables.event_packets(t(spark, sf_dir, "events")))).select("packets", "parsed", "decode_errors")


@query("s3_packet_filter", "SELECT count(*)::BIGINT AS packets FROM events WHERE user_id % 60000 = 7 OR user_id % 60000 = 9")
def packet_filter(spark, sf_dir):
    decoded = packets.decode(tables.event_packets(t(spark, sf_dir, "events")))
    return decoded.where(packets.packet_filter("udp and dst port 53 and (src port 1031 or src port 1033)")).agg(F.count("*").alias("packets"))


@query("s11_dump", "SELECT event_id AS packet_no, 'raw_packet' AS event_type FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL")
def dump(spark, sf_dir):
    return packets.dump_events(tables.event_packets(t(spark, sf_dir, "events"))).select("packet_no", "event_type")


@query(
    "f1_f4_flow_aggregate",
    """SELECT user_id AS client, count(*)::BIGINT AS packets, min_by(epoch_us(ts), event_id)::BIGINT AS first_seen_us, max_by(epoch_us(ts), event_id)::BIGINT AS last_seen_us,
    sum(18 + length(event_type) + 8)::BIGINT AS payload_bytes, false AS finished FROM events WHERE event_id IS NOT NULL GROUP BY user_id""",
)
def flow_aggregate(spark, sf_dir):
    """Payload: 12 bytes of header, the name event_type.example with two length bytes and an end, 4 of type and class."""
    keyed = packets.with_flow(packets.decode(tables.event_packets(t(spark, sf_dir, "events"))))
    return packets.flows(keyed).select(_client().alias("client"), "packets", "first_seen_us", "last_seen_us", "payload_bytes", "finished")


@query(
    "f5_running_counts",
    "SELECT event_id AS packet_no, user_id AS client, count(*) OVER w::BIGINT AS flow_packets, (row_number() OVER w = 1) AS is_new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
)
def running(spark, sf_dir):
    keyed = packets.with_flow(packets.decode(tables.event_packets(t(spark, sf_dir, "events"))))
    return packets.running_counts(keyed).select("packet_no", _client().alias("client"), "flow_packets", "is_new")


@query("f3_stream_ids")
def stream_ids(spark, sf_dir):
    return conversation_flows(spark, sf_dir).select("stream_id_hex", _client().alias("client")).distinct()


@query(
    "r1_c6_reassembly",
    """SELECT conv_id AS client, CASE WHEN role = 'assistant' THEN 'b_to_a' ELSE 'a_to_b' END AS direction, sum(octet_length(encode(text)))::BIGINT AS stream_bytes,
    md5(string_agg(text, '' ORDER BY turn)) AS digest FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2 HAVING sum(octet_length(encode(text))) > 0""",
)
def reassembly(spark, sf_dir):
    """Segments are swapped on the way; the chunks put them in order again."""
    keyed = conversation_flows(spark, sf_dir)
    chunks = streams.fold(keyed).where("tag = 'chunk'")
    clients = keyed.select("stream_id_hex", _client().alias("client")).distinct()
    whole = content.read(content.ranges(chunks)).join(clients, "stream_id_hex")
    return whole.select("client", "direction", F.length("data").cast("long").alias("stream_bytes"), F.md5("data").alias("digest"))


@query("r1_f8_sequence_status")
def sequence_status(spark, sf_dir):
    return streams.flow_counters(streams.fold(conversation_flows(spark, sf_dir)).where("tag = 'observation'"))


@query(
    "c1_ranges",
    """SELECT conv_id, turn, role, (sum(n) OVER w - n)::BIGINT AS "start", (sum(n) OVER w)::BIGINT AS "end" FROM (SELECT *, octet_length(encode(text)) AS n FROM conversations)
    WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)""",
)
def logical_ranges(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").withColumn("data", F.encode("text", "UTF-8"))
    return content.ranges(rows, ("conv_id", "role"), ("turn",)).select("conv_id", "turn", "role", "start", "end")


@query(
    "c8_windows",
    "SELECT doc_id AS stream_id_hex, 100::BIGINT AS \"start\", least(300, octet_length(encode(text)))::BIGINT AS \"end\" FROM documents WHERE octet_length(encode(text)) > 100",
)
def clipped(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id_hex"), F.lit("a_to_b").alias("direction"), F.lit(0).alias("packet_no"), F.lit(0).alias("event_no"), F.encode("text", "UTF-8").alias("data"))
    stored = content.split(content.ranges(rows).where(F.length("data") > 0), 64)
    return content.windows(stored, 100, 300).select("stream_id_hex", "start", "end")


@query("c2_c4_split_trim", "SELECT doc_id AS stream_id_hex, least(2000, octet_length(encode(text)))::BIGINT AS stored FROM documents WHERE length(text) > 0")
def split_trim(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream_id_hex"), F.lit("a_to_b").alias("direction"), F.lit(0).alias("packet_no"), F.lit(0).alias("event_no"), F.encode("text", "UTF-8").alias("data"))
    cut = content.split(content.ranges(rows).where(F.length("data") > 0), 512).withColumn("event_no", F.col("start"))
    return content.trim(cut, 2000).groupBy("stream_id_hex").agg(F.sum(F.length("data")).cast("long").alias("stored"))


@query("i1_i4_stream_events")
def stream_events(spark, sf_dir):
    return streams.fold(conversation_flows(spark, sf_dir)).where("tag = 'stream'").select("stream_id_hex", "packet_no", "kind", "status", "service", "side", "confidence", "source", "evidence", "content_kind")


@query("h1_http_messages", "SELECT page_id AS client, 'GET /' || regexp_replace(regexp_replace(url, '^[^:]*://', ''), '^[^/]*/?', '') AS summary FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id, 'HTTP 200 OK' FROM pages WHERE url IS NOT NULL")
def http_messages(spark, sf_dir):
    keyed = packets.with_flow(packets.decode(tables.page_packets(t(spark, sf_dir, "pages"))))
    clients = keyed.select("stream_id_hex", _client().alias("client")).distinct()
    return streams.fold(keyed).where("tag = 'message'").join(clients, "stream_id_hex").select("client", "summary")


@query("h1_http_bodies", "SELECT page_id AS client, octet_length(encode(coalesce(html, '')))::BIGINT AS decoded FROM pages WHERE url IS NOT NULL")
def http_bodies(spark, sf_dir):
    keyed = packets.with_flow(packets.decode(tables.page_packets(t(spark, sf_dir, "pages"))))
    clients = keyed.select("stream_id_hex", _client().alias("client")).distinct()
    replies = streams.fold(keyed).where("tag = 'message' AND kind = 'response'").join(clients, "stream_id_hex")
    return replies.select("client", F.get_json_object("fields", "$.framing.decoded").cast("long").alias("decoded"))


@query("h6_dns_messages", "SELECT event_id AS packet_no, 'DNS query A ' || event_type || '.example' AS summary FROM events WHERE event_type IS NOT NULL")
def dns_messages(spark, sf_dir):
    keyed = packets.with_flow(packets.decode(tables.event_packets(t(spark, sf_dir, "events"))))
    return streams.fold(keyed).where("tag = 'message'").select("packet_no", "summary")


@query("h18_dns_headers", "SELECT event_id AS packet_no, (event_id % 65536)::BIGINT AS id, false AS response, 1::BIGINT AS questions, 0::BIGINT AS answers FROM events")
def dns_headers(spark, sf_dir):
    return streams.lone_parser(packets.decode(tables.event_packets(t(spark, sf_dir, "events")))).select("packet_no", "id", "response", "questions", "answers")


@query(
    "h17_http_events",
    "SELECT CASE WHEN page_id % 2 = 1 THEN 'chunked' ELSE 'content-length' END AS framing, count(*)::BIGINT AS requests, count(*)::BIGINT AS responses FROM pages WHERE url IS NOT NULL GROUP BY 1",
)
def http_events(spark, sf_dir):
    """Of all pages; a reply's framing follows from its page."""
    keyed = packets.with_flow(packets.decode(tables.page_packets(t(spark, sf_dir, "pages"))))
    clients = keyed.select("stream_id_hex", _client().alias("page_id")).distinct()
    rows = streams.fold(keyed).where("tag = 'http'").join(clients, "stream_id_hex")
    framing = F.when(F.col("page_id") % 2 == 1, "chunked").otherwise("content-length").alias("framing")
    return rows.groupBy(framing).agg(F.count_if(F.col("kind") == "http_request").alias("requests"), F.count_if(F.col("kind") == "http_response").alias("responses"))


@query(
    "f8_r1_flow_counters",
    f"""WITH s AS (SELECT conv_id, role = 'assistant' AS back, octet_length(encode(text)) AS n FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL),
    d AS (SELECT *, greatest(1, ceil(n / {tables.SEGMENT}))::BIGINT AS parts FROM s),
    t AS (SELECT conv_id, sum(parts) AS segments, sum(n) AS payload_bytes, count_if(parts > 2) AS swapped, count_if(n = 0) AS no_sequence, count(DISTINCT coalesce(back, false)) FILTER (n > 0) AS init,
        count_if(parts > 2) AS buffered FROM d GROUP BY 1)
    SELECT conv_id AS client, segments::BIGINT AS segments, payload_bytes::BIGINT AS payload_bytes, init::BIGINT AS init, init::BIGINT AS mid_stream_starts, swapped::BIGINT AS gap_filled,
    buffered::BIGINT AS out_of_order_buffered, buffered::BIGINT AS gaps, no_sequence::BIGINT AS no_sequence, (segments - init - swapped - buffered - no_sequence)::BIGINT AS in_order,
    0::BIGINT AS retransmission, 0::BIGINT AS overlap, 0::BIGINT AS out_of_order_dropped, least(swapped, 1)::BIGINT AS peak_waiting FROM t""",
)
def flow_counters(spark, sf_dir):
    """The second and third segment of a turn are swapped: one is buffered, the other fills the gap."""
    keyed = conversation_flows(spark, sf_dir)
    clients = keyed.select("stream_id_hex", _client().alias("client")).distinct()
    counters = streams.flow_counters(streams.fold(keyed).where("tag = 'observation'")).join(clients, "stream_id_hex")
    return counters.select(
        "client", "segments", "payload_bytes", "init", "mid_stream_starts", "gap_filled", "out_of_order_buffered", "gaps", "no_sequence", "in_order", "retransmission", "overlap", "out_of_order_dropped", "peak_waiting"
    )


@query(
    "r7_direction_state",
    """SELECT conv_id AS client, CASE WHEN role = 'assistant' THEN 'b_to_a' ELSE 'a_to_b' END AS direction, (1 + sum(octet_length(encode(text))))::BIGINT AS next_seq, 1::BIGINT AS initial_seq,
    (1 + sum(octet_length(encode(text))))::BIGINT AS highest_seq, 0::BIGINT AS waiting, 0::BIGINT AS waiting_bytes
    FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2 HAVING sum(octet_length(encode(text))) > 0""",
)
def direction_state(spark, sf_dir):
    keyed = conversation_flows(spark, sf_dir)
    clients = keyed.select("stream_id_hex", _client().alias("client")).distinct()
    rows = streams.direction_states(streams.fold(keyed).where("tag = 'observation'")).where("next_seq is not null")
    return rows.join(clients, "stream_id_hex").drop("stream_id_hex")


@query(
    "r6_chunk_counters",
    f"""WITH d AS (SELECT conv_id, octet_length(encode(text)) AS n FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL)
    SELECT conv_id AS client, sum(ceil(n / {tables.SEGMENT}))::BIGINT AS chunks, sum(n)::BIGINT AS stream_bytes, count_if(n > 2 * {tables.SEGMENT})::BIGINT AS buffered_chunks,
    sum(CASE WHEN n > 2 * {tables.SEGMENT} THEN least({tables.SEGMENT}, n - 2 * {tables.SEGMENT}) ELSE 0 END)::BIGINT AS buffered_bytes FROM d GROUP BY 1 HAVING sum(n) > 0""",
)
def chunk_counters(spark, sf_dir):
    """Of each turn's segments, the third waits until the second comes."""
    keyed = conversation_flows(spark, sf_dir)
    clients = keyed.select("stream_id_hex", _client().alias("client")).distinct()
    rows = streams.chunk_counters(streams.fold(keyed).where("tag = 'chunk'")).join(clients, "stream_id_hex")
    return rows.select("client", "chunks", "stream_bytes", "buffered_chunks", "buffered_bytes")


@query(
    "i13_inventory_counters",
    "SELECT count(DISTINCT conv_id)::BIGINT AS created, 0::BIGINT AS closed, count(DISTINCT conv_id)::BIGINT AS active FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL",
)
def inventory(spark, sf_dir):
    return streams.inventory_counters(streams.fold(conversation_flows(spark, sf_dir))).select("created", "closed", "active")


def _document_chunks(spark, sf_dir) -> DataFrame:
    rows = t(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rows.select(F.col("doc_id").alias("stream_id_hex"), F.lit("a_to_b").alias("direction"), F.lit(0).alias("packet_no"), F.lit(0).alias("event_no"), F.encode("text", "UTF-8").alias("data"))


@query(
    "c9_content_counters",
    """WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE length(text) > 0)
    SELECT count(*)::BIGINT AS active, count(*)::BIGINT AS updates, sum(least(n, 2000))::BIGINT AS stored_bytes, sum(n)::BIGINT AS observed_bytes, sum(greatest(n - 2000, 0))::BIGINT AS dropped_bytes,
    count_if(n > 2000)::BIGINT AS truncated, 0::BIGINT AS evicted, sum(ceil(n / 512) - CASE WHEN n > 2000 THEN floor((n - 2000) / 512) ELSE 0 END)::BIGINT AS segments FROM d""",
)
def content_counts(spark, sf_dir):
    """Segments of 512 bytes, of which each stream keeps the newest 2,000 bytes."""
    chunks = _document_chunks(spark, sf_dir).where(F.length("data") > 0)
    cut = content.split(content.ranges(chunks), 512).withColumn("event_no", F.col("start"))
    return content.content_counters(chunks, content.trim(cut, 2000))


@query(
    "l2_highlight_counts",
    """WITH d AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE length(text) > 0),
    m AS (SELECT doc_id, i FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 2)) AS i FROM d) WHERE substr(x, 2 * i + 1, 6) = '746865'),
    p AS (SELECT doc_id, sum(1 + (i % 512 > 509)::BIGINT) AS pieces FROM m GROUP BY 1)
    SELECT doc_id AS stream_id_hex, 'a_to_b' AS direction, least(pieces, 4096)::BIGINT AS kept, greatest(pieces - 4096, 0)::BIGINT AS dropped FROM p""",
)
def highlight_counts(spark, sf_dir):
    """Matches of a literal in segments of 512 bytes; a match across two segments has a part in each."""
    chunks = _document_chunks(spark, sf_dir).where(F.length("data") > 0)
    found = patterns.scan(chunks.withColumn("stream_id_hex", F.col("stream_id_hex").cast("string")), patterns.compile_patterns(["the"]))
    found = found.withColumn("stream_id_hex", F.col("stream_id_hex").cast("long"))
    return content.highlight_counts(content.split(content.ranges(chunks), 512), found)


@query(
    "m7_run_cap",
    """WITH d AS (SELECT doc_id, hex(encode(text)) AS x FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0),
    m AS (SELECT doc_id, i FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 2)) AS i FROM d) WHERE substr(x, 2 * i + 1, 6) = '746865'),
    r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
    c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, k) AS n FROM r WHERE k <= 1024)
    SELECT (SELECT count(*) FROM c WHERE n <= 1000000)::BIGINT AS matches, ((SELECT count(*) FROM m) - (SELECT count(*) FROM c WHERE n <= 1000000))::BIGINT AS dropped,
    (SELECT count(DISTINCT doc_id) FROM m)::BIGINT AS matched_streams""",
)
def run_cap(spark, sf_dir):
    """A document is one packet; the limits of a stream and of a run are the features."""
    chunks = _document_chunks(spark, sf_dir).where("stream_id_hex is not null").where(F.length("data") > 0).withColumn("packet_no", F.col("stream_id_hex"))
    found = patterns.scan(chunks.withColumn("stream_id_hex", F.col("stream_id_hex").cast("string")), patterns.compile_patterns(["the"]))
    return patterns.match_stats(patterns.capped(found)).select("matches", "dropped", "matched_streams")


@query("h10_fixture_mixed")
def mixed_fixture(spark, sf_dir):
    keyed = packets.with_flow(packets.decode(tables.fixture_packets(spark, "mixed-services", 200, 3)))
    return streams.fold(keyed).where("tag = 'message'").groupBy("source").agg(F.count("*").alias("messages"))


@query(
    "m3_stream_literals",
    """WITH s AS (SELECT conv_id, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS d, string_agg(text, '' ORDER BY turn) AS x FROM conversations GROUP BY 1, 2)
    SELECT count(*)::BIGINT AS matches, count(DISTINCT conv_id)::BIGINT AS matched_streams FROM (SELECT conv_id, unnest(range(1, length(x) - 1)) AS i, x FROM s) WHERE substr(x, i, 3) = 'the'""",
)
def stream_literals(spark, sf_dir):
    found = patterns.capped(patterns.scan(conversation_chunks(spark, sf_dir), patterns.compile_patterns(["the"])), 1 << 40, None)
    return patterns.match_stats(found).select("matches", "matched_streams")


@query("m4_stream_regexes")
def stream_regexes(spark, sf_dir):
    found = patterns.capped(patterns.scan(conversation_chunks(spark, sf_dir), patterns.compile_patterns(["and"], ["t[a-z]+n"], ["74 68 65"])))
    return patterns.match_events(found.where("stored"))


@query("l2_highlights")
def stream_highlights(spark, sf_dir):
    chunks = conversation_chunks(spark, sf_dir)
    found = patterns.scan(chunks, patterns.compile_patterns(["the"]))
    return content.highlights(content.ranges(chunks), found).drop("rank")


def stream_view(spark, sf_dir) -> DataFrame:
    """View rows of the conversations' streams with ports, matches and an index."""
    keyed = conversation_flows(spark, sf_dir)
    rows = streams.fold(keyed)
    events = rows.where("tag = 'stream'").withColumn("order", F.struct("packet_no", "event_no"))
    view = views.latest(events, "stream_id_hex", "order", ["status", "service", "side", "confidence", "source", "evidence", "content_kind"])
    ends = keyed.groupBy("stream_id_hex").agg(F.first("a.port").alias("a_port"), F.first("b.port").alias("b_port"), F.first("protocol").alias("protocol"))
    found = patterns.scan(rows.where("tag = 'chunk'"), patterns.compile_patterns(["the"]))
    return views.with_matches(view.join(ends, "stream_id_hex"), found)


@query("v5_v11_profiles")
def stream_profiles(spark, sf_dir):
    return views.profile_stats(views.with_state(stream_view(spark, sf_dir), rules=[("port", 8080)]), list(views.BUILTIN))


@query("v10_primary_profile", "SELECT 'http' AS profile, count(DISTINCT conv_id)::BIGINT AS streams FROM conversations")
def stream_primary(spark, sf_dir):
    return stream_view(spark, sf_dir).select(views.primary_profile(list(views.BUILTIN)).alias("profile")).groupBy("profile").agg(F.count("*").alias("streams"))


@query("t2_url_decode", "SELECT page_id, CASE WHEN url_decode(url) = url THEN 'noop' ELSE 'applied' END AS status, CASE WHEN url_decode(url) = url THEN '' ELSE url_decode(url) END AS url FROM pages")
def transform_urls(spark, sf_dir):
    rows = t(spark, sf_dir, "pages").select("page_id", F.encode("url", "UTF-8").alias("data"))
    return transforms.transform(rows, "url").select("page_id", "transformed.status", F.decode("transformed.data", "UTF-8").alias("url"))


@query(
    "t5_dechunk",
    "SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'applied' ELSE 'noop' END AS status, octet_length(encode(coalesce(html, '')))::BIGINT AS body_bytes FROM pages WHERE url IS NOT NULL",
)
def transform_chunked(spark, sf_dir):
    """Of all pages: chunked replies are joined, those with Content-Length stay as they are."""
    keyed = packets.with_flow(packets.decode(tables.page_packets(t(spark, sf_dir, "pages"))))
    clients = keyed.select("stream_id_hex", _client().alias("page_id")).distinct()
    replies = content.read(content.ranges(streams.fold(keyed).where("tag = 'chunk' AND direction = 'b_to_a'"))).join(clients, "stream_id_hex")
    done = transforms.transform(replies, "chain:chunked")
    data = F.when(F.col("transformed.status") == "noop", F.col("data")).otherwise(F.col("transformed.data"))
    done = done.select("page_id", "transformed.status", data.alias("data"))
    head = F.length(F.substring_index(native.latin1("data"), "\r\n\r\n", 1)) + 4
    return done.select("page_id", "status", (F.length("data") - head).cast("long").alias("body_bytes"))


# ---- the same operators over plain tables ------------------------------------------------------------------------


@query("k4_w4_shard_loads", "SELECT (l_orderkey % 8)::BIGINT AS shard, count(*)::BIGINT AS packets, sum(l_quantity::BIGINT)::BIGINT AS bytes, count(DISTINCT l_partkey)::BIGINT AS flows FROM lineitem GROUP BY 1")
def shard_loads(spark, sf_dir):
    return stats.shard_loads(_lines(spark, sf_dir), "shard", "size", "flow")


def _lines(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 8).alias("shard"), F.col("l_quantity").cast("long").alias("size"), F.col("l_partkey").alias("flow"))


_LOADS = "(SELECT l_orderkey % 8 AS shard, count(*) AS packets, sum(l_quantity::BIGINT) AS bytes FROM lineitem GROUP BY 1)"


@query("k5_skew", f"SELECT (max(bytes) * count(*) * 1000 // sum(bytes))::BIGINT AS skew FROM {_LOADS}")
def skew(spark, sf_dir):
    return stats.skew(stats.shard_loads(_lines(spark, sf_dir), "shard", "size", "flow"), "bytes", "skew")


@query("k7_busiest", f"SELECT shard::BIGINT AS shard, packets::BIGINT AS packets FROM {_LOADS} ORDER BY packets DESC, shard DESC LIMIT 1")
def busiest(spark, sf_dir):
    return stats.busiest(stats.shard_loads(_lines(spark, sf_dir), "shard", "size", "flow"), "shard", "packets")


@query(
    "k6_hot_flows",
    """SELECT shard::BIGINT AS shard, flow, bytes::BIGINT AS bytes, packets::BIGINT AS packets, (bytes * 1000 // total)::BIGINT AS share_milli FROM (
    SELECT *, sum(bytes) OVER (PARTITION BY shard) AS total, row_number() OVER (PARTITION BY shard ORDER BY bytes DESC, flow) AS n FROM
    (SELECT l_orderkey % 8 AS shard, l_partkey AS flow, sum(l_quantity::BIGINT) AS bytes, count(*) AS packets FROM lineitem GROUP BY 1, 2)) WHERE n = 1""",
)
def hot_flows(spark, sf_dir):
    return stats.hot_flows(_lines(spark, sf_dir), "shard", "flow", "size").select("shard", "flow", "bytes", "packets", "share_milli")


@query("w3_distribution", f"SELECT min(packets)::BIGINT AS least, max(packets)::BIGINT AS most, (max(packets) * 1000 // min(packets))::BIGINT AS ratio_milli FROM {_LOADS}")
def distribution(spark, sf_dir):
    loads = stats.shard_loads(_lines(spark, sf_dir), "shard", "size", "flow")
    return stats.distribution(loads, "packets").select("least", "most", native.milli(F.col("most"), F.col("least")).alias("ratio_milli"))


@query(
    "w2_run_aggregates",
    "SELECT (o_custkey % 4)::BIGINT AS workers, count(*)::BIGINT AS runs, min(o_orderkey * 1000 // 8)::BIGINT AS min_pps, max(o_orderkey * 1000 // 8)::BIGINT AS max_pps FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
)
def run_aggregates(spark, sf_dir):
    runs = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("workers"), (F.col("o_orderstatus") == "P").alias("warmup"), F.col("o_orderkey").alias("packets"), F.col("o_orderkey").alias("bytes"), F.lit(8).alias("elapsed_ms"))
    return stats.run_aggregates(runs).select("workers", "runs", F.floor("min_pps").cast("long").alias("min_pps"), F.floor("max_pps").cast("long").alias("max_pps"))


@query(
    "w6_baseline",
    """WITH c AS (SELECT o_custkey % 4 AS workers, count(*) AS v FROM orders GROUP BY 1), b AS (SELECT c_custkey % 3 AS workers, count(*) * 12 AS v FROM customer GROUP BY 1)
    SELECT c.workers::BIGINT AS workers, CASE WHEN b.v IS NULL THEN 'missing_baseline' WHEN (c.v - b.v) * 100.0 / b.v < -10 THEN 'regression' ELSE 'ok' END AS status FROM c LEFT JOIN b USING (workers)""",
)
def baseline(spark, sf_dir):
    now = t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 4).alias("workers")).agg(F.count("*").cast("double").alias("avg_pps"))
    then = t(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 3).alias("workers")).agg((F.count("*") * 12).cast("double").alias("avg_pps"))
    return stats.compare_to_baseline(now, then).select("workers", "status")


@query(
    "k8_pressure",
    "SELECT (p_partkey)::BIGINT AS id, CASE WHEN p_size * 20 >= 900 THEN 'saturated' WHEN p_size * 20 >= 750 THEN 'hot' WHEN p_size * 20 >= 600 THEN 'watch' ELSE 'healthy' END AS state FROM part",
)
def pressure(spark, sf_dir):
    zero = F.lit(0)
    rows = t(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.lit(4).alias("shards"), F.lit(1000).alias("packets"), F.lit(1000).alias("packet_skew"), F.lit(1000).alias("byte_skew"),
        (F.col("p_size") * 20).alias("queue_fill"), zero.alias("output_fill"), zero.alias("fallback"), zero.alias("malformed"), zero.alias("elephants"),
    )
    return stats.pressure(rows).select("id", "state")


@query(
    "k9_rates",
    """SELECT event_id, round((event_id - lag(event_id) OVER w) * 1e6 / (epoch_us(ts) - lag(epoch_us(ts)) OVER w), 6) AS per_second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def rates(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return stats.rates(rows, "user_id", "event_id", "us", "event_id").select("event_id", F.round("per_second", 6).alias("per_second"))


@query(
    "f6_idle_epochs",
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_id + 1 AS n FROM events), s AS (SELECT n, us FROM e WHERE n % 64 = 0),
    p AS (SELECT *, lag(n) OVER w AS before, lag(us) OVER w AS seen FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    q AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.n > p.before AND s.n <= p.n AND s.us - p.seen > 3600000000) THEN 1 ELSE 0 END AS fresh FROM p)
    SELECT event_id, user_id, (sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS epoch FROM q""",
)
def idle_epochs(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("event_id") + 1).alias("n"))
    return packets.epochs(rows, "user_id", "event_id", "us", 64, 3600, "n").select("event_id", "user_id", F.col("epoch").cast("long").alias("epoch"))


@query("v3_q1_keep_last", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20")
def keep_last(spark, sf_dir):
    return views.keep_last(t(spark, sf_dir, "events"), "user_id", "event_id", 20).select("event_id", "user_id")


@query("v1_latest", "SELECT user_id, max_by(event_type, event_id) AS event_type, min(event_id) AS view_order FROM events GROUP BY 1")
def latest(spark, sf_dir):
    return views.latest(t(spark, sf_dir, "events"), "user_id", "event_id", ["event_type"]).select("user_id", "event_type", "view_order")


@query(
    "v2_match_accumulation",
    "SELECT doc_id, count(l.doc_id2)::BIGINT AS match_count, coalesce(string_agg(DISTINCT l.pattern_id, ',' ORDER BY l.pattern_id), '') AS patterns FROM documents LEFT JOIN (SELECT doc_id AS doc_id2, 'quality:' || quality AS pattern_id FROM labels) l ON doc_id = doc_id2 GROUP BY 1",
)
def match_accumulation(spark, sf_dir):
    found = t(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("quality:"), F.col("quality").cast("string")).alias("pattern_id"))
    return views.with_matches(t(spark, sf_dir, "documents").select("doc_id"), found, "doc_id").select("doc_id", "match_count", F.concat_ws(",", "pattern_ids").alias("patterns"))


@query("v2_orphans", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_matches(spark, sf_dir):
    return views.orphans(t(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), t(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query(
    "v7_v8_hide_rules",
    """SELECT d.doc_id, (l.doc_id IS NOT NULL) AS favorite, CASE WHEN n.doc_id IS NOT NULL THEN 'manual' WHEN lang = 'de' THEN 'service:de' WHEN source = 'src3' THEN 'status:src3' END AS hidden_reason
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) n USING (doc_id)""",
)
def hide_rules(spark, sf_dir):
    view, labels = _document_view(spark, sf_dir), t(spark, sf_dir, "labels")
    rules = [("service", "de"), ("service", "de"), ("status", "src3")]
    return views.with_state(view, labels.where("quality = 1"), labels.where("toxic = 1"), rules, "doc_id").select("doc_id", "favorite", "hidden_reason")


def _document_view(spark, sf_dir):
    return t(spark, sf_dir, "documents").select(
        "doc_id", F.col("doc_id").alias("view_index"), F.col("lang").alias("service"), F.col("source").alias("status"), F.lit("tcp").alias("protocol"), (F.col("doc_id") % 100).alias("a_port"),
        F.lit(80).alias("b_port"), F.lit("text").alias("content_kind"), (F.col("doc_id") % 3).alias("match_count"), F.array().cast("array<string>").alias("pattern_ids"),
    )


@query(
    "v5_v6_stream_page",
    """WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, count(*) OVER () AS total FROM documents WHERE doc_id >= 40 AND lang = 'en' AND doc_id % 3 > 0)
    SELECT doc_id, (SELECT max(CASE WHEN total > 25 THEN doc_id + 1 END) FROM p WHERE n = 25)::BIGINT AS next_cursor FROM p WHERE n <= 25""",
)
def stream_page(spark, sf_dir):
    view = views.with_state(_document_view(spark, sf_dir), key="doc_id")
    return views.stream_page(view, views.StreamQuery(service="EN", matched=True, cursor=40, limit=25)).select("doc_id", F.col("next_cursor").cast("long").alias("next_cursor"))


@query(
    "q2_q3_message_page",
    """WITH m AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS offset_, count(*) OVER (PARTITION BY user_id) AS total FROM events WHERE event_type = 'click')
    SELECT event_id, user_id, total::BIGINT AS total FROM m WHERE offset_ >= 5 AND offset_ < 15""",
)
def message_page(spark, sf_dir):
    """The page of every user's stream."""
    return views.message_page(t(spark, sf_dir, "events"), "event_id", 5, 10, each="user_id", event_type="click").select("event_id", "user_id", "total")


@query("e5_delta_page", "SELECT event_id AS cursor, true AS missed FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 500 AND event_id > 10 ORDER BY 1 LIMIT 100")
def delta_page(spark, sf_dir):
    return views.delta_page(t(spark, sf_dir, "events").select(F.col("event_id").alias("cursor")), 10, 500, 100).select("cursor", "missed")


@query("m3_literal_hits", "SELECT doc_id, i - 1 AS at FROM (SELECT doc_id, text, unnest(range(1, length(text))) AS i FROM documents) WHERE substr(text, i, 2) = 'sh'")
def literal_hits(spark, sf_dir):
    return patterns.literal_hits(t(spark, sf_dir, "documents"), "doc_id", "text", "sh").select("doc_id", F.col("at").cast("long").alias("at"))


@query(
    "l3_safe_text",
    """SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x{10000}-\\x{10ffff}]', '....', 'g'), '[\\x{800}-\\x{ffff}]', '...', 'g'),
    '[\\x{80}-\\x{7ff}]', '..', 'g'), '[^\\n\\r\\t\\x20-\\x7e]', '.', 'g') AS text, regexp_matches(text, '[^\\n\\r\\t\\x20-\\x7e]') AS lossy FROM conversations""",
)
def safe_text(spark, sf_dir):
    """Of all turns: a character outside ASCII becomes as many dots as it has UTF-8 bytes."""
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.encode("text", "UTF-8").alias("data"))
    return content.text_view(rows).select("conv_id", "turn", "text", "lossy")


@query(
    "l4_hex_rows",
    """SELECT page_id, o::BIGINT AS "offset", trim(regexp_replace(lower(substr(h, o * 2 + 1, 32)), '(..)', '\\1 ', 'g')) AS hex FROM
    (SELECT page_id, hex(encode(url)) AS h, unnest(range(0, octet_length(encode(url)), 16)) AS o FROM pages)""",
)
def hex_rows(spark, sf_dir):
    rows = t(spark, sf_dir, "pages").select("page_id", F.encode("url", "UTF-8").alias("data"))
    return content.hex_view(rows, "page_id").select("page_id", "offset", "hex")


@query("l5_copy", "SELECT page_id, base64(encode(url)) AS copy FROM pages")
def copy(spark, sf_dir):
    return content.copy_as(t(spark, sf_dir, "pages").select("page_id", F.encode("url", "UTF-8").alias("data")), "base64").select("page_id", "copy")


@query(
    "i6_i7_content_kind",
    """SELECT doc_id, least(4096, octet_length(encode(text)))::BIGINT AS sampled, 'text' AS content_kind FROM documents WHERE text IS NOT NULL""",
)
def content_kind(spark, sf_dir):
    counts = native.class_counts(F.encode("text", "UTF-8"))
    return t(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", counts["sampled"].alias("sampled"), native.content_kind(counts).alias("content_kind"))


@query(
    "i6_i7_byte_classes",
    """WITH r AS (SELECT doc_id, 'text' AS bytes_of, hex(encode(text)) AS x FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'digest', upper(md5(text)) FROM documents WHERE text IS NOT NULL),
    h AS (SELECT doc_id, bytes_of, regexp_replace(substr(x, 1, 8192), '(..)', '\\1,', 'g') AS x FROM r),
    c AS (SELECT doc_id, bytes_of, length(x) // 3 AS n, len(regexp_extract_all(x, '00,')) AS nulls, len(regexp_extract_all(x, '(09|0A|0D|20),')) AS whitespace,
        len(regexp_extract_all(x, '(0[1-8BCEF]|1.|7F),')) AS control FROM h)
    SELECT doc_id, bytes_of, n::BIGINT AS sampled, nulls::BIGINT AS nulls, whitespace::BIGINT AS whitespace, control::BIGINT AS control, (n - nulls - whitespace - control)::BIGINT AS printable,
    CASE WHEN n = 0 THEN 'unknown' WHEN nulls > 0 OR control * 100 // n > 5 THEN 'binary' WHEN (n - nulls - control) * 100 // n >= 90 THEN 'text' ELSE 'mixed' END AS content_kind FROM c""",
)
def byte_classes(spark, sf_dir):
    """Of texts, and of their digests, whose bytes are of all classes."""
    texts = t(spark, sf_dir, "documents").where("text IS NOT NULL")
    raw = texts.select("doc_id", F.lit("text").alias("bytes_of"), F.encode("text", "UTF-8").alias("data"))
    raw = raw.unionByName(texts.select("doc_id", F.lit("digest").alias("bytes_of"), F.unhex(F.md5(F.encode("text", "UTF-8"))).alias("data")))
    counts = native.class_counts(F.col("data"))
    return raw.select("doc_id", "bytes_of", *[c.alias(n) for n, c in counts.items()], native.content_kind(counts).alias("content_kind"))


@query("i10_port_service")
def port_service(spark, sf_dir):
    from ..functions.detection import PORTS

    known = spark.createDataFrame([(proto, port, s, c) for (proto, port), (s, c) in PORTS.items()], "protocol string, port int, service string, confidence int")
    flows = packets.flows(conversation_flows(spark, sf_dir)).select("stream_id_hex", "protocol", F.col("a.port").alias("a_port"), F.col("b.port").alias("b_port"))
    k = F.broadcast(known)
    a = k.select("protocol", F.col("port").alias("a_port"), F.col("service").alias("sa"), F.col("confidence").alias("ca"))
    b = k.select("protocol", F.col("port").alias("b_port"), F.col("service").alias("sb"), F.col("confidence").alias("cb"))
    return flows.join(a, ["protocol", "a_port"], "left").join(b, ["protocol", "b_port"], "left").select("stream_id_hex", F.coalesce("sa", "sb", F.lit("unknown")).alias("service"), F.coalesce("ca", "cb", F.lit(0)).alias("confidence"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of conversations, decoded, grouped to flows and put in order: bytes and first bytes of each stream."""
    chunks = content.ranges(conversation_chunks(spark, sf_dir))
    return content.read(chunks).select("stream_id_hex", "direction", F.length("data").cast("long").alias("stream_bytes"), native.preview(F.substring("data", 1, 256)).alias("preview"))
