"""Each capture query against its SQL on the small tables, and the live fold against the batch fold."""

import os

import pytest

from capstride.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "m3_literal_hits"])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == columns
        by = [want.columns.index(c) for c in columns]
        assert got == sorted(map(repr, (tuple(r[k] for k in by) for r in want.fetchall())))


def test_pcap_and_live(spark, tmp_path):
    from capstride.operators import packets, streams
    from capstride.sources import pcap, tables
    from capstride.streaming import live

    (tmp_path / "in").mkdir()
    rows = [(r.ts_sec, r.ts_usec, bytes(r.data)) for r in tables.fixture_packets(spark, "out-of-order-http", 5).orderBy("packet_no").collect()]
    pcap.write_file(str(tmp_path / "in" / "a.pcap"), rows)
    batch = pcap.read_pcap(spark, str(tmp_path / "in"))
    assert [bytes(r.data) for r in batch.orderBy("packet_no").collect()] == [r[2] for r in rows]
    folded = streams.fold(packets.with_flow(packets.decode(batch)))
    key = lambda r: (r.stream_id_hex, r.event_no, r.tag, r.kind, r.summary)
    want = sorted(map(repr, map(key, folded.collect())))
    assert folded.where("tag = 'message'").count() == 5
    q = live.write_deltas(live.live_fold(pcap.tail_pcap(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert sorted(map(repr, map(key, spark.read.parquet(str(tmp_path / "out")).collect()))) == want
