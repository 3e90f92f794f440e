"""Capture files: a Python data source `pcap` for batch and streaming reads, and a writer; JSON lines of events.

Options: path (a file or a folder).  A file is a partition; packet_no is the file's number times 2^40 plus the packet's
place.  Both byte orders and micro- or nanosecond times are read; times before 1970 become 0.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.wire import link_layer

SCHEMA = "packet_no long, ts_sec long, ts_usec int, link_layer string, linktype int, data binary"
# Magic numbers, byte order and ticks of a microsecond.
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
FILE_SHIFT = 40


def read_file(path: str, number: int = 0) -> Iterator[tuple]:
    """Packets of a capture file."""
    with open(path, "rb") as f:
        head = f.read(24)
        if len(head) < 24 or head[:4] not in MAGICS:
            raise ValueError(f"{path} is no capture file")
        order, ticks = MAGICS[head[:4]]
        linktype = struct.unpack(f"{order}I", head[20:24])[0] & 0xFFFF
        layer, k = link_layer(linktype), 0
        while record := f.read(16):
            if len(record) < 16:
                raise ValueError(f"{path} ends within a record")
            sec, part, size, _ = struct.unpack(f"{order}iIII", record)
            data = f.read(size)
            if len(data) < size:
                raise ValueError(f"{path} ends within a packet")
            sec, part = (0, 0) if sec < 0 else (sec, part)
            yield (number << FILE_SHIFT) + k, sec, part // ticks, layer, linktype, data
            k += 1


def files(path: str) -> list[str]:
    if os.path.isdir(path):
        return sorted(os.path.join(path, x) for x in os.listdir(path) if not x.startswith(("_", ".")))
    return [path]


class _File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path") or ""

    def partitions(self):
        return [_File(p, k) for k, p in enumerate(files(self.path))]

    def read(self, partition):
        yield from read_file(partition.path, partition.number)


class _Tail(SimpleDataSourceStreamReader):
    """Whole files as they come to a folder, in the order of their names."""

    def __init__(self, options):
        self.path = options.get("path") or ""

    def initialOffset(self):
        return {"files": 0}

    def read(self, start):
        every = files(self.path)
        return iter([row for k in range(start["files"], len(every)) for row in read_file(every[k], k)]), {"files": len(every)}

    def readBetweenOffsets(self, start, end):
        every = files(self.path)
        return iter([row for k in range(start["files"], end["files"]) for row in read_file(every[k], k)])


class PcapSource(DataSource):
    """spark.dataSource.register(PcapSource); then spark.read.format("pcap").load(path)."""

    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _Tail(self.options)


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    """Packets of a capture file that every executor sees."""
    spark.dataSource.register(PcapSource)
    return spark.read.format("pcap").load(path)


def tail_pcap(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the packets of files that come to a folder."""
    spark.dataSource.register(PcapSource)
    return spark.readStream.format("pcap").load(path)


def write_file(path: str, rows, linktype: int = 1) -> None:
    """Write (ts_sec, ts_usec, data) rows to a capture file."""
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, linktype))
        for sec, usec, data in rows:
            f.write(struct.pack("<IIII", sec, usec, len(data), len(data)) + data)


def write_events(events: DataFrame, path: str) -> None:
    """One JSON object a line for each event, null fields left out; replaces what is there."""
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
