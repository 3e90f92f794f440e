"""Search stream content for literals, byte strings and regular expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_STREAM, TOTAL, LOOKBACK, SPAN = 1024, 1_000_000, 4096, 65_536


@dataclass(frozen=True)
class Pattern:
    id: str
    kind: str
    raw: bytes


def parse_hex(text: str) -> bytes:
    """Bytes of hex digits with blanks, colons, dashes or underscores, and perhaps one 0x."""
    digits = re.sub(r"[\s:_-]", "", text)
    digits = digits[2:] if digits[:2].lower() == "0x" else digits
    if len(digits) % 2 or not re.fullmatch("[0-9a-fA-F]*", digits):
        raise ValueError(f"{text!r} is no whole number of hex bytes")
    return bytes.fromhex(digits)


def compile_patterns(substrings=(), regexes=(), binaries=()) -> list[Pattern]:
    """Patterns substring:i, regex:i, binary:i; empty literals and bad expressions raise."""
    out = [Pattern(f"substring:{i}", "substring", s.encode()) for i, s in enumerate(substrings)]
    out += [Pattern(f"regex:{i}", "regex", r.encode()) for i, r in enumerate(regexes)]
    out += [Pattern(f"binary:{i}", "binary", parse_hex(h)) for i, h in enumerate(binaries)]
    for p in out:
        if not p.raw:
            raise ValueError(f"{p.id} is empty")
        if p.kind == "regex":
            if re.search(rb"\(\?[=!<]|\\[1-9]", p.raw):
                raise ValueError(f"{p.id}: no look-around or back-references")
            re.compile(p.raw)
    return out


class Matcher:
    """Compiled patterns: one automaton over the bytes of all literals, and expressions one by one."""

    def __init__(self, patterns: list[Pattern]):
        self.expressions = [(p.id, re.compile(p.raw)) for p in patterns if p.kind == "regex"]
        ids: dict[bytes, list[str]] = {}
        for p in patterns:
            if p.kind != "regex":
                ids.setdefault(p.raw, []).append(p.id)
        self.longest = max(map(len, ids), default=0)
        self.automaton = None
        if ids:
            self.automaton = ahocorasick.Automaton()
            for raw, names in ids.items():
                self.automaton.add_word(raw.decode("latin-1"), (len(raw), names))
            self.automaton.make_automaton()

    def find(self, data: bytes, new_from: int = 0) -> set[tuple[str, int, int]]:
        """Matches that overlap data[new_from:]: literals overlap each other, expressions are leftmost-first."""
        out = set()
        for name, expression in self.expressions:
            out |= {(name, *m.span()) for m in expression.finditer(data) if m.end() > max(new_from, m.start())}
        if self.automaton:
            low = max(0, new_from - self.longest + 1)
            for last, (size, names) in self.automaton.iter(data[low:].decode("latin-1")):
                end = low + last + 1
                if end > new_from:
                    out |= {(name, end - size, end) for name in names}
        return out


def find(patterns: list[Pattern], data: bytes, new_from: int = 0) -> set[tuple[str, int, int]]:
    return Matcher(patterns).find(data, new_from)


_SCHEMA = pa.schema([(n, pa.string()) for n in ("stream_id_hex", "direction", "pattern_id")] + [(n, pa.int64()) for n in ("packet_no", "event_no", "start", "end")] + [("data", pa.binary())])
MATCHES = "stream_id_hex string,direction string,pattern_id string,packet_no long,event_no long,start long,end long,data binary"


def scan(chunks: DataFrame, patterns: list[Pattern], lookback: int = LOOKBACK) -> DataFrame:
    """Matches of each chunk in its stream's order; a window of earlier bytes finds those across chunks."""
    back = max([lookback, *(len(p.raw) - 1 for p in patterns)])

    def run(batches):
        key, tail, at, matcher = None, b"", 0, Matcher(patterns)
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if key != (r["stream_id_hex"], r["direction"]):
                    key, tail, at = (r["stream_id_hex"], r["direction"]), b"", 0
                data = tail + r["data"]
                base = at - len(tail)
                for pid, low, high in sorted(matcher.find(data, len(tail)), key=lambda m: (m[1], m[2], m[0])):
                    rows.append((*key, pid, r["packet_no"], r["event_no"], base + low, base + high, data[low:high]))
                at += len(r["data"])
                tail = data[-back:] if back else b""
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 8, _SCHEMA)], schema=_SCHEMA)

    rows = chunks.select("stream_id_hex", "direction", "packet_no", "event_no", "data").repartition("stream_id_hex", "direction")
    return rows.sortWithinPartitions("stream_id_hex", "direction", "packet_no", "event_no").mapInArrow(run, MATCHES)


def capped(matches: DataFrame, per_stream: int = PER_STREAM, total: int | None = TOTAL) -> DataFrame:
    """The first `per_stream` matches of each stream and, of these, the first `total` of the run (None: all) have `stored`.

    The run's order is that of packets.  Only counts of SPAN packets at a time meet in one task.
    """
    order = ["packet_no", "event_no", "start", "end", "pattern_id"]
    rows = matches.withColumn("stored", F.row_number().over(Window.partitionBy("stream_id_hex").orderBy(*order)) <= per_stream)
    if total is None:
        return rows
    rows = rows.withColumn("__span", F.floor(F.col("packet_no") / SPAN))
    counts = rows.where("stored").groupBy("__span").agg(F.count("*").alias("__n"))
    before = counts.select("__span", (F.sum("__n").over(Window.orderBy("__span")) - F.col("__n")).alias("__before"))
    # a span's stored rows come first, so that their ranks count them alone
    rank = F.row_number().over(Window.partitionBy("__span").orderBy(F.desc("stored"), *order, "stream_id_hex", "direction"))
    ranked = rows.withColumn("__rank", rank).join(before, "__span", "left")
    return ranked.withColumn("stored", F.col("stored") & (F.col("__before") + F.col("__rank") <= total)).drop("__span", "__rank", "__before")


def match_events(matches: DataFrame) -> DataFrame:
    """What is told of a match: range, Base64, and text where all bytes are text."""
    from ..functions import native

    textish = ~native.latin1(F.col("data")).rlike("[^\\t\\r\\n\\x20-\\x7e]")
    return matches.select(
        "stream_id_hex", "direction", "pattern_id", "packet_no", "event_no", "start", "end", (F.col("end") - F.col("start")).alias("length"),
        native.base64("data").alias("match_base64"), F.when(textish, native.preview(F.col("data"))).alias("match_text"),
    )


def match_stats(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count_if("stored").alias("matches"), F.count_if(~F.col("stored")).alias("dropped"), F.count_distinct("stream_id_hex").alias("matched_streams"))


def literal_hits(rows: DataFrame, key: str, text: str, literal: str) -> DataFrame:
    """Offsets of a literal in text, overlapping, natively: (key, at) from 0."""
    last = F.length(text) - len(literal)
    places = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text), i + 1, F.lit(len(literal))) == literal))
    return rows.where(F.col(text).contains(literal)).select(key, F.explode(places).alias("at"))
