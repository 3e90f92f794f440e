"""Stored payload of streams: logical ranges, windows, slices, views.  All native.

Chunks are rows (stream_id_hex, direction, packet_no, event_no, data); content rows add start and end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native

SEGMENT_BYTES, STREAM_BYTES, SLICE_BYTES, HIGHLIGHTS = 64 << 10, 8 << 20, 64 << 10, 4096
WAY = ("stream_id_hex", "direction")


def ranges(chunks: DataFrame, by: tuple = WAY, order: tuple = ("packet_no", "event_no")) -> DataFrame:
    """Give each chunk the logical range [start, end) of its stream and direction."""
    size = F.length("data").cast("long")
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = chunks.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))
    return rows.withColumn("end", F.col("start") + size)


def split(content: DataFrame, most: int = SEGMENT_BYTES) -> DataFrame:
    """Cut chunks into segments of at most `most` bytes."""
    size = F.col("end") - F.col("start")
    rows = content.withColumn("__k", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / most), F.lit(0)))))
    low = F.col("start") + F.col("__k") * most
    data = F.substring("data", (F.col("__k") * most + 1).cast("int"), F.lit(most))
    return rows.withColumn("data", data).withColumn("end", F.least(low + most, F.col("end"))).withColumn("start", low).drop("__k")


def trim(content: DataFrame, most: int = STREAM_BYTES) -> DataFrame:
    """Keep the newest `most` bytes of a stream over both directions; the oldest stored segment is cut first."""
    size = F.col("end") - F.col("start")
    newer = Window.partitionBy("stream_id_hex").orderBy(F.desc("packet_no"), F.desc("event_no")).rowsBetween(Window.unboundedPreceding, -1)
    room = F.lit(most) - F.coalesce(F.sum(size).over(newer), F.lit(0))
    rows = content.withColumn("__room", room).where("__room > 0")
    cut = F.greatest(size - F.col("__room"), F.lit(0)).cast("int")
    return rows.withColumn("data", F.expr("substring(data, cast(greatest(end - start - __room, 0) as int) + 1)")).withColumn("start", F.col("start") + cut).drop("__room")


def read(content: DataFrame, by: tuple = WAY) -> DataFrame:
    """The stored bytes of each stream and direction."""
    return content.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.expr("listagg(data) WITHIN GROUP (ORDER BY start)").alias("data"))


def windows(content: DataFrame, start: int, end: int, by: tuple = WAY) -> DataFrame:
    """Clip stored segments to [start, end) and join those that touch."""
    low, high = F.greatest(F.col("start"), F.lit(start)), F.least(F.col("end"), F.lit(end))
    clipped = content.where((F.col("start") < end) & (F.col("end") > start)).select(
        *by, low.alias("start"), high.alias("end"), F.substring("data", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("data")
    )
    along = Window.partitionBy(*by).orderBy("start")
    part = F.coalesce(F.lag("end").over(along) != F.col("start"), F.lit(False)).cast("int")
    islands = clipped.withColumn("__new", part).withColumn("window", F.sum("__new").over(along))
    return read(islands, (*by, "window"))


def counters(content: DataFrame) -> DataFrame:
    return content.agg(
        F.count_distinct("stream_id_hex").alias("active"), F.count("*").alias("segments"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("stored_bytes")
    )


def content_counters(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """counters() of what is stored beside what was seen: updates, observed and dropped bytes, streams cut or gone."""
    size = lambda rows, name: rows.groupBy("stream_id_hex").agg(F.sum(F.length("data").cast("long")).alias(name), F.count("*").alias(f"{name}_rows"))
    rows = size(chunks, "seen").join(size(stored, "held"), "stream_id_hex", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    held = F.coalesce("held", F.lit(0))
    return rows.agg(
        F.count("held").alias("active"), total("held_rows").alias("segments"), total("held").alias("stored_bytes"), total("seen").alias("observed_bytes"), total("seen_rows").alias("updates"),
        total(F.col("seen") - held).alias("dropped_bytes"), F.count_if(F.col("held") < F.col("seen")).alias("truncated"), F.count_if(F.col("held").isNull()).alias("evicted"),
    )


def previews(content: DataFrame, size: int = 256) -> DataFrame:
    """The first bytes of each stream and direction, in Base64 and as escaped text, with class counts and kind."""
    head = read(content.where(F.col("start") < 4096))
    first = F.substring("data", 1, size)
    counts = native.class_counts(F.col("data"))
    return head.select(*WAY, native.base64(first).alias("preview_base64"), native.preview(first).alias("preview_text"), *[c.alias(n) for n, c in counts.items()], native.content_kind(counts).alias("content_kind"))


def slice_of(content: DataFrame, stream: str, direction: str, start: int = 0, size: int = SLICE_BYTES) -> DataFrame:
    """Windows of at most SLICE_BYTES from one stream and direction."""
    if size <= 0:
        raise ValueError("empty request")
    here = content.where((F.col("stream_id_hex") == stream) & (F.col("direction") == direction))
    return windows(here, start, start + min(size, SLICE_BYTES))


def slice_error(content: DataFrame, streams: DataFrame, stream: str, size: int = SLICE_BYTES) -> str | None:
    """Why slice_of() has nothing to give: empty_request, unknown_stream, no_content or None; a stream lookup each."""
    if size <= 0:
        return "empty_request"
    here = F.col("stream_id_hex") == stream
    if streams.where(here).isEmpty():
        return "unknown_stream"
    return "no_content" if content.where(here).isEmpty() else None


def _highlights(segments: DataFrame, matches: DataFrame) -> DataFrame:
    """Ranked parts of matches inside segments; both sides meet in the spans of SEGMENT_BYTES that they touch."""
    touched = lambda low, high: F.explode(F.sequence(F.floor(low / SEGMENT_BYTES), F.floor((high - 1) / SEGMENT_BYTES)))
    some = [x.where(F.col("end") > F.col("start")).withColumn("span", touched(F.col("start"), F.col("end"))) for x in (segments, matches)]
    s, m = some[0].alias("s"), some[1].alias("m")
    over = (F.col("m.start") < F.col("s.end")) & (F.col("m.end") > F.col("s.start")) & (F.col("s.span") == F.floor(F.greatest("s.start", "m.start") / SEGMENT_BYTES))
    for c in (*WAY, "span"):
        over &= F.col(f"s.{c}") == F.col(f"m.{c}")
    rows = s.join(m, over).select(
        "s.stream_id_hex", "s.direction", "m.pattern_id", F.greatest("s.start", "m.start").alias("start"), F.least("s.end", "m.end").alias("end"), F.col("s.start").alias("segment_start")
    )
    rank = F.row_number().over(Window.partitionBy(*WAY).orderBy("start", "end", "segment_start", "pattern_id"))
    return rows.withColumn("rank", rank)


def highlights(segments: DataFrame, matches: DataFrame, most: int = HIGHLIGHTS) -> DataFrame:
    """Parts of matches (pattern_id, start, end) inside segments, the first `most` of each stream and direction."""
    return _highlights(segments, matches).where(F.col("rank") <= most)


def highlight_counts(segments: DataFrame, matches: DataFrame, most: int = HIGHLIGHTS) -> DataFrame:
    """Parts that highlights() keeps and drops, for each stream and direction that has any."""
    kept = F.count_if(F.col("rank") <= most)
    return _highlights(segments, matches).groupBy(*WAY).agg(kept.alias("kept"), (F.count("*") - kept).alias("dropped"))


def text_view(rows: DataFrame, data: str = "data") -> DataFrame:
    return rows.withColumn("text", native.safe_text(F.col(data))).withColumn("lossy", native.lossy(F.col(data)))


def hex_view(rows: DataFrame, key: str, data: str = "data", width: int = 16) -> DataFrame:
    """Rows of `width` bytes (1 to 64): offset, hex pairs, text."""
    width = max(1, min(64, width))
    n = F.length(F.col(data))
    at = rows.where(n > 0).select(key, F.col(data), F.explode(F.sequence(F.lit(0), n - 1, F.lit(width))).alias("offset"))
    part = F.substring(F.col(data), F.col("offset") + 1, F.lit(width))
    return at.select(key, F.col("offset").cast("long").alias("offset"), native.hex_text(part).alias("hex"), F.regexp_replace(native.latin1(part), "[^\\x20-\\x7e]", ".").alias("text"))


def copy_as(rows: DataFrame, form: str, data: str = "data") -> DataFrame:
    """The bytes as base64, spaced hex or safe text."""
    forms = {"base64": native.base64, "hex": native.hex_text, "text": native.safe_text}
    if form not in forms:
        raise ValueError(f"unknown form {form}")
    return rows.withColumn("copy", forms[form](F.col(data)))


def merge_adjacent(segments: DataFrame, most: int = SEGMENT_BYTES) -> DataFrame:
    """Join segments (stream_id_hex, direction, seq, start, end, data) whose sequences touch, up to `most` bytes.

    Segments without a sequence (datagrams) stay apart.  Greedy in stream order; only the cut into segments changes.
    """
    import pyarrow as pa

    schema = pa.schema([("stream_id_hex", pa.string()), ("direction", pa.string()), ("seq", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("data", pa.binary())])

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                touches = held and r["seq"] is not None and held["seq"] is not None and (held["stream_id_hex"], held["direction"]) == (r["stream_id_hex"], r["direction"])
                if touches and (held["seq"] + len(held["data"])) % 2**32 == r["seq"] and len(held["data"]) + len(r["data"]) <= most:
                    held["data"] += r["data"]
                    held["end"] = r["end"]
                    continue
                if held:
                    out.append(held)
                held = r
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    rows = segments.select(*schema.names).repartition(*WAY).sortWithinPartitions(*WAY, "start")
    return rows.mapInArrow(run, "stream_id_hex string, direction string, seq long, start long, end long, data binary")


def keep_newest_streams(content: DataFrame, most: int) -> DataFrame:
    """Drop whole streams, least recently seen first, until `most` bytes are left; the newest always stays."""
    sizes = content.groupBy("stream_id_hex").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.max("packet_no").alias("seen"))
    # one row a stream; the running sum is a global order, so this is for stores that have a cap
    newer = Window.orderBy(F.desc("seen"), "stream_id_hex").rowsBetween(Window.unboundedPreceding, 0)
    kept = sizes.withColumn("upto", F.sum("n").over(newer)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("seen"), "stream_id_hex")))
    return content.join(kept.where((F.col("upto") <= most) | (F.col("rank") == 1)).select("stream_id_hex"), "stream_id_hex", "left_semi")
