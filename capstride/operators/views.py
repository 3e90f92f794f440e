"""Queryable streams and messages: latest rows, matches, filters, profiles, hide rules, pages.  All native."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native

KEEP_MESSAGES, KEEP_MATCHES, MOST_ROWS = 2048, 256, 512


def keep_last(rows: DataFrame, by, order, most: int) -> DataFrame:
    """The newest `most` rows of each key."""
    newest = Window.partitionBy(by).orderBy(*[F.desc(o) for o in ([order] if isinstance(order, str) else order)])
    return rows.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= most).drop("__n")


def latest(events: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The latest values of each key, and view_order: the place of its first event."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__l"), F.min(order).alias("view_order")).select(key, "view_order", "__l.*")


def with_matches(view: DataFrame, matches: DataFrame, key: str = "stream_id_hex") -> DataFrame:
    """match_count and the sorted set of pattern ids for each view row; matches of unknown streams are left out."""
    found = matches.groupBy(key).agg(F.count("*").alias("match_count"), F.sort_array(F.collect_set("pattern_id")).alias("pattern_ids"))
    return view.join(found, key, "left").withColumns({"match_count": F.coalesce("match_count", F.lit(0)), "pattern_ids": F.coalesce("pattern_ids", F.array().cast("array<string>"))})


def orphans(view: DataFrame, matches: DataFrame, key: str = "stream_id_hex") -> DataFrame:
    return matches.join(view, key, "left_anti")


def enriched(view: DataFrame, messages: DataFrame) -> DataFrame:
    """Protocol parsers' evidence replaces a stream's service; binary content of text protocols becomes mixed."""
    port = F.coalesce(F.col("service"), F.lit("unknown"))
    service = F.when(F.col("m.protocol") == "http1", "http").when(F.col("m.protocol") == "tls", F.when(port.isin("https"), "https").otherwise("tls")).otherwise(F.col("m.protocol"))
    last = messages.where("kind <> 'parse_error'").groupBy("stream_id_hex").agg(F.max_by(F.struct("protocol", F.col("source").alias("event")), "event_no").alias("m"))
    rows = view.join(last, "stream_id_hex", "left")
    known = F.col("m.protocol").isNotNull()
    return rows.withColumns({
        "service": F.when(known, service).otherwise(F.col("service")), "confidence": F.when(known, F.lit(100)).otherwise(F.col("confidence")),
        "source": F.when(known, F.lit("parser")).otherwise(F.col("source")), "evidence": F.when(known, F.col("m.event")).otherwise(F.col("evidence")),
        "content_kind": F.when(known & (F.col("content_kind") == "binary") & (F.col("m.protocol") != "tls"), "mixed").otherwise(F.col("content_kind")),
    }).drop("m")


@dataclass(frozen=True)
class Profile:
    """A named filter: enabled, and of its protocol, and of one of its services, ports, kinds or patterns."""

    id: str
    name: str = ""
    priority: int = 50
    enabled: bool = True
    protocol: str | None = None
    services: tuple = ()
    ports: tuple = ()
    content_kind: str | None = None
    pattern_ids: tuple = ()
    transforms: tuple = ()
    hide_rules: tuple = ()

    def column(self) -> Column:
        if not self.enabled:
            return F.lit(False)
        if self.id == "matched":
            return F.col("match_count") > 0
        some = [F.lit(False)]
        if self.services:
            some.append(F.lower("service").isin(*self.services))
        if self.ports:
            some.append(F.col("a_port").isin(*self.ports) | F.col("b_port").isin(*self.ports))
        if self.content_kind:
            some.append(F.col("content_kind") == self.content_kind)
        if self.pattern_ids:
            some.append(F.arrays_overlap("pattern_ids", F.array(*map(F.lit, self.pattern_ids))))
        out = some[0]
        for c in some[1:]:
            out = out | c
        out = F.coalesce(out, F.lit(False))
        return out & (F.col("protocol") == self.protocol) if self.protocol else out


# The profiles that are always there.
BUILTIN = (
    Profile("http", "HTTP", 100, protocol="tcp", services=("http",), ports=(80, 8000, 8008, 8080, 8081, 8888)),
    Profile("https", "HTTPS", 95, protocol="tcp", services=("https",), ports=(443, 8443)),
    Profile("tls", "TLS", 90, protocol="tcp", services=("tls",)),
    Profile("dns", "DNS", 85, services=("dns", "mdns", "llmnr"), ports=(53, 5353, 5355)),
    Profile("websocket", "WebSocket", 80, protocol="tcp", services=("websocket",)),
    Profile("binary", "Binary", 40, content_kind="binary"),
    Profile("matched", "Matched", 30),
)


def load_profiles(text: str) -> list[Profile]:
    """Profiles of a JSON file over the built-in ones, by falling priority; equal ids replace."""
    raw = json.loads(text)
    out = {p.id: p for p in BUILTIN} if raw.get("include_builtins", True) else {}
    for p in raw.get("profiles", []):
        pid = p["id"].strip().lower()
        steps = p.get("default_transforms") or ([p["default_transform"]] if p.get("default_transform") else [])
        out[pid] = Profile(
            pid, p.get("name") or pid, p.get("priority", 50), p.get("enabled", True), (p.get("protocol") or "").strip().lower() or None,
            tuple(s.strip().lower() for s in p.get("services", [])), tuple(sorted(set(p.get("ports", [])))), p.get("content_kind"), tuple(p.get("pattern_ids", [])),
            tuple(steps), tuple((r["kind"], r.get("value")) for r in p.get("hide_rules", [])),
        )
    return sorted(out.values(), key=lambda p: -p.priority)


def primary_profile(profiles: list[Profile]) -> Column:
    """The id of the first profile by falling priority that a row fits."""
    return native.first_when([(p.column(), p.id) for p in sorted(profiles, key=lambda p: -p.priority)])


def profile_stats(view: DataFrame, profiles: list[Profile]) -> DataFrame:
    """Rows (profile, total, visible, hidden, matched, favorite): one pass over the view."""
    ids = F.array_compact(F.array(*[F.when(p.column(), F.lit(p.id)) for p in profiles]))
    every = view.sparkSession.createDataFrame([(p.id,) for p in profiles], "profile string")
    hidden = F.col("hidden_reason").isNotNull()
    counted = view.withColumn("profile", F.explode(ids)).groupBy("profile").agg(
        F.count("*").alias("total"), F.count_if(~hidden).alias("visible"), F.count_if(hidden).alias("hidden"), F.count_if(F.col("match_count") > 0).alias("matched"), F.count_if("favorite").alias("favorite")
    )
    return every.join(F.broadcast(counted), "profile", "left").fillna(0)


def rule_column(kind: str, value) -> Column:
    """A hide rule's condition."""
    rules = {
        "service": lambda: F.lower("service") == str(value).lower(), "port": lambda: (F.col("a_port") == int(value)) | (F.col("b_port") == int(value)),
        "protocol": lambda: F.col("protocol") == value, "content_kind": lambda: F.col("content_kind") == value, "status": lambda: F.col("status") == value,
        "pattern": lambda: F.array_contains("pattern_ids", value), "unmatched": lambda: F.col("match_count") == 0,
    }
    if kind not in rules:
        raise ValueError(f"unknown hide rule {kind}")
    return F.coalesce(rules[kind](), F.lit(False))


def with_state(view: DataFrame, favorites: DataFrame | None = None, hidden: DataFrame | None = None, rules: list[tuple] = (), key: str = "stream_id_hex") -> DataFrame:
    """favorite and hidden_reason: manual, else the label of the first hide rule; repeated rules count once."""
    rules = list(dict.fromkeys(rules))
    out = view
    if favorites is not None:
        out = out.join(favorites.select(key, F.lit(True).alias("favorite")).distinct(), key, "left")
    else:
        out = out.withColumn("favorite", F.lit(False))
    if hidden is not None:
        out = out.join(hidden.select(key, F.lit(True).alias("__manual")).distinct(), key, "left")
    else:
        out = out.withColumn("__manual", F.lit(False))
    by_rule = native.first_when([(rule_column(k, v), f"{k}:{v}" if v is not None else k) for k, v in rules]) if rules else F.lit(None).cast("string")
    reason = F.when(F.coalesce("__manual", F.lit(False)), F.lit("manual")).otherwise(by_rule)
    return out.withColumn("favorite", F.coalesce("favorite", F.lit(False))).withColumn("hidden_reason", reason).drop("__manual")


@dataclass(frozen=True)
class StreamQuery:
    """Optional conditions, all of which must hold; hidden rows stay out unless asked for."""

    include_hidden: bool = False
    favorites: bool = False
    matched: bool = False
    profile: Profile | None = None
    protocol: str | None = None
    service: str | None = None
    port: int | None = None
    content_kind: str | None = None
    status: str | None = None
    pattern_id: str | None = None
    cursor: int = 0
    limit: int = 100
    more: dict = field(default_factory=dict)

    def column(self) -> Column:
        out = F.lit(True) if self.include_hidden else F.col("hidden_reason").isNull()
        for wanted, rule in (
            (self.favorites, lambda: F.col("favorite")), (self.matched, lambda: F.col("match_count") > 0), (self.profile, lambda: self.profile.column()),
            (self.protocol, lambda: F.col("protocol") == self.protocol), (self.service, lambda: F.lower("service") == self.service.lower()),
            (self.port is not None, lambda: (F.col("a_port") == self.port) | (F.col("b_port") == self.port)), (self.content_kind, lambda: F.col("content_kind") == self.content_kind),
            (self.status, lambda: F.col("status") == self.status), (self.pattern_id, lambda: F.array_contains("pattern_ids", self.pattern_id)),
        ):
            if wanted:
                out = out & F.coalesce(rule(), F.lit(False))
        return out


def stream_page(view: DataFrame, query: StreamQuery) -> DataFrame:
    """A page in view order; the cursor counts rows before filters, and next_cursor is null at the end.

    `view` has a dense view_index; the page holds at most MOST_ROWS rows.
    """
    most = max(1, min(MOST_ROWS, query.limit))
    few = view.where(F.col("view_index") >= query.cursor).where(query.column()).orderBy("view_index").limit(most + 1)
    rank, total = F.row_number().over(Window.orderBy("view_index")), F.count("*").over(Window.partitionBy())
    page = few.withColumn("__n", rank).withColumn("__all", total)
    last = F.max(F.when(F.col("__n") == most, F.col("view_index"))).over(Window.partitionBy())
    return page.withColumn("next_cursor", F.when(F.col("__all") > most, last + 1)).where(F.col("__n") <= most).drop("__n", "__all")


def message_page(messages: DataFrame, order: str, cursor: int = 0, limit: int = 100, each: str | None = None, **equal) -> DataFrame:
    """A page of the filtered messages of one stream, or of each stream by the key `each`, with total and next_cursor; the cursor is an offset."""
    most = max(1, min(MOST_ROWS, limit))
    rows = messages
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    # one stream keeps at most KEEP_MESSAGES messages
    by = [each] if each else []
    rank, total = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1, F.count("*").over(Window.partitionBy(*by))
    page = rows.withColumn("offset", rank).withColumn("total", total).where((F.col("offset") >= cursor) & (F.col("offset") < cursor + most))
    return page.withColumn("next_cursor", F.when(F.col("total") > cursor + most, F.lit(cursor + most)))


def message_counters(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.count("*").alias("observed"), *[F.count_if(F.col("protocol") == p).alias(p) for p in ("http1", "dns", "websocket", "tls")], F.count_if(F.col("status") == "parse_error").alias("errors")
    )


def view_stats(view: DataFrame) -> DataFrame:
    return view.agg(
        F.count("*").alias("tracked"), F.count_if("favorite").alias("favorite"), F.count_if(F.col("hidden_reason").isNotNull()).alias("hidden"), F.count_if(F.col("match_count") > 0).alias("matched")
    )


def newest_streams(view: DataFrame, most: int) -> DataFrame:
    """Leave out the streams first seen when there are more than `most`."""
    return view.orderBy(F.desc("view_order")).limit(most)


def delta_page(deltas: DataFrame, cursor: int, capacity: int = 16_384, limit: int = 8192) -> DataFrame:
    """Deltas after a cursor from the newest `capacity`, with missed, dropped_before and next_cursor."""
    latest_cursor = deltas.agg(F.coalesce(F.max("cursor"), F.lit(0)).alias("latest"))
    kept = deltas.join(F.broadcast(latest_cursor), F.lit(True))  # one row
    before = F.greatest(F.col("latest") - capacity, F.lit(0))
    rows = kept.withColumn("dropped_before", before).where((F.col("cursor") > F.greatest(F.col("dropped_before"), F.lit(cursor)))).orderBy("cursor").limit(min(limit, 8192))
    return rows.withColumn("missed", F.lit(cursor) < F.col("dropped_before"))
