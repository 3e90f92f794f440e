"""A small HTTP server around the query functions over saved tables; JSON only.

Routes: /health, /streams, /streams/<id>, /streams/<id>/matches, /streams/<id>/messages, /streams/<id>/content, /profiles, /deltas.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native
from ..functions.transforms import chain, parse_plan
from ..operators import content, views


def stream_key(text: str) -> str:
    """A stream's id from 16 hex digits, 0x and hex digits, or a decimal number."""
    text = text.strip().lower()
    if text.startswith("0x"):
        return f"{int(text[2:], 16):016x}"
    if len(text) == 16:
        return f"{int(text, 16):016x}"
    return f"{int(text):016x}"


class Api:
    """Queries over the tables of a run: view (with state), matches, messages, content, deltas, health."""

    def __init__(self, tables: dict[str, DataFrame], profiles=views.BUILTIN):
        self.tables, self.profiles = tables, {p.id: p for p in profiles}

    def rows(self, df: DataFrame) -> list[dict]:
        return [json.loads(x) for x in df.toJSON().take(views.MOST_ROWS)]

    def handle(self, path: str, q: dict[str, str]) -> tuple[int, object]:
        parts = [p for p in path.split("/") if p]
        try:
            return self._route(parts, q)
        except (ValueError, KeyError) as why:
            return 400, {"error": str(why)}

    def _route(self, parts: list[str], q: dict[str, str]) -> tuple[int, object]:
        flag = lambda name: q.get(name, "").lower() in ("1", "true", "yes")
        number = lambda name, default: int(q.get(name, default))
        if parts == ["health"]:
            return 200, self.rows(self.tables["health"])[0]
        if parts == ["profiles"]:
            return 200, self.rows(views.profile_stats(self.tables["view"], list(self.profiles.values())))
        if len(parts) == 2 and parts[0] == "profiles":
            if parts[1] not in self.profiles:
                return 404, {"error": "unknown profile"}
            return 200, self.rows(views.profile_stats(self.tables["view"], [self.profiles[parts[1]]]))[0]
        if parts == ["deltas"]:
            return 200, self.rows(views.delta_page(self.tables["deltas"], number("cursor", 0), limit=number("limit", 512)))
        if parts == ["streams"]:
            query = views.StreamQuery(
                flag("include_hidden"), flag("favorites"), flag("matched"), self.profiles[q["profile"]] if "profile" in q else None, q.get("protocol"), q.get("service"),
                number("port", 0) if "port" in q else None, q.get("content_kind"), q.get("status"), q.get("pattern_id"), number("cursor", 0), number("limit", 100),
            )
            return 200, self.rows(views.stream_page(self.tables["view"], query))
        if parts[:1] != ["streams"] or len(parts) > 3:
            return 404, {"error": "unknown route"}
        key = stream_key(parts[1])
        one = lambda name: self.tables[name].where(F.col("stream_id_hex") == key)
        if len(parts) == 2:
            found = self.rows(one("view"))
            return (200, found[0]) if found else (404, {"error": "unknown stream"})
        if parts[2] == "matches":
            return 200, self.rows(views.keep_last(one("matches"), "stream_id_hex", ["packet_no", "start"], views.KEEP_MATCHES))
        if parts[2] == "messages":
            page = views.message_page(one("messages"), "event_no", number("cursor", 0), number("limit", 100), direction=q.get("direction"), protocol=q.get("protocol"), kind=q.get("kind"), status=q.get("status"))
            return 200, self.rows(page)
        if parts[2] == "content":
            cut = content.slice_of(self.tables["content"], key, q.get("direction", "a_to_b"), number("start", 0), number("len", content.SLICE_BYTES))
            if "transform" in q:
                raw = b"".join(bytes(r.data) for r in cut.orderBy("start").collect())
                done, steps = chain(parse_plan(q["transform"]), raw)
                return 200, {"status": done.status, "text": done.data.decode("latin-1"), "steps": steps}
            mode = {"text": native.safe_text, "hex": native.hex_text, "base64": native.base64}[q.get("mode", "text")]
            return 200, self.rows(cut.select("start", "end", mode(F.col("data")).alias("data")).orderBy("start"))
        return 404, {"error": "unknown route"}


def serve(api: Api, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that the caller runs; port 0 takes any free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            url = urlsplit(self.path)
            status, body = api.handle(url.path, {k: v[-1] for k, v in parse_qs(url.query).items()})
            raw = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
