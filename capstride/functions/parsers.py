"""Protocol messages from ordered bytes: HTTP/1, DNS, WebSocket, TLS, and the plainer event analyzers.

A parser's push() takes the next bytes of one direction and returns messages: dicts with protocol, kind, status,
ordinal, summary, logical_start, logical_end, header_bytes, body_bytes and info (a dict of what the protocol adds).
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from .detection import HTTP_METHODS
from .wire import address_text

MAX_HEADER, MAX_BUFFER, MAX_HEADERS = 64 << 10, 8 << 20, 128
_STARTS = tuple(f"{m} ".encode() for m in HTTP_METHODS) + (b"HTTP/1.",)


def message(protocol, kind, ordinal, summary, start, end, status="complete", header=0, body=0, **info) -> dict:
    return {
        "protocol": protocol, "kind": kind, "status": status, "ordinal": ordinal, "summary": summary, "logical_start": start,
        "logical_end": end, "header_bytes": header, "body_bytes": body, "info": info,
    }


def head_end(b: bytes) -> tuple[int, int] | None:
    """Length of a head without and with its blank line; the CRLF form wins even when it comes later."""
    for mark in (b"\r\n\r\n", b"\n\n"):
        at = b.find(mark)
        if at >= 0:
            return at, at + len(mark)
    return None


def line_end(b: bytes, at: int = 0) -> tuple[int, int] | None:
    """The end of a line and the start of the next; the first CRLF beats an earlier bare line feed."""
    for mark in (b"\r\n", b"\n"):
        k = b.find(mark, at)
        if k >= 0:
            return k, k + len(mark)
    return None


def parse_head(raw: bytes) -> dict:
    """Start line and headers of an HTTP/1 message; ValueError says what is wrong."""
    lines = re.split(r"\r?\n", raw.decode("utf-8", "replace"))
    headers = []
    for line in lines[1:]:
        name, sep, value = line.partition(":")
        if sep and len(headers) < MAX_HEADERS:
            headers.append((name.strip().lower(), value.strip()))
    first: dict[str, str] = {}
    for name, value in headers:
        first.setdefault(name, value)
    length = first.get("content-length", "").split(",")[0].strip()
    out = {
        "headers": headers, "host": first.get("host"), "content_length": int(length) if length.isdigit() else None,
        "transfer_encoding": first.get("transfer-encoding"), "content_encoding": first.get("content-encoding"),
        "upgrade": first.get("upgrade"), "connection": first.get("connection"),
    }
    parts = lines[0].split(None, 2)
    if lines[0].startswith("HTTP/"):
        if len(parts) < 2:
            raise ValueError("missing http status")
        if not parts[1].isdigit() or int(parts[1]) > 65535:
            raise ValueError("invalid http status")
        reason = parts[2] if len(parts) > 2 else ""
        return out | {"kind": "response", "status_code": int(parts[1]), "reason": reason, "version": parts[0], "summary": f"HTTP {parts[1]} {reason}".rstrip()}
    if not parts:
        raise ValueError("missing http method")
    if parts[0] not in HTTP_METHODS:
        raise ValueError("unknown http method")
    if len(parts) < 2:
        raise ValueError("missing http target")
    version = parts[2].split()[0] if len(parts) > 2 else ""
    return out | {"kind": "request", "method": parts[0], "target": parts[1], "version": version, "summary": f"{parts[0]} {parts[1]}"}


def chunked_end(b: bytes) -> dict | None:
    """Sizes of a complete chunked body at the start of `b`, or None if more is to come; ValueError if it is broken."""
    at = decoded = chunks = 0
    while True:
        end = line_end(b, at)
        if end is None:
            return None
        token = re.sub(rb"\s", b"", b[at : end[0]].split(b";")[0])
        if not re.fullmatch(rb"\+?[0-9a-fA-F]+", token):
            raise ValueError("invalid chunk size")
        size, at = int(token, 16), end[1]
        if not size:
            for trailer in (b"\r\n", b"\n"):
                if b.startswith(trailer, at):
                    return {"wire": at + len(trailer), "decoded": decoded, "chunks": chunks, "trailer": len(trailer)}
            end = head_end(b[at:])
            return end and {"wire": at + end[1], "decoded": decoded, "chunks": chunks, "trailer": end[1]}
        if len(b) < at + size + 1:
            return None
        decoded, chunks, at = decoded + size, chunks + 1, at + size
        newline = next((m for m in (b"\r\n", b"\n") if b.startswith(m, at)), None)
        if newline is None:
            if b[at:] == b"\r":  # its line feed is in the next segment
                return None
            raise ValueError("chunk data is not followed by a newline")
        at += len(newline)


@dataclass
class Http1:
    """HTTP/1 messages of one direction, with pipelining and bodies that come later."""

    max_header: int = MAX_HEADER
    max_buffer: int = MAX_BUFFER
    logical: int = 0
    start: int = 0
    buffer: bytes = b""
    ordinal: int = 0
    pending: tuple[dict, int] | None = None

    def push(self, data: bytes) -> list[dict]:
        out: list[dict] = []
        at, self.logical = self.logical, self.logical + len(data)
        if self.pending:
            waiting, missing = self.pending
            used = min(missing, len(data))
            self.pending = (waiting, missing - used) if used < missing else None
            if self.pending:
                return out
            out.append(waiting)
            data, at = data[used:], at + used
        if not data:
            return out
        if not self.buffer:
            skip = self._sync(data)
            if skip is None:
                return out
            data, self.start = data[skip:], at + skip
        self.buffer += data
        while self.buffer and self._one(out):
            pass
        return out

    @staticmethod
    def _sync(b: bytes) -> int | None:
        """The first place where a message starts, or may start with what comes next."""
        if b.startswith(tuple(_STARTS)):
            return 0
        found = [k for s in _STARTS if (k := b.find(s)) >= 0]
        longest = max(map(len, _STARTS))
        for k in range(max(0, len(b) - longest + 1), len(b)):
            if any(s.startswith(b[k:]) for s in _STARTS):
                found.append(k)
                break
        return min(found, default=None)

    def _drop(self, n: int) -> None:
        self.buffer, self.start = self.buffer[n:], self.start + n

    def _error(self, out: list, why: str) -> None:
        out.append(message("http1", "parse_error", self.ordinal, why, self.start, self.start + len(self.buffer), "parse_error"))
        self.ordinal += 1

    def _one(self, out: list) -> bool:
        """Take one message off the buffer; whether to go on."""
        b = self.buffer
        if not any(b.startswith(s) or s.startswith(b) for s in _STARTS):
            skip = self._sync(b)
            self._drop(len(b) if skip is None else skip)
            return True
        if len(b) > self.max_buffer:
            self._error(out, "http message exceeded parser buffer limit")
            self._drop(len(b))
            return False
        end = head_end(b)
        if end is None:
            if len(b) > self.max_header:
                self._error(out, "http header exceeded parser limit")
                self._drop(len(b))
            return False
        try:
            head = parse_head(b[: end[0]])
        except ValueError as why:
            self._error(out, str(why))
            self._drop(end[1])
            return True
        body = {"framing": "none", "wire": 0, "decoded": 0, "chunks": 0, "transforms": []}
        encodings = [e for e in ("gzip",) if e in (head["content_encoding"] or "").lower()]
        if "chunked" in (head["transfer_encoding"] or "").lower():
            try:
                chunked = chunked_end(b[end[1] :])
            except ValueError as why:
                self._error(out, str(why))
                self._drop(end[1])
                return True
            if chunked is None:
                return False
            body |= chunked | {"framing": "chunked", "transforms": ["http_chunked", *(f"http_{e}" for e in encodings)]}
        elif head["content_length"]:
            n = head["content_length"]
            body |= {"framing": "content_length", "wire": n, "decoded": n, "transforms": [f"http_{e}" for e in encodings]}
        total = end[1] + body["wire"]
        made = message("http1", head["kind"], self.ordinal, head["summary"], self.start, self.start + total, header=end[1], body=body["wire"], head=head, framing=body)
        self.ordinal += 1
        if total > len(b):
            self.pending = (made, total - len(b))
            self._drop(len(b))
            return False
        out.append(made)
        self._drop(total)
        return True


def is_upgrade(head: dict) -> bool:
    """Whether a request asks for, or a 101 response grants, a WebSocket."""
    if (head["upgrade"] or "").lower() != "websocket":
        return False
    if head["kind"] == "response":
        return head["status_code"] == 101
    return "upgrade" in [t.strip().lower() for t in (head["connection"] or "").split(",")]


# Names of opcodes and types.
WS_OPCODES = {0: "continuation", 1: "text", 2: "binary", 8: "close", 9: "ping", 10: "pong"}
TLS_TYPES = {20: "change_cipher_spec", 21: "alert", 22: "handshake", 23: "application_data"}
TLS_HANDSHAKES = {
    0: "hello_request", 1: "client_hello", 2: "server_hello", 4: "new_session_ticket", 8: "encrypted_extensions", 11: "certificate",
    12: "server_key_exchange", 13: "certificate_request", 14: "server_hello_done", 15: "certificate_verify", 16: "client_key_exchange", 20: "finished",
}
TLS_VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 41: "OPT", 65: "HTTPS", 255: "ANY"}
PREVIEW = 128


@dataclass
class WebSocket:
    """Frames of one direction; offsets count from where frames began."""

    max_buffer: int = MAX_BUFFER
    start: int = 0
    buffer: bytes = b""
    ordinal: int = 0

    def push(self, data: bytes) -> list[dict]:
        self.buffer += data
        out = []
        if len(self.buffer) > self.max_buffer:
            out.append(message("websocket", "parse_error", self.ordinal, "websocket frame exceeded parser buffer limit", self.start, self.start + len(self.buffer), "parse_error"))
            self.start, self.buffer, self.ordinal = self.start + len(self.buffer), b"", self.ordinal + 1
            return out
        while len(self.buffer) >= 2:
            b = self.buffer
            size, at = b[1] & 127, 2
            wide = {126: 2, 127: 8}.get(size, 0)
            mask = 4 if b[1] & 128 else 0
            if len(b) < at + wide + mask:
                break
            if wide:
                size, at = int.from_bytes(b[at : at + wide], "big"), at + wide
            opcode = b[0] & 15
            if opcode not in WS_OPCODES or opcode >= 8 and (size > 125 or not b[0] & 128):
                out.append(message("websocket", "parse_error", self.ordinal, "invalid websocket frame", self.start, self.start + len(b), "parse_error"))
                self.start, self.buffer, self.ordinal = self.start + len(b), b"", self.ordinal + 1
                break
            key, at = b[at : at + mask], at + mask
            if len(b) < at + size:
                break
            payload = unmask(b[at : at + size], key) if mask else b[at : at + size]
            compressed, close = bool(b[0] & 64), int.from_bytes(payload[:2], "big") if opcode == 8 and size >= 2 else None
            preview = payload[:PREVIEW].decode("utf-8", "replace") if opcode == 1 and not compressed else None
            summary = f"WS {WS_OPCODES[opcode]} {size} bytes" + " compressed" * compressed
            summary += (f" close={close}" if close is not None else "") + (f" {preview}" if preview is not None else "")
            out.append(message(
                "websocket", "frame", self.ordinal, summary, self.start, self.start + at + size, header=at, body=size, fin=bool(b[0] & 128),
                opcode=WS_OPCODES[opcode], masked=bool(mask), rsv1=compressed, close_code=close, text_preview=preview,
            ))
            self.start, self.buffer, self.ordinal = self.start + at + size, b[at + size :], self.ordinal + 1
        return out


def unmask(payload: bytes, key: bytes) -> bytes:
    if not payload:
        return b""
    wide = (key * (len(payload) // 4 + 1))[: len(payload)]
    return (int.from_bytes(payload, "big") ^ int.from_bytes(wide, "big")).to_bytes(len(payload), "big")


@dataclass
class Tls:
    """Records of one direction, from the first that looks like one."""

    max_buffer: int = MAX_BUFFER
    start: int = 0
    buffer: bytes = b""
    ordinal: int = 0

    def push(self, data: bytes) -> list[dict]:
        self.buffer += data
        out = []
        while len(self.buffer) >= 5:
            b = self.buffer
            size = int.from_bytes(b[3:5], "big")
            if b[0] not in TLS_TYPES or b[1] != 3 or b[2] > 4 or not size or len(b) > self.max_buffer:
                out.append(message("tls", "parse_error", self.ordinal, "invalid tls record", self.start, self.start + len(b), "parse_error"))
                self.start, self.buffer, self.ordinal = self.start + len(b), b"", self.ordinal + 1
                break
            if len(b) < 5 + size:
                break
            info = {"content_type": TLS_TYPES[b[0]], "record_version": TLS_VERSIONS[b[1] << 8 | b[2]], "handshake_type": None, "sni": None, "alpn": [], "cipher_suite": None}
            if b[0] == 22:
                info |= tls_handshake(b[5 : 5 + size])
            summary = f"TLS {info['content_type']}" + (f" {info['handshake_type']}" if info["handshake_type"] else "")
            summary += (f" sni={info['sni']}" if info["sni"] else "") + (f" alpn={','.join(info['alpn'])}" if info["alpn"] else "")
            summary += f" cipher={info['cipher_suite']}" if info["cipher_suite"] else ""
            out.append(message("tls", "record", self.ordinal, summary, self.start, self.start + 5 + size, header=5, body=size, **info))
            self.start, self.buffer, self.ordinal = self.start + 5 + size, b[5 + size :], self.ordinal + 1
        return out


class _Reader:
    """Big-endian fields of a byte string; IndexError at its end."""

    def __init__(self, b: bytes, at: int = 0):
        self.b, self.at = b, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.b):
            raise IndexError
        self.at += n
        return self.b[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")


def _grease(v: int) -> bool:
    return v >> 8 == v & 255 and v & 15 == 10


def tls_handshake(b: bytes) -> dict:
    """What the first handshake message of a record tells."""
    out: dict = {}
    try:
        r = _Reader(b)
        kind = r.number(1)
        out["handshake_type"] = TLS_HANDSHAKES.get(kind, f"type_{kind}")
        if kind not in (1, 2):
            return out
        r = _Reader(r.take(min(r.number(3), len(b) - 4)))
        version = r.number(2)
        out["version"] = TLS_VERSIONS.get(version)
        r.take(32)
        r.take(r.number(1))
        if kind == 1:
            suites = r.take(r.number(2))
            ids = [i for i in struct.unpack(f"!{len(suites) // 2}H", suites[: len(suites) // 2 * 2]) if not _grease(i)]
            out["cipher_suites"] = [f"0x{i:04x}" for i in ids]
            r.take(r.number(1))
        else:
            out["cipher_suite"] = f"0x{r.number(2):04x}"
            r.take(1)
        extensions = _Reader(r.take(r.number(2)))
        while extensions.at < len(extensions.b):
            number = extensions.number(2)
            e = _Reader(extensions.take(extensions.number(2)))
            if number == 0 and len(e.b) > 5:
                e.take(3)
                out["sni"] = e.take(e.number(2)).decode("utf-8", "replace")
            elif number == 16:
                e.take(2)
                names = []
                while e.at < len(e.b):
                    names.append(e.take(e.number(1)).decode("utf-8", "replace"))
                out["alpn"] = names
            elif number == 43:
                if kind == 1:
                    e.take(1)
                known = [e.number(2) for _ in range((len(e.b) - e.at) // 2)]
                best = max([v for v in known if not _grease(v)], default=version)
                out["version"] = TLS_VERSIONS.get(best)
    except IndexError:
        pass
    return out


def dns_name(b: bytes, at: int) -> tuple[str, int]:
    """A name, with compression of at most 16 jumps, and the place after it."""
    labels, after, jumps = [], None, 0
    while True:
        if at >= len(b):
            raise IndexError
        n = b[at]
        if n >= 192:
            if at + 1 >= len(b) or (jumps := jumps + 1) > 16:
                raise IndexError
            after = at + 2 if after is None else after
            at = (n & 63) << 8 | b[at + 1]
        elif n == 0:
            return ".".join(labels) or ".", at + 1 if after is None else after
        else:
            if at + 1 + n > len(b):
                raise IndexError
            labels.append(b[at + 1 : at + 1 + n].decode("utf-8", "replace"))
            at += 1 + n


def _record(b: bytes, kind: int, at: int, n: int) -> str:
    raw = b[at : at + n]
    if kind in (1, 28) and n == (4 if kind == 1 else 16):
        return address_text(raw)
    if kind in (2, 5, 12):
        return dns_name(b, at)[0]
    if kind == 15:
        return f"{int.from_bytes(raw[:2], 'big')} {dns_name(b, at + 2)[0]}"
    if kind == 16:
        parts, k = [], 0
        while k < n:
            parts.append(raw[k + 1 : k + 1 + raw[k]].decode("utf-8", "replace"))
            k += 1 + raw[k]
        return " ".join(parts)
    if kind == 6:
        first, k = dns_name(b, at)
        second, k = dns_name(b, k)
        return " ".join([first, second, *map(str, struct.unpack("!5I", b[k : k + 20]))])
    if kind == 33:
        return " ".join([*map(str, struct.unpack("!3H", raw[:6])), dns_name(b, at + 6)[0]])
    return raw.hex()


def parse_dns(b: bytes, ordinal: int = 0, start: int = 0) -> dict | None:
    """The message of a DNS datagram; None without a whole header."""
    if len(b) < 12:
        return None
    number, flags, *counts = struct.unpack("!6H", b[:12])
    info: dict = {
        "id": number, "query": not flags & 0x8000, "opcode": flags >> 11 & 15, "authoritative": bool(flags & 0x400), "truncated": bool(flags & 0x200),
        "recursion_desired": bool(flags & 0x100), "recursion_available": bool(flags & 0x80), "rcode": flags & 15, "questions": [], "answers": [], "authorities": [], "additionals": [],
    }
    at, status = 12, "complete"
    try:
        for k in range(counts[0]):
            name, at = dns_name(b, at)
            kind, _ = struct.unpack("!2H", b[at : at + 4])
            at += 4
            if k < 16:
                info["questions"].append({"name": name, "qtype": DNS_TYPES.get(kind, f"TYPE{kind}")})
        for section, count in zip(("answers", "authorities", "additionals"), counts[1:]):
            for k in range(count):
                name, at = dns_name(b, at)
                kind, _, ttl, size = struct.unpack("!HHIH", b[at : at + 10])
                at += 10
                if at + size > len(b):
                    raise IndexError
                if k < 32:
                    info[section].append({"name": name, "rtype": DNS_TYPES.get(kind, f"TYPE{kind}"), "ttl": ttl, "data": _record(b, kind, at, size)})
                at += size
    except (IndexError, struct.error):
        status = "parse_error"
    first = f"{info['questions'][0]['qtype']} {info['questions'][0]['name']}" if info["questions"] else "no question"
    summary = f"DNS query {first}" if info["query"] else f"DNS response {first} rcode={info['rcode']} answers={len(info['answers'])}"
    kind = "parse_error" if status != "complete" else "request" if info["query"] else "response"
    return message("dns", kind, ordinal, summary, start, start + len(b), status, 12, len(b) - 12, **info)


def event_type(m: dict) -> str:
    """The event name of a message."""
    if m["kind"] == "parse_error":
        return f"{m['protocol']}_parse_error"
    return {"http1": f"http1_{m['kind']}", "dns": "dns_query" if m["kind"] == "request" else "dns_response", "websocket": "websocket_frame", "tls": "tls_record"}[m["protocol"]]


@dataclass
class HttpEvents:
    """The plainer HTTP analyzer: heads only, skipping bodies with a length."""

    buffer: bytes = b""
    skip: int = 0

    def push(self, data: bytes) -> list[dict]:
        used = min(self.skip, len(data))
        self.skip -= used
        self.buffer += data[used:]
        out = []
        while (end := head_end(self.buffer)) is not None:
            raw, self.buffer = self.buffer[: end[0]], self.buffer[end[1] :]
            try:
                head = parse_head(raw.decode("utf-8").encode())
            except ValueError:
                continue
            expected = head["content_length"] or 0
            out.append({"event_type": f"http_{head['kind']}", "summary": head["summary"], "target": head.get("target"), "body_bytes_expected": expected})
            used = min(expected, len(self.buffer))
            self.skip, self.buffer = expected - used, self.buffer[used:]
        if len(self.buffer) > MAX_HEADER:
            self.buffer = b""
        return out


@dataclass
class FlowParsers:
    """All stream parsers of a flow; the WebSocket check precedes the HTTP parse of the same chunk."""

    http: dict = field(default_factory=lambda: {False: Http1(), True: Http1()})
    websocket: dict | None = None
    tls: dict = field(default_factory=dict)

    def push(self, b_to_a: bool, data: bytes, tls_like: bool) -> list[dict]:
        out = []
        if tls_like or b_to_a in self.tls:
            out += self.tls.setdefault(b_to_a, Tls()).push(data)
        if self.websocket is not None:
            return out + self.websocket[b_to_a].push(data)
        found = self.http[b_to_a].push(data)
        if any(m["kind"] in ("request", "response") and is_upgrade(m["info"]["head"]) for m in found):
            self.websocket = {False: WebSocket(), True: WebSocket()}
        return out + found
