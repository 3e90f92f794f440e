"""Decode transforms over bytes: URL escapes, gzip, HTTP gzip, HTTP chunked, compressed WebSocket frames, and chains."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from .parsers import chunked_end, head_end, parse_head, unmask

MOST = 8 << 20
MODES = ("url_decode", "gzip", "http_gzip", "http_chunked", "websocket_deflate", "auto")
# Other names of modes.
ALIASES = {"url": "url_decode", "urldecode": "url_decode", "gunzip": "gzip", "chunked": "http_chunked", "dechunk": "http_chunked", "httpgzip": "http_gzip", "ws": "websocket_deflate", "websocket": "websocket_deflate", "ws_deflate": "websocket_deflate", "none": "raw", "raw": "raw"}


@dataclass
class Result:
    """applied, noop or failed, with output bytes and what happened."""

    status: str
    data: bytes = b""
    note: str = ""
    truncated: bool = False


def url_decode(b: bytes) -> Result:
    """%XX and + are decoded; broken escapes stay and are counted."""
    out, at, changed, bad = bytearray(), 0, 0, 0
    for m in re.finditer(rb"[%+]", b):
        k = m.start()
        if k < at:
            continue
        out += b[at:k]
        if b[k] == 43:
            out += b" "
            at, changed = k + 1, changed + 1
        elif re.fullmatch(rb"[0-9a-fA-F]{2}", b[k + 1 : k + 3]):
            out.append(int(b[k + 1 : k + 3], 16))
            at, changed = k + 3, changed + 1
        else:
            out += b"%"
            at, bad = k + 1, bad + 1
    out += b[at:]
    return Result("applied" if changed else "noop", bytes(out), f"{bad} broken escapes" if bad else "")


def _inflate(b: bytes, window: int, most: int) -> Result:
    d = zlib.decompressobj(window)
    try:
        out = d.decompress(b, most + 1)
    except zlib.error as why:
        return Result("failed", note=str(why))
    cut = len(out) > most
    if not out and not d.eof:
        return Result("failed", note="no complete data")
    return Result("applied", out[:most], "" if d.eof or cut else "the stream ends early", cut)


def gunzip(b: bytes, most: int = MOST) -> Result:
    return _inflate(b, 31, most) if b[:2] == b"\x1f\x8b" else Result("noop", note="no gzip header")


def _http(b: bytes) -> tuple[dict, bytes, bytes] | None:
    end = head_end(b)
    if end is None:
        return None
    try:
        return parse_head(b[: end[0]]), b[: end[1]], b[end[1] :]
    except ValueError:
        return None


def http_gzip(b: bytes, most: int = MOST) -> Result:
    """The head stays; a gzip body is inflated."""
    parts = _http(b)
    if parts is None or "gzip" not in (parts[0]["content_encoding"] or "").lower():
        return Result("noop", note="no gzip body")
    out = gunzip(parts[2], max(0, most - len(parts[1])))
    return Result(out.status, parts[1] + out.data, out.note, out.truncated) if out.status == "applied" else out


def dechunk(b: bytes) -> tuple[bytes, bool]:
    """The bytes of a chunked body, and whether it is whole."""
    out, at = bytearray(), 0
    while m := re.compile(rb"[ \t]*([0-9a-fA-F]+)[^\r\n]*\r?\n").match(b, at):
        size, at = int(m[1], 16), m.end()
        if not size:
            return bytes(out), True
        out += b[at : at + size]
        if len(b) < at + size:
            return bytes(out), False
        at += size
        at += 2 if b.startswith(b"\r\n", at) else 1 if b.startswith(b"\n", at) else 0
    return bytes(out), False


def http_chunked(b: bytes, most: int = MOST) -> Result:
    """The head stays; a chunked body is joined."""
    parts = _http(b)
    if parts is None or "chunked" not in (parts[0]["transfer_encoding"] or "").lower():
        return Result("noop", note="no chunked body")
    try:
        chunked_end(parts[2])
    except ValueError as why:
        return Result("failed", note=str(why))
    body, whole = dechunk(parts[2])
    out = parts[1] + body
    return Result("applied", out[:most], "" if whole else "the body ends early", len(out) > most)


def websocket_deflate(b: bytes, most: int = MOST) -> Result:
    """Inflate compressed messages of a run of frames; other messages pass; a line feed between."""
    out, current, packed, at, any_packed = [], b"", False, 0, False
    while at + 2 <= len(b):
        size, k = b[at + 1] & 127, at + 2
        wide = {126: 2, 127: 8}.get(size, 0)
        if wide:
            size, k = int.from_bytes(b[k : k + wide], "big"), k + wide
        key = b""
        if b[at + 1] & 128:
            key, k = b[k : k + 4], k + 4
        if k + size > len(b) or b[at] & 15 not in (0, 1, 2, 8, 9, 10):
            break
        payload = unmask(b[k : k + size], key) if key else b[k : k + size]
        opcode, fin = b[at] & 15, b[at] & 128
        if opcode < 8:
            if opcode:
                current, packed = b"", bool(b[at] & 64)
            current += payload
            if fin:
                if packed:
                    plain = _inflate(current + b"\0\0\xff\xff", -15, most)
                    if plain.status == "failed":
                        return plain
                    current, any_packed = plain.data, True
                out.append(current)
                current = b""
        at = k + size
    if not any_packed:
        return Result("noop", note="no compressed message")
    data = b"\n".join(out)
    return Result("applied", data[:most], "", len(data) > most)


def mostly_text(b: bytes) -> bool:
    """Whether at least 85 % of the first 4096 bytes are text."""
    head = b[:4096]
    return bool(head) and sum(32 <= c <= 126 or c in (9, 10, 13) for c in head) * 100 >= 85 * len(head)


def auto(b: bytes, most: int = MOST) -> Result:
    """The first that applies: chunked, HTTP gzip, gzip, WebSocket, then URL escapes in text."""
    for f in (http_chunked, http_gzip, gunzip, websocket_deflate):
        out = f(b, most)
        if out.status == "applied":
            return out
    return url_decode(b) if mostly_text(b) else Result("noop")


def one(mode: str, b: bytes, most: int = MOST) -> Result:
    if mode == "url_decode":
        return url_decode(b)
    return {"gzip": gunzip, "http_gzip": http_gzip, "http_chunked": http_chunked, "websocket_deflate": websocket_deflate, "auto": auto}[mode](b, most)


def parse_plan(text: str, profile: tuple = ()) -> list[str]:
    """Modes of a plan: names parted by , | + or >, perhaps after chain: or pipeline:; `profile` means the given ones."""
    text = re.sub(r"^(chain|pipeline):", "", text.strip().lower())
    out = []
    for part in re.split(r"[,|+>]", text):
        name = part.strip().replace("-", "_").replace(" ", "_")
        if not name:
            continue
        if name == "profile":
            out += profile
            continue
        name = ALIASES.get(name, name)
        if name == "raw":
            continue
        if name not in MODES:
            raise ValueError(f"unknown transform {part.strip()}")
        out.append(name)
    return out


def chain(modes: list[str], b: bytes, most: int = MOST) -> tuple[Result, list[dict]]:
    """Apply modes in order: a failure stops, a noop passes on; without an applied step the output is empty."""
    steps, data, applied, cut = [], b, False, False
    for mode in modes:
        if mode == "url_decode" and len(modes) > 1 and not mostly_text(data):
            out = Result("noop", note="not text")
        else:
            out = one(mode, data, most)
        steps.append({"mode": mode, "status": out.status, "bytes": len(out.data) if out.status == "applied" else 0, "note": out.note})
        if out.status == "failed":
            return Result("failed", note=out.note), steps
        if out.status == "applied":
            data, applied, cut = out.data, True, cut or out.truncated
    return (Result("applied", data, truncated=cut) if applied else Result("noop")), steps
