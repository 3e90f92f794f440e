"""Service detection: well-known ports, payload rules in order, and how evidence merges."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values: (transports, ports, service, confidence).
PORT_RULES = (
    ("tcp", (20, 21), "ftp", 90),
    ("tcp", (22,), "ssh", 95),
    ("udp", (67, 68), "dhcp", 85),
    ("tcp udp", (53,), "dns", 95),
    ("udp", (137,), "netbios", 85),
    ("udp", (123,), "ntp", 85),
    ("tcp", (80, 8080, 8000, 8008, 8081, 8888), "http", 90),
    ("tcp", (110, 995), "pop3", 85),
    ("tcp", (143, 993), "imap", 85),
    ("tcp", (443, 8443), "https", 92),
    ("udp", (443, 8443), "quic", 80),
    ("tcp", (465, 587, 25), "smtp", 85),
    ("udp", (1900,), "ssdp", 85),
    ("tcp", (3306,), "mysql", 90),
    ("tcp", (3389,), "rdp", 90),
    ("tcp", (5432,), "postgres", 90),
    ("udp", (5353,), "mdns", 85),
    ("udp", (5355,), "llmnr", 85),
    ("tcp", (6379,), "redis", 90),
    ("tcp udp", (11211,), "memcached", 85),
    ("tcp", (27017,), "mongodb", 85),
)
# First bytes of requests and commands.
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "TRACE", "CONNECT")
HTTP2_PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
MEMCACHED_COMMANDS = (b"get ", b"gets ", b"set ", b"add ", b"replace ", b"append ", b"prepend ", b"delete ", b"incr ", b"decr ")
SMTP_STARTS = (b"220 ", b"ehlo ", b"helo ", b"mail from:", b"rcpt to:", b"data\r\n", b"quit\r\n", b"starttls\r\n")
FTP_STARTS = (b"220 ", b"user ", b"pass ", b"syst\r\n", b"feat\r\n", b"pwd\r\n", b"type ", b"pasv\r\n")
TEXT_FRAMED = ("http", "http2", "websocket", "ssh", "smtp", "ftp", "redis", "memcached", "pop3", "imap")

PORTS = {(t, p): (service, confidence) for ts, ports, service, confidence in PORT_RULES for t in ts.split() for p in ports}


@dataclass(frozen=True)
class Evidence:
    service: str = "unknown"
    side: str = "unknown"
    confidence: int = 0
    source: str = "unknown"
    evidence: str = "none"


def by_port(protocol: str, a_port: int, b_port: int) -> Evidence:
    for side, port in (("a", a_port), ("b", b_port)):
        if (protocol, port) in PORTS:
            service, confidence = PORTS[protocol, port]
            return Evidence(service, side, confidence, "port", "well_known_port")
    return Evidence()


def merge(now: Evidence, new: Evidence) -> Evidence:
    """Agreeing evidence adds up; other evidence replaces when clearly stronger."""
    if "unknown" in (now.service, new.service):
        return now if new.service == "unknown" else new
    if now.service != new.service and {now.service, new.service} != {"https", "tls"}:
        return new if new.confidence >= now.confidence + 8 else now
    sources = {now.source, new.source} - {"unknown"}
    return Evidence(
        "https" if "https" in (now.service, new.service) else now.service,
        now.side if new.side == "unknown" else new.side,
        min(100, max(now.confidence, new.confidence) + 2),
        sources.pop() if len(sources) == 1 else "port_and_payload" if sources else "unknown",
        new.evidence,
    )


def is_http_request(b: bytes) -> bool:
    return b.split(b" ", 1)[0].decode("latin-1") in HTTP_METHODS and b" " in b[:8]


def has_header(b: bytes, name: bytes, token: bytes) -> bool:
    """Whether a header of a complete head starts with `name` and holds `token`, whatever the case."""
    head, sep, _ = b.partition(b"\r\n\r\n")
    return bool(sep) and any(x.strip(b" \t\r\n\x0c").lower().startswith(name) and token in x.lower() for x in head.split(b"\n"))


def is_tls_record(b: bytes) -> bool:
    return len(b) >= 5 and 0x14 <= b[0] <= 0x17 and b[1] == 3 and b[2] <= 4 and b[3:5] != b"\0\0"


def _is_redis(b: bytes) -> bool:
    return b[:1] in (b"*", b"$", b"+", b"-", b":") and b"\r\n" in b


def _is_mysql(b: bytes) -> bool:
    return len(b) >= 6 and b[0] == 10 and b"mysql_" in b[1:]


def _is_postgres(b: bytes) -> bool:
    return len(b) >= 8 and 8 <= int.from_bytes(b[:4], "big") <= len(b) and int.from_bytes(b[4:8], "big") in (196608, 80877103)


def _is_mongodb(b: bytes) -> bool:
    return len(b) >= 16 and 16 <= int.from_bytes(b[:4], "little") <= len(b) + 16384 and int.from_bytes(b[12:16], "little") in (1, 2001, 2013)


def is_dns(protocol: str, b: bytes) -> bool:
    if protocol == "tcp":
        size = int.from_bytes(b[:2], "big")
        if len(b) < 14 or size < 12 or size + 2 > len(b):
            return False
        b = b[2:]
    elif protocol != "udp":
        return False
    return len(b) >= 12 and b[2] >> 3 & 15 <= 5 and 1 <= int.from_bytes(b[4:6], "big") <= 64 and int.from_bytes(b[6:8], "big") <= 512


def _dns_answers(b: bytes) -> bool:
    size = int.from_bytes(b[:2], "big")
    at = 4 if len(b) >= 14 and 12 <= size <= len(b) - 2 else 2
    return len(b) > at and b[at] & 0x80 != 0


def _is_quic(b: bytes) -> bool:
    return len(b) >= 6 and b[0] >> 6 == 3 and b[1:5] != b"\0\0\0\0"


def _is_ntp(b: bytes) -> bool:
    return len(b) >= 48 and b[0] & 7 in (3, 4) and b[0] >> 3 & 7 in (3, 4)


def by_payload(protocol: str, a_port: int, b_port: int, from_a: bool, b: bytes) -> Evidence | None:
    """The first payload rule that holds, merged onto the port's evidence."""
    if not b:
        return None
    port = by_port(protocol, a_port, b_port)
    source, target = ("a", "b") if from_a else ("b", "a")
    to = port.side if port.side != "unknown" else target
    by = port.side if port.side != "unknown" else source
    low = b[:16].lower()
    if b.startswith(HTTP2_PREFACE):
        found = ("http2", target, 99, "http2_preface")
    elif is_http_request(b):
        found = ("websocket", target, 99, "http_websocket_upgrade") if has_header(b, b"upgrade:", b"websocket") else ("http", target, 98, "http_request")
    elif b.startswith(b"HTTP/1."):
        found = ("http", source, 98, "http_response")
    elif is_tls_record(b):
        found = ("https", to, 98, "https_tls_record") if port.service == "https" else ("tls", to, 98, "tls_record")
    elif b.startswith(b"SSH-"):
        found = ("ssh", source, 98, "ssh_banner")
    elif _is_redis(b):
        found = ("redis", to, 96, "redis_resp")
    elif _is_mysql(b):
        found = ("mysql", source, 94, "mysql_handshake")
    elif _is_postgres(b):
        found = ("postgres", target, 92, "postgres_startup")
    elif _is_mongodb(b):
        found = ("mongodb", to, 90, "mongodb_wire")
    elif low.startswith(MEMCACHED_COMMANDS):
        found = ("memcached", to, 90, "memcached_ascii")
    elif is_dns(protocol, b):
        found = ("dns", source if _dns_answers(b) else target, 91, "dns_header")
    elif protocol == "udp" and _is_quic(b):
        found = ("quic", to, 91, "quic_long_header")
    elif protocol == "udp" and _is_ntp(b):
        found = ("ntp", target, 90, "ntp_header")
    elif low.startswith(SMTP_STARTS):
        found = ("smtp", by, 88, "smtp_text")
    elif low.startswith(FTP_STARTS):
        found = ("ftp", by, 88, "ftp_text")
    else:
        return None
    service, side, confidence, evidence = found
    return merge(port, Evidence(service, side, confidence, "payload", evidence))


SAMPLE = 4096
_SPACE, _PRINTABLE = b" \t\r\n", bytes([*range(33, 127), *range(128, 256)])


@dataclass
class Classes:
    """Classes of a direction's first SAMPLE bytes, counted as they come; bytes from 0x80 on count as printable."""

    size: int = 0
    nulls: int = 0
    space: int = 0
    printable: int = 0

    def add(self, data: bytes) -> None:
        if self.size >= SAMPLE or not data:
            return
        data = data[: SAMPLE - self.size]
        self.size += len(data)
        self.nulls += data.count(0)
        self.space += len(data) - len(data.translate(None, _SPACE))
        self.printable += len(data) - len(data.translate(None, _PRINTABLE))

    def kind(self) -> str:
        """unknown, binary, text or mixed."""
        if not self.size:
            return "unknown"
        control = self.size - self.nulls - self.space - self.printable
        if self.nulls or control * 100 // self.size > 5:
            return "binary"
        return "text" if (self.space + self.printable) * 100 // self.size >= 90 else "mixed"


def content_kind(sample: bytes) -> str:
    classes = Classes()
    classes.add(sample)
    return classes.kind()


def combine_kinds(a: str, b: str) -> str:
    if "unknown" in (a, b):
        return b if a == "unknown" else a
    return a if a == b else "mixed"


def adjust_kind(kind: str, service: str) -> str:
    return "mixed" if kind == "binary" and service in TEXT_FRAMED else kind


def parsed(evidence: Evidence, service: str, side: str, name: str) -> Evidence:
    """Evidence of a protocol parser replaces all other."""
    return replace(evidence, service=service, side=side, confidence=100, source="parser", evidence=name)
