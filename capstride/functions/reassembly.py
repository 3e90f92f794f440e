"""One direction of a TCP stream as a state machine: what each segment means and which bytes it completes."""

from __future__ import annotations

from dataclasses import dataclass, field

from .wire import M32, before

MAX_SEGMENTS, MAX_BYTES = 128, 1 << 20
FIN, SYN, RST = 1, 2, 4


@dataclass
class Direction:
    """Sequence state; segments that wait are (start, end, first payload sequence, payload), by start."""

    expected: int | None = None
    initial: int | None = None
    highest: int | None = None
    waiting: list[tuple[int, int, int, bytes]] = field(default_factory=list)
    fin_seen: bool = False
    rst_seen: bool = False

    @property
    def waiting_bytes(self) -> int:
        return sum(len(w[3]) for w in self.waiting)


@dataclass
class Step:
    """What one segment did: its status, chunks (sequence, bytes, source) and counters."""

    status: str
    chunks: list[tuple[int, bytes, str]] = field(default_factory=list)
    gap: bool = False
    mid_stream: bool = False


def _tail(seq: int, payload: bytes, expected: int) -> tuple[int, bytes, bool]:
    """Payload from `expected` on, and whether something was cut."""
    if not before(seq, expected):
        return seq, payload, False
    skip = (expected - seq) & M32
    return expected, payload[skip:], True


def _drain(d: Direction, chunks: list) -> bool:
    """Emit waiting segments that continue the stream; whether the stream moved."""
    moved = True
    any_moved = False
    while moved:
        moved = False
        for k, (start, end, first, payload) in enumerate(d.waiting):
            if start == d.expected or before(start, d.expected) and before(d.expected, end):
                del d.waiting[k]
                seq, rest, cut = _tail(first, payload, d.expected)
                if rest:
                    chunks.append((seq, rest, "overlap_trimmed" if cut else "buffered"))
                d.expected = end
                moved = any_moved = True
                break
    return any_moved


def step(d: Direction, other_waiting: int, seq: int, flags: int, payload: bytes, max_segments: int = MAX_SEGMENTS, max_bytes: int = MAX_BYTES) -> Step:
    """Advance one direction by a segment; `other_waiting` are the bytes that wait in the other direction."""
    d.fin_seen |= bool(flags & FIN)
    d.rst_seen |= bool(flags & RST)
    if flags & RST:
        return Step("reset")
    span = len(payload) + bool(flags & SYN) + bool(flags & FIN)
    if not span:
        return Step("no_sequence")
    first = (seq + bool(flags & SYN)) & M32
    end = (seq + span) & M32
    if d.highest is None or before(d.highest, end):
        d.highest = end
    if d.expected is None:
        d.initial, d.expected = seq, end
        out = Step("init", mid_stream=not flags & SYN)
        if payload:
            out.chunks.append((first, payload, "current"))
        _drain(d, out.chunks)
        return out
    if seq == d.expected:
        out = Step("fin" if flags & FIN else "in_order")
        if payload:
            out.chunks.append((first, payload, "current"))
        d.expected = end
        if _drain(d, out.chunks):
            out.status = "gap_filled"
        return out
    if before(seq, d.expected):
        if not before(d.expected, end):
            return Step("retransmission")
        out = Step("overlap")
        start, rest, _ = _tail(first, payload, d.expected)
        if rest:
            out.chunks.append((start, rest, "overlap_trimmed"))
        d.expected = end
        _drain(d, out.chunks)
        return out
    if any(w[0] == seq and w[1] == end for w in d.waiting):
        return Step("retransmission")
    if len(d.waiting) >= max_segments or d.waiting_bytes + other_waiting + len(payload) > max_bytes:
        return Step("out_of_order_dropped", gap=True)
    k = len(d.waiting)
    while k and before(seq, d.waiting[k - 1][0]):
        k -= 1
    d.waiting.insert(k, (seq, end, first, payload))
    return Step("out_of_order_buffered", gap=True)
