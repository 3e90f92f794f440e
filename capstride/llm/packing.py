"""Packing documents into token windows by order-preserving dynamic programming.

The documents of an input split form one stream of ids in their stored order.  Windows are successive runs of that
stream, cut at document ends (free), sentence ends (a small penalty) or, where a sentence is too long, at fixed steps
(a larger one).  f(i) is the least cost of all windows up to cut i: padding, plus the penalty of each cut, plus a fixed
cost a window, which is min over j of f(j) + p(j), over the cuts j at most `width` ids before i, less p(i): a minimum
over a sliding window, kept in a monotone queue.  A window whose length is a power of two needs no padding, so each
such j is a transition of its own.  Streams are solved in stretches of bounded length; the last windows of a stretch
are solved again with the next one.

Defined cases: a null text has only the end id; null and repeated doc_ids are documents like others; an empty table
gives no rows; other columns are ignored; documents longer than a window are cut into several pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, read, text_slices
from .tokens import ENCODE_BYTES, encoder

WIDTH = 4096
END_ID = 2
#: Costs in tokens of padding: a window as such, a cut at a sentence end, a cut elsewhere.
WINDOW_COST, SENTENCE_COST, INSIDE_COST = 48, 8, 256
#: One sentence end at most is a cut in each run of so many ids; without any, every HARD-th id is one.
CELL, HARD = 16, 1024
#: Ids that are solved at once.
STRETCH = 1 << 19


def sentence_ends(path: str) -> np.ndarray:
    """For each of 65,536 ids whether it ends a sentence: a word piece of full stops, exclamation or question marks."""
    out = np.zeros(1 << 16, bool)
    vocab = encoder(path, False).tokenizer.get_vocab(with_added_tokens=False)
    out[[i for t, i in vocab.items() if re.fullmatch(r"[.!?]+(</w>)?", t)]] = True
    return out


def cuts(n: int, doc_ends: np.ndarray, sentences: np.ndarray, width: int = WIDTH, cell: int = CELL, hard: int = HARD):
    """Candidate cuts 0 to n in order and the penalty of each."""
    soft = sentences[np.concatenate([[True], sentences[1:] // cell != sentences[:-1] // cell])] if len(sentences) else sentences
    at = np.unique(np.concatenate([[0], soft, doc_ends, [n]]))
    gaps = np.diff(at)
    step = min(hard, width)
    extra = [np.arange(at[i] + step, at[i + 1], step) for i in np.flatnonzero(gaps > step)]
    places = np.unique(np.concatenate([at, *extra])).astype(np.int64)
    cost = np.full(len(places), float(INSIDE_COST))
    cost[np.searchsorted(places, soft)] = SENTENCE_COST
    cost[np.searchsorted(places, doc_ends)] = 0.0
    cost[[0, -1]] = 0.0
    return places, cost


def best_windows(places: np.ndarray, cost: np.ndarray, width: int = WIDTH) -> list[int]:
    """Indexes of the cuts of the cheapest windows, from 0 to the last."""
    m = len(places)
    powers: dict[int, list[int]] = {}
    k = 1
    while k < width:
        at = np.searchsorted(places, places - k)
        for i in np.flatnonzero((places >= k) & (places[np.minimum(at, m - 1)] == places - k)).tolist():
            powers.setdefault(i, []).append(int(at[i]))
        k *= 2
    p, pen = places.tolist(), cost.tolist()
    f, key, back = [0.0] * m, [0.0] * m, [0] * m
    queue: deque[int] = deque([0])
    for i in range(1, m):
        here = p[i]
        while p[queue[0]] < here - width:
            queue.popleft()
        j = queue[0]
        best = key[j] - here + width
        for other in powers.get(i, ()):
            if f[other] < best:
                best, j = f[other], other
        f[i] = best = best + WINDOW_COST + pen[i]
        back[i] = j
        key[i] = best = best + here
        while queue and key[queue[-1]] >= best:
            queue.pop()
        queue.append(i)
    path, i = [m - 1], m - 1
    while i:
        i = back[i]
        path.append(i)
    return path[::-1]


def pack_stream(docs, ends_sentence: np.ndarray, width: int = WIDTH, stretch: int = STRETCH):
    """Yield (document number, start, length, ids, window number, offset) of all pieces of a stream of (number, ids)."""
    held: list[tuple[int, int, np.ndarray]] = []  # number, ids before, ids
    size, window = 0, 0

    def solve(last: bool):
        nonlocal held, size, window
        ids = np.concatenate([h[2] for h in held])
        doc_ends = np.cumsum([len(h[2]) for h in held])  # of held parts; a very long document has several
        whole = doc_ends[[a[0] != b[0] for a, b in zip(held, held[1:])] + [True]]
        places, cost = cuts(len(ids), whole, np.flatnonzero(ends_sentence[ids]) + 1, width)
        at = places[best_windows(places, cost, width)]
        if not last:
            kept = at[at <= len(ids) - 4 * width]
            at = kept if len(kept) > 1 else at[:2]
        stop = int(at[-1])
        marks = np.unique(np.concatenate([at, doc_ends[doc_ends <= stop]]))
        of = np.searchsorted(doc_ends, marks[:-1], side="right")
        seq = np.searchsorted(at, marks[:-1], side="right") - 1
        begins = doc_ends - [len(h[2]) for h in held]
        for a, b, d, s in zip(marks[:-1].tolist(), marks[1:].tolist(), of.tolist(), seq.tolist()):
            yield held[d][0], held[d][1] + a - int(begins[d]), b - a, ids[a:b], window + s, a - int(at[s])
        window += len(at) - 1
        rest = []
        for h, begin, end in zip(held, begins.tolist(), doc_ends.tolist()):
            if end > stop:
                skip = max(0, stop - begin)
                rest.append((h[0], h[1] + skip, h[2][skip:]))
        held, size = rest, len(ids) - stop

    for number, ids in docs:
        for low in range(0, len(ids), stretch // 2):
            part = ids[low : low + stretch // 2]
            held.append((number, low, part))
            size += len(part)
            if size >= stretch:
                yield from solve(False)
    while size:
        yield from solve(True)


_PIECES, _PIECES_ARROW = arrow_schema(
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_PIECE_IDS, _PIECE_IDS_ARROW = arrow_schema(_PIECES + ", ids array<int>")


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, width: int = WIDTH, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents; sequence_id holds the split in its upper bits and the window's number in the lower 33."""

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        codec = encoder(tokenizer, False)
        ends = sentence_ends(tokenizer)
        info: dict[int, tuple] = {}

        def stream():
            number = 0
            for batch in batches:
                for part in text_slices(batch, limit=ENCODE_BYTES):
                    flat, off = codec.encode(part.column("text"), end_id)
                    for i, doc_id in enumerate(part.column("doc_id").to_pylist()):
                        ids = flat[off[i] : off[i + 1]]
                        info[number] = (doc_id, len(ids))
                        yield number, ids
                        number += 1

        rows: list[tuple] = []

        def out():
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            schema = _PIECES_ARROW
            if with_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
                schema = _PIECE_IDS_ARROW
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for number, start, length, ids, window, offset in pack_stream(stream(), ends, width):
            doc_id, total = info[number]
            if start + length == total:
                del info[number]
            wide = ids.astype("<u4")
            row = (doc_id, start, length, zlib.crc32(wide), total, base | window, offset)
            rows.append((*row, wide.astype(np.int32)) if with_ids else row)
            if len(rows) >= 4096:
                yield out()
                rows.clear()
        if rows:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, _PIECE_IDS if with_ids else _PIECES)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 4096 ids."""
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
