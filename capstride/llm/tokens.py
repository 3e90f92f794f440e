"""Exact tokenization of many texts by the tokenizers library, with each distinct chunk encoded once for a worker.

Both vocabularies split a text before they merge, and a split never joins a character that is not white space with
white space after it.  So ids of a text are the ids of its chunks in a row, where a chunk is a blank or line feed and
what follows up to the next one.  Texts with two of these in a row, or one at the end, go to the library whole, and so
do texts that hold the content of an added token, which the library takes as that token.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_bytes, word_hashes

#: Distinct chunks that a worker remembers, at some 60 bytes each; when full, it keeps those met twice.
CACHE_CHUNKS = 2_000_000
#: UTF-8 bytes of text that are encoded at once.
ENCODE_BYTES = 3 << 20
#: New chunks that the library gets in one text.
JOINED = 200
#: A chunk of its own between chunks, for vocabularies that drop white space.
BETWEEN = "\ue000"
#: In front of a text, to tell its first chunk from others.
FIRST = "\ue001"


def chunk_hashes(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string of a row of bytes."""
    out = np.full(len(off) - 1, 1, np.uint64)
    some = np.flatnonzero(np.diff(off))
    out[some] = word_hashes(raw, off[some], off[some + 1])
    return out


def spread_places(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of runs that begin at `starts`, in a row, and the running total of their sizes."""
    upto = np.cumsum(sizes)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes), upto


class ChunkEncoder:
    """Encode texts to the ids that the library gives (uint16: both vocabularies have fewer than 65,536 entries).

    A hash finds a known chunk, whose bytes are then compared.
    """

    def __init__(self, path: str, keep_blank: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.blank = " " if keep_blank else ""
        self.opens = np.zeros(1 << 16, bool)  # ids that open a chunk: they begin with a blank or line feed
        if keep_blank:
            self.opens[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t[0] in "\u0120\u010a"]] = True
        else:
            self.between = self.whole(BETWEEN)
        self.tails = {c: self.whole(c).tolist() for c in ".,!?"}
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # of known chunks, ascending, and the number of each
        self.numbers = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint16)
        self.ends = np.zeros(1 << 16, np.int64)
        self.hits = np.zeros(1 << 16, np.int32)
        self.text = np.zeros(1 << 16, np.uint8)  # the chunks themselves; a chunk's bytes end at text_ends[number + 1]
        self.text_ends = np.zeros(1 << 16, np.int64)
        self.known = self.used = self.text_used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of chunks by hash; -1 for what is not known."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, self.numbers[at], -1)

    def _match(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of chunks and the numbers of those that are known byte by byte; -1 for others."""
        raw, off = text_bytes(col)
        h = chunk_hashes(raw, off)
        own, size = self._find(h), np.diff(off)
        own[self.text_ends[own + 1] - self.text_ends[own] != size] = -1
        at = np.flatnonzero(own >= 0)
        places, upto = spread_places(self.text_ends[own[at]], size[at])
        other, _ = spread_places(off[at], size[at])
        apart = np.concatenate([[0], np.cumsum(self.text[places] != raw[other])])
        own[at[apart[upto] > apart[upto - size[at]]]] = -1
        return h, own

    def _thin(self) -> None:
        """Forget what was met once; forget all if that leaves too much."""
        keep = np.flatnonzero(self.hits[self.numbers] > 1)
        h, k = self.hashes[keep], self.numbers[keep]
        sizes, lengths = self.ends[k + 1] - self.ends[k], self.text_ends[k + 1] - self.text_ends[k]
        flat, text = self.ids[spread_places(self.ends[k], sizes)[0]], self.text[spread_places(self.text_ends[k], lengths)[0]]
        self._clear()
        if len(h) < CACHE_CHUNKS * 2 // 3:
            self.hashes, self.numbers = h, np.arange(len(h))
            self._keep(flat, sizes, text, lengths)

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _keep(self, flat: np.ndarray, sizes: np.ndarray, text: np.ndarray, lengths: np.ndarray) -> None:
        """Append ids and bytes of chunks in the order of their numbers; a chunk's ids end at ends[number + 1]."""
        n, total = len(sizes), len(flat)
        self._room("text", self.text_used + len(text))
        self._room("text_ends", self.known + n + 1)
        self.text[self.text_used : self.text_used + len(text)] = text
        self.text_ends[self.known + 1 : self.known + n + 1] = self.text_used + np.cumsum(lengths)
        self.text_used += len(text)
        self._room("ids", self.used + total)
        self._room("ends", self.known + n + 1)
        self._room("hits", self.known + n)
        self.ids[self.used : self.used + total] = flat
        self.ends[self.known + 1 : self.known + n + 1] = self.used + np.cumsum(sizes)
        self.known += n
        self.used += total

    def _joined(self, part: list[str]) -> list[list[int]] | None:
        """Ids of chunks encoded as one text, or None if the places between them can't be told."""
        text = "".join(part) if self.blank else f" {BETWEEN} ".join(part)
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        flat, n = np.array(ids, np.uint16), len(part)
        if self.blank:
            starts = np.flatnonzero(self.opens[flat]).tolist()
            if len(starts) != n or starts[0]:
                return None
            return [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)])]
        m = len(self.between)
        at = np.flatnonzero(np.logical_and.reduce([flat[j : len(flat) - m + 1 + j] == self.between[j] for j in range(m)])).tolist()
        if len(at) != n - 1 or text.count(BETWEEN) != n - 1:
            return None
        return [ids[a:b] for a, b in zip([0, *[x + m for x in at]], [*at, len(ids)])]

    def _learn(self, chunks: pa.Array, hashes: np.ndarray) -> None:
        """Ids of new chunks, which get the next numbers.

        A word with one mark after it is its word's ids and the mark's: no split joins letters with a mark.
        """
        new = chunks.to_pylist()
        stems: dict[str, object] = {}  # what the library encodes
        plan = []
        for c in new:
            tail = c[-1:]
            if tail in self.tails and c[:-1].isalpha():
                c = c[:-1]
            else:
                tail = ""
            stems[c] = None
            plan.append((c, tail))
        names = list(stems)
        _, known = self._match(pa.array(names, pa.string()))
        starts, ends = self.ends[known].tolist(), self.ends[known + 1].tolist()
        first, rest = [], []
        for c, k, low, high in zip(names, known.tolist(), starts, ends):
            if k >= 0:
                stems[c] = self.ids[low:high].tolist()
            elif self.blank and c[:1] == FIRST or not c:
                first.append(c)  # a text's first chunk has a mark, but no blank in front
            else:
                rest.append(c)
        plain = [c[1:] if c else self.blank for c in first]
        stems.update(zip(first, (e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False))))
        for low in range(0, len(rest), JOINED):
            part = [c if c[0] == "\n" else self.blank + c for c in rest[low : low + JOINED]]
            found = self._joined(part) or [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            stems.update(zip(rest[low : low + JOINED], found))
        found = [stems[c] + self.tails[tail] if tail else stems[c] for c, tail in plan]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        numbers = np.arange(self.known, self.known + len(new))
        raw, off = text_bytes(chunks)
        self._keep(np.fromiter(chain.from_iterable(found), np.uint16, int(sizes.sum())), sizes, raw, np.diff(off))
        h, k = np.concatenate([self.hashes, hashes]), np.concatenate([self.numbers, numbers])
        by = np.argsort(h, kind="stable")
        self.hashes, self.numbers = h[by], k[by]

    def whole(self, text: str) -> np.ndarray:
        """The library's own ids of a text."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _prepared(self, col: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Texts with a blank before each line feed and a mark in front, and which of them go to the library whole."""
        # lower-casing below could make an added token of what is none
        lowered = col if self.blank else pc.ascii_lower(col)
        special = pa.array(np.zeros(len(col), bool))
        for content in self.added:
            special = pc.or_(special, pc.match_substring(lowered, content))
        if self.blank:
            spread = pc.replace_substring(col, "\n", " \n")
            odd = pc.or_(pc.match_substring(spread, "  "), pc.match_substring(spread, "\n "))
            odd = pc.or_(odd, pc.or_(pc.ends_with(spread, " "), pc.ends_with(spread, "\n")))
            odd = pc.or_(pc.or_(odd, special), pc.match_substring(spread, FIRST))
            whole = np.asarray(odd)
            spread = pc.binary_join_element_wise(FIRST, pc.if_else(odd, "", spread), "")
            return spread, whole
        # this vocabulary has no capitals; before combining marks, they could compose differently
        raw = col.cast(pa.binary())
        marks = pc.or_(pc.match_substring(raw, b"\xcc"), pc.match_substring(raw, b"\xcd"))
        plain = pc.replace_substring(pc.if_else(marks, col, lowered), "\n", " ")
        return pc.if_else(special, "", plain), np.asarray(special)

    def encode(self, texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and n + 1 offsets, with the id `end` after each text if given; null counts as empty."""
        if self.known > CACHE_CHUNKS:
            self._thin()
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        col = col.cast(pa.string()).fill_null("")
        spread, whole = self._prepared(col)
        lists = pc.split_pattern(spread, " ")
        coded = lists.flatten().dictionary_encode()
        hashes, own = self._match(coded.dictionary)
        new = np.flatnonzero(own < 0)
        if len(new):
            own[new] = np.arange(self.known, self.known + len(new))
            self._learn(coded.dictionary.take(pa.array(new)), hashes[new])
        at = coded.indices.to_numpy(zero_copy_only=False)
        self.hits[own] += np.bincount(at, minlength=len(own)).astype(np.int32)
        starts, ends = self.ends[own], self.ends[own + 1]
        places, upto = spread_places(starts[at], (ends - starts)[at])
        flat = self.ids[places]
        off = np.concatenate([[0], upto])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        direct = {int(i): self.whole(col[int(i)].as_py()) for i in np.flatnonzero(whole)}
        if not direct and end is None:
            return flat, off
        tail = 0 if end is None else 1
        lengths = np.diff(off)
        for i, ids in direct.items():
            lengths[i] = len(ids)
        ends = np.concatenate([[0], np.cumsum(lengths + tail)])
        out = np.empty(int(ends[-1]), np.uint16)
        plain = np.repeat(~whole, lengths + tail)
        if tail:
            out[ends[1:] - 1] = end
            plain[ends[1:] - 1] = False
        out[plain] = flat
        for i, ids in direct.items():
            out[ends[i] : ends[i] + len(ids)] = ids
        return out, ends


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, keep_blank: bool) -> ChunkEncoder:
    """The encoder of this worker process for a vocabulary file."""
    key = (path, keep_blank)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, keep_blank)
    return _ENCODERS[key]
