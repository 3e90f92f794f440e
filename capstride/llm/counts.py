"""Token counts without tokens: Viterbi over Aho-Corasick matches of a unigram vocabulary.

The tokenizer is the tokenizers library's Unigram model with byte fallback over the pieces and scores of a
SentencePiece file, on words split at white space, each with U+2581 in front unless it is there.  Counts need no token list: for each end
of a match the best score so far and its number of pieces are enough.  An automaton finds all pieces that end at a
place, longest first, and only a strictly better score replaces another, so that of equal scores the one whose last
piece starts first wins, as in the library.  A character that is no piece costs the least score less 10 and counts as
its UTF-8 bytes.  Distinct words are solved once for a worker.

Defined cases: null, empty and blank texts have no tokens and score 0; null and repeated doc_ids are rows like others;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_schema, read, text_slices

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
#: Distinct words that a worker remembers; when full, it starts anew.
CACHE_WORDS = 700_000
#: Unicode's White_Space; Python's split() takes U+001C to U+001F as well.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[^{_SPACES}]+")
_ODD = re.compile("[\x1c-\x1f]")


def split_words(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD.search(text) else text.split()


def load_pieces(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces and scores of a SentencePiece file, and the number of its unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Counter:
    """Counts pieces of words."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and not re.search(f"[{_SPACES}]", piece):
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        bytes_there = {f"<0x{i:02X}>" for i in range(256)} <= {p for p, _ in pieces}
        self.fallback = bytes_there
        known = np.array(sorted(ord(p) for p, _ in pieces if len(p) == 1), np.uint32)
        self.single = np.zeros(0x110000, bool)
        self.single[known] = True
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.counts = np.zeros(0, np.int64)
        self.scores = np.zeros(0)

    def solve(self, words: list[str]) -> tuple[list[int], list[float]]:
        """Number of pieces and best score of each word."""
        forms = [w if w[0] == MARK else MARK + w for w in words]
        text = "\n".join(forms)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        missing = ~self.single[codes]
        sizes = np.fromiter(map(len, forms), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        missing[ends[:-1]] = False  # line feeds part the words
        width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4))).tolist()
        lone = np.flatnonzero(missing).tolist()
        lone.append(len(codes) + 1)
        nothing = float("-inf")
        best, count = [nothing] * (len(codes) + 2), [0] * (len(codes) + 2)
        for start in (ends - sizes + 1).tolist():
            best[start] = 0.0
        fused = self.fallback
        last_unknown = [False] * (len(codes) + 2) if not fused else None
        k, p = 0, lone[0]

        def alone(p: int) -> None:
            score = best[p] + self.unknown
            if score > best[p + 1]:
                best[p + 1] = score
                if fused:
                    count[p + 1] = count[p] + width[p]
                else:  # unknown characters in a row are one token
                    count[p + 1] = count[p] + (not last_unknown[p])
                    last_unknown[p + 1] = True

        for end, (size, score) in self.automaton.iter(text):
            end += 1
            while p + 1 < end:
                alone(p)
                k += 1
                p = lone[k]
            start = end - size
            score += best[start]
            if score > best[end]:
                best[end] = score
                count[end] = count[start] + 1
        while k < len(lone) - 1:
            alone(lone[k])
            k += 1
        at = ends.tolist()
        return [count[e] for e in at], [best[e] for e in at]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of pieces and best score of each text."""
        if len(self.index) > CACHE_WORDS:
            self._clear()
        lists = [split_words(t) if t else [] for t in texts]
        index, new, numbers = self.index, [], []
        for words in lists:
            for w in words:
                n = index.get(w)
                if n is None:
                    n = index[w] = len(index)
                    new.append(w)
                numbers.append(n)
        counts, scores = [self.counts], [self.scores]
        for low in range(0, len(new), 20_000):
            c, s = self.solve(new[low : low + 20_000])
            counts.append(np.array(c, np.int64))
            scores.append(np.array(s))
        if new:
            self.counts, self.scores = np.concatenate(counts), np.concatenate(scores)
        k = np.array(numbers, np.int64)
        of = np.repeat(np.arange(len(texts)), [len(w) for w in lists])
        total = np.zeros(len(texts), np.int64)
        np.add.at(total, of, self.counts[k])
        return total, np.bincount(of, self.scores[k], len(texts))


_COUNTERS: dict[str, Counter] = {}
_OUT, _OUT_ARROW = arrow_schema("doc_id long, n_tokens long, score double")


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score) of whole texts by the pieces of the SentencePiece file at `path`."""

    def run(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(load_pieces(path)[0])
        counter = _COUNTERS[path]
        for batch in batches:
            for part in text_slices(batch):
                counts, scores = counter.texts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(scores)], schema=_OUT_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Unigram tokens of each document of `documents`."""
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
