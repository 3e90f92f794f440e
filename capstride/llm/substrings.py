"""Substring dedup by repeated-phrase automata.

A window is WINDOW successive words.  The first document (smallest doc_id) that holds a window keeps it; every word
that such a window covers in a later document goes.

1.  Anchors: of the ANCHOR-word runs of a window, the one with the least hash is its anchor.  Equal windows have equal
    anchors, and neighbouring windows mostly share theirs, so that a fifth of the words is an anchor.  An anchor that
    only one document has can't be part of a repeated window; counting pre-aggregates before the shuffle.
2.  Passages: around each shared anchor, a document's run of windows with that anchor is a passage of at most
    2 * WINDOW - ANCHOR words.  All documents stream to the shards in this form: what is not in a passage can't recur.
    A passage goes to a shard by its anchor.  An anchor that more than HOT_DOCS documents have is split further: its
    passages are cut into single windows, dealt by the whole window.  A window that more than HOT_DOCS documents have is
    salted; all salts get its text once, with its first and last documents.
3.  Automata: a shard confirms by hash which windows several documents have, takes their texts from the first document
    alone, compiles these into Aho-Corasick automata over about AUTOMATON_CHARS of passages, and streams all passages
    through them; only what the automaton finds, word by word, is an occurrence.
4.  The covered words of a document are cut.

Matches are of texts, not of hashes: an anchor's hash only tells where to look.

Defined cases: null and empty texts have no words; a null doc_id is never smaller, and such rows stay whole; rows with
equal doc_ids do not remove each other's words; fewer than WINDOW words have no window; an empty table gives none;
other columns stay, but for those with the names of results, which are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import beside
from .common import arrow_schema, gram_hashes, mix, read, stage, text_bytes, text_slices, word_hashes, word_spans

WINDOW, ANCHOR = 13, 4
#: Documents above which an anchor is dealt to several tasks.
HOT_DOCS = 5_000
#: Characters of the passages of one automaton, which has 100 bytes a character at most.
AUTOMATON_CHARS = 1_000_000


def anchors(hashes: np.ndarray, words: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR):
    """For word hashes and each text's offsets into them: valid windows' starts and the hash of the anchor of each.

    Windows that cross texts are left out.
    """
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = gram_hashes(hashes, anchor)
    best = grams[:n].copy()
    for j in range(1, window - anchor + 1):
        np.minimum(best, grams[j : n + j], out=best)
    text = np.repeat(np.arange(len(words) - 1), np.diff(words))
    starts = np.flatnonzero(text[:n] == text[window - 1 :])
    return starts, best[starts]


def runs(starts: np.ndarray, best: np.ndarray, text: np.ndarray):
    """Group successive windows of one text with one anchor: first window's start, number of windows."""
    new = np.ones(len(starts), bool)
    new[1:] = (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(starts)))


_ANCHORS, _ANCHORS_ARROW = arrow_schema("anchor long, doc_id long, n int")
_PASSAGES, _PASSAGES_ARROW = arrow_schema("anchor long, doc_id long, copy long, start long, passage string")
_COVERED, _COVERED_ARROW = arrow_schema("doc_id long, copy long, low long, high long")


#: No doc_id is this in practice; it stands for null within numpy.
_NONE = np.iinfo(np.int64).min


def _copy(raw: bytes) -> int:
    """Tells rows with equal doc_ids apart."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=3).digest(), "big")


def document_anchors(docs: DataFrame) -> DataFrame:
    """(anchor, doc_id, n): the distinct anchors of each document, pre-aggregated.

    An anchor that several documents of a step have is shared for sure: its documents come with n = 0, and one row with
    their number stands for them.  So however common an anchor is, a step sends one row of it to the anchor's task.
    """

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                ids = part.column("doc_id").cast(pa.int64())
                raw, off = text_bytes(part.column("text"))
                begins, ends, words = word_spans(raw, off)
                starts, best = anchors(word_hashes(raw, begins, ends), words)
                text = np.searchsorted(words, starts, side="right") - 1
                by = np.lexsort((text, best))
                text, best = text[by], best[by]
                new = np.ones(len(by), bool)
                new[1:] = (text[1:] != text[:-1]) | (best[1:] != best[:-1])
                text, best = text[new], best[new]
                first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]])) if len(best) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(best)))
                known = np.repeat(count, count) > 1
                text = np.concatenate([text[first], text[known]])
                best = np.concatenate([best[first], best[known]])
                n = np.concatenate([count, np.zeros(int(known.sum()), np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(best.view(np.int64)), ids.take(pa.array(text)), pa.array(n)], schema=_ANCHORS_ARROW)

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, _ANCHORS)


def shared_anchors(rows: DataFrame, hot: int) -> DataFrame:
    """Of document_anchors(), (anchor, doc_id) of anchors that two documents have; those of more than `hot` also come
    once with a null doc_id and their number of documents.  Partitions stream in the order of anchors."""

    def run(batches):
        held = None  # the last row, whether it has company, and the documents of its anchor so far
        for batch in batches:
            a, d, n = (batch.column(c).to_numpy() for c in ("anchor", "doc_id", "n"))
            sure = n == 0
            out_a, out_d, out_n = [a[sure]], [d[sure]], [n[sure]]
            a, d, n = a[~sure], d[~sure], n[~sure]
            size = n.astype(np.int64)
            if len(a):
                if held is not None:
                    a, d, n = np.concatenate([held[0], a]), np.concatenate([held[1], d]), np.concatenate([held[2], n])
                    size = np.concatenate([held[4], size])
                same = a[1:] == a[:-1]
                keep = np.concatenate([same, [False]]) | np.concatenate([[held is not None and held[3]], same])
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                total = np.add.reduceat(size, first)
                held = (a[-1:], d[-1:], n[-1:], bool(keep[-1]), total[-1:])
                # rows of several documents are among the sure ones
                go = keep[:-1] & (n[:-1] == 1)
                many = total[:-1] > hot
                out_a += [a[:-1][go], a[first[:-1]][many]]
                out_d += [d[:-1][go], np.full(int(many.sum()), _NONE)]
                out_n += [n[:-1][go], total[:-1][many].astype(np.int32)]
            yield emit(out_a, out_d, out_n)
        if held is not None:
            last = int(held[3] and held[2][0] == 1)
            many = held[4] > hot
            yield emit([held[0][:last], held[0][many]], [held[1][:last], np.full(int(many.sum()), _NONE)], [held[2][:last], held[4][many].astype(np.int32)])

    def emit(a, d, n):
        d = np.concatenate(d)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(d, mask=d == _NONE), pa.array(np.concatenate(n))], schema=_ANCHORS_ARROW)

    place = F.when(F.col("n") == 0, F.xxhash64("doc_id")).otherwise(F.col("anchor"))
    return rows.repartition(place).sortWithinPartitions("anchor").mapInArrow(run, _ANCHORS)


def passages(rows: DataFrame) -> DataFrame:
    """Passages of rows (doc_id, text, shared: the text's shared anchors)."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                raw, off = text_bytes(part.column("text"))
                begins, ends, words = word_spans(raw, off)
                starts, best = anchors(word_hashes(raw, begins, ends), words)
                text = np.searchsorted(words, starts, side="right") - 1
                first, count = runs(starts, best, text)
                lists = part.column("shared")
                flat = lists.flatten()
                owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists).fill_null(0)))
                # shared anchors of a text, found by (text, anchor)
                keys = np.empty(len(owner), [("t", np.int64), ("a", np.uint64)])
                keys["t"], keys["a"] = owner, flat.to_numpy(zero_copy_only=False).view(np.uint64)
                keys = keys[np.lexsort((keys["a"], keys["t"]))]
                base = np.searchsorted(keys["t"], np.arange(len(lists) + 1))
                ids = part.column("doc_id").to_pylist()
                data = raw.tobytes()
                out: list[list] = [[], [], [], [], []]
                at, size = starts[first], count
                where, anchor = text[first], best[first]
                for t in range(len(lists)):
                    lo, hi = np.searchsorted(where, (t, t + 1))
                    own = keys["a"][base[t] : base[t + 1]]
                    if lo == hi or not len(own):
                        continue
                    k = np.searchsorted(own, anchor[lo:hi])
                    k[k == len(own)] = 0
                    hit = np.flatnonzero(own[k] == anchor[lo:hi])
                    if not len(hit):
                        continue
                    copy = _copy(data[off[t] : off[t + 1]])
                    for i in hit.tolist():
                        s, n = int(at[lo + i]), int(size[lo + i])
                        last = s + n + WINDOW - 2
                        out[0].append(int(anchor[lo + i].view(np.int64)))
                        out[1].append(ids[t])
                        out[2].append(copy)
                        out[3].append(s - int(words[t]))
                        out[4].append(b" ".join(data[begins[s] : ends[last]].split()))
                if out[0]:
                    columns = [pa.array(c, f.type) for c, f in zip(out[:4], _PASSAGES_ARROW)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(out[4], pa.binary()).cast(pa.string())], schema=_PASSAGES_ARROW)

    return rows.select("doc_id", "text", "shared").mapInArrow(run, _PASSAGES)


class Shard:
    """Passages and their documents, resolved by one automaton.

    The automaton's letters are digits of word numbers, of another range for each digit, so that matches start and end
    at words and a node has few children.
    """

    def __init__(self):
        self.passages: list[str] = []
        self.low: list[int] = []  # smallest and largest doc_id that a row stands for
        self.high: list[int] = []
        self.found: list[tuple[int, int, int] | None] = []  # doc_id, copy, start; none for a row that only tells
        self.size = 0

    def add(self, passage: str, low: int, high: int, occurrence: tuple[int, int, int] | None) -> None:
        self.passages.append(passage)
        self.low.append(low)
        self.high.append(high)
        self.found.append(occurrence)
        self.size += len(passage)

    def covered(self) -> list[np.ndarray]:
        """doc_id, copy, low and high of words that repeated windows cover."""
        import ahocorasick

        lists = pc.split_pattern(pa.array(self.passages, pa.string()), " ")
        off = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
        at = np.arange(len(word) - WINDOW + 1)
        at = at[owner[at] == owner[at + WINDOW - 1]]
        # confirm: windows of several documents, and the first of these
        same, group = np.unique(gram_hashes(mix(word.astype(np.uint64)), WINDOW)[at], return_inverse=True)
        low, high = np.array(self.low, np.int64)[owner[at]], np.array(self.high, np.int64)[owner[at]]
        first, last = np.full(len(same), np.iinfo(np.int64).max), np.full(len(same), _NONE)
        np.minimum.at(first, group, low)
        np.maximum.at(last, group, high)
        phrase = np.flatnonzero((low == first[group]) & (first < last)[group])
        _, once = np.unique(group[phrase], return_index=True)
        phrase = phrase[once]
        if not len(phrase):
            return [np.zeros(0, np.int64)] * 4
        digits = 1
        while 256**digits < len(coded.dictionary):
            digits += 1
        letters = np.stack([256 * d + 1 + (word >> 8 * d & 255) for d in range(digits)], 1)
        text = letters.astype("<u4").tobytes().decode("utf-32-le")
        automaton = ahocorasick.Automaton()
        for i, of in zip(at[phrase].tolist(), first[group[phrase]].tolist()):
            automaton.add_word(text[i * digits : (i + WINDOW) * digits], of)
        automaton.make_automaton()
        hits = np.array(list(automaton.iter(text)), np.int64).reshape(-1, 2)
        del automaton
        start, of = (hits[:, 0] + 1) // digits - WINDOW, hits[:, 1]
        told = np.array([f is not None for f in self.found])
        doc, copy, begin = np.array([f or (_NONE, 0, 0) for f in self.found], np.int64).T
        row = owner[start]
        ok = (row == owner[start + WINDOW - 1]) & told[row] & (of < doc[row])
        start, row = start[ok], row[ok]
        if not len(row):
            return [np.zeros(0, np.int64)] * 4
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + WINDOW)
        opens = np.flatnonzero(new)
        ends = start[np.append(opens[1:], len(row)) - 1] + WINDOW
        own = row[opens]
        place = begin[own] - off[own]
        return [doc[own], copy[own], start[opens] + place, ends + place]


def single_windows(rows: DataFrame) -> DataFrame:
    """Passages cut into windows, whose hash takes the anchor's place."""

    def run(batches):
        for batch in batches:
            lists = pc.split_pattern(batch.column("passage"), " ")
            ids, copies, starts = (batch.column(c).to_pylist() for c in ("doc_id", "copy", "start"))
            out: list[list] = [[], [], [], []]
            for words, d, c, start in zip(lists.to_pylist(), ids, copies, starts):
                for i in range(len(words) - WINDOW + 1):
                    for column, value in zip(out, (d, c, start + i, " ".join(words[i : i + WINDOW]))):
                        column.append(value)
            if out[0]:
                texts = pa.array(out[3], pa.string())
                raw, off = text_bytes(texts)
                key = word_hashes(raw, off[:-1], off[1:])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[pa.array(x, pa.int64()) for x in out[:3]], texts], schema=_PASSAGES_ARROW)

    return rows.select("anchor", "doc_id", "copy", "start", "passage").mapInArrow(run, _PASSAGES)


def locate(found: DataFrame) -> DataFrame:
    """Covered words of all passages (..., salts): (doc_id, copy, low, high)."""
    texts = found.where("salts > 1").groupBy("anchor", "passage").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.first("salts").alias("salts"))
    phrases = texts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    phrases = phrases.select("anchor", "salt", "passage", "doc_id", "last", F.lit(None).cast("long").alias("copy"), F.lit(None).cast("long").alias("start"))
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("salts"))).otherwise(0).cast("int")
    seen = found.select("anchor", salt.alias("salt"), "passage", "doc_id", F.col("doc_id").alias("last"), "copy", "start")

    def run(batches):
        shard, last = Shard(), None
        for batch in batches:
            for anchor, salt, passage, doc_id, last_id, copy, start in zip(*(c.to_pylist() for c in batch.columns)):
                if (anchor, salt) != last:
                    if shard.size >= AUTOMATON_CHARS:
                        yield out(shard)
                        shard = Shard()
                    last = (anchor, salt)
                shard.add(passage, doc_id, last_id, None if start is None else (doc_id, copy, start))
        if shard.size:
            yield out(shard)

    def out(shard: Shard) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in shard.covered()], schema=_COVERED_ARROW)

    by = seen.unionByName(phrases).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return by.mapInArrow(run, _COVERED)


_CUT = "struct<n_words: long, n_removed: long, kept: string>"
_CUT_ARROW = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Count the words of each text and join those that no span covers by blanks."""
    out = []
    raw, off = text_bytes(texts)
    data = raw.tobytes()
    for i, by in enumerate(spans.to_pylist()):
        text = data[off[i] : off[i + 1]]
        words = text.split()
        kept = words
        if by:
            copy, keep = _copy(text), np.ones(len(words), bool)
            for s in by:
                if s["copy"] == copy:
                    keep[s["low"] : s["high"]] = False
            kept = [words[k] for k in np.flatnonzero(keep).tolist()]
        out.append({"n_words": len(words), "n_removed": len(words) - len(kept), "kept": b" ".join(kept).decode("utf-8", "surrogatepass")})
    return pa.array(out, _CUT_ARROW)


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, n_removed and kept: the words that stay, joined by blanks."""
    docs = docs.drop("n_words", "n_removed", "kept")
    shared = stage(shared_anchors(document_anchors(docs), HOT_DOCS), "anchors")
    lists = shared.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"))
    found = stage(passages(docs.select("doc_id", "text").join(lists, "doc_id")), "passages")
    hot = shared.where("doc_id is null").select("anchor", F.lit(1).alias("hot")).distinct()
    found = beside(found, hot, "anchor", "left")
    windows = stage(single_windows(found.where("hot = 1")), "windows")
    many = windows.groupBy("anchor").agg(F.ceil(F.count("*") / HOT_DOCS).cast("int").alias("salts")).where("salts > 1")
    windows = beside(windows, many, "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    found = found.where("hot is null").drop("hot").withColumn("salts", F.lit(1)).unionByName(windows)
    spans = locate(found).groupBy("doc_id").agg(F.collect_list(F.struct("copy", "low", "high")).alias("__spans"))
    cut = docs.join(spans, "doc_id", "left").withColumn("__cut", F.arrow_udf(_cut, _CUT)("text", "__spans"))
    return cut.select(*[F.col(c) for c in docs.columns], "__cut.n_words", "__cut.n_removed", "__cut.kept")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What 13-word windows of earlier documents leave of each document."""
    cut = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM p WHERE i + 12 <= len(w)),
f AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN f USING (s) WHERE first < doc_id),
k AS (SELECT p.doc_id, count(cov.i)::BIGINT AS n_removed, string_agg(w[p.i], ' ' ORDER BY p.i) FILTER (cov.i IS NULL) AS kept
  FROM p LEFT JOIN cov ON cov.doc_id = p.doc_id AND cov.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
